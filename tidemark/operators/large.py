"""The window operators for groups too large for a task: running totals, ranks, quantiles and indicators of one long series.

Rows are put in order by ranges that Spark samples, and stored with their range, so that what is
counted once holds for whatever reads them next.  A group then lies in as many tasks as it has
ranges or blocks; only one summary for each of these meets in a task of its own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.config import DEFAULT, Settings
from tidemark.functions.stats import complete, ratio
from tidemark.sources.files import new_path


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _ranges(df: DataFrame, partitions: int | None) -> int:
    spark = df.sparkSession
    return partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def running_total(rows: DataFrame, key: str, order: str, weight: Column | None = None, partitions: int | None = None) -> DataFrame:
    """`rows`, stored, with `total`: the sum of `weight` (1 by default) over the rows of the same key up to and with this one.

    Rows without a key or an order are left out; rows of equal order follow one another in no particular order.
    """
    known = rows.where(F.col(key).isNotNull() & F.col(order).isNotNull()).withColumn("weight", F.lit(1).cast("long") if weight is None else weight)
    ranged = _stored(known.repartitionByRange(_ranges(rows, partitions), key, order).withColumn("range", F.spark_partition_id()), "ranges")
    lower = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(key, "range").agg(F.sum("weight").alias("sum")).withColumn("below", F.coalesce(F.sum("sum").over(lower), F.lit(0).cast("long"))).drop("sum")
    own = F.sum("weight").over(Window.partitionBy(key, "range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.join(sums, [key, "range"]).withColumn("total", F.col("below") + own).drop("below", "range", "weight")


def ranks(rows: DataFrame, key: str = "asset", value: str = "ret", partitions: int | None = None) -> DataFrame:
    """`rows` with `value` replaced by its average rank within the key, as `correlation.ranks` does.

    Equal values are ranked once, with their number, and the ranks go back to the rows by key and value.
    Rows without a key are left out; a NULL value has no rank and counts for none.
    """
    rows = _stored(rows, "ranked-rows")
    values = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    placed = running_total(values, key, value, F.col("n"), partitions)
    placed = placed.select(F.col(key).alias("of_key"), F.col(value).alias("of_value"), (F.col("total") - (F.col("n") - 1) / F.lit(2.0)).alias("rank"))
    joined = rows.where(F.col(key).isNotNull()).join(placed, (F.col(key) == F.col("of_key")) & (F.col(value) == F.col("of_value")), "left")
    return joined.select(*(F.col("rank").alias(c) if c == value else F.col(c) for c in rows.columns))


def quantiles(rows: DataFrame, key: str, value: str, probabilities: Sequence[float], bins: int = 1024) -> DataFrame:
    """(key, probability, quantile), to the last bit what `percentile` gives, without holding a group's values.

    An order statistic lies in one bin of a histogram between its bounds; the next pass divides the
    values of that bin alone, and the search ends when they are all equal, after few passes even for
    values that differ in their last bits.  A pass sends at most `bins` counts for each
    statistic and task.  NULL values count for nothing; values must be finite, and rows without a key are left out.
    """
    rows = _stored(rows.select(F.col(key).alias("key"), F.col(value).cast("double").alias("v")).where("key is not null and v is not null"), "quantile-rows")
    if rows.where("isnan(v) or abs(v) = double('inf')").limit(1).count():
        raise ValueError(f"{value} holds values that are not finite")
    spans = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    wanted = F.explode(F.array(*(F.struct(F.lit(float(p)).alias("p"), F.lit(up).alias("up")) for p in probabilities for up in (False, True)))).alias("w")
    position = F.col("w.p") * (F.col("n") - 1)
    place = F.when(F.col("w.up"), F.ceil(position)).otherwise(F.floor(position)).cast("long")
    kind = "key, p, up, position, place, below, low, high"
    open_ = spans.select("key", "n", "low", "high", wanted).select("key", "w.p", "w.up", position.alias("position"), place.alias("place"), F.lit(0).cast("long").alias("below"), "low", "high")
    open_, done = _stored(open_, "quantile-bounds"), []
    while True:
        done.append(open_.where("low = high"))
        open_ = open_.where("low < high")
        if open_.isEmpty():
            break
        # halves keep the span of the largest values finite; the bin never decreases as v grows
        share = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        held = rows.join(open_.withColumnRenamed("key", "of"), F.col("key") == F.col("of")).where("v between low and high").withColumn("bin", F.least(F.floor(share * bins), F.lit(bins - 1)))
        counted = held.groupBy("key", "p", "up", "position", "place", "below", "bin").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        w = Window.partitionBy("key", "p", "up").orderBy("bin")
        counted = counted.withColumn("through", F.col("below") + F.sum("n").over(w)).where("place < through and place >= through - n")
        open_ = _stored(counted.withColumn("below", F.col("through") - F.col("n")).selectExpr(*kind.split(", ")), "quantile-bounds")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    pair = found.groupBy("key", "p").agg(F.first("position").alias("at"), F.max(F.when(~F.col("up"), F.col("low"))).alias("lower"), F.max(F.when(F.col("up"), F.col("low"))).alias("upper"))
    between = (F.ceil("at") - F.col("at")) * F.col("lower") + (F.col("at") - F.floor("at")) * F.col("upper")
    exact = F.when((F.floor("at") == F.ceil("at")) | (F.col("lower") == F.col("upper")), F.col("lower")).otherwise(between)
    return pair.select(F.col("key").alias(key), F.col("p").alias("probability"), exact.alias("quantile"))


def _carried(blocks: pd.DataFrame) -> pd.DataFrame:
    """What each block of a symbol starts with: the high, and the smoothed gain and loss, of all blocks before."""
    blocks = blocks.sort_values("block")
    high, gain, loss, out = None, 0.0, 0.0, []
    for b in blocks.itertuples():
        out.append((b.symbol, b.block, high, gain, loss))
        high = b.high if high is None else max(high, b.high)
        gain, loss = gain * b.fade + b.gain, loss * b.fade + b.loss
    return pd.DataFrame(out, columns=["symbol", "block", "high_before", "gain_before", "loss_before"])


def indicators(bars: DataFrame, s: Settings = DEFAULT, block_rows: int = 4096, partitions: int | None = None) -> DataFrame:
    """(symbol, day, price, ret, drawdown, rolling_vol, rsi) as the operators of `risk` and `cycles` give them, one symbol over many tasks.

    Rows are numbered and cut into blocks.  A block holds copies of the rows before it that its
    windows reach; running maxima and smoothed means go on from summaries of the blocks before.
    Rows without a symbol, day or price are left out.
    """
    n = s.rsi_window
    q = (n - 1) / n
    halo = max(s.vol_window, 1)
    # powers of q within a block must stay within a double
    size = max(halo, block_rows if q == 0 else min(block_rows, int(600 / -math.log(q))))
    rows = running_total(bars.select("symbol", "day", "price").where("price is not null"), "symbol", "day", None, partitions).withColumnRenamed("total", "k")
    block, at = F.floor((F.col("k") - 1) / size), (F.col("k") - 1) % size
    both = F.when(at >= size - halo, F.array(block, block + 1)).otherwise(F.array(block))
    rows = rows.withColumn("home", block).withColumn("j", at).withColumn("block", F.explode(both)).withColumn("own", F.col("home") == F.col("block"))
    w = Window.partitionBy("symbol", "block").orderBy("k")
    rows = rows.withColumn("before", F.lag("price").over(w)).withColumn("ret", ratio(F.col("price"), F.col("before")) - 1)
    vol = complete(F.stddev_samp("ret"), F.col("ret"), s.vol_window, w.rowsBetween(-(s.vol_window - 1), 0)) * F.sqrt(F.lit(s.periods))
    rows = rows.withColumn("rolling_vol", vol).where("own")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    change = F.col("price") - F.col("before")
    weight = F.when(F.col("k") == 2, F.lit(1.0)).otherwise(F.lit(1 / n))  # the first change starts the means
    for name, x in (("gain", F.greatest(change, F.lit(0.0))), ("loss", F.greatest(-change, F.lit(0.0)))):
        x = F.coalesce(x, F.lit(0.0)) * weight
        rows = rows.withColumn(name, (F.pow(F.lit(q), F.col("j")) * F.sum(x * F.pow(F.lit(q), -F.col("j"))).over(so_far)) if q else x)
    rows = _stored(rows.withColumn("high", F.max("price").over(so_far)).drop("home", "own", "before"), "indicator-blocks")
    last = F.struct("k", "gain", "loss", "j")
    ends = rows.groupBy("symbol", "block").agg(F.max("high").alias("high"), F.max(last).alias("last"))
    ends = ends.select("symbol", "block", "high", "last.gain", "last.loss", F.pow(F.lit(q), F.col("last.j") + 1).alias("fade"))
    carried = ends.groupBy("symbol").applyInPandas(_carried, "symbol string, block long, high_before double, gain_before double, loss_before double")  # a row for each block
    rows = rows.join(carried, ["symbol", "block"])
    gain, loss = (F.col(c) + F.col(f"{c}_before") * F.pow(F.lit(q), F.col("j") + 1) for c in ("gain", "loss"))
    strength = F.when(loss > 0, 100 - 100 / (1 + ratio(gain, loss))).when(gain > 0, 100.0).otherwise(50.0)
    high = F.greatest("high", "high_before")
    return rows.select("symbol", "day", "price", "ret", (ratio(F.col("price"), high) - 1).alias("drawdown"), "rolling_vol", F.when(F.col("k") > n, strength).alias("rsi"))
