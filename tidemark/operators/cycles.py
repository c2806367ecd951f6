"""Market-cycle labels: moving averages, Wilder's RSI, drawdown and the rule chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.config import DEFAULT, Settings
from tidemark.functions.stats import by_day, dash, ratio, so_far

#: Rows over which the recursive mean is summed in closed form; weights of older rows vanish in a double.
_BLOCK = 1000


def moving_averages(bars: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(symbol, day, price, sma_short, sma_long, ma_short, ma_long), windows by each symbol's number of rows.

    Frames are literals but windows differ by symbol, so rows are placed at their number over
    the symbol's window and a frame covers the places less than 1 before: the rows of one window.
    """
    rows = bars.select("symbol", "day", "price").withColumn("n", F.count("*").over(Window.partitionBy("symbol"))).withColumn("k", F.row_number().over(by_day("symbol")))
    short, long_ = ma_lengths(F.col("n"), s)
    rows = rows.withColumn("ma_short", short).withColumn("ma_long", long_)
    below_one = 1 - 1 / (2 * max(s.ma_long, s.ma_short, s.full_history, 20))
    for name in ("short", "long"):
        rows = rows.withColumn("place", F.col("k") / F.col(f"ma_{name}"))
        frame = f"OVER (PARTITION BY symbol ORDER BY place RANGE BETWEEN {below_one!r}D PRECEDING AND CURRENT ROW)"
        rows = rows.withColumn(f"sma_{name}", F.when(F.expr(f"count(price) {frame}") == F.col(f"ma_{name}"), F.expr(f"avg(price) {frame}")))
    return rows.select("symbol", "day", "price", "sma_short", "sma_long", "ma_short", "ma_long")


def ma_lengths(n: Column, s: Settings = DEFAULT) -> tuple[Column, Column]:
    """`ma_windows` for a column."""
    full, part = n >= s.full_history, F.greatest(F.lit(20), F.floor(n / 3))
    long_ = F.when(full, s.ma_long).otherwise(part)
    return F.when(full, s.ma_short).otherwise(F.greatest(F.lit(5), F.floor(part / 4))).cast("int"), long_.cast("int")


def rsi(bars: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(symbol, day, rsi): gains and losses smoothed recursively by 1/n from the first change on.

    NULL until n changes are known; 100 without losses, 50 without any change.  Prices
    must not be NULL.  The smoothing y = y' + (x - y')/n is summed in closed form within
    blocks of rows, each with the end of the block before it.
    """
    n = s.rsi_window
    q = F.lit((n - 1) / n)
    w, block = by_day("symbol"), Window.partitionBy("symbol", "block").orderBy("day")
    change = F.col("price") - F.lag("price").over(w)
    rows = bars.select("symbol", "day", "price").withColumn("change", change)
    rows = rows.withColumn("k", F.count("change").over(so_far("symbol"))).withColumn("block", F.when(F.col("k") > 0, F.expr(f"(k - 1) div {_BLOCK}"))).withColumn("j", (F.col("k") - 1) % _BLOCK)
    for name, x in (("gain", F.greatest("change", F.lit(0.0))), ("loss", F.greatest(-F.col("change"), F.lit(0.0)))):
        x = F.when(F.col("change").isNotNull(), x) * F.when(F.col("k") == 1, F.lit(1.0)).otherwise(F.lit(1 / n))
        own = F.pow(q, F.col("j")) * F.sum(x * F.pow(q, -F.col("j"))).over(block.rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("own", own).withColumn("before", F.lag("own").over(w))
        before = F.first("before").over(block)  # the end of the block before
        rows = rows.withColumn(name, F.col("own") + F.coalesce(F.when(F.col("block") > 0, before), F.lit(0.0)) * F.pow(q, F.col("j") + 1))
    value = F.when(F.col("loss") > 0, 100 - 100 / (1 + ratio(F.col("gain"), F.col("loss")))).when(F.col("gain") > 0, 100.0).otherwise(50.0)
    return rows.select("symbol", "day", F.when(F.col("k") >= n, value).alias("rsi"))


def phase(price: Column, short: Column, long_: Column, strength: Column, drawdown: Column, s: Settings = DEFAULT, strict_sideways: bool = False) -> Column:
    """The first rule that holds; with `strict_sideways` the basing rule leaves uptrends alone."""
    up, down, near = (price > short) & (short > long_), (price < short) & (short < long_), drawdown > s.near_high
    basing = (drawdown < s.basing) & (strength < 50)
    if strict_sideways:
        basing &= ~up
    return (
        F.when(long_.isNull() | strength.isNull(), "Undetermined")
        .when(up & (strength >= s.rsi_strong), "Markup (Bull)")
        .when(up & (strength < s.rsi_strong) & near, "Distribution")
        .when(down & (strength <= s.rsi_weak) & (drawdown < s.deep), "Markdown (Bear)")
        .when(down & (strength > s.rsi_weak) & (drawdown < s.deep), "Accumulation")
        .when(down, "Markdown (Bear)")
        .when(basing, "Accumulation")
        .when(near & (strength > s.rsi_strong), "Distribution")
        .otherwise("Transition")
    )


def phase_series(bars: DataFrame, s: Settings = DEFAULT, strict_sideways: bool = False) -> DataFrame:
    """(symbol, day, price, sma_short, sma_long, ma_short, ma_long, rsi, drawdown, phase)."""
    rows = moving_averages(bars, s).join(rsi(bars, s), ["symbol", "day"])
    rows = rows.withColumn("drawdown", ratio(F.col("price"), F.max("price").over(so_far("symbol"))) - 1)
    return rows.withColumn("phase", phase(*(F.col(c) for c in ("price", "sma_short", "sma_long", "rsi", "drawdown")), s, strict_sideways))


def phase_distribution(bars: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(symbol, phase, days), each symbol's most frequent phase first."""
    return phase_series(bars, s).groupBy("symbol", "phase").agg(F.count("*").alias("days")).orderBy("symbol", F.desc("days"), "phase")


def current_phase(bars: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """The last row of each symbol with its trend, the price against the long average only."""
    rows = phase_series(bars, s)
    last = rows.groupBy("symbol").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "symbol")), "day").alias("r"))
    trend = F.when(F.col("r.sma_long").isNull(), "n/a").when(F.col("r.price") > F.col("r.sma_long"), "Up").otherwise("Down")
    return last.select(
        "symbol", "r.phase", "r.rsi", (ratio(F.col("r.price"), F.col("r.sma_long")) - 1).alias("price_vs_ma_long"), F.col("r.drawdown").alias("drawdown_from_high"),
        trend.alias("trend"), "r.ma_short", "r.ma_long",
    )


def cycle_table(bars: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """The current phases as display text; ma_long says which average the price is held against."""
    rows = current_phase(bars, s)
    return rows.select("symbol", "phase", dash(F.col("rsi"), "%.0f").alias("rsi"), dash(100 * F.col("price_vs_ma_long"), "%+.1f%%").alias("price_vs_ma_long"), dash(100 * F.col("drawdown_from_high"), "%.1f%%").alias("drawdown"), "trend", "ma_long")
