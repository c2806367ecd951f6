"""Operators for groups larger than a task, against the plain windows."""

import datetime
import math
import random

import pytest
from pyspark.sql import Window, functions as F

from tidemark.operators import correlation, cycles, large, risk

DAY = datetime.date(1990, 1, 1)


@pytest.fixture(scope="module")
def series(spark, tmp_path_factory):
    r = random.Random(6)
    rows = []
    for symbol, n in (("hot", 5000), ("cold", 40), ("one", 1), ("flat", 100)):
        p = 100.0
        for i in range(n):
            p = p if symbol == "flat" else max(0.5, p * (1 + r.gauss(0, 0.02)))
            rows.append((symbol, DAY + datetime.timedelta(days=i + i // 7), round(p, 2)))
    at = str(tmp_path_factory.mktemp("series") / "s")
    spark.createDataFrame(rows, "symbol string, day date, price double").repartition(5).write.parquet(at)
    return spark.read.parquet(at)


def test_running_totals_spread_one_key_over_ranges(spark, series):
    got = large.running_total(series, "symbol", "day", partitions=8)
    w = Window.partitionBy("symbol").orderBy("day")
    assert got.exceptAll(series.withColumn("total", F.row_number().over(w).cast("long"))).count() == 0 and got.count() == series.count()
    weighted = large.running_total(series.withColumn("n", F.lit(3)), "symbol", "day", F.col("n").cast("long"), 4)
    assert weighted.groupBy("symbol").agg(F.max("total")).where("symbol = 'hot'").first()[1] == 15000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(symbol" in plan and "range" in plan.split("hashpartitioning(symbol", 1)[1]
    ranges = large._stored(series.repartitionByRange(8, "symbol", "day").withColumn("range", F.spark_partition_id()), "t").where("symbol = 'hot'").groupBy("range").count().collect()
    assert len(ranges) >= 7 and max(r["count"] for r in ranges) < 3 * 5000 / 8  # the hot symbol lies in all of them


@pytest.mark.parametrize("partitions", [1, 7, None])
def test_ranks_equal_the_window(spark, series, partitions):
    values = series.select(F.col("symbol").alias("asset"), "day", F.round("price", 0).alias("ret"))
    got = large.ranks(values.unionByName(spark.createDataFrame([("hot", DAY, None), (None, DAY, 1.0), ("zero", DAY, 0.0), ("zero", DAY, -0.0)], "asset string, day date, ret double")), partitions=partitions)
    assert got.where("asset = 'zero'").select("ret").collect() == [(1.5,), (1.5,)] and got.where("ret is null").count() == 1
    got, want = got.where("asset <> 'zero' and ret is not null"), correlation.ranks(values)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    assert large.ranks(values.where("false")).count() == 0


@pytest.mark.parametrize("bins", [2, 1024])
def test_quantiles_equal_percentile_to_the_last_bit(spark, series, bins):
    r = random.Random(3)
    odd = [("near", 1 + i * math.ulp(1.0)) for i in range(50)] + [("huge", r.choice((-1, 1)) * 1.7e308 * r.random()) for _ in range(30)] + [("tail", math.exp(r.uniform(-300, 300))) for _ in range(60)]
    odd += [("ties", float(r.randint(0, 2))) for _ in range(90)] + [("ties", None), ("none", None), ("single", 7.25), (None, 1.0), ("two", 0.1), ("two", 0.3), ("zero", 0.0), ("zero", -0.0)]
    rows = series.select("symbol", "price").union(spark.createDataFrame(odd, "symbol string, price double"))
    p = [0.0, 0.01, 1 - 0.95, 0.33, 0.5, 0.66, 0.9, 1.0]
    got = {(x.symbol, x.probability): x.quantile for x in large.quantiles(rows, "symbol", "price", p, bins).collect()}
    want = rows.where("symbol is not null and price is not null").groupBy("symbol").agg(*(F.percentile("price", F.lit(x)).alias(str(x)) for x in p)).collect()
    assert len(got) == len(want) * len(p) and not any(k[0] == "none" for k in got)
    for row in want:
        for x in p:
            assert got[row.symbol, x] == row[str(x)], (row.symbol, x)


def test_quantiles_refuse_values_without_an_order(spark):
    with pytest.raises(ValueError):
        large.quantiles(spark.createDataFrame([("a", float("nan"))], "k string, v double"), "k", "v", [0.5])
    assert large.quantiles(spark.createDataFrame([], "k string, v double"), "k", "v", [0.5]).count() == 0


@pytest.mark.parametrize("block_rows, partitions", [(64, 5), (4096, None), (1, 3)])
def test_indicators_of_blocks_equal_the_windows(spark, series, block_rows, partitions):
    got = {(r.symbol, r.day): r for r in large.indicators(series, block_rows=block_rows, partitions=partitions).collect()}
    want = risk.indicators(series).join(cycles.rsi(series), ["symbol", "day"]).collect()
    assert len(got) == len(want) == 5141
    for r in want:
        mine = got[r.symbol, r.day]
        assert (mine.price, mine.ret, mine.drawdown) == (r.price, r.ret, r.drawdown)
        for a, b in ((mine.rolling_vol, r.rolling_vol), (mine.rsi, r.rsi)):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, abs=1e-9)), r
    assert large.indicators(series.where("false")).count() == 0
