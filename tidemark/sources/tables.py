"""Series derived from tables of orders, line items and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _mean(amount: str) -> Column:
    """The mean of amounts of two places, summed exactly, so that every engine gets the same double."""
    return F.sum(F.col(amount).cast("decimal(18,2)")).cast("double") / F.count("*")


def bars_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bars(symbol, day, price, volume, market_cap): one symbol for each order priority."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("day"), "o_totalprice")
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return rows.groupBy("symbol", "day").agg(_mean("o_totalprice").alias("price"), total.alias("volume"), F.lit(None).cast("double").alias("market_cap"))


def macro_lineitem(spark: SparkSession, sf_dir: str, rate: str = "R") -> DataFrame:
    """macro(asset, day, level, is_rate) on weekdays: one asset for each return flag, one of them quoted as a rate."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("asset"), F.to_date("l_shipdate").alias("day"), "l_extendedprice")
    return rows.where(F.weekday("day") < 5).groupBy("asset", "day").agg(_mean("l_extendedprice").alias("level")).withColumn("is_rate", F.col("asset") == rate)


def ticks_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticks(symbol, ts, id, price)."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("id"), F.col("value").alias("price"))


def daily_last(ticks: DataFrame) -> DataFrame:
    """(symbol, day, price): the last known price of each day, ties by id; days without one are left out."""
    known = ticks.where(F.col("price").isNotNull() & ~F.isnan("price"))
    return known.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.max_by("price", F.struct("ts", "id")).alias("price"))


def sentiment_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, fng_value) from the daily mean of event values, kept within 0 and 100."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.to_date("ts").alias("day"), "value")
    return rows.groupBy("day").agg(F.least(F.greatest(_mean("value"), F.lit(0.0)), F.lit(100.0)).alias("fng_value"))


def recent(bars: DataFrame, days: int) -> DataFrame:
    """The rows of the last `days` calendar days of the table."""
    last = bars.agg(F.max("day").alias("last"))
    return bars.join(F.broadcast(last)).where(F.col("day") > F.date_sub("last", days)).drop("last")  # one row
