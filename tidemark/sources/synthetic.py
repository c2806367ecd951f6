"""Simulated feeds: seeded numpy shocks on the driver (a few hundred rows a symbol), series built in Spark.

The last day is a parameter, so a result does not depend on when it is made.
"""

from __future__ import annotations

import datetime as dt
import math
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.config import RATE_ASSETS
from tidemark.functions.stats import clip, ratio, so_far, trailing

#: Latest level, yearly drift and volatility, and loading on the factor of each asset (fixed values).
CRYPTO = {
    "BTC": (95_000, 0.12, 0.45, 0.90),
    "ETH": (3_400, 0.10, 0.55, 0.92),
    "SOL": (180, 0.15, 0.80, 0.85),
    "BNB": (620, 0.08, 0.48, 0.80),
    "XRP": (2.20, 0.06, 0.68, 0.72),
    "ADA": (0.85, 0.05, 0.72, 0.78),
}
MACRO = {
    "S&P 500": (6_100, 0.10, 0.15, 0.90),
    "Gold": (3_300, 0.08, 0.13, 0.05),
    "US Dollar Index": (103, 0.0, 0.07, -0.35),
    "US 10Y Yield": (4.1, 0.0, 0.20, 0.25),
    "Crude Oil": (78, 0.05, 0.35, 0.45),
}
DEFAULT_PROFILE = (100, 0.3, 0.8, 0.8)
EQUITY_CORRELATION = 0.35
BASE_SEED = 20260808


def seed(name: str, salt: int = 0) -> int:
    return (zlib.crc32(name.encode()) + BASE_SEED + salt) % 2**32


def spine(spark: SparkSession, end: dt.date, days: int) -> DataFrame:
    """(day, i) of the `days` days that end on `end`."""
    low = F.lit(end - dt.timedelta(days=days - 1))
    return spark.range(days).select(F.date_add(low, F.col("id").cast("int")).alias("day"), F.col("id").alias("i"))


def factors(days: int) -> tuple[np.ndarray, np.ndarray]:
    """Shocks of the equity and the crypto factor, of unit variance and correlation 0.35."""
    rng = np.random.default_rng(seed("factors"))
    equity, own = rng.standard_normal(days), rng.standard_normal(days)
    return equity, EQUITY_CORRELATION * equity + math.sqrt(1 - EQUITY_CORRELATION**2) * own


def _shocks(spark: SparkSession, columns: dict[str, np.ndarray], **keys) -> DataFrame:
    n = len(next(iter(columns.values())))
    rows = [(i, *(float(c[i]) for c in columns.values())) for i in range(n)]
    out = spark.createDataFrame(rows, ", ".join(["i long", *(f"{c} double" for c in columns)]))
    for k, v in keys.items():
        out = out.withColumn(k, F.lit(v))
    return out


def _paths(spark: SparkSession, end: dt.date, days: int, profiles: dict, factor: np.ndarray, extra=None) -> DataFrame:
    """(symbol, day, price, …): geometric paths that load on the factor and end at the latest level."""
    table = None
    for name, (latest, drift, vol, load) in profiles.items():
        rng = np.random.default_rng(seed(name))
        shock = load * factor + math.sqrt(max(0.0, 1 - load * load)) * rng.standard_normal(days)
        columns = {"step": (drift - vol * vol / 2) / 365 + vol / math.sqrt(365) * shock} | (extra(name) if extra else {})
        own = _shocks(spark, columns, symbol=name, latest=float(latest))
        table = own if table is None else table.unionByName(own)
    rows = table.join(spine(spark, end, days), "i")
    level = F.sum("step").over(so_far("symbol"))
    rows = rows.withColumn("level", level)
    last = F.last("level").over(Window.partitionBy("symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("price", F.col("latest") * F.exp(F.col("level") - last))


def crypto_bars(spark: SparkSession, end: dt.date, days: int, symbols: list[str] | None = None) -> DataFrame:
    """bars; a symbol without a profile gets a default one."""
    profiles = {s: CRYPTO.get(s, DEFAULT_PROFILE) for s in symbols or CRYPTO}

    def extra(name: str) -> dict[str, np.ndarray]:
        rng = np.random.default_rng(seed(name, 1))
        return {"noise": rng.lognormal(0, 0.3, days), "supply": np.full(days, rng.uniform(1.7e7, 2e7))}

    rows = _paths(spark, end, days, profiles, factors(days)[1], extra)
    before = F.lag("price").over(Window.partitionBy("symbol").orderBy("day"))
    move = F.coalesce(F.abs(ratio(F.col("price") - before, F.col("price"))), F.lit(0.0))
    return rows.select("symbol", "day", "price", (1e6 * F.col("latest") * (1 + 6 * move) * F.col("noise")).alias("volume"), (F.col("price") * F.col("supply")).alias("market_cap"))


def macro_levels(spark: SparkSession, end: dt.date, days: int, rates: frozenset[str] = RATE_ASSETS) -> DataFrame:
    """macro on weekdays; the paths run over all days."""
    rows = _paths(spark, end, days, MACRO, factors(days)[0])
    return rows.where(F.weekday("day") < 5).select(F.col("symbol").alias("asset"), "day", F.col("price").alias("level"), F.col("symbol").isin(*rates).alias("is_rate"))


def label(value: Column) -> Column:
    """The band of a sentiment value: right-closed steps at 25, 45, 55 and 75."""
    return F.when(value <= 25, "Extreme Fear").when(value <= 45, "Fear").when(value <= 55, "Neutral").when(value <= 75, "Greed").when(value <= 100, "Extreme Greed")


def sentiment(spark: SparkSession, end: dt.date, days: int) -> DataFrame:
    """(day, fng_value, fng_label): a smoothed factor with noise; the label is that of the value before rounding."""
    noise = np.random.default_rng(seed("fear_greed")).normal(0, 3, days)
    rows = _shocks(spark, {"f": factors(days)[1], "noise": noise}, symbol="fng").join(spine(spark, end, days), "i")
    value = clip(F.avg("f").over(trailing(14, "symbol")) * 40 + 50 + F.col("noise"), 5.0, 95.0)
    return rows.withColumn("raw", value).select("day", F.bround("raw", 0).alias("fng_value"), label(F.col("raw")).alias("fng_label"))


def onchain(spark: SparkSession, end: dt.date, days: int) -> DataFrame:
    """(day, tx_count, active_addresses): random walks kept within bounds."""
    rng = np.random.default_rng(seed("onchain"))
    rows = _shocks(spark, {"a": rng.normal(0, 4_000, days), "b": rng.normal(0, 8_000, days)}, symbol="chain").join(spine(spark, end, days), "i")
    w = so_far("symbol")
    tx, addresses = clip(F.sum("a").over(w) + 300_000, 200_000.0, 500_000.0), clip(F.sum("b").over(w) + 800_000, 500_000.0, 1_200_000.0)
    return rows.select("day", F.bround(tx, 0).alias("tx_count"), F.bround(addresses, 0).alias("active_addresses"))
