"""Risk metrics per symbol, from one pass over the bars partitioned by symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.config import DEFAULT, Settings
from tidemark.functions.stats import complete, dash, ratio, so_far, trailing
from tidemark.operators.returns import with_returns


def indicators(bars: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(symbol, day, price, ret, drawdown, rolling_vol): the columns the other metrics share."""
    rows = with_returns(bars.select("symbol", "day", "price"))
    drawdown = ratio(F.col("price"), F.max("price").over(so_far("symbol"))) - 1
    vol = complete(F.stddev_samp("ret"), F.col("ret"), s.vol_window, trailing(s.vol_window, "symbol"))
    return rows.withColumn("drawdown", drawdown).withColumn("rolling_vol", vol * F.sqrt(F.lit(s.periods)))


def rolling_volatility(bars: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    return indicators(bars, s).where("rolling_vol is not null").select("symbol", "day", "rolling_vol")


def drawdown_series(bars: DataFrame) -> DataFrame:
    return indicators(bars).select("symbol", "day", "drawdown")


def risk_profile(bars: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """One row per symbol: annual_volatility, var_95, var_99, cvar_95, max_drawdown, sharpe, sortino, regime.

    A metric is NULL where it has no value: fewer than two returns for a deviation, no
    return for a quantile.  The regime compares the last rolling volatility with quantiles
    of those before it.
    """
    full = Window.partitionBy("symbol")
    rows = indicators(bars, s)
    # the regime's quantiles leave out the last rolling volatility
    latest = F.max(F.when(F.col("rolling_vol").isNotNull(), F.col("day"))).over(full)
    rows = rows.withColumn("threshold", F.percentile("ret", F.lit(1 - 0.95)).over(full)).withColumn("latest", latest)
    earlier = F.when(F.col("day") < F.col("latest"), F.col("rolling_vol"))
    year, target = F.sqrt(F.lit(s.periods)), s.risk_free / s.periods
    low, high = s.regime_cuts
    found = rows.groupBy("symbol").agg(
        (F.stddev_samp("ret") * year).alias("annual_volatility"),
        (-F.max("threshold")).alias("var_95"),
        (-F.percentile("ret", F.lit(1 - 0.99))).alias("var_99"),
        (-F.avg(F.when(F.col("ret") <= F.col("threshold"), F.col("ret")))).alias("cvar_95"),
        F.min("drawdown").alias("max_drawdown"),
        (ratio(F.avg("ret") - target, F.when(F.stddev_samp("ret") > 1e-15, F.stddev_samp("ret"))) * year).alias("sharpe"),
        (ratio(F.avg("ret") - target, F.sqrt(F.avg(F.pow(F.least(F.col("ret") - target, F.when(F.col("ret").isNotNull(), F.lit(0.0))), F.lit(2))))) * year).alias("sortino"),
        F.count("rolling_vol").alias("vols"),
        F.max(F.when(F.col("day") == F.col("latest"), F.col("rolling_vol"))).alias("now"),
        F.percentile(earlier, F.lit(low)).alias("low"),
        F.percentile(earlier, F.lit(high)).alias("high"),
    )
    regime = F.when(F.col("vols") < s.min_regime_rows, "Unknown").when(F.col("now") <= F.col("low"), "Low").when(F.col("now") >= F.col("high"), "High").otherwise("Elevated")
    return found.withColumn("regime", regime).drop("vols", "now", "low", "high")


def risk_table(bars: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """The profile as display text."""
    rows = risk_profile(bars, s)
    percents = ("annual_volatility", "var_95", "var_99", "cvar_95", "max_drawdown")
    text = [dash(F.col(c) * 100, "%.2f%%").alias(c) for c in percents] + [dash(F.col(c), "%.2f").alias(c) for c in ("sharpe", "sortino")]
    return rows.select("symbol", *text, "regime")
