"""Returns, coverage pruning and complete cases on long tables (asset, day, level)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tidemark.config import DEFAULT, Settings
from tidemark.functions.stats import by_day, ratio, so_far


def with_returns(bars: DataFrame) -> DataFrame:
    """`bars` with `ret`, the change from the row before; NULL on a symbol's first row and after a zero or NULL price."""
    return bars.withColumn("ret", ratio(F.col("price"), F.lag("price").over(by_day("symbol"))) - 1)


def daily_returns(bars: DataFrame) -> DataFrame:
    return with_returns(bars).where("ret is not null").select("symbol", "day", "ret")


def log_returns(bars: DataFrame) -> DataFrame:
    before = F.lag("price").over(by_day("symbol"))
    return bars.withColumn("ret", F.ln(ratio(F.col("price"), before))).where("ret is not null").select("symbol", "day", "ret")


def mixed_returns(levels: DataFrame) -> DataFrame:
    """`levels` (asset, day, level, is_rate) with `ret` for the last two: rates are differenced, prices change by ratio.

    The first row of an asset and rows without a level on either side have a NULL return.
    """
    before = F.lag("level").over(by_day("asset"))
    change: Column = F.when(F.col("is_rate"), F.col("level") - before).otherwise(ratio(F.col("level"), before) - 1)
    return levels.withColumn("ret", change).drop("level", "is_rate")


def drop_empty_days(returns: DataFrame) -> DataFrame:
    """Rows of days on which some asset has a return."""
    n = F.count("ret").over(Window.partitionBy("day"))
    return returns.withColumn("returns", n).where("returns > 0").drop("returns")


def coverage(returns: DataFrame, min_coverage: float = DEFAULT.min_coverage) -> DataFrame:
    """(asset, n, keep): an asset stays if it has `min_coverage` of the largest number of returns, and any at all."""
    counts = returns.groupBy("asset").agg(F.count("ret").alias("n"))
    most = F.max("n").over(_all_assets())
    return counts.withColumn("most", most).select("asset", "n", ((F.col("n") >= F.col("most") * F.lit(min_coverage)) & (F.col("most") > 0)).alias("keep"))


def _all_assets() -> WindowSpec:
    """All rows of a table that has one for each asset, a column of the matrix asked for."""
    return Window.partitionBy(F.lit(True))


def complete_cases(returns: DataFrame, min_coverage: float = DEFAULT.min_coverage) -> DataFrame:
    """`returns` of the assets with enough coverage, on the days that have all of them."""
    kept = coverage(returns, min_coverage).where("keep").select("asset", F.count("*").over(_all_assets()).alias("assets"))
    n = F.count("ret").over(Window.partitionBy("day"))
    return returns.join(kept, "asset").withColumn("returns", n).where("returns = assets").drop("assets", "returns")


def align(prices: DataFrame, macro: DataFrame) -> DataFrame:
    """(asset, day, level, is_rate, is_macro) of both sides on the days they have in common.

    The join comes before differencing, so that a return over a weekend spans it on both sides.
    It is a window over the days of both, so that neither side is read twice.
    """
    left = prices.select(F.col("symbol").alias("asset"), "day", F.col("price").alias("level"), F.lit(False).alias("is_rate"), F.lit(False).alias("is_macro"))
    both = left.unionByName(macro.select("asset", "day", "level", "is_rate", F.lit(True).alias("is_macro")))
    day = Window.partitionBy("day")
    both = both.withColumn("common", F.bool_or("is_macro").over(day) & ~F.bool_and("is_macro").over(day))
    return both.where("common").drop("common")


def aligned_returns(prices: DataFrame, macro: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(asset, day, is_macro, ret): join on days, difference, prune thin assets, keep complete days, in this order (empty days are never complete)."""
    return complete_cases(mixed_returns(align(prices, macro)), s.min_coverage)


def forward_filled(levels: DataFrame, key: str = "asset", value: str = "level") -> DataFrame:
    return levels.withColumn(value, F.last(value, ignorenulls=True).over(so_far(key)))


def price_matrix(bars: DataFrame) -> DataFrame:
    """(day, symbol, price) on every day that any symbol has, forward-filled; days before a symbol's first price are left out."""
    days, symbols = bars.select("day").distinct(), bars.select("symbol").distinct()
    grid = days.crossJoin(symbols)  # days by symbols is the matrix asked for
    return forward_filled(grid.join(bars.select("symbol", "day", "price"), ["symbol", "day"], "left"), "symbol", "price").where("price is not null").select("day", "symbol", "price")


def densified(bars: DataFrame) -> DataFrame:
    """(symbol, day, price) on every calendar day from a symbol's first to its last price, forward-filled."""
    known = bars.where("price is not null").select("symbol", "day", "price")
    known = known.withColumn("until", F.coalesce(F.date_sub(F.lead("day").over(by_day("symbol")), 1), F.col("day")))
    days = F.sequence("day", F.greatest("day", "until"), F.expr("interval 1 day"))  # a row stands for the days up to the next one
    return known.select("symbol", F.explode(days).alias("day"), "price")
