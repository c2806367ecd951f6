"""Column helpers: complete windows, ratios and correlations that are NULL instead of raising."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec, functions as F


def by_day(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("day")


def trailing(n: int, *keys: str) -> WindowSpec:
    """The last n rows."""
    return by_day(*keys).rowsBetween(-(n - 1), 0)


def so_far(*keys: str) -> WindowSpec:
    return by_day(*keys).rowsBetween(Window.unboundedPreceding, 0)


def complete(value: Column, of: Column, n: int, window: WindowSpec) -> Column:
    """`value` over `window` once `of` has n values there, else NULL."""
    return F.when(F.count(of).over(window) == n, value.over(window))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """x kept between bounds; least() and greatest() alone would skip a NULL x."""
    out = x
    if high is not None:
        out = F.least(out, F.lit(high))
    if low is not None:
        out = F.greatest(out, F.lit(low))
    return F.when(x.isNotNull(), out)


def no_nan(x: Column) -> Column:
    return F.nanvl(x, F.lit(None).cast("double"))


def corr(x: Column, y: Column, window: WindowSpec | None = None) -> Column:
    """Pearson correlation of columns without half-null pairs; NULL where a side is constant."""
    parts = [F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)]
    if window is not None:
        parts = [p.over(window) for p in parts]
    cov, a, b = parts
    flat = (a < 1e-15) | (b < 1e-15)
    return F.when(~flat, ratio(cov, a * b))


def half_even(x: Column, places: int) -> Column:
    return F.bround(x, places)


def dash(x: Column, pattern: str) -> Column:
    """Text for display, an em dash for NULL."""
    return F.coalesce(F.format_string(pattern, x), F.lit("—"))
