"""Co-movement of aligned returns (asset, day, ret) without NULLs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.config import BENCHMARK, DEFAULT, Settings
from tidemark.functions.stats import corr, dash, half_even, trailing


#: A tile holds the returns of some assets on up to so many days.
_DAYS = 2048
_TILE = "side int, days int, block int, names array<string>, shift binary, present binary, data binary"
_MOMENTS = "a int, b int, names_a array<string>, names_b array<string>, moments binary"


def _pack(table: pa.Table) -> pa.Table:
    """One tile: a matrix of days by assets, without the assets' means over these days, NaN where there is no return."""
    names, column = np.unique(np.array(table["asset"].to_pylist(), object), return_inverse=True)
    days, row = np.unique(table["at"].to_numpy(), return_inverse=True)
    data = np.full((len(days), len(names)), np.nan)
    data[row, column] = table["ret"].to_numpy()
    shift, present = np.nanmean(data, axis=0), np.zeros(_DAYS, bool)
    present[days] = True
    binaries = [pa.array([x.tobytes()], pa.binary()) for x in (shift, np.packbits(present), data - shift)]
    return pa.table([*(table[c][:1] for c in ("side", "days", "block")), pa.array([names.tolist()], pa.list_(pa.string())), *binaries], ["side", "days", "block", "names", "shift", "present", "data"])


def _dense(tile: dict) -> tuple[np.ndarray, np.ndarray]:
    """(values with 0 for none, 1 where there is one) of all days of the block."""
    own = np.frombuffer(tile["data"]).reshape(-1, len(tile["names"]))
    values, known = np.zeros((_DAYS, own.shape[1])), np.zeros((_DAYS, own.shape[1]))
    at = np.unpackbits(np.frombuffer(tile["present"], np.uint8)).astype(bool)
    values[at], known[at] = np.nan_to_num(own), ~np.isnan(own)
    return values, known


def _moments(table: pa.Table) -> pa.Table:
    """Counts, means and central sums of all pairs of two tiles' assets, a matrix product each."""
    tiles = table.drop_columns(["a", "b"]).to_pylist()
    a, b = int(table["a"][0].as_py()), int(table["b"][0].as_py())
    if len(tiles) == 1 and not (tiles[0]["side"] < 0 and a == b):  # nothing to meet
        return pa.table([pa.array([], f) for f in (pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.binary())], ["a", "b", "names_a", "names_b", "moments"])
    one, two = tiles[0], tiles[-1]
    if (two["side"], two["block"]) < (one["side"], one["block"]):
        one, two = two, one
    (x, m), (y, n) = _dense(one), _dense(two)
    count = m.T @ n
    some = np.maximum(count, 1)
    sx, sy, sxx, syy, sxy = x.T @ n, m.T @ y, (x * x).T @ n, m.T @ (y * y), x.T @ y
    cxx, cyy = (np.where(c <= 1e-13 * s, 0, c) for c, s in ((sxx - sx * sx / some, sxx), (syy - sy * sy / some, syy)))  # what rounding leaves of a constant
    found = np.stack((count, np.frombuffer(one["shift"])[:, None] + sx / some, np.frombuffer(two["shift"]) + sy / some, cxx, cyy, sxy - sx * sy / some))
    return pa.table([pa.array([a], pa.int32()), pa.array([b], pa.int32()), *(pa.array([t["names"]], pa.list_(pa.string())) for t in (one, two)), pa.array([found.tobytes()], pa.binary())], ["a", "b", "names_a", "names_b", "moments"])


def _correlations(table: pa.Table, mirrored: bool) -> pa.Table:
    """(asset_a, asset_b, corr) of a pair of blocks of assets from the moments over its blocks of days."""
    sides = [table[c].to_pylist() for c in ("names_a", "names_b")]
    every = [sorted({n for names in side for n in names}) for side in sides]
    n, mx, my, cxx, cyy, cxy = total = np.zeros((6, len(every[0]), len(every[1])))
    for i in range(table.num_rows):
        at = np.ix_(np.searchsorted(every[0], sides[0][i]), np.searchsorted(every[1], sides[1][i]))
        k, ux, uy, dxx, dyy, dxy = np.frombuffer(table["moments"][i].as_buffer()).reshape(6, *n[at].shape)
        both = np.maximum(n[at] + k, 1)
        apart_x, apart_y, weight = ux - mx[at], uy - my[at], n[at] * k / both
        cxx[at] += dxx + apart_x**2 * weight
        cyy[at] += dyy + apart_y**2 * weight
        cxy[at] += dxy + apart_x * apart_y * weight
        mx[at] += apart_x * k / both
        my[at] += apart_y * k / both
        n[at] += k
    some = np.maximum(n, 1)
    flat = (cxx / some < np.maximum(1e-30, 1e-26 * mx * mx)) | (cyy / some < np.maximum(1e-30, 1e-26 * my * my))
    corr = cxy / np.sqrt(np.where(flat, 1, cxx) * np.where(flat, 1, cyy))
    i, j = np.nonzero(total[0] > 0)
    names, others = (np.array(side, object)[k] for side, k in zip(every, (i, j)))
    values, hidden = corr[i, j], flat[i, j]
    if mirrored and table["a"][0] != table["b"][0]:
        names, others, values, hidden = np.concatenate((names, others)), np.concatenate((others, names)), np.tile(values, 2), np.tile(hidden, 2)
    return pa.table([pa.array(names, pa.string()), pa.array(others, pa.string()), pa.array(values, pa.float64(), mask=hidden)], ["asset_a", "asset_b", "corr"])


def _gram(returns: DataFrame, sides: Column, blocks: int, mirrored: bool) -> DataFrame:
    """(asset_a, asset_b, corr) of the assets of side 0 with those of side 1, or of all with all where the side is -1.

    Pairs count over the days that both have; NULL where a side is constant there.  Assets are dealt to `blocks`
    by hash and days to blocks of _DAYS.  A tile goes to every tile of the same days that it must meet, so no
    row stands for a pair of assets on a day; a pair of blocks of assets then merges its blocks of days.
    """

    def finish(table: pa.Table) -> pa.Table:
        return _correlations(table, mirrored)

    day = F.unix_date("day")
    rows = returns.where("ret is not null").select("asset", "ret", F.floor(day / _DAYS).cast("int").alias("days"), F.pmod(day, F.lit(_DAYS)).alias("at"), F.pmod(F.xxhash64("asset"), F.lit(blocks)).cast("int").alias("block"), F.explode(sides).alias("side"))
    tiles = rows.groupBy("side", "days", "block").applyInArrow(_pack, _TILE).select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    one, two, every = F.col("block"), F.col("other"), F.col("side") < 0
    a, b = F.when(every, F.least(one, two)).when(F.col("side") == 0, one).otherwise(two), F.when(every, F.greatest(one, two)).when(F.col("side") == 0, two).otherwise(one)
    met = tiles.select("*", a.alias("a"), b.alias("b")).drop("other").groupBy("days", "a", "b").applyInArrow(_moments, _MOMENTS)
    return met.groupBy("a", "b").applyInArrow(finish, "asset_a string, asset_b string, corr double")


def ranks(returns: DataFrame) -> DataFrame:
    """Returns replaced by their average ranks within the asset."""
    order, ties = Window.partitionBy("asset").orderBy("ret"), Window.partitionBy("asset", "ret")
    return returns.withColumn("ret", (F.rank().over(order) + (F.count("*").over(ties) - 1) / F.lit(2.0)))


def correlation_matrix(returns: DataFrame, method: str = "pearson", blocks: int = 16) -> DataFrame:
    """(asset_a, asset_b, corr) of all pairs; NULL where a side is constant.  `blocks`: about one for each 256 assets or more."""
    if method == "spearman":
        returns = ranks(returns)
    elif method != "pearson":
        raise ValueError(f"unknown method {method}")
    return _gram(returns, F.array(F.lit(-1)), blocks, mirrored=True)


def macro_block(returns: DataFrame, assets: Sequence[str] | None = None, macro: Sequence[str] | None = None, blocks: int = 16) -> DataFrame:
    """Correlations of `assets` with `macro` assets to two places; absent ones give no row.  By default, of all of each side."""
    left = ~F.col("is_macro") if assets is None else F.col("asset").isin(*assets)
    right = F.col("is_macro") if macro is None else F.col("asset").isin(*macro)
    sides = F.array_compact(F.array(F.when(left, F.lit(0)), F.when(right, F.lit(1))))
    return _gram(returns, sides, blocks, mirrored=False).withColumn("corr", half_even(F.col("corr"), 2))


def _with_benchmark(returns: DataFrame, benchmark: str) -> DataFrame:
    """`returns` with `bench`, the benchmark's return of the day (NULL where it has none)."""
    bench = F.max(F.when(F.col("asset") == benchmark, F.col("ret"))).over(Window.partitionBy("day"))
    return returns.withColumn("bench", bench)


def rolling_correlation(returns: DataFrame, benchmark: str = BENCHMARK, window: int = DEFAULT.corr_windows[0]) -> DataFrame:
    """(asset, day, corr) over complete windows of rows."""
    w = trailing(window, "asset")
    rows = _with_benchmark(returns, benchmark).where((F.col("asset") != benchmark) & F.col("bench").isNotNull())
    value = F.when(F.count("ret").over(w) == window, corr(F.col("ret"), F.col("bench"), w))
    return rows.withColumn("corr", value).where("corr is not null").select("asset", "day", "corr")


def beta(returns: DataFrame, benchmark: str = BENCHMARK, s: Settings = DEFAULT) -> DataFrame:
    """(asset, beta) against the benchmark; NULL below three rows or for a constant benchmark."""
    rows = _with_benchmark(returns, benchmark).where((F.col("asset") != benchmark) & F.col("bench").isNotNull())
    return rows.groupBy("asset").agg(F.when(F.count("*") >= s.min_corr_rows, F.regr_slope("ret", "bench")).alias("beta"))


def regime_correlation(returns: DataFrame, benchmark: str = BENCHMARK, assets: Sequence[str] | None = None, s: Settings = DEFAULT) -> DataFrame:
    """(asset, benchmark, calm, stressed, shift, calm_days, stressed_days).

    Days on which the benchmark is at or below its `stress_quantile` are stressed.  A side of
    fewer than three days has no correlation; fewer than twenty days in all, or an asset or
    benchmark that is absent, give NULLs and zero counts.  Without `assets`, all but the benchmark.
    """
    rows = _with_benchmark(returns, benchmark).where(F.col("asset") != benchmark if assets is None else F.col("asset").isin(*assets))
    full = Window.partitionBy("asset")
    cut, n = F.percentile("bench", F.lit(s.stress_quantile)).over(full), F.count("bench").over(full)
    rows = rows.withColumn("cut", cut).withColumn("n", n).withColumn("low", F.when(F.col("n") >= s.min_stress_rows, F.col("bench") <= F.col("cut")))

    def side(low: bool) -> tuple[Column, Column]:
        own = F.col("low") == low
        days = F.count_if(own)
        return F.when(days >= s.min_corr_rows, corr(F.when(own, F.col("ret")), F.when(own, F.col("bench")))), days

    (calm, calm_days), (stressed, stressed_days) = side(False), side(True)
    out = rows.groupBy("asset").agg(calm.alias("calm"), stressed.alias("stressed"), calm_days.alias("calm_days"), stressed_days.alias("stressed_days"))
    if assets is not None:
        out = returns.sparkSession.createDataFrame([(a,) for a in assets], "asset string").join(out, "asset", "left")
    return out.select(
        "asset", F.lit(benchmark).alias("benchmark"), "calm", "stressed", (F.col("stressed") - F.col("calm")).alias("shift"),
        F.coalesce("calm_days", F.lit(0)).cast("long").alias("calm_days"), F.coalesce("stressed_days", F.lit(0)).cast("long").alias("stressed_days"),
    )


def regime_table(returns: DataFrame, benchmark: str = BENCHMARK, assets: Sequence[str] | None = None, s: Settings = DEFAULT) -> DataFrame:
    """Calm and stressed correlations as display text."""
    text = [dash(F.col(c), "%+.2f").alias(c) for c in ("calm", "stressed", "shift")]
    return regime_correlation(returns, benchmark, assets, s).select("asset", *text, "calm_days", "stressed_days")
