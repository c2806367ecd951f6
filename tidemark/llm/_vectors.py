"""Vectors as integer rows, and exact arithmetic on them in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Integer components are kept within this, so that no arithmetic below can overflow unseen.
LIMIT = 1 << 40
_EXACT = float(1 << 53)  # integers up to here are doubles


def integers(vectors: DataFrame, scale: int, *columns: str) -> DataFrame:
    """(`columns`..., ints): the vectors' components times `scale`, rounded down, within LIMIT.

    Null vectors and those with null or non-finite components are left out, an empty vector is not.
    """
    ok = "embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf'))"
    ints = F.transform("embedding", lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-float(LIMIT))), F.lit(float(LIMIT)))))
    return vectors.where(ok).select(*columns, ints.alias("ints"))


def of_one_length(rows: DataFrame, multiple: int = 1) -> tuple[DataFrame, int]:
    """The rows whose vector is as long as that of the smallest vec_id (nulls last, the shorter of equal ids), and that length.

    Only lengths that are positive multiples of `multiple` count; the length is 0 if no row has one.
    """
    size = F.size("ints")
    fit = rows.where((size > 0) & (size % multiple == 0))
    first = fit.agg(F.min(F.struct(F.col("vec_id").isNull(), "vec_id", size.alias("n"))).alias("m")).first()["m"]
    return fit.where(size == (first["n"] if first else 0)), first["n"] if first else 0


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of an int64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _largest(x: np.ndarray) -> float:
    return float(np.abs(x).max(initial=0))


def products(a: np.ndarray, b: np.ndarray, most: int = 1 << 62) -> np.ndarray:
    """Inner products of the rows of a and b as int64, exact, kept within `most`."""
    if _largest(a) * _largest(b) * a.shape[1] < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    out = np.empty((len(a), len(b)), np.int64)
    wide = b.astype(object).T
    for i, row in enumerate(a.astype(object)):
        out[i] = np.clip(row @ wide, -most, most).astype(np.int64)
    return out


def nearest(x: np.ndarray, book: np.ndarray, most: int = 1 << 61) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the nearest row of `book` (the first of equals) and the squared distance, exact, at most `most`.

    Distances are doubles first.  Where these are not exact integers, rows that rounding
    leaves open are decided by Python's integers.
    """
    d = x.shape[1]
    wide, entries = x.astype(np.float64), book.astype(np.float64)
    x2, b2 = (wide * wide).sum(axis=1), (entries * entries).sum(axis=1)
    far = x2[:, None] - 2 * (wide @ entries.T) + b2
    big = np.maximum(np.abs(wide).max(axis=1, initial=0)[:, None], np.abs(entries).max(axis=1, initial=0))
    slack = np.where(4 * d * big * big < _EXACT, 0.0, (d + 8) * 2.0**-50 * (x2[:, None] + b2))
    open_ = far - slack <= (far + slack).min(axis=1)[:, None]
    code = open_.argmax(axis=1)
    unsure = open_ & (slack > 0)
    for i in np.flatnonzero(unsure.any(axis=1) & (open_.sum(axis=1) > 1)):
        among = np.flatnonzero(open_[i])
        apart = book[among].astype(object) - x[i].astype(object)
        code[i] = among[int((apart * apart).sum(axis=1).argmin())]
    apart = x - book[code]
    if _largest(apart) ** 2 * d < 2.0**62:
        return code, np.minimum((apart * apart).sum(axis=1), most)
    wide = apart.astype(object)
    return code, np.minimum((wide * wide).sum(axis=1), most).astype(np.int64)


def sums(x: np.ndarray, code: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Per code that occurs: the code, its weight and the weighted componentwise sums, as exact integers."""
    order = np.argsort(code, kind="stable")
    codes, first = np.unique(code[order], return_index=True)
    total = int(weight.sum())
    x, weight = x[order], weight[order]
    if _largest(x) * total >= 2.0**62:
        x, weight = x.astype(object), weight.astype(object)
    return codes, np.add.reduceat(weight, first), np.add.reduceat(x * weight[:, None], first, axis=0).tolist()
