"""Vector code compression: product codes from weighted Lloyd rounds over distinct integer parts.

Components become integers and vectors are cut into equal parts.  Equal parts at a
position are one row with their number as weight, so a round costs as much as there are
different parts, however many vectors share one.  A round assigns every distinct part to
the nearest entry and adds up entries' weights and sums, first in each task and then in
Spark; only the codebooks themselves, whose size the settings fix, pass through the driver.
The last assignment is joined back to the vectors by position and part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm._store import Scratch
from tidemark.llm._vectors import integers, matrix, nearest, of_one_length, sums

_SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("total", pa.decimal128(38, 0))])
_MOST = (1 << 63) - 1


@dataclass(frozen=True)
class Settings:
    scale: int = 1024
    parts: int = 4
    entries: int = 256  # of a codebook, 256 at most, as a code has two hexadecimal digits
    rounds: int = 4


@dataclass(frozen=True)
class Codebooks:
    """For each part position its entries, an int64 matrix."""

    books: tuple[np.ndarray, ...]

    def sha256(self) -> str:
        """Of all entries' decimal components by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(v) for book in self.books for v in book.ravel().tolist()).encode()).hexdigest()


def _parts(rows: DataFrame, dim: int, s: Settings) -> DataFrame:
    """`rows` once for each part: (columns of rows but ints, part, value)."""
    step = dim // s.parts
    pieces = F.array(*(F.slice("ints", 1 + i * step, step) for i in range(s.parts)))
    return rows.select(*(c for c in rows.columns if c != "ints"), F.posexplode(pieces).alias("part", "value"))


def _by_part(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part, its rows in the batch, their values)."""
    part, values = batch["part"].to_numpy(), matrix(batch["value"])
    for p in np.unique(part):
        at = np.flatnonzero(part == p)
        yield int(p), at, values[at]


def _round(values: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round of weighted Lloyd."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list[int]] = {}  # by part and entry, so as large as the codebooks
        for batch in batches:
            weight = batch["weight"].to_numpy()
            for p, at, x in _by_part(batch):
                code, _ = nearest(x, books.books[p])
                for entry, n, total in zip(*sums(x, code, weight[at])):
                    new = [int(n), *total]
                    old = found.get((p, int(entry)))
                    found[p, int(entry)] = new if old is None else [a + b for a, b in zip(old, new)]
        keys = [(p, e, place, Decimal(v)) for (p, e), row in found.items() for place, v in enumerate(row)]
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*keys), _SUMS.types)], schema=_SUMS)

    partial = values.mapInArrow(run, "part int, entry int, place int, total decimal(38,0)")
    new = [b.copy() for b in books.books]
    totals: dict[tuple[int, int], dict[int, int]] = {}
    for r in partial.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect():  # a number for each of the codebooks'
        totals.setdefault((r["part"], r["entry"]), {})[r["place"]] = int(r["total"])
    for (p, e), row in totals.items():
        new[p][e] = [row[place] // row[0] for place in range(1, len(row))]
    return Codebooks(tuple(new))


def _assigned(values: DataFrame, books: Codebooks) -> DataFrame:
    """(part, value, entry, apart): each distinct part's entry and squared distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, apart = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for p, at, x in _by_part(batch):
                entry[at], apart[at] = nearest(x, books.books[p])
            yield pa.RecordBatch.from_arrays([batch["part"], batch["value"], pa.array(entry), pa.array(apart)], ["part", "value", "entry", "apart"])

    return values.mapInArrow(run, "part int, value array<bigint>, entry int, apart bigint")


def compress(vectors: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, error) for each vector, stored, and the codebooks.

    Null vectors and those with null or non-finite components are left out, and so are those
    whose length is not the one that counts (see `of_one_length`).  Null vec_ids come last when
    the first entries are chosen, equal ones in the order of their components; repeated rows
    count and are coded each.  Components are kept within 2^40, a part's squared distance within
    2^61.  Without rows the result is empty, with codebooks without entries.  Columns beyond
    vec_id, embedding and label are ignored.
    """
    store = Scratch(vectors.sparkSession)
    rows = integers(vectors, s.scale, "vec_id", "label")
    rows, dim = of_one_length(rows, s.parts)
    rows = store.write(rows.withColumn("rid", F.monotonically_increasing_id()), "codes-rows")
    first = matrix(pa.array([r["ints"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "ints").limit(s.entries).select("ints").collect()], pa.list_(pa.int64())))
    books = Codebooks(tuple(np.split(first, s.parts, axis=1)) if dim else tuple(np.zeros((0, 0), np.int64) for _ in range(s.parts)))
    values = _parts(rows.select("ints"), dim, s).groupBy("part", "value").agg(F.count("*").alias("weight"))
    values = store.write(values, "codes-values")
    for _ in range(s.rounds if dim else 0):
        books = _round(values, books)
    assigned = store.write(_assigned(values, books), "codes-assigned")
    # a value may belong to a third of all vectors: it has one row in `assigned`, so Spark can split its vectors
    coded = _parts(rows, dim, s).join(assigned, ["part", "value"]).groupBy("rid").agg(
        F.first("vec_id").alias("vec_id"), F.first("label").alias("label"),
        *(F.max(F.when(F.col("part") == p, F.lpad(F.lower(F.hex("entry")), 2, "0"))).alias(f"code_{p}") for p in range(s.parts)),
        F.sum("apart").alias("error"),
    )
    coded = coded.select("vec_id", "label", F.concat(*(f"code_{p}" for p in range(s.parts))).alias("code"), "error")
    coded = store.write(coded, "codes")
    store.keep(coded)
    return coded, books


def with_label_error(coded: DataFrame) -> DataFrame:
    """`coded` with label_error, the error summed over equal labels, nulls together (at most the largest long)."""
    wide = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_MOST).cast("decimal(38,0)")).cast("long")
    totals = coded.groupBy(F.col("label").alias("of_label")).agg(wide.alias("label_error"))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of_label"))).drop("of_label")


def op13(spark, sf_dir: str) -> DataFrame:
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _op13_sql(parts: int = 4, rounds: int = 4) -> str:
    """Rounds are spelled out one after another; distances of integers below 2^26 are exact in doubles."""
    ok = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    sql = [f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS ints FROM embeddings WHERE {ok}),
p AS MATERIALIZED (
  SELECT rid, part, list_transform(ints[1 + part * (len(ints) // {parts}):(part + 1) * (len(ints) // {parts})], lambda x: x::DOUBLE) AS value FROM v, range({parts}) r(part)),
u AS MATERIALIZED (SELECT part, value, count(*) AS w FROM p GROUP BY ALL),
f AS (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, ints) - 1 AS entry FROM v ORDER BY vec_id NULLS LAST, ints LIMIT 256),
b0 AS MATERIALIZED (SELECT part, entry, value FROM f JOIN p USING (rid))"""]
    near = "SELECT u.part, u.value, u.w, arg_min(entry, (list_inner_product(u.value, u.value) - 2 * list_inner_product(u.value, b.value) + list_inner_product(b.value, b.value)) * 1024 + entry) AS entry FROM u JOIN b{0} b USING (part) GROUP BY ALL"
    for i in range(rounds):
        sql.append(f"""a{i} AS MATERIALIZED ({near.format(i)}),
m{i} AS (SELECT part, entry, k, floor(sum(w * x) / sum(w)) AS x FROM (SELECT part, entry, w, unnest(value) AS x, unnest(range(len(value))) AS k FROM a{i}) GROUP BY ALL),
b{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n.value, o.value) AS value FROM b{i} o LEFT JOIN (SELECT part, entry, list(x ORDER BY k) AS value FROM m{i} GROUP BY ALL) n USING (part, entry))""")
    sql.append(f"""z AS MATERIALIZED ({near.format(rounds)}),
c AS (
  SELECT p.rid, string_agg(printf('%02x', z.entry), '' ORDER BY p.part) AS code, sum(list_inner_product(p.value, p.value) - 2 * list_inner_product(p.value, b.value) + list_inner_product(b.value, b.value))::BIGINT AS error
  FROM p JOIN z USING (part, value) JOIN b{rounds} b ON b.part = p.part AND b.entry = z.entry GROUP BY p.rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(list_transform(value, lambda x: x::BIGINT::VARCHAR), ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM v JOIN c USING (rid)""")
    return ",\n".join(sql)


OP13_SQL = _op13_sql()
