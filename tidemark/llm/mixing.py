"""Mixing sources to target weights.

Tokens are summed per source, targets follow from the weights by filling up to a cap,
and each document is taken floor(rate) times plus once more with probability equal to
the rate's fraction, decided by a seeded hash of its id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm._store import materialize

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of the key's MD5."""
    hexes = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":" + seed))), 1, 13)
    return F.conv(hexes, 16, 10).cast("double") / F.lit(float(1 << 52))


def _numbered(sources: DataFrame, partitions: int) -> DataFrame:
    """`sources` with `place`, the position in code-point order, nulls last; no task sees more than one range."""
    ranged = sources.repartitionByRange(partitions, F.col("source").asc_nulls_last())
    stored = materialize(ranged.withColumn("part", F.spark_partition_id()), "mix-sources")
    counts = dict(stored.groupBy("part").count().collect())  # one row for each of `partitions` ranges
    offsets, total = {}, 0
    for part in sorted(counts):
        offsets[part], total = total, total + counts[part]
    if not offsets:
        return stored.withColumn("place", F.lit(0).cast("long")).drop("part")
    offset = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair])
    order = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return stored.withColumn("place", offset[F.col("part")] + F.row_number().over(order) - 1).drop("part")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, partitions: int = 8) -> DataFrame:
    """Targets for a table (source, source_size) with one row per source.

    Sources, ordered by code point with null last, weigh `weights` in turn and share
    `share` times all tokens.  No target exceeds `cap` times its source's size; what
    exceeds it is shared again by weight among the others until none is above.  Only
    sums of the whole table reach the driver.  An empty table gives an empty table.
    """
    place = F.col("place") % len(weights)
    weight = F.lit(float(weights[-1]))
    for i, w in enumerate(weights[:-1]):
        weight = F.when(place == i, F.lit(float(w))).otherwise(weight)
    table = _numbered(sizes, partitions).withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(cap))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, capped = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("cap") < F.lit(level) * F.col("weight")
        n, used, rest = table.agg(F.count_if(full), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == capped or not rest:
            break
        capped, level = n, (total * share - (used or 0.0)) / rest
    target = F.least(F.col("cap"), F.lit(level or 0.0) * F.col("weight"))
    return table.select("source", "source_size", target.cast("double").alias("target"))


def plan_mix(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """`docs` with size, source_size, target and copies (how often the mix takes the row).

    Null texts have no words; null sources are one source; a source without words has
    target 0 and none of its rows is taken.  Equal rows share an id, hence a draw.
    Columns of `docs` with those four names are replaced.
    """
    docs = docs.drop("size", "source_size", "target", "copies").withColumn("size", word_count(F.col("text")))
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, **options).withColumnRenamed("source", "of_source")
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    whole = F.floor(rate)
    joined = docs.join(targets, F.col("source").eqNullSafe(F.col("of_source")), "left").drop("of_source")
    return joined.withColumn("copies", whole + (uniform(F.col("doc_id"), seed) < rate - whole).cast("long"))


def mix(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """The mixed corpus: each row of `docs` as many times as it is taken, with the columns of `docs`."""
    planned = plan_mix(docs, seed, **options)
    return planned.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.nullif("copies", F.lit(0).cast("long"))))).select(*docs.columns)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return plan_mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM d GROUP BY source),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, row_number() OVER (ORDER BY source_size * 2.0::DOUBLE / w, source NULLS LAST) AS k FROM s),
-- with the k-1 sources of the smallest cap by weight at their caps, the others share the rest
lv AS (
  SELECT k, cap, w, ((SELECT sum(source_size) FROM s)::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
l AS (SELECT level FROM lv WHERE cap >= level * w ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM l), 0) * w)::DOUBLE AS target FROM c),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size = 0 THEN 0 ELSE t.target / t.source_size END AS rate,
         ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || ':mix'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT))::BIGINT AS taken FROM r
"""
