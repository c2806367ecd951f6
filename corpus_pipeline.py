"""The corpus pipeline: rejects toxic documents and near copies, cuts repeated passages, mixes sources and encodes."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.llm import jaccard, mixing, pieces, substrings, toxicity
from tidemark.llm._store import Scratch, blocked, materialize


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> SparkSession:
    """From here on, Arrow batches of the session hold 8 MB at most, so that long texts come to Python few at a time."""
    spark.conf.set(_BATCH, "8m")
    return spark


#: Columns that stages work with; all others go through a stage as the fields of one column, whatever their names.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_OTHERS = "other_columns"


def carrying(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that returns the rows it keeps with all columns of `docs`, unchanged where it has no business with them."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        others = [c for c in docs.columns if c not in COLUMNS]
        if not others:
            return stage(spark, docs, sf_dir)
        own = docs.select(*(c for c in docs.columns if c in COLUMNS), F.struct(*(F.col(f"`{c}`") for c in others)).alias(_OTHERS))
        kept = stage(spark, own, sf_dir)
        return kept.select(*(F.col(f"{_OTHERS}.`{c}`").alias(c) if c in others else F.col(c) for c in docs.columns))

    return run


@carrying
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from the labelled ones outside its held-out fold."""
    bounded(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


@carrying
def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked documents, that of the smallest doc_id (of its copies, the first row).

    Groups are told apart by their sets, so null and reused ids neither join nor drop any.

    Documents without words are linked with nothing and all stay.
    """
    store = Scratch(bounded(spark))
    named = blocked(docs, "pipeline-rows", store)
    found = jaccard.join_blocked(named, store)
    first = F.when(F.col("doc_id").eqNullSafe(F.col("component_id")), F.col("rid"))
    kept = found.where("n_shingles > 0").groupBy("root").agg(F.min(first).alias("rid")).select("rid")
    kept = kept.union(found.where("n_shingles = 0").select("rid"))
    return named.join(kept, "rid", "left_semi").select(*docs.columns)


@carrying
def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated passages, all rows kept; characters that lost bytes are dropped whole."""
    bounded(spark)
    cut = substrings.remove_repeats(docs)
    text = F.expr("try_validate_utf8(cast(kept as string))")
    whole = F.coalesce(text, F.expr("replace(make_valid_utf8(cast(kept as string)), '\\uFFFD', '')"))
    cut = cut.withColumn("text", whole).withColumn("n_chars", F.length("text").cast("long"))
    return cut.select(*docs.columns)


@carrying
def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their target weights."""
    return mixing.mix(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's piece ids and whether they decode to its text again."""
    bounded(spark)
    coded = pieces.encode(docs.select("doc_id", "source", "text"), decoded=True)
    same = F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit(pieces.SPACE), F.lit(" "))
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("suffix-array dedup", repeats_stage),
    ("mixing sources to target weights", mix_stage),
    ("SentencePiece encoding and decoding", encode_stage),
]

#: No stage but the mixing can be stated in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the documents of `sf_dir`, each over the written result of the one before; the session's settings stay."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.conf.get(_BATCH)
    try:
        for _, stage in STAGES:
            docs = materialize(stage(spark, docs, sf_dir), "pipeline-stage")
    finally:
        spark.conf.set(_BATCH, before)
    return docs
