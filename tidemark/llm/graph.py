"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.llm._store import Scratch


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every id in `links` (a, b): root is the smallest id of its component.

    Each round points every id at the smallest of itself and its neighbours, and goes on
    with the links between what they point at; the rounds' tables are written, so a lost
    executor costs one round at most.  Ids without a link, and links with nulls, give no row.
    """
    store = Scratch(links.sparkSession)
    edges = store.write(links.select("a", "b").where("a <> b").distinct(), "graph-links")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parents = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("root"))
        parents = store.write(parents, "graph-parents")
        left = edges.join(parents.withColumnRenamed("id", "a"), "a").select(F.col("root").alias("x"), "b")
        both = left.join(parents.withColumnRenamed("id", "b"), "b").select(F.least("x", "root").alias("a"), F.greatest("x", "root").alias("b"))
        edges = store.write(both.where("a <> b").distinct(), "graph-links")
        if labels is None:
            labels = parents
        else:
            next_ = parents.select(F.col("id").alias("root"), F.col("root").alias("next"))
            labels = store.write(labels.join(next_, "root", "left").select("id", F.coalesce("next", "root").alias("root")), "graph-labels")
        store.keep(edges, labels)
    store.drop(edges)
    return labels if labels is not None else links.select(F.col("a").alias("id"), F.col("b").alias("root")).limit(0)
