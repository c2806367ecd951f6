"""Approximate nearest neighbours: a robust-pruned directed graph per shard.

Every vector is indexed.  Distinct vectors are dealt to shards of bounded size; in each
shard a greedy search proposes neighbours for a vector and relaxed distance pruning keeps
edges in diverse directions.  A beam search answers each query in each shard and the
shards' answers are merged.  Searches run in lockstep over a block of vectors, so the
work is a few large numpy operations.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm._store import materialize


@dataclass(frozen=True)
class Settings:
    shard_rows: int = 4096  # vectors per shard, about
    degree: int = 32  # edges of a vector
    build_beam: int = 64
    search_beam: int = 96
    relax: float = 1.2  # an edge goes if a kept one is this much closer to its end
    batch: int = 256  # vectors searched in lockstep
    query_block: int = 65536  # queries that a copy of a shard's graph answers, one batch after another


def valid(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, embedding) whose vector has finite components, not all zero."""
    ok = "vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(embedding, x -> x <> 0)"
    return vectors.select("vec_id", "embedding").where(ok)


class Graph:
    """Vectors of one shard (scaled to length 1) and their edges."""

    def __init__(self, unit: np.ndarray, edges: np.ndarray, start: int):
        self.unit, self.edges, self.start = unit, edges, start

    def search(self, queries: np.ndarray, width: int, trace: bool = False) -> tuple[np.ndarray, ...]:
        """The `width` nearest vectors found for each query, nearest first: (ids, distances); -1 pads.

        With `trace`, also the vectors whose edges were followed.
        """
        b, n, r = len(queries), len(self.unit), self.edges.shape[1]
        width = min(width, n)
        ids = np.full((b, width), -1)
        far = np.full((b, width), np.inf, np.float32)
        done = np.zeros((b, width), bool)
        ids[:, 0] = self.start
        far[:, 0] = 1 - queries @ self.unit[self.start]
        seen = np.zeros((b, n + 1), bool)  # the last column stands for no vector
        seen[:, self.start] = seen[:, n] = True
        every, followed = np.arange(b), []
        while True:
            open_ = (ids >= 0) & ~done
            live = np.flatnonzero(open_.any(axis=1))
            if not len(live):
                break
            at = open_[live].argmax(axis=1)  # beams are sorted: the first open entry is the nearest
            here = ids[live, at]
            done[live, at] = True
            if trace:
                step = np.full(b, -1)
                step[live] = here
                followed.append(step)
            near = np.where(self.edges[here] < 0, n, self.edges[here])
            fresh = ~seen[live[:, None], near]
            seen[live[:, None], near] = True
            dist = 1 - np.matmul(self.unit[np.minimum(near, n - 1)], queries[live][:, :, None])[:, :, 0]
            all_ids = np.concatenate((ids[live], np.where(fresh, near, -1)), axis=1)
            all_far = np.concatenate((far[live], np.where(fresh, dist, np.inf).astype(np.float32)), axis=1)
            all_done = np.concatenate((done[live], np.zeros((len(live), r), bool)), axis=1)
            order = np.argsort(all_far, axis=1, kind="stable")[:, :width]
            ids[live], far[live], done[live] = (np.take_along_axis(x, order, 1) for x in (all_ids, all_far, all_done))
        path = np.stack(followed, axis=1) if followed else np.zeros((b, 0), int)
        return (ids, far, path) if trace else (ids, far)


def _prune(unit: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Edges of `points`: the nearest candidate is kept, candidates that it is `relax` times closer to go, and so on."""
    n = len(unit)
    candidates = np.where(candidates == points[:, None], -1, candidates)
    candidates = -np.sort(-candidates, axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    vectors = unit[np.clip(candidates, 0, n - 1)]
    far = 1 - np.matmul(vectors, unit[points][:, :, None])[:, :, 0]
    far = np.where(candidates < 0, np.inf, np.maximum(far, 0))
    between = np.maximum(1 - np.matmul(vectors, vectors.transpose(0, 2, 1)), 0)
    out = np.full((len(points), degree), -1)
    rows, left = np.arange(len(points)), far.copy()
    for k in range(min(degree, candidates.shape[1])):
        best = left.argmin(axis=1)
        real = np.isfinite(left[rows, best])
        if not real.any():
            break
        out[real, k] = candidates[rows, best][real]
        # squared chords are twice these distances, so the factor on lengths is squared here
        left[(relax * relax) * between[rows, best] <= far] = np.inf
        left[rows, best] = np.inf
    return out


def build(unit: np.ndarray, s: Settings = Settings()) -> Graph:
    """The graph of one shard's unit vectors, inserted in batches over a random start graph."""
    n = len(unit)
    rng = np.random.default_rng(n)
    start = int((unit @ unit.mean(axis=0)).argmax())
    edges = rng.integers(0, n, (n, s.degree))
    edges[edges == np.arange(n)[:, None]] = -1
    graph = Graph(unit, edges, start)
    order = rng.permutation(n)
    for i in range(0, n, s.batch):
        points = order[i : i + s.batch]
        ids, _, path = graph.search(unit[points], s.build_beam, trace=True)
        edges[points] = _prune(unit, points, np.concatenate((ids, path, edges[points]), axis=1), s.degree, s.relax)
        # edges back to the new points: room is made by pruning again
        to, source = edges[points].ravel(), np.repeat(points, s.degree)
        keep = to >= 0
        to, source = to[keep], source[keep]
        by = np.argsort(to, kind="stable")
        ends, first, count = np.unique(to[by], return_index=True, return_counts=True)
        more = np.full((len(ends), int(count.max(initial=0))), -1)
        more[np.repeat(np.arange(len(ends)), count), np.arange(len(to)) - np.repeat(first, count)] = source[by]
        for j in range(0, len(ends), s.batch):
            part = ends[j : j + s.batch]
            edges[part] = _prune(unit, part, np.concatenate((edges[part], more[j : j + s.batch]), axis=1), s.degree, s.relax)
    return graph


def _unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of a and b, in double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


INDEX = "dim int, shard int, vectors binary, edges binary, members binary, start int"


def build_index(vectors: DataFrame, k: int, s: Settings = Settings()) -> DataFrame:
    """One row per shard, written to the shared folder.  Of equal vectors one is indexed, with the k + 1 smallest ids."""
    rows = valid(vectors)
    first = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    distinct = rows.dropDuplicates(["vec_id", "embedding"]).withColumn("place", first).where(F.col("place") <= k + 1)
    members = distinct.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # k + 1 ids at most
    members = materialize(members.withColumn("dim", F.size("embedding")), "ann-vectors")
    shards = max(1, math.ceil(members.count() / s.shard_rows))

    def make(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ids", key=lambda c: c.str[0]).reset_index(drop=True)
        own = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        ids = np.full((len(pdf), k + 1), -1, np.int64)
        lengths = pdf["ids"].str.len().to_numpy()
        ids[np.repeat(np.arange(len(pdf)), lengths), np.concatenate([np.arange(x) for x in lengths])] = np.concatenate(pdf["ids"].to_numpy())
        graph = build(_unit(own), s)
        kept = own.astype(np.float32) if (own.astype(np.float32) == own).all() else own
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "vectors": [kept.tobytes()], "edges": [graph.edges.astype(np.int32).tobytes()], "members": [np.column_stack((ids, lengths)).tobytes()], "start": [graph.start]})

    dealt = members.withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int"))
    return materialize(dealt.groupBy("dim", "shard").applyInPandas(make, INDEX), "ann-index")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, s: Settings = Settings()) -> DataFrame:
    """The k nearest rows of `vectors` for each row of `queries`: (query_id, rank, vec_id, score).

    Nearness is the largest cosine, ties go to the smaller vec_id, and a query's own id is
    no answer.  Ties between equal vectors are exact; vectors of one direction and different
    lengths are found like any others, so among many of them a larger vec_id may be given.  Null and zero vectors and those with null or non-finite components take no
    part on either side; rows repeated with their id count once.  Of several vectors under one
    id all are candidates, and the smallest (by its components in order) is the query.  Vectors
    of different lengths are kept apart.  Columns beyond vec_id and embedding are ignored.
    """
    index = build_index(vectors, k, s)
    asked = valid(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))
    blocks = max(1, math.ceil(asked.count() / s.query_block))
    # a task reads a shard's graph once, and the queries of its length follow as a stream
    shards = index.groupBy("dim").agg(F.collect_set("shard").alias("shards"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).join(shards, "dim").withColumn("shard", F.explode("shards"))
    copies = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = ("dim", "shard", "block")
    graph, ask = F.struct("vectors", "edges", "members", "start").alias("graph"), F.struct("vec_id", "embedding").alias("ask")
    both = copies.select(*key, graph).unionByName(asked.select(*key, ask), allowMissingColumns=True)

    def answer(graph: Graph, own: np.ndarray, members: np.ndarray, ids: np.ndarray, wanted: np.ndarray) -> pd.DataFrame:
        found, _ = graph.search(_unit(wanted), s.search_beam)
        q, _ = np.nonzero(found >= 0)
        v = found[found >= 0]
        score = cosine(wanted[q], own[v])
        copies = members[v, -1]
        take = np.repeat(np.arange(len(v)), copies)
        answers = pd.DataFrame({"query_id": ids[q[take]], "vec_id": members[v[take], np.arange(len(take)) - np.repeat(np.cumsum(copies) - copies, copies)], "score": score[take]})
        return answers[answers["query_id"] != answers["vec_id"]].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        for batch in batches:
            keys = np.column_stack([batch[c].to_numpy() for c in key])
            head = batch["graph"].is_valid().to_numpy(zero_copy_only=False)
            i = 0
            while i < batch.num_rows:
                if head[i]:
                    row, at = batch["graph"][i].as_py(), keys[i]
                    members = np.frombuffer(row["members"], np.int64).reshape(-1, k + 2)
                    n, dim = len(members), int(at[0])
                    own = np.frombuffer(row["vectors"], np.float32 if len(row["vectors"]) == 4 * n * dim else np.float64).reshape(n, dim)
                    shard = Graph(_unit(own), np.frombuffer(row["edges"], np.int32).reshape(n, -1), int(row["start"])), own, members
                    i += 1
                    continue
                here = (keys[i : i + s.batch] == at).all(axis=1) & ~head[i : i + s.batch]
                asking = batch["ask"].slice(i, int(here.cumprod().sum()))
                ids, wanted = (asking.field(f) for f in ("vec_id", "embedding"))
                wanted = wanted.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(asking), -1)
                yield pa.RecordBatch.from_pandas(answer(*shard, ids.to_numpy(), wanted), preserve_index=False)
                i += len(asking)

    tasks = max(vectors.sparkSession.sparkContext.defaultParallelism, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = both.repartition(tasks, *key).sortWithinPartitions(*key, F.desc(F.col("graph").isNotNull()))
    hits = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(rows, rows.where("vec_id % 50 = 0"))
