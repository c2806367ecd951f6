"""Hard-negative mining: exact top-k by inner product over one-dimensional distance keys.

Vectors get one more component that makes all equally long, so that a larger inner
product with an anchor is a smaller distance to it.  Each vector belongs to its nearest
pivot and is stored by (pivot, distance to it), in cells of consecutive keys and blocks of
bounded size.  By the triangle inequality, what lies within a radius of an anchor has its
key within that radius of the anchor's own distance to the pivot: a search scans the key
intervals of a radius, takes the k-th best found as the next radius, and ends once no
unscanned key can be nearer than that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm._store import Scratch
from tidemark.llm._vectors import integers, matrix, of_one_length, products

_MOST = 1 << 62  # scores are kept within this


@dataclass(frozen=True)
class Settings:
    scale: int = 256
    positives: int = 5
    negatives: int = 3
    low: int = 50  # percent of the positive's score
    high: int = 95
    pivots: int = 32
    sample: int = 4096  # rows, the first by hash, that pivots are fitted on
    cells: int = 4096  # about this many intervals of keys at most; their bounds are all that the driver holds of the index
    block_rows: int = 2048
    first_cells: int = 4  # the first radius reaches so many cells
    chunk: int = 65536  # anchors that a copy of a block answers, one after another
    batch: int = 128  # anchors in one product


_BLOCK = "cell long, block int, width int, ints binary, rid binary, vec_id binary, label binary"
_PACKED = pa.schema([("cell", pa.int64()), ("block", pa.int32()), ("width", pa.int32()), ("ints", pa.binary()), ("rid", pa.binary()), ("vec_id", pa.binary()), ("label", pa.binary())])

# -- index ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Keys:
    """Pivots and the cells of their keys, small tables that go to every task.

    Cell `ids[i]` holds vectors of pivot `pivot[i]` with keys from `low[i]` to `high[i]`, in `blocks[i]` blocks.
    """

    pivots: np.ndarray
    top: float  # the squared length that all vectors get
    edges: tuple[np.ndarray, ...] = ()
    ids: np.ndarray | None = None
    pivot: np.ndarray | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    blocks: np.ndarray | None = None

    def lifted(self, ints: np.ndarray) -> np.ndarray:
        wide = ints.astype(np.float64)
        return np.column_stack((wide, np.sqrt(np.maximum(self.top - (wide * wide).sum(axis=1), 0))))

    def distances(self, points: np.ndarray) -> np.ndarray:
        """To each pivot."""
        return np.sqrt(np.maximum((points * points).sum(axis=1)[:, None] - 2 * points @ self.pivots.T + (self.pivots * self.pivots).sum(axis=1), 0))

    def slack(self) -> float:
        """More than rounding can move a distance."""
        return 1e-6 * np.sqrt(self.top) + 1e-6

    def place(self, ints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pivot, key) of vectors."""
        far = self.distances(self.lifted(ints))
        nearest = far.argmin(axis=1)
        return nearest, far[np.arange(len(far)), nearest]

    def cell(self, pivot: np.ndarray, key: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros(len(pivot), np.int64)
        for p in np.unique(pivot):
            own = pivot == p
            out[own] = p * width + np.searchsorted(self.edges[p], key[own])
        return out

    def away(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For anchors and cells: no vector of the cell is nearer than the first and none farther than the second."""
        wide = anchors.astype(np.float64)
        to = self.distances(np.column_stack((wide, np.zeros(len(wide)))))[:, self.pivot]
        return np.maximum(np.maximum(to - self.high, self.low - to), 0), to + self.high

    def distance(self, norms: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """The distance that an inner product stands for."""
        return np.sqrt(np.maximum(self.top + norms - 2 * scores, 0))


def _fit_pivots(sample: np.ndarray, top: float, s: Settings) -> Keys:
    """Centres of a few rounds of Lloyd on the sample, the first pivots being its first different rows."""
    points = Keys(np.zeros((0, 0)), top).lifted(sample)
    _, first = np.unique(points, axis=0, return_index=True)
    keys = Keys(points[np.sort(first)[: s.pivots]], top)
    for _ in range(5):
        own = keys.distances(points).argmin(axis=1)
        keys = Keys(np.array([points[own == p].mean(axis=0) if (own == p).any() else keys.pivots[p] for p in range(len(keys.pivots))]), top)
    return keys


def _norm(ints: str = "ints") -> Column:
    return F.aggregate(ints, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


@dataclass(frozen=True)
class Index:
    keys: Keys
    rows: DataFrame  # rid, vec_id, label, ints
    blocks: DataFrame  # cell, block, and the block's vectors in the order of their keys


def build_index(rows: DataFrame, store: Scratch, s: Settings = Settings()) -> Index:
    """`rows` (vec_id, label, ints) of one length, stored by (pivot, distance)."""
    rows = store.write(rows.withColumn("rid", F.monotonically_increasing_id()), "negatives-rows")
    top = rows.agg(F.max(_norm())).first()[0] or 0.0
    sample = rows.orderBy(F.xxhash64("rid"), "rid").limit(s.sample).select("ints").collect()
    if not sample:
        return Index(Keys(np.zeros((0, 1)), 0.0), rows, store.spark.createDataFrame([], _BLOCK))
    keys = _fit_pivots(np.array([r["ints"] for r in sample], np.int64), top, s)
    width = max(1, s.cells // len(keys.pivots))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot, key = keys.place(matrix(batch["ints"])) if batch.num_rows else (np.zeros(0, np.int64), np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch["rid"], pa.array(pivot), pa.array(key)], ["rid", "pivot", "key"])

    # edges: quantiles of each pivot's keys, as many as its share of the rows allows
    placed = rows.select("rid", "ints").mapInArrow(place, "rid long, pivot long, key double")
    shares = [i / width for i in range(1, width)] or [0.5]
    found = placed.groupBy("pivot").agg(F.count("*").alias("n"), F.percentile_approx("key", shares, F.lit(10 * s.cells)).alias("edges")).collect()  # a row a pivot
    edges = [np.zeros(0)] * len(keys.pivots)
    for r in found:
        cells = min(width, max(1, round(r["n"] / s.block_rows)))
        edges[r["pivot"]] = np.array([r["edges"][i * width // cells - 1] for i in range(1, cells)])
    keys = Keys(keys.pivots, top, tuple(edges))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot, key = keys.place(matrix(batch["ints"])) if batch.num_rows else (np.zeros(0, np.int64), np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.cell(pivot, key, width)), pa.array(key)], [*batch.schema.names, "cell", "key"])

    dealt = rows.select("rid", "vec_id", "label", "ints").mapInArrow(cells, "rid long, vec_id long, label long, ints array<bigint>, cell long, key double")
    # equal keys share a cell however many they are, so a cell has as many blocks as its exact number of rows asks for
    held = sorted(dealt.groupBy("cell").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect())
    ids = np.array([r["cell"] for r in held], np.int64)
    blocks = np.array([-(-r["n"] // s.block_rows) for r in held], np.int64)
    keys = Keys(keys.pivots, top, keys.edges, ids, ids // width, np.array([r["low"] for r in held]), np.array([r["high"] for r in held]), blocks)
    parts = F.element_at(F.create_map(*[F.lit(int(x)) for pair in zip(ids, blocks) for x in pair]), F.col("cell")) if len(set(blocks)) > 1 else F.lit(int(blocks[0]))

    def pack(table: pa.Table) -> pa.Table:
        ints, key = matrix(table["ints"]), table["key"].to_numpy()
        order = np.lexsort((table["rid"].to_numpy(), key))
        small = next(t for t in (np.int16, np.int32, np.int64) if np.abs(ints).max(initial=0) <= np.iinfo(t).max)
        data = {"cell": [table["cell"][0].as_py()], "block": [table["block"][0].as_py()], "width": [np.dtype(small).itemsize], "ints": [ints[order].astype(small).tobytes()]}
        data |= {c: [table[c].to_numpy()[order].tobytes()] for c in ("rid", "vec_id", "label")}
        return pa.table({f.name: pa.array(data[f.name], f.type) for f in _PACKED})

    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rid"), parts).cast("int"))
    return Index(keys, rows, store.write(dealt.groupBy("cell", "block").applyInArrow(pack, _BLOCK), "negatives-index"))


# -- search -----------------------------------------------------------------------------------

#: An anchor under search: `highs` and `lows` are its bands of scores, `reach` the radius scanned, `radius` the one to scan,
#: `floors` for each band the least score that still counts.
_STATE = "qid long, label long, ints array<bigint>, highs array<bigint>, lows array<bigint>, floors array<bigint>, reach double, radius double, open boolean"
_ASKED = "cell long, block int, chunk int, qid long, label long, ints array<bigint>, highs array<bigint>, lows array<bigint>, floors array<bigint>"
_HITS = "qid long, band int, score long, vec_id long"


def _lists(rows: list, kind: pa.DataType = pa.int64()) -> pa.Array:
    return pa.array(rows, pa.list_(kind))


def _begin(anchors: DataFrame, keys: Keys, s: Settings) -> DataFrame:
    """First radii: as far as the nearest few cells, but not short of the band's best score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ints = matrix(batch["ints"])
            near, _ = keys.away(ints)
            radius = np.sort(near, axis=1)[:, min(s.first_cells, near.shape[1]) - 1]
            norms = (ints.astype(np.float64) ** 2).sum(axis=1)
            best = np.array([max(h) for h in batch["highs"].to_pylist()], np.float64)
            radius = np.maximum(radius, keys.distance(norms, best)) + keys.slack()
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, batch["lows"], pa.array(np.full(n, -1.0)), pa.array(radius), pa.array(np.ones(n, bool))], [*batch.schema.names, "floors", "reach", "radius", "open"])

    return anchors.select("qid", "label", "ints", "highs", "lows").mapInArrow(run, _STATE)


def _asked(state: DataFrame, keys: Keys, chunks: int) -> DataFrame:
    """The blocks whose keys come within an anchor's radius and did not before, unless all they hold is too near for every band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ints = matrix(batch["ints"])
            near, far = keys.away(ints)
            norms = (ints.astype(np.float64) ** 2).sum(axis=1)
            best = np.array([max(h) for h in batch["highs"].to_pylist()], np.float64)
            fresh = (near <= batch["radius"].to_numpy()[:, None]) & (near > batch["reach"].to_numpy()[:, None])
            fresh &= far >= (keys.distance(norms, best) - keys.slack())[:, None]
            row, cell = np.nonzero(fresh)
            each = keys.blocks[cell]
            block = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            row, cell = np.repeat(row, each), np.repeat(cell, each)
            for i in range(0, len(row), 4096):
                own = batch.take(pa.array(row[i : i + 4096]))
                chunk = (own["qid"].to_numpy() * 0x9E3779B1 >> 16) % chunks
                yield pa.RecordBatch.from_arrays([pa.array(keys.ids[cell[i : i + 4096]]), pa.array(block[i : i + 4096].astype(np.int32)), pa.array(chunk.astype(np.int32)), *(own[c] for c in ("qid", "label", "ints", "highs", "lows", "floors"))], ["cell", "block", "chunk", "qid", "label", "ints", "highs", "lows", "floors"])

    return state.mapInArrow(run, _ASKED)


class _Block:
    """The vectors of one block, in the order of their ids."""

    def __init__(self, row: dict, dim: int):
        ids = np.frombuffer(row["vec_id"], np.int64)
        order = np.argsort(ids, kind="stable")
        self.vec_id = ids[order]
        self.rid, self.label = (np.frombuffer(row[c], np.int64)[order] for c in ("rid", "label"))
        self.ints = np.frombuffer(row["ints"], f"i{row['width']}").reshape(len(ids), dim)[order].astype(np.int64)

    def answer(self, queries: pa.RecordBatch, k: int, same: bool) -> Iterator[tuple[np.ndarray, ...]]:
        """(qid, band, score, vec_id): the k best of each query's bands, ties by id."""
        qid, label = queries["qid"].to_numpy(), queries["label"].to_numpy()
        score = products(matrix(queries["ints"]), self.ints, _MOST)
        fit = (label[:, None] == self.label) & (qid[:, None] != self.rid) if same else label[:, None] != self.label
        highs, lows, floors = (queries[c].to_pylist() for c in ("highs", "lows", "floors"))
        for band in range(max(map(len, highs))):
            at = np.array([i for i, h in enumerate(highs) if len(h) > band])
            bound = lambda x: np.array([x[i][band] for i in at], np.int64)[:, None]
            own = score[at]
            ok = fit[at] & (own <= bound(highs)) & (own >= bound(lows)) & (own >= bound(floors))
            if own.shape[1] > k:  # what is below the k-th best goes before anything is sorted
                kth = -np.partition(np.where(ok, -own, _MOST), k - 1, axis=1)[:, k - 1]
                ok &= own >= kth[:, None]
            q, v = np.nonzero(ok)
            order = np.lexsort((v, -own[q, v], q))
            q, v = q[order], v[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            q, v = q[place < k], v[place < k]
            yield qid[at[q]], np.full(len(q), band, np.int32), own[q, v], self.vec_id[v]


def _answers(index: Index, asked: DataFrame, chunks: int, k: int, same: bool, dim: int, s: Settings) -> DataFrame:
    """Hits of each asked block: a block comes first in its task and the anchors that ask it follow as a stream."""
    blocks = index.blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    packed = F.struct("width", "rid", "vec_id", "label", F.col("ints").alias("data")).alias("packed")
    ask = F.struct("qid", "label", "ints", "highs", "lows", "floors").alias("ask")
    both = blocks.select("cell", "block", "chunk", packed).unionByName(asked.select("cell", "block", "chunk", ask), allowMissingColumns=True)
    key = ("cell", "block", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, None
        for batch in batches:
            keys = np.column_stack([batch[c].to_numpy() for c in key])
            head = batch["packed"].is_valid().to_numpy(zero_copy_only=False)
            i = 0
            while i < batch.num_rows:
                if head[i]:
                    row = batch["packed"][i].as_py()
                    at, block = keys[i], _Block(row | {"ints": row["data"]}, dim)
                    i += 1
                    continue
                end = i + 1
                while end < min(batch.num_rows, i + s.batch) and not head[end]:
                    end += 1
                if block is None or (keys[i] != at).any():  # hashing has dealt this block no vector
                    i += 1
                    continue
                end = i + int((keys[i:end] == at).all(axis=1).cumprod().sum())
                asking = batch["ask"].slice(i, end - i)
                queries = pa.RecordBatch.from_arrays(asking.flatten(), [f.name for f in asking.type])
                for found in block.answer(queries, k, same):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["qid", "band", "score", "vec_id"])
                i = end

    tasks = max(asked.sparkSession.sparkContext.defaultParallelism, int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = both.repartition(tasks, *key).sortWithinPartitions(*key, F.desc(F.col("packed").isNotNull()))
    return dealt.mapInArrow(run, _HITS)


def _advance(state: DataFrame, best: DataFrame, keys: Keys, k: int) -> DataFrame:
    """The state after a scan.  A radius that no unscanned vector can beat ends the search."""
    found = best.groupBy("qid").agg(F.collect_list(F.struct("band", "n", "kth")).alias("found"))  # a band each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ints = matrix(batch["ints"])
            norms = (ints.astype(np.float64) ** 2).sum(axis=1)
            whole = keys.away(ints)[0].max(axis=1)  # every cell is within this
            reach = batch["radius"].to_numpy()
            floors, need = batch["lows"].to_pylist(), np.zeros(len(ints))
            for i, (own, rows) in enumerate(zip(floors, batch["found"].to_pylist())):
                for r in rows or ():
                    if r["n"] >= k:
                        own[r["band"]] = max(own[r["band"]], r["kth"])
                need[i] = keys.distance(norms[i], np.array(min(own), np.float64))  # all within the band are nearer than its least score
            need = np.minimum(need + keys.slack(), whole)
            counted = np.array([sum(r["n"] >= k for r in rows or ()) == len(h) for rows, h in zip(batch["found"].to_pylist(), batch["highs"].to_pylist())])
            radius = np.where(counted, need, np.minimum(need, np.maximum(1.5 * reach, reach + keys.slack())))
            columns = [batch[c] for c in ("qid", "label", "ints", "highs", "lows")]
            yield pa.RecordBatch.from_arrays([*columns, _lists(floors), pa.array(reach), pa.array(radius), pa.array(need > reach)], ["qid", "label", "ints", "highs", "lows", "floors", "reach", "radius", "open"])

    return state.join(found, "qid", "left").mapInArrow(run, _STATE)


def search(index: Index, anchors: DataFrame, k: int, same: bool, store: Scratch, s: Settings = Settings()) -> DataFrame:
    """(qid, band, rank, vec_id, score): for each anchor and band of scores its k rows of largest inner product, stored.

    `anchors` (qid, label, ints, highs, lows) have their rid in the index as qid; with `same`, rows
    of the anchor's label other than itself are searched, else those of other labels.  Ties go to
    the smaller vec_id.
    """
    top = Window.partitionBy("qid", "band").orderBy(F.desc("score"), "vec_id")
    best = store.write(store.spark.createDataFrame([], _HITS + ", rank int"), "negatives-best")
    if index.keys.ids is None:
        return best
    dim = index.keys.pivots.shape[1] - 1
    state = store.write(_begin(anchors, index.keys, s), "negatives-state")
    while n := state.where("open").count():
        chunks = -(-n // s.chunk)
        open_ = state.where("open")
        hits = _answers(index, _asked(open_, index.keys, chunks), chunks, k, same, dim, s)
        ranked = best.drop("rank").unionByName(hits).withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
        new = store.write(ranked, "negatives-best")
        store.drop(best)
        best = new
        summed = best.groupBy("qid", "band").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
        new = store.write(_advance(open_, summed, index.keys, k), "negatives-state")
        store.drop(state)
        state = new
    store.drop(state)
    return best


# -- mining -----------------------------------------------------------------------------------


def mine(vectors: DataFrame, is_anchor: Column, s: Settings = Settings()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `vectors` has vec_id, embedding and an integral label; further columns may be used by
    `is_anchor` and are ignored otherwise.  An anchor's positives are its nearest rows of the same
    label, and each positive's negatives the nearest rows of other labels whose score is from `low`
    to `high` percent of the positive's.  Rows with a null vec_id, label or vector, or with a null or
    non-finite component, take no part, nor do those whose length is not the one that counts (see
    `of_one_length`).  Rows that agree in id, label and vector are one; several vectors or labels
    under one id are rows of their own, each an anchor if its id is one.  Integer components are kept
    within 2^40 and scores within 2^62.  Positives of negative score have no negatives.
    """
    store = Scratch(vectors.sparkSession)
    rows = integers(vectors.where("vec_id is not null and label is not null").withColumn("label", F.col("label").cast("long")).withColumn("asks", F.coalesce(is_anchor, F.lit(False))), s.scale, "vec_id", "label", "asks")
    rows, _ = of_one_length(rows.groupBy("vec_id", "label", "ints").agg(F.bool_or("asks").alias("asks")))
    index = build_index(rows, store, s)
    anchors = index.rows.where("asks").select(F.col("rid").alias("qid"), "vec_id", "label", "ints")
    every = F.array(F.lit(_MOST)).alias("highs"), F.array(F.lit(-_MOST)).alias("lows")
    positives = search(index, anchors.select("qid", "label", "ints", *every), s.positives, True, store, s)
    # a * (score div 100) + a * (score % 100) / 100 stays within a long
    share = lambda a, up: f"{a} * (x div 100) + ({a} * (x % 100) + {99 if up else 0}) div 100"
    bands = positives.where("score >= 0").groupBy("qid").agg(F.sort_array(F.collect_set("score")).alias("scores"))
    bands = bands.select("qid", F.expr(f"transform(scores, x -> {share(s.high, False)})").alias("highs"), F.expr(f"transform(scores, x -> {share(s.low, True)})").alias("lows"), "scores")
    bands = store.write(bands, "negatives-bands")
    negatives = search(index, anchors.join(bands, "qid"), s.negatives, False, store, s)
    positives = positives.select("qid", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    scored = bands.select("qid", F.posexplode("scores").alias("band", "positive_score"))
    negatives = negatives.select("qid", "band", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = anchors.select("qid", F.col("vec_id").alias("anchor_id"))
    found = positives.join(scored, ["qid", "positive_score"]).join(negatives, ["qid", "band"]).join(named, "qid")
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS ints
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
r AS MATERIALIZED (SELECT row_number() OVER () AS rid, * FROM v),
s AS MATERIALIZED (
  SELECT a.rid AS aid, a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, list_inner_product(a.ints, b.ints)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.rid <> b.rid),
p AS (SELECT aid, anchor_id, vec_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY aid ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.aid, p.vec_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.aid = p.aid AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT * FROM n WHERE rank <= 3
"""
