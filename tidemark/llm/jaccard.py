"""Similarity join on word shingles by token-combination prefixes.

Shingles are put into one global order, rare ones first, by counts over all texts: blocks of
texts send their hashes to the range that counts them, which sends the counts' logarithms
back.  Two sets that are similar enough share their first common shingle within a short
prefix of both.  Where that shingle is rare it is indexed by itself, and one that a single
set holds is not indexed at all.  Where it is frequent, the prefix is extended by B shingles: then
B + 1 common shingles lie in it, two of them fall into one of B hash buckets, and so pairs
of frequent shingles of one bucket are indexed instead of single ones.  Sets that share an
index key are verified exactly, after a bound from bitmaps has dropped what cannot be similar.

Within the sets of a key, all are first compared with one of them.  What is linked then is
one component already, and only pairs of sets of different components remain to be compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm._store import Scratch, blocked, broadcast_up_to, given_back, lean
from tidemark.llm._text import LOWER, NOT_SPACE, Words, blocks, mix, window_hashes
from tidemark.llm.graph import components

_C = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 75  # of the union that two linked sets share
    frequent: int = 64  # sets that hold a frequent shingle, about
    range_hashes: int = 1 << 21  # hashes counted in one range, about
    rounds: int = 1  # further sets that all sets of a key are compared with, before all that are left are
    salted: int = 50_000  # sets per part of a key that more sets than this hold
    place_rows: int = 4096  # rows per task when what is left of groups is compared; a larger group goes in pairs of blocks
    max_broadcast: int = 500_000  # ids up to which they are broadcast to the texts


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, sorted distinct shingle hashes, bounds) of blocks of texts; fewer than k words are one shingle, none give none."""
    for rows, data, at in blocks(texts, 1 << 19):
        words = Words(LOWER[data], at, NOT_SPACE)
        hashes = words.hashes()
        parts = [window_hashes(hashes, words.bounds, k)]
        for short in range(1, k):
            h, p, row = window_hashes(hashes, words.bounds, short)
            only = words.counts[row] == short
            parts.append((h[only], p[only], row[only]))
        h, row = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts])
        if len(h) and (np.diff(row) < 0).any():
            by = np.argsort(row, kind="stable")
            h, row = h[by], row[by]
        cuts = np.searchsorted(row, np.arange(len(words.counts) + 1))
        sets = [np.unique(h[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        yield rows, np.concatenate(sets) if sets else h, np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)


def set_ids(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; 0 is that of empty ones."""
    total, size = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ _C)))), np.diff(bounds)
    out = mix((total[bounds[1:]] - total[bounds[:-1]]) + size.astype(np.uint64) * _C)
    return np.where(size > 0, np.maximum(out, np.uint64(1)), np.uint64(0)).view(np.int64)


def _list(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


def _pick(h: np.ndarray, bounds: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets that `keep` marks."""
    size = np.diff(bounds)
    return h[np.repeat(keep, size)], np.concatenate(([0], np.cumsum(size[keep])))


def _needed(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _buckets(n: int, percent: int) -> int:
    """B for sets of n shingles: a power of two up to the length of their prefix."""
    return 1 << ((n - _needed(n, percent) + 1).bit_length() - 1)


def keys_of(h: np.ndarray, often: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(index keys, expected sets of each) of one set of hashes, given about how many sets hold each (1: no other set)."""
    n = len(h)
    if n < 3:  # only an equal set can be similar enough, and equal sets are one already
        return h[:0], often[:0]
    first = n - _needed(n, s.percent) + 1
    scarce = np.flatnonzero(often < s.frequent)
    scarce = scarce[np.argsort(often[scarce], kind="stable")]  # by count, then by hash
    shared = scarce[:first]
    shared = shared[often[shared] > 1]
    rare = len(scarce)
    keys, sizes = [h[shared]], [often[shared]]
    if rare >= first:
        return keys[0], sizes[0]
    busy = np.flatnonzero(often >= s.frequent)
    busy = busy[np.lexsort((h[busy], often[busy]))]
    low, high = -(-s.percent * n // 100), 100 * n // s.percent
    for b in sorted({_buckets(m, s.percent) for m in range(low, high + 1)} if high - low < 64 else {1 << e for e in range(_buckets(low, s.percent).bit_length() - 1, _buckets(high, s.percent).bit_length())}):
        part = busy[: max(0, min(n, first + b) - rare)]
        bucket = (h[part] >> np.uint64(9)) & np.uint64(b - 1)
        by = np.argsort(bucket, kind="stable")
        part, bucket = part[by], bucket[by]
        for step in range(1, len(part)):
            same = np.flatnonzero(bucket[step:] == bucket[:-step])
            if not len(same):
                break
            x, y = part[same], part[same + step]
            keys.append(mix(mix(h[x] + _C) + h[y] * _C + np.uint64(b)))
            sizes.append(np.minimum(often[x], often[y]))
    return np.concatenate(keys), np.concatenate(sizes)


# -- counts of shingles ---------------------------------------------------------------------


def _cells(h: np.ndarray, ranges: int) -> np.ndarray:
    """Each hash's range and, within it, 32 bits by which counts tell hashes apart: one number, ordered by both.

    Hashes that agree in these share their count, which moves them in the order but loses none.
    """
    low = h & np.uint64(0xFFFFFFFF)
    return ((((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)) << np.uint64(32)) | low


def _level(count: np.ndarray) -> np.ndarray:
    """Quarter steps of the logarithm: 0 for a hash that one set holds."""
    return np.where(count > 1, 1 + np.floor(4 * np.log2(np.maximum(count, 1))), 0).astype(np.uint8)


#: About how many sets hold a shingle of each level.
_OFTEN = np.concatenate(([1], np.ceil(2.0 ** (np.arange(255) / 4)).clip(2, 2**62))).astype(np.int64)


def _different(ids: np.ndarray) -> np.ndarray:
    """Marks the first set of each name, empty ones left out."""
    keep = np.zeros(len(ids), bool)
    keep[np.unique(ids, return_index=True)[1]] = True
    return keep & (ids != 0)


def _summaries(k: int):
    """(rid, doc_id, n, id, bits) of each text."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, h, bounds in shingle_sets(batch.column("text"), k):
                maps = [bitmap(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
                bits = _list(np.concatenate(maps), np.concatenate(([0], np.cumsum([len(m) for m in maps]))), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("rid")[rows], batch.column("doc_id")[rows], pa.array(np.diff(bounds)), pa.array(set_ids(h, bounds)), bits], ["rid", "doc_id", "n", "id", "bits"])

    return run


def _block_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, bounds, names) of the different sets of a block's texts."""
    hs, sizes, names = [], [], []
    for _, h, bounds in shingle_sets(texts, k):
        hs.append(h)
        sizes.append(np.diff(bounds))
        names.append(set_ids(h, bounds))
    if not hs:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int64)
    names, bounds = np.concatenate(names), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
    keep = _different(names)
    return *_pick(np.concatenate(hs), bounds, keep), names[keep]


def _sent(k: int, ranges: int):
    """(range, block, data, more): the sorted cells of a block's sets, each once, and for those that several sets hold their place and further number."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column("block").to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True]))) if len(block) else []
            for low, high in zip(cuts[:-1], cuts[1:]):
                cells, count = np.unique(_cells(_block_sets(batch.column("text")[low:high], k)[0], ranges), return_counts=True)
                if not len(cells):
                    continue
                of = cells >> np.uint64(32)
                at = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                data, ends = cells.astype(np.uint32), np.append(at[1:], len(cells))
                several = [np.flatnonzero(count[i:j] > 1) for i, j in zip(at, ends)]
                more = [np.stack((x, count[i + x] - 1)).astype(np.uint32).tobytes() for i, x in zip(at, several)]
                yield pa.RecordBatch.from_arrays([pa.array(of[at].astype(np.int64)), pa.array(np.full(len(at), block[low])), pa.array([data[i:j].tobytes() for i, j in zip(at, ends)], pa.binary()), pa.array(more, pa.binary())], ["range", "block", "data", "more"])

    return run


def _counted(table: pa.Table) -> pa.Table:
    """(block, range, levels) for one range: the levels of each block's cells in order, each once."""
    block = table.column("block").to_numpy()
    data = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("data").combine_chunks()]
    cells, count = np.unique(np.concatenate(data), return_counts=True)
    for x, more in zip(data, table.column("more").combine_chunks()):
        place, further = np.frombuffer(more.as_buffer(), np.uint32).reshape(2, -1)
        count[np.searchsorted(cells, x[place])] += further  # a block's own cells differ
    level = _level(count)
    own: dict[int, list[np.ndarray]] = {}
    for b, x in zip(block.tolist(), data):
        own.setdefault(b, []).append(x)
    out = [level[np.searchsorted(cells, np.unique(np.concatenate(x)))].tobytes() for x in own.values()]
    number = table.column("range")[0].as_py()
    return pa.table({"block": pa.array(list(own), pa.int64()), "range": pa.array(np.full(len(own), number)), "levels": pa.array(out, pa.binary())})


def _postings(s: Settings, ranges: int):
    """(id, n, rare, keys, parts) of a block's sets; `rare` are its shingles in a thousand that are not frequent."""

    def run(texts: pa.Table, levels: pa.Table) -> pa.Table:
        h, bounds, names = _block_sets(texts.column("text").combine_chunks(), s.words)
        cells = _cells(h, ranges)
        every = np.unique(cells)
        by = np.argsort(levels.column("range").to_numpy())
        told = levels.column("levels").combine_chunks().take(pa.array(by)) if len(by) else []
        level = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x.as_buffer(), np.uint8) for x in told)])
        if len(level) != len(every):
            raise ValueError(f"{len(level)} counts came back for {len(every)} shingles of a block")
        often = _OFTEN[level[np.searchsorted(every, cells)]]
        found = [keys_of(h[a:b], often[a:b], s) for a, b in zip(bounds[:-1], bounds[1:])]
        scarce = np.concatenate(([0], np.cumsum(often < s.frequent)))[bounds]
        rare = 1000 * np.diff(scarce) // np.maximum(np.diff(bounds), 1)
        cuts = np.concatenate(([0], np.cumsum([len(k) for k, _ in found]))).astype(np.int64)
        keys, sizes = np.concatenate([h[:0], *(k for k, _ in found)]), np.concatenate([often[:0], *(n for _, n in found)])
        parts = np.repeat(names.view(np.uint64), np.diff(cuts)) % (sizes // s.salted + 1).astype(np.uint64)
        parts = np.where(sizes >= s.salted, parts.astype(np.int64) + 1, 0)  # 0: the key is whole
        return pa.table([pa.array(names), pa.array(np.diff(bounds)), pa.array(rare.astype(np.int32)), _list(keys.view(np.int64), cuts, pa.int64()), _list(parts.astype(np.int32), cuts, pa.int32())], ["id", "n", "rare", "keys", "parts"])

    return run


def postings(docs: DataFrame, hashes: int, s: Settings) -> DataFrame:
    """The postings of the sets of `docs` (block, text), which hold `hashes` shingles in all."""
    ranges = max(1, -(-hashes // s.range_hashes))
    sent = docs.select("block", "text").mapInArrow(_sent(s.words, ranges), "range long, block long, data binary, more binary")
    levels = sent.groupBy("range").applyInArrow(lambda cells: given_back(_counted(cells)), "block long, range long, levels binary")
    both = docs.select("block", "text").groupBy("block").cogroup(levels.groupBy("block"))
    found = _postings(s, ranges)
    return both.applyInArrow(lambda texts, levels: given_back(found(texts, levels)), "id long, n long, rare int, keys array<long>, parts array<int>")


# -- groups of sets with a key in common ------------------------------------------------------


@lean
def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, part, rare, id, n) sorted in this order to (group, id, n, rare, pivot): keys of one set are dropped, and keys of the same sets get one name.

    The pivot is the set with the fewest rare shingles: among copies of one text that is
    the text they come from, or nearly, which more of them resemble than any other.
    """
    names = ["key", "part", "id", "n", "rare"]

    def out(key: np.ndarray, part: np.ndarray, ids: np.ndarray, n: np.ndarray, rare: np.ndarray) -> pa.RecordBatch:
        once = np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (ids[1:] != ids[:-1]))
        key, part, ids, n, rare = key[once], part[once], ids[once], n[once], rare[once]
        first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])))
        size = np.diff(np.append(first, len(key)))
        total = np.add.reduceat(mix(ids.view(np.uint64)), first)
        group = np.where(part[first] > 0, mix(key[first].view(np.uint64) ^ _C), mix(total + size.astype(np.uint64) * _C)).view(np.int64)
        keep = size > 1
        keep |= part[first] > 0  # sets of other parts may follow
        rows, pivot = np.repeat(keep, size), np.repeat(ids[first], size)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(group, size)[rows]), pa.array(ids[rows]), pa.array(n[rows]), pa.array(rare[rows]), pa.array(pivot[rows])], ["group", "id", "n", "rare", "pivot"])

    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        rows = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in names)
        if not len(rows[0]):
            continue
        last = len(rows[0]) - 1
        start = int(np.flatnonzero((rows[0] != rows[0][last]) | (rows[1] != rows[1][last]))[-1]) + 1 if (rows[0][0], rows[1][0]) != (rows[0][last], rows[1][last]) else 0
        held.append(tuple(c[:start] for c in rows))
        if start:
            yield out(*(np.concatenate(c) for c in zip(*held)))
            held = []
        held.append(tuple(c[start:] for c in rows))
    if held and sum(len(c[0]) for c in held):
        yield out(*(np.concatenate(c) for c in zip(*held)))


class _Crowd:
    """The sets of one group: which of them may be similar to sets of other components, by size and bitmap.

    Sets of one side have met elsewhere; a side below 0 is none.
    """

    def __init__(self, n: np.ndarray, root: np.ndarray, side: np.ndarray, bits: list[np.ndarray], percent: int):
        self.n, self.root, self.side, self.percent = n, root, side, percent
        length = np.array([len(b) for b in bits])
        self.length, self.row = length, np.zeros(len(n), np.int64)
        self.maps: dict[tuple[int, int], np.ndarray] = {}
        for k in np.unique(length).tolist():
            own = np.flatnonzero(length == k)
            self.row[own] = np.arange(len(own))
            self.maps[k, k] = np.stack([bits[i] for i in own]).view(np.uint64)

    def folded(self, k: int, to: int) -> np.ndarray:
        if (k, to) not in self.maps:
            m = self.folded(k, 2 * to)
            self.maps[k, to] = m[:, :to] ^ m[:, to:]
        return self.maps[k, to]

    def like(self, i: int) -> np.ndarray:
        """Places after i."""
        n = self.n[i + 1 :]
        apart = (self.root[i + 1 :] != self.root[i]) & ((self.side[i + 1 :] != self.side[i]) | (self.side[i] < 0))
        j = np.flatnonzero(apart & (100 * np.minimum(n, self.n[i]) >= self.percent * np.maximum(n, self.n[i]))) + i + 1
        out, k = [], int(self.length[i])
        for other in np.unique(self.length[j]).tolist():
            part, to = j[self.length[j] == other], min(k, other)
            differ = np.bitwise_count(self.folded(other, to)[self.row[part]] ^ self.folded(k, to)[self.row[i]]).sum(axis=1)
            both = self.n[part] + self.n[i]
            most = (both - differ.astype(np.int64)) // 2
            out.append(part[100 * most >= self.percent * (both - most)])
        return np.concatenate(out) if out else j


class _Told:
    """Pairs that a task has given, by 64-bit names; it forgets them beyond a number."""

    def __init__(self, most: int = 500_000):
        self.names, self.most = np.zeros(0, np.uint64), most

    def fresh(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (a <= b) that are new, each once."""
        names, first = np.unique(mix(a.view(np.uint64) + mix(b.view(np.uint64) ^ _C)), return_index=True)
        at = np.searchsorted(self.names, names)
        new = (at == len(self.names)) | (np.append(self.names, np.uint64(0))[at] != names)
        self.names = np.insert(self.names, at[new], names[new]) if len(self.names) <= self.most else names[new]
        return a[first[new]], b[first[new]]


def _cross(percent: int):
    """Rows (cell, id, n, root, side, bits) sorted by cell to the pairs (a, b) of one cell and different roots that may be similar."""
    names = ("cell", "id", "n", "root", "side")

    def pairs(cell: np.ndarray, ids: np.ndarray, n: np.ndarray, root: np.ndarray, side: np.ndarray, bits: list[np.ndarray], told: _Told) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True])))
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*found))
            found.clear()
            return pa.RecordBatch.from_arrays(list(map(pa.array, told.fresh(np.minimum(a, b), np.maximum(a, b)))), ["a", "b"])

        held = 0
        for low, high in zip(cuts[:-1], cuts[1:]):
            crowd = _Crowd(n[low:high], root[low:high], side[low:high], bits[low:high], percent)
            for i in range(high - low - 1):
                near = crowd.like(i)
                if len(near):
                    found.append((np.full(len(near), ids[low + i]), ids[low + near]))
                    held += len(near)
                    if held > 100_000:
                        yield out()
                        held = 0
        if found:
            yield out()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        told = _Told()
        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in names]
            if not len(rows[0]):
                continue
            bits = [b.values.to_numpy() for b in batch.column("bits")]
            same = rows[0] == rows[0][-1]
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                held.append((*(c[:cut] for c in rows), bits[:cut]))
                *done, maps = zip(*held)
                yield from pairs(*(np.concatenate(c) for c in done), sum(maps, []), told)
                held = []
            held.append((*(c[cut:] for c in rows), bits[cut:]))
        if held:
            *done, maps = zip(*held)
            yield from pairs(*(np.concatenate(c) for c in done), sum(maps, []), told)

    return run


def bitmap(h: np.ndarray) -> np.ndarray:
    """Parities of how many hashes fall on each of about twice as many bits as there are hashes."""
    size = max(64, 1 << (2 * len(h) - 1).bit_length()) if len(h) else 64
    odd = np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def shared_at_most(x: np.ndarray, y: np.ndarray, n: int, m: int) -> int:
    """A bound on the hashes that two sets of n and m share: bits of different parity need a hash of one set alone each."""
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return (n + m - int(np.bitwise_count((x ^ y).view(np.uint64)).sum())) // 2


def _bounded(percent: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
            most = np.array([shared_at_most(x.values.to_numpy(), y.values.to_numpy(), i, j) for x, y, i, j in zip(batch.column("bits"), batch.column("others"), n.tolist(), m.tolist())], np.int64)
            keep = pa.array(100 * most >= percent * (n + m - most))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    return run


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets share `percent` of their union."""
    left = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b")), "b")
    both = left.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a")), "a")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return both.where(100 * shared >= percent * (F.size("of_a") + F.size("of_b") - shared)).select("a", "b")


def join(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """A row for each row of `docs` (doc_id, text): doc_id, n_shingles, component_id and root.

    component_id is the smallest doc_id that links reach from the row; as ids may be null or
    reused, only `root` tells components apart (it is null for an empty set).  Null texts and
    texts without words have an empty set and are linked with nothing, not even each
    other.  Rows are told apart by a stored number; equal rows are copies like any other.  A
    null doc_id is never the smallest unless the component has no other.
    """
    store = Scratch(docs.sparkSession)
    rows = blocked(docs.select("doc_id", "text"), "join-rows", store)
    found = join_blocked(rows, store, s)
    store.drop(rows)
    return found.drop("rid")


def join_blocked(docs: DataFrame, store: Scratch, s: Settings = Settings()) -> DataFrame:
    """`join` over a table of `blocked` (doc_id, text, rid, block), with rid; what the result does not read is deleted from `store`, but not `docs`."""
    sets = store.write(docs.select("rid", "doc_id", "text").mapInArrow(_summaries(s.words), "rid long, doc_id long, n long, id long, bits array<long>"), "join-sets")
    rows = sets.select("rid", "doc_id", "n", "id")
    hashes = sets.agg(F.sum("n")).first()[0] or 0
    found = postings(docs, hashes, s)
    flat = found.select("id", "n", "rare", F.explode(F.arrays_zip("keys", "parts")).alias("k")).select("k.keys", "k.parts", "id", "n", "rare").toDF("key", "part", "id", "n", "rare")
    dealt = flat.repartition(F.col("key"), F.col("part")).sortWithinPartitions("key", "part", "rare", "id")
    groups = dealt.mapInArrow(_groups, "group long, id long, n long, rare int, pivot long").dropDuplicates(["group", "id", "pivot"])
    groups = store.write(groups, "join-groups")

    holders = rows.where("n > 0").groupBy("id").agg(F.min("rid").alias("rid"))  # a text of each set

    @lean
    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, h, bounds in shingle_sets(batch.column("text"), s.words):
                yield pa.RecordBatch.from_arrays([batch.column("id")[part], _list(h.view(np.int64), bounds, pa.int64())], ["id", "shingles"])

    def of(members: DataFrame) -> DataFrame:
        """(id, rid) of the sets in (id)."""
        return holders.join(members.distinct(), "id", "left_semi")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("id")).union(pairs.select("b"))

    def bitmaps(members: DataFrame) -> DataFrame:
        return sets.select("rid", "n", "bits").join(of(members), "rid").select("n", "bits", "id")

    def linked(pairs: DataFrame) -> DataFrame:
        """The linked ones of (a, b): those that a bound from their bitmaps leaves open are verified on their texts, read again."""
        pairs = store.write(pairs, "join-pairs")
        maps = store.write(bitmaps(ends(pairs)), "join-bitmaps")
        both = pairs.join(maps.toDF("n", "bits", "a"), "a").join(maps.toDF("m", "others", "b"), "b").select("n", "m", "bits", "others", "a", "b")
        close = store.write(both.mapInArrow(_bounded(s.percent), "a long, b long"), "join-close")
        store.drop(pairs, maps)
        source = store.write(of(ends(close)), "join-members")
        wanted = docs.select("rid", "text").join(broadcast_up_to(source, source.count(), s.max_broadcast), "rid").select("id", "text")
        texts = store.write(wanted.mapInArrow(shingles, "id long, shingles array<long>"), "join-shingles")
        links = store.write(_verify(close, texts, s.percent), "join-links")
        store.drop(close, source, texts)
        return links

    # 1: every set with the first one of its key (and the first ones of a salted key's parts)
    near = F.expr(f"100 * least(n, m) >= {s.percent} * greatest(n, m)")
    heads = groups.where("id = pivot").select("group", "id", "n", "rare").distinct()
    lowest = heads.groupBy("group").agg(F.min(F.struct("rare", "id", "n")).alias("low")).select("group", "low.id", "low.n").toDF("group", "top", "m")
    pivots = heads.select(F.col("id").alias("pivot"), F.col("n").alias("m")).distinct()
    pairs = groups.where("id <> pivot").select("pivot", "id", "n").distinct().join(pivots, "pivot").where(near).select(F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b"))
    tops = heads.join(lowest, "group").where("id <> top").where(near).select(F.least("top", "id").alias("a"), F.greatest("top", "id").alias("b"))
    tried = store.write(pairs.union(tops).distinct(), "join-tried")
    links = linked(tried)

    # 2: sets of one group that are still in different components, first with a few of them, then with each other
    def unsettled(members: DataFrame, links: DataFrame) -> DataFrame:
        """(group, id, n, rare, root) of the groups of several components."""
        labelled = store.write(members.join(components(links), "id", "left").withColumn("root", F.coalesce("root", "id")), "join-labelled")
        mixed = labelled.groupBy("group").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("group")
        out = store.write(labelled.join(mixed, "group", "left_semi"), "join-open")
        store.drop(labelled)
        return out

    open_ = unsettled(groups.select("group", "id", "n", "rare").distinct(), links)
    store.drop(groups)
    for _ in range(s.rounds):
        # next, of each group the set of fewest rare shingles outside its largest component
        sizes = open_.groupBy("group", "root").agg(F.count("*").alias("size"), F.min(F.struct("rare", "id", "n", "root")).alias("h"))
        largest = sizes.groupBy("group").agg(F.max(F.struct("size", "root")).alias("most")).select("group", F.col("most.root").alias("most"))
        heads = sizes.join(largest, "group").where("root <> most").groupBy("group").agg(F.min("h").alias("h")).select("group", F.col("h.id").alias("top"), F.col("h.n").alias("m"), F.col("h.root").alias("other"))
        asked = open_.join(heads, "group").where("root <> other").where(near).select(F.least("id", "top").alias("a"), F.greatest("id", "top").alias("b")).distinct()
        asked = store.write(asked.join(tried, ["a", "b"], "left_anti"), "join-asked")
        more = linked(asked)
        links, tried = store.write(links.union(more), "join-links"), store.write(tried.union(asked), "join-tried")
        open_ = unsettled(open_.select("group", "id", "n", "rare"), links)
        store.keep(docs, sets, links, tried, open_)
    more = linked(_left(open_, s).join(bitmaps(open_.select("id")).select("id", "bits"), "id").repartition("place").sortWithinPartitions("cell", "root", "id").select("cell", "id", "n", "root", "side", "bits").mapInArrow(_cross(s.percent), "a long, b long").distinct().join(tried, ["a", "b"], "left_anti"))

    roots = components(links.union(more))
    named = rows.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    smallest = named.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    together = named.where("n > 0").join(smallest, "root").select("doc_id", "rid", F.col("n").alias("n_shingles"), "component_id", "root")
    alone = rows.where("n = 0").select("doc_id", "rid", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root"))
    out = store.write(together.union(alone), "join-rows-found")
    store.keep(docs, out)
    return out


def _left(open_: DataFrame, s: Settings) -> DataFrame:
    """`open_` (group, id, n, rare, root) dealt for comparison: (place, cell, side, id, n, root).

    Groups around one component have many pairs in common, so they go to few tasks, each
    with a bounded share of their rows.  A group of more rows than a task should hold is cut
    into blocks by its ids, and each pair of blocks is a cell of its own.
    """
    sizes = open_.groupBy("group", "root").agg(F.count("*").alias("size"))
    around = sizes.groupBy("group").agg(F.max(F.struct("size", "root")).alias("most"), F.sum("size").alias("size")).select("group", F.col("most.root").alias("core"), F.ceil(F.col("size") / s.place_rows).cast("int").alias("blocks"), "size")
    shares = around.where("blocks = 1").groupBy("core").agg(F.ceil(F.sum("size") / s.place_rows).cast("long").alias("shares"))
    around = around.join(shares, "core", "left").select("group", "blocks", F.xxhash64("core", F.pmod(F.xxhash64("group"), F.coalesce("shares", F.lit(1)))).alias("around"))
    rows = open_.join(around, "group").withColumn("own", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("id"), F.col("blocks"))).cast("int"))
    whole = rows.where("blocks = 1").select(F.col("around").alias("place"), F.col("group").alias("cell"), F.lit(-1).alias("side"), "id", "n", "root")
    paired = rows.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other"))
    paired = paired.select(cell.alias("place"), cell.alias("cell"), F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("side"), "id", "n", "root")
    return whole.union(paired)


def op9(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("root")
