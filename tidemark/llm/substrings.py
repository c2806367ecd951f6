"""Exact substring deduplication: repeated byte strings of a minimum length.

Every string of `length` bytes is assigned to the smallest hash of the shorter strings in
it (its anchor), so equal strings have equal anchors wherever they stand.  Consecutive
strings of one anchor are a segment.  Only segments whose anchor occurs again are kept, of
equal segments one with its number of copies, and all segments of an anchor meet in one
bucket; those of an anchor of very many different segments have their strings counted one by
one instead.

In a bucket, a Burrows-Wheeler transform of the segments is searched breadth first: the
interval of the empty string is extended backward letter by letter, and a common prefix of
l letters between two neighbours in suffix order becomes known when an interval of l letters
is extended.  Common prefixes thus come by increasing value, and the search stops at the
minimum length: neighbours without a value then share at least that much.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm._store import Scratch, given_back, lean, numbered
from tidemark.llm._text import blocks, mix, prefix_sums, span_hashes, utf8

_BLOCK = 1 << 19  # bytes of texts worked on at a time, which take about a hundred times that
_SEPARATOR = 0xFF  # never a byte of UTF-8
_C = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    length: int = 200  # bytes that a repeated string has at least
    gram: int = 64  # bytes of the strings that anchors are chosen among
    bucket_bytes: int = 1 << 20  # segment bytes per bucket, about
    longest: int = 2048  # strings per segment at most; longer runs of one anchor are cut
    crowded: int = 20_000  # different segments of an anchor beyond which its strings are counted one by one


# -- anchors --------------------------------------------------------------------------


def anchored(data: np.ndarray, at: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """Segments of the texts in one block: (anchor, content hash, row, start in the text, strings, whether the anchor stands in it twice)."""
    none = np.zeros(0, np.int64)
    n = len(data)
    width = s.length - s.gram + 1
    if n < s.length:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, none.astype(bool)
    sums = prefix_sums(data)
    grams = np.arange(n - s.gram + 1)
    low = each = span_hashes(data, grams, grams + s.gram, sums)
    span = 1
    while span < width:  # minima of windows of doubling width
        step = min(span, width - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    inside = np.zeros(n + 1, np.int32)  # strings must not run over the end of their text
    ends = at[1:] - s.length + 1
    real = ends > at[:-1]
    np.add.at(inside, at[:-1][real], 1)
    np.add.at(inside, ends[real], -1)
    ok = np.cumsum(inside)[: len(low)] > 0
    first = ok.copy()
    first[1:] &= (low[1:] != low[:-1]) | ~ok[:-1]
    first[at[:-1][real]] = True
    starts = np.flatnonzero(first)
    stops = np.flatnonzero(ok & np.append(first[1:] | ~ok[1:], True)) + 1
    if (long := stops - starts > s.longest).any():
        pieces = np.where(long, -(-(stops - starts) // s.longest), 1)
        offset = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts, stops = np.repeat(starts, pieces) + offset * s.longest, np.minimum(np.repeat(stops, pieces), np.repeat(starts, pieces) + (offset + 1) * s.longest)
    row = np.searchsorted(at, starts, side="right") - 1
    content = span_hashes(data, starts, stops + s.length - 1, sums)
    size = (stops - starts + width - 1).astype(np.int32)
    begin = (np.cumsum(size) - size).astype(np.int32)
    short, value = each.astype(np.uint32), low[starts].astype(np.uint32)
    hits = short[np.repeat(starts.astype(np.int32) - begin, size) + np.arange(size.sum(), dtype=np.int32)] == np.repeat(value, size)
    twice = np.add.reduceat(hits, begin, dtype=np.int32) > 1 if len(begin) else none.astype(bool)
    return low[starts], content, row, starts - at[row], stops - starts, twice


def _segments(s: Settings):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column("rid").to_numpy()
            for rows, data, at in blocks(batch.column("text"), _BLOCK):
                anchor, content, row, start, count, twice = anchored(data, at, s)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(rid[rows][row]), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(twice)], ["anchor", "content", "rid", "start", "strings", "twice"])

    return run


# -- the transform -------------------------------------------------------------------------


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of a cyclic text ordered by their next `depth` bytes at least (ties as they come)."""
    n = len(text)
    wide = np.concatenate((text, text[:8])) if n >= 8 else np.resize(text, n + 8)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | wide[i : i + n]
    order = np.argsort(key).astype(np.int32)
    ranked = key[order]
    new = np.append(True, ranked[1:] != ranked[:-1])
    tied = np.arange(n, dtype=np.int32)
    rank, known = np.empty(n, np.int32), 8
    while True:
        # a rank is the place of the first position that shares it; only shared ones are ordered anew
        place = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied), dtype=np.int32), 0))]
        rank[order[tied]] = place
        alone = new & np.append(new[1:], True)
        tied, place = tied[~alone], place[~alone]
        if known >= depth or not len(tied):
            return order
        own = order[tied]
        next_ = own + np.int32(known)
        next_[next_ >= n] %= n
        key = (place.astype(np.uint64) << np.uint64(32)) | rank[next_].astype(np.uint64)
        by = np.argsort(key)
        order[tied] = own[by]
        key = key[by]
        new = np.append(True, key[1:] != key[:-1])
        known *= 2


def shared_from(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each position in suffix order shares `length` letters with the one before it.

    The search goes over intervals of the transform by length.  A level holds disjoint
    intervals; following the last-to-first mapping extends all by every letter before them,
    and an extended interval goes on only if the place behind it had no common prefix yet.
    """
    n = len(text)
    letters = text[order - 1]  # the transform: the letter before each suffix
    forward = np.empty(n, np.int32)
    forward[np.argsort(letters, kind="stable")] = np.arange(n, dtype=np.int32)
    column = text[order]
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    place, of = np.arange(n), np.zeros(n, np.int32)
    parent = np.zeros(n, np.int32)
    for _ in range(length):
        if not len(place):
            break
        to = forward[place]
        parent[to] = of
        if 8 * len(to) > n:
            mark = np.zeros(n, bool)
            mark[to] = True
            place = np.flatnonzero(mark)
        else:
            place = np.sort(to)
        up = parent[place]
        last = np.append((place[1:] != place[:-1] + 1) | (up[1:] != up[:-1]) | (column[place[1:]] != column[place[:-1]]), True)
        ends = np.flatnonzero(last)
        fresh = ~known[place[ends] + 1]
        known[place[ends][fresh] + 1] = True
        size = np.diff(np.append(-1, ends))
        goes = np.repeat(fresh, size)
        place, of = place[goes], np.repeat(np.arange(len(ends), dtype=np.int32), size)[goes]
    return ~known[:n]


def repeated(segments: list[bytes], copies: np.ndarray, length: int) -> list[np.ndarray]:
    """For each segment, which of its strings of `length` bytes start in some segment's copy elsewhere too."""
    sizes = np.array([len(b) for b in segments])
    text = np.frombuffer(b"".join(b + b"\xff" for b in segments), np.uint8)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    order = suffix_order(text, length)
    group = np.cumsum(~shared_from(text, order, length))
    of = np.empty(len(text), np.int64)
    of[order] = group
    strings = np.maximum(sizes - length + 1, 0)
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(strings)[:-1])), strings) + np.arange(strings.sum())
    weight = np.bincount(of[at], np.repeat(copies, strings), int(group[-1]) + 1 if len(group) else 1)
    return np.split(weight[of[at]] > 1, np.cumsum(strings)[:-1])


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


# -- Spark -----------------------------------------------------------------------------------


def _cut(length: int):
    """Bytes of the segments of each text."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "content", "copies", "crowded"]
        for batch in batches:
            data, at = utf8(batch.column("text"))
            out: dict[str, list] = {k: [] for k in (*names, "bytes")}
            for i, parts in enumerate(batch.column("parts").to_pylist()):
                text = data[at[i] : at[i + 1]].tobytes()
                for p in parts:
                    for k in names:
                        out[k].append(p[k])
                    out["bytes"].append(text[p["start"] : p["start"] + p["strings"] + length - 1])
            yield pa.RecordBatch.from_arrays([pa.array(out["anchor"], pa.int64()), pa.array(out["content"], pa.int64()), pa.array(out["copies"], pa.int64()), pa.array(out["crowded"], pa.bool_()), pa.array(out["bytes"], pa.binary())], [*names, "bytes"])

    return run


FOUND = "anchor long, content long, low int, high int"


def repeated_ranges(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(rid, low, high): byte ranges of `docs` (rid, text) covered by repeated strings; ranges of a text may overlap."""
    store = Scratch(docs.sparkSession)
    rows = docs.select("rid", "text").mapInArrow(_segments(s), "anchor long, content long, rid long, start int, strings int, twice boolean")
    again = rows.groupBy("anchor").agg(F.count("*").alias("n"), F.bool_or("twice").alias("twice")).where("n > 1 or twice").select("anchor")
    # a join, so that Spark splits an anchor that very many texts hold
    places = store.write(rows.join(again, "anchor", "left_semi").drop("twice"), "repeat-places")
    one = store.write(places.groupBy("anchor", "content").agg(F.count("*").alias("copies"), F.min(F.struct("rid", "start", "strings")).alias("at")), "repeat-contents")
    kinds = one.groupBy("anchor").count().where(F.col("count") > s.crowded).select("anchor", F.lit(True).alias("crowded"))
    known = one.join(kinds, "anchor", "left").select("anchor", "content", "copies", "at", F.coalesce("crowded", F.lit(False)).alias("crowded"))
    parts = known.select("at.rid", F.struct("anchor", "content", "copies", "crowded", "at.start", "at.strings").alias("part")).groupBy("rid").agg(F.collect_list("part").alias("parts"))  # those of one text
    cut = docs.select("rid", "text").join(parts, "rid").mapInArrow(_cut(s.length), "anchor long, content long, copies long, crowded boolean, bytes binary")
    segments = store.write(cut, "repeat-segments")
    store.drop(one)
    total = segments.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    buckets = max(1, -(-total // s.bucket_bytes))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["anchor", "content"])
        flags = repeated(pdf["bytes"].tolist(), pdf["copies"].to_numpy(), s.length)
        out = [(a, c, low, high + s.length - 1) for a, c, f in zip(pdf["anchor"], pdf["content"], flags) for low, high in zip(*_runs(f))]
        return pd.DataFrame(out, columns=["anchor", "content", "low", "high"])

    by_bucket = segments.where("not crowded").withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    found = by_bucket.groupBy("bucket").applyInPandas(lambda pdf: given_back(search(pdf)), FOUND)

    # an anchor of very many different segments would fill a bucket: its strings are counted one by one
    @lean
    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                data = np.frombuffer(r["bytes"], np.uint8)
                at = np.arange(len(data) - s.length + 1)
                hashes = span_hashes(data, at, at + s.length).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), r["anchor"])), pa.array(np.full(len(at), r["content"])), pa.array(np.full(len(at), r["copies"])), pa.array(at.astype(np.int32)), pa.array(hashes)], ["anchor", "content", "copies", "low", "string"])

    each = segments.where("crowded").mapInArrow(strings, "anchor long, content long, copies long, low int, string long")
    often = each.groupBy("string").agg(F.sum("copies").alias("n")).where("n > 1").select("string")
    lone = each.join(often, "string", "left_semi").select("anchor", "content", "low", (F.col("low") + s.length).alias("high"))
    found = store.write(found.union(lone), "repeat-found")
    store.drop(segments)
    return places.join(found, ["anchor", "content"]).select("rid", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high"))


@lean
def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the bytes of their ranges."""
    for batch in batches:
        data, at = utf8(batch.column("text"))
        kept, removed, spans = [], [], []
        for i, ranges in enumerate(batch.column("ranges")):
            text = data[at[i] : at[i + 1]]
            if ranges.values is None or not len(ranges.values):
                kept.append(text.tobytes())
                removed.append(0)
                spans.append(0)
                continue
            low, high = (ranges.values.field(c).to_numpy() for c in ("low", "high"))
            depth = np.zeros(len(text) + 1, np.int32)
            np.add.at(depth, low, 1)
            np.add.at(depth, high, -1)
            gone = np.cumsum(depth[:-1]) > 0
            kept.append(text[~gone].tobytes())
            removed.append(int(gone.sum()))
            spans.append(len(_runs(gone)[0]))
        others = [c for c in batch.schema.names if c not in ("text", "ranges")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(np.diff(at)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], [*others, "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """`docs` without `text`, with n_bytes, n_removed, n_spans and kept, the bytes that are left (binary).

    A byte goes if a string of `length` bytes over it also starts elsewhere, in the same
    text or another; strings are judged on the input and never cross texts.  Null and
    empty texts have no bytes.  Rows are told apart by a stored number, so of equal rows of enough
    bytes all is removed.  Columns of `docs` with the four names, or rid or ranges, are replaced.
    """
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept", "ranges", "rid")
    docs = numbered(docs, "repeat-rows")
    ranges = repeated_ranges(docs, s).groupBy("rid").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))  # those of one text
    joined = docs.join(ranges, "rid", "left").drop("rid")
    others = [c for c in docs.columns if c not in ("text", "rid")]
    schema = joined.select(*others, F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.lit(b"").alias("kept")).schema
    return joined.mapInArrow(_keep, schema)


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
