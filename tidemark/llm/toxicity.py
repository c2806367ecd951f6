"""Toxicity by compression distance.

Two Zstandard dictionaries of equal size, one trained on toxic and one on ordinary text,
compress every window of a document; a window that the toxic dictionary shortens more than
the ordinary one holds toxic wording.

Most of what texts of either label are made of is the same, so dictionaries are trained on
the word starts that lean to their label, by counts in other texts than the ones they are
taken from.  Thresholds are calibrated on texts that the dictionaries were not trained on:
the sample is halved, each half trains a pair of dictionaries that the other half has
judged the leaning for and calibrates, and a score is the mean of both.

The encoder is set so that lengths compare byte by byte: a fast strategy with raw
literals (entropy coding of literals would add noise), and a run of zero bytes before
each window, which both dictionaries end in, so that no window is stored raw.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm._store import lean
from tidemark.llm._text import NOT_SPACE, Words, blocks, mix, span_hashes

_PAD = bytes(64)
#: Everything but lower-case letters and non-ASCII bytes separates words.
_WORD_BYTES = bytes(b if 0x61 <= b < 0x7B or b >= 0x80 else 0x20 for b in range(256))
_MAGIC = (0xEC30A437).to_bytes(4, "little")  # a trained dictionary begins with it (fixed value of the format)


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 6000  # labelled rows that dictionaries and calibration are fitted on, at most
    sample_pieces: int = 8  # a longer text gives so many pieces, evenly spread over all of it
    piece_chars: int = 4096
    window: int = 64
    overlap: int = 8
    min_match: int = 6
    starts: tuple[int, ...] = (6, 7, 8)  # bytes of a word's start with the space before it; the first that leans is taken
    min_ratio: float = 20.0  # how much more frequent a start is in texts of its label than in others
    dictionary_bytes: int = 2048
    thresholds: tuple[int, ...] = (2, 3, 4, 6)  # bytes gained by which windows are counted
    ridge: float = 1.0


def _clean(text: str | None) -> bytes:
    return b" " + b" ".join((text or "").encode("utf-8", "replace").lower().translate(_WORD_BYTES).split()) + b" "


class Starts:
    """How often each word start occurs, as the number of distinct neighbour pairs: copied documents and passages count once."""

    def __init__(self, texts: list[bytes], s: Settings):
        self.total, self.hashes, self.counts = 0, [], []
        for n in s.starts:
            pairs, own = [], []
            for i in range(0, len(texts), 200):
                column = pa.array([t.decode("utf-8", "replace") for t in texts[i : i + 200]], pa.large_utf8())
                for _, data, at in blocks(column):
                    words = Words(data, at, NOT_SPACE)
                    whole = words.hashes()
                    around = mix(np.concatenate(([0], whole[:-1])).astype(np.uint64) + mix(np.concatenate((whole[1:], [0])).astype(np.uint64)))
                    first, last = words.starts - 1, np.minimum(words.starts - 1 + n, words.ends + 1)
                    real = first >= 0
                    own.append(span_hashes(data, first[real], last[real]))
                    pairs.append(mix(own[-1] + mix(around[real])))
            own, pairs = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (own, pairs))
            _, at = np.unique(pairs, return_index=True)
            hashes, counts = np.unique(own[at], return_counts=True)
            self.hashes.append(hashes)
            self.counts.append(counts)
            self.total = max(self.total, len(at))

    def of(self, k: int, wanted: np.ndarray) -> np.ndarray:
        """Counts of starts of the k-th length."""
        if not len(self.hashes[k]):
            return np.zeros(len(wanted), np.int64)
        at = np.minimum(np.searchsorted(self.hashes[k], wanted), len(self.hashes[k]) - 1)
        return np.where(self.hashes[k][at] == wanted, self.counts[k][at], 0)


def ratios(texts: list[bytes], own: Starts, other: Starts, s: Settings, k: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, first, last, ratio) of the k-th start of each word, for one block of texts after another.

    A ratio is the share of a start among the words of the label that `own` counts over its
    share among the words of the other, which count one occurrence more than they have.
    """
    for i in range(0, len(texts), 200):
        column = pa.array([t.decode("utf-8", "replace") for t in texts[i : i + 200]], pa.large_utf8())
        for _, data, at in blocks(column):
            words = Words(data, at, NOT_SPACE)
            first = words.starts - 1
            real = first >= 0
            first, last = first[real], np.minimum(first + s.starts[k], words.ends + 1)[real]
            wanted = span_hashes(data, first, last)
            yield data, first, last, (own.of(k, wanted) / max(1, own.total)) / ((other.of(k, wanted) + 1) / max(1, other.total))


def leaning(texts: list[bytes], own: Starts, other: Starts, s: Settings) -> list[tuple[float, bytes]]:
    """(ratio, start) of every word of the texts that leans to its label, judged by counts in other texts: of its starts the first that does."""
    out: list[tuple[float, bytes]] = []
    for parts in zip(*(ratios(texts, own, other, s, k) for k in range(len(s.starts)))):
        taken = np.zeros(len(parts[0][1]), bool)
        for data, first, last, ratio in parts:
            leans = (ratio >= s.min_ratio) & ~taken
            taken |= leans
            out += [(r, data[i:j].tobytes()) for r, i, j in zip(ratio[leans].tolist(), first[leans].tolist(), last[leans].tolist())]
    return out


def most_leaning(texts: list[bytes], own: Starts, other: Starts, s: Settings, most: int) -> list[bytes]:
    """The `most` starts of the first length that lean to their label most."""
    every = np.concatenate([np.zeros(0), *(r for *_, r in ratios(texts, own, other, s))])
    least = np.partition(every, -most)[-most] if len(every) > most else 0.0
    found = leaning(texts, own, other, replace(s, starts=s.starts[:1], min_ratio=float(least)))
    return [w for _, w in sorted(found, key=lambda x: (-x[0], x[1]))[:most]]


def trained(windows: list[bytes], s: Settings) -> bytes:
    """A trained dictionary of windows, dealt over samples by a hash; the windows themselves where they are too few to train on."""
    order = sorted(range(len(windows)), key=lambda i: (hash_of(i), i))
    samples = [b"".join(windows[i] for i in order[k : k + 16]) for k in range(0, len(order), 16)]
    try:
        content = zstandard.train_dictionary(s.dictionary_bytes, samples, k=16, d=6, level=1).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(windows))[-s.dictionary_bytes :]
    return content


def hash_of(i: int) -> int:
    return (i * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)


class Meter:
    """Bytes that the toxic dictionary saves over the ordinary one, window by window."""

    def __init__(self, toxic: bytes, ordinary: bytes, s: Settings):
        self.s = s
        params = zstandard.ZstdCompressionParameters(window_log=17, hash_log=14, chain_log=14, search_log=1, min_match=s.min_match, target_length=1, strategy=zstandard.STRATEGY_FAST, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.pair = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(self._content(d), dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params) for d in (toxic, ordinary)]

    def _content(self, dictionary: bytes) -> bytes:
        """Dictionaries at one length, so that offsets cost the same, and zero bytes at their end."""
        return dictionary[-self.s.dictionary_bytes :].rjust(self.s.dictionary_bytes, b"\0") + bytes(16)

    def gains(self, text: bytes) -> np.ndarray:
        s, (toxic, ordinary) = self.s, (c.compress for c in self.pair)
        windows = [_PAD + text[i : i + s.window] for i in range(0, max(1, len(text) - s.overlap), s.window - s.overlap)]
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows])

    def features(self, text: bytes) -> list[float]:
        gains = self.gains(text)
        counts = [int((gains >= v).sum()) for v in self.s.thresholds]
        return [*map(math.log1p, counts), *(math.sqrt(c / len(gains)) for c in counts)]


@dataclass
class Half:
    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the intercept


@dataclass
class Model:
    halves: list[Half]
    settings: Settings

    def scorer(self):
        meters = [(Meter(h.toxic, h.ordinary, self.settings), h) for h in self.halves]

        def score(text: str | None) -> float:
            clean, z = _clean(text), 0.0
            for meter, h in meters:
                x = (np.array(meter.features(clean)) - h.mean) / h.scale
                z += float(x @ h.weights[:-1] + h.weights[-1]) / len(meters)
            return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))

        return score


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of a logistic regression in which both labels weigh the same."""
    a, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    share = np.where(y > 0, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, len(y) - y.sum())) * len(y)
    penalty = np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w -= np.linalg.solve((a * (share * p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-9), a.T @ (share * (p - y)) + penalty * w)
    return w


def fit(rows: list[tuple[str | None, int]], s: Settings = Settings()) -> Model | None:
    """Dictionaries and calibration from labelled texts; None if a label is missing altogether.

    Equal rows count once.  A half without texts of both labels gives no pair of its own;
    if neither has them, both halves are all rows.
    """
    rows = sorted({(t or "", int(y)) for t, y in rows})
    if len({y for _, y in rows}) < 2:
        return None
    clean = [_clean(t) for t, _ in rows]
    side = [hash_of(i + 1) >> 63 for i in range(len(rows))]
    parts = [{y: [c for c, (_, label), k in zip(clean, rows, side) if k == half and label == y] for y in (0, 1)} for half in (0, 1)]
    usable = all(p[0] and p[1] for p in parts)
    if not usable:
        parts = [{y: [c for c, (_, label) in zip(clean, rows) if label == y] for y in (0, 1)}] * 2
    starts = [{y: Starts(p[y], s) for y in (0, 1)} for p in parts]
    halves = []
    for own in (0, 1) if usable else (0,):
        other = 1 - own
        toxic = [w for _, w in leaning(parts[own][1], starts[other][1], starts[other][0], s)]
        # as many ordinary windows, those that lean to their label most
        ordinary = most_leaning(parts[own][0], starts[other][0], starts[other][1], s, max(len(toxic), 64))
        dictionaries = trained(toxic, s), trained(ordinary, s)
        meter = Meter(*dictionaries, s)
        x = np.array([meter.features(c) for y in (0, 1) for c in parts[other][y]])
        y = np.repeat([0.0, 1.0], [len(parts[other][0]), len(parts[other][1])])
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        halves.append(Half(*dictionaries, mean, scale, _logistic((x - mean) / scale, y, s.ridge)))
    return Model(halves, s)


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text is a multiple of 5 (a null id counts as empty)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model | None:
    """Fit on at most `sample_rows` labelled rows outside the held-out fold, taken in the order of a hash of their ids.

    Of a text of more than `sample_pieces` times `piece_chars` characters so many pieces
    are used, spread evenly from its start to its end; so what reaches the driver is
    bounded by the three settings.
    """
    order = [F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":sample"))), "doc_id"]
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    ids = known.groupBy("doc_id").agg(F.max("toxic").alias("label")).orderBy(*order).limit(s.sample_rows)
    most, last = s.sample_pieces * s.piece_chars, max(1, s.sample_pieces - 1)
    spread = f"concat_ws(' ', transform(sequence(0, {s.sample_pieces - 1}), i -> substring(text, cast(1 + i * (length(text) - {s.piece_chars}) div {last} as int), {s.piece_chars})))"
    texts = docs.select("doc_id", F.when(F.length("text") > most, F.expr(spread)).otherwise(F.col("text")).alias("text"))
    sample = texts.join(F.broadcast(ids), "doc_id").orderBy(*order, "text").limit(s.sample_rows)  # ids: sample_rows rows at most
    return fit([(r.text, r.label) for r in sample.select("text", "label").collect()], s)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """`docs` with `score` (0 to 1) and `predicted` (1 from 0.5 on), replacing columns of those names.

    Null and empty texts are scored like a text without words.  Without a model (no
    labelled rows of both kinds) every score is 0.
    """
    docs = docs.drop("score", "predicted")
    names = docs.columns

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer() if model else lambda _: 0.0
        for batch in batches:
            at = batch.schema.get_field_index("text")
            values = pa.array([of(t.as_py()) for t in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], [*names, "score"])

    schema = docs.select("*", F.lit(0.0).alias("score")).schema
    return docs.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model)  # the text leaves with the plan's last projection
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
