"""Scoring with a gated recurrent language model.

Word counts come from all training documents.  The network reads the most frequent words
(others by their frequency class) and predicts a class first and then a word within it:
the 4,096 most frequent words stand in 64 classes of 64 with a softmax over their words,
rarer ones of the head share out their class by count, and a last class holds every word
outside the head, unseen words included.

Tasks train copies of one starting network by truncated backpropagation on all their
documents and the copies are averaged, some at a time until one is left.  Documents are
packed onto lanes, whole and one after another, so that the state is carried from a
document's first word to its last, in training as in scoring, and its log-likelihood covers
all of it.

Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm._store import materialize, most_frequent
from tidemark.llm._text import LOWER, NOT_SPACE, Words, blocks

END = np.uint64(0)  # the hash of the empty word stands for the end of a document
ROWS = 1024  # states whose classes are computed at a time, so that they stay in a core's cache


@dataclass(frozen=True)
class Settings:
    head: int = 131_072  # most frequent words, whose counts every task holds
    words_per_class: int = 64
    word_classes: int = 64  # classes with a softmax over their words
    count_classes: int = 31  # classes whose words share out by count
    hidden: int = 16
    window: int = 32  # steps of truncated backpropagation
    lanes: int = 256  # documents that are read side by side in training
    stream: int = 4_000_000  # words that a task gathers before it trains on them, about
    rate: float = 0.01
    score_lanes: int = 4096
    score_words: int = 32_768  # words scored at a time
    average: int = 16  # copies averaged in one group
    seed: int = 7

    @property
    def soft(self) -> int:
        return self.words_per_class * self.word_classes

    @property
    def classes(self) -> int:
        return self.word_classes + self.count_classes + 1


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the id as text leaves 2 on division by 7 (a null id counts as empty)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def tokens(texts: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, token hashes, offsets) of blocks of texts; each text ends in END (null: only that)."""
    for rows, data, at in blocks(texts):
        words = Words(LOWER[data], at, NOT_SPACE)
        out = np.insert(words.hashes(), words.bounds[1:], END)
        yield rows, out, words.bounds + np.arange(len(at))


# -- counts -----------------------------------------------------------------------------


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        words, where = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
        return words, np.bincount(where, np.concatenate([n for _, n in held]), len(words)).astype(np.int64)

    def out() -> pa.RecordBatch:
        words, n = merged()
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])

    size = 0
    for batch in batches:
        for _, seen, _ in tokens(batch.column("text")):
            held.append(np.unique(seen, return_counts=True))
            size += len(held[-1][0])
            if size > 2_000_000:
                held[:] = [merged()]
                size = len(held[0][0])
                if size > 1_000_000:
                    yield out()
                    held.clear()
                    size = 0
    if held:
        yield out()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all rows of `docs`, END included, written to the shared folder."""
    partial = docs.select("text").mapInArrow(_count, "word long, n long")
    return materialize(partial.groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")


# -- the network -----------------------------------------------------------------------


@dataclass
class Vocabulary:
    """The head: hashes in order of frequency, counts, and the corpus totals."""

    words: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int
    s: Settings

    def __post_init__(self) -> None:
        s, n = self.s, len(self.words)
        order = np.argsort(self.words)
        self.order = np.append(order, n)
        self.sorted = np.append(self.words[order], ~np.uint64(0))  # closed by the largest hash, so that a search ends
        bits = max(1, (2 * n).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.sorted[:n], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)  # by leading bits
        rank = np.arange(n)
        shared = max(1, -(-max(0, n - s.soft) // s.count_classes))
        self.kind = np.where(rank < s.soft, rank // s.words_per_class, s.word_classes + (rank - s.soft) // shared)
        self.kind = np.append(self.kind, s.classes - 1)  # the last place stands for all other words
        self.rest = self.total - int(self.counts.sum()), self.distinct - n
        # what the network reads: a frequent word, or the class of another
        self.input = np.append(np.where(rank < s.soft, rank, s.soft + self.kind[:-1] - s.word_classes), s.soft + s.count_classes)
        mass = np.bincount(self.kind[:-1], self.counts, s.classes)
        mass[-1] = max(0, self.rest[0]) + 1
        self.mass = mass
        share = np.log(np.maximum(self.counts, 1) / np.maximum(mass[self.kind[:-1]], 1))
        self.share = np.append(np.where(rank < s.soft, 0.0, share), 0.0)  # what a word takes of its class, where counts decide

    def find(self, words: np.ndarray) -> np.ndarray:
        """Ranks of words; the size of the head for those outside."""
        at = self.first[words >> self.shift]
        left = np.flatnonzero(self.sorted[at] < words)
        while len(left):  # the few that are not the first of their leading bits
            at[left] += 1
            left = left[self.sorted[at[left]] < words[left]]
        return np.where(self.sorted[at] == words, self.order[at], len(self.words))

    @property
    def end(self) -> int:
        return int(self.find(np.array([END]))[0])


NAMES = ("embed", "carry", "bias", "to_class", "class_bias", "to_word", "word_bias")


class Network:
    def __init__(self, v: Vocabulary):
        s, h = v.s, v.s.hidden
        rng = np.random.default_rng(s.seed)
        self.v = v
        self.embed = rng.normal(0, 0.3, (s.soft + s.count_classes + 1, 3 * h)).astype(np.float32)
        self.carry = rng.normal(0, 1 / math.sqrt(h), (h, 3 * h)).astype(np.float32)
        self.bias = np.repeat([1.0, 0.0, 0.0], h).astype(np.float32)  # an update gate that keeps the state
        self.to_class = rng.normal(0, 0.05, (h, s.classes)).astype(np.float32)
        self.class_bias = np.log(v.mass + 1e-3).astype(np.float32)
        self.to_word = rng.normal(0, 0.05, (s.soft, h)).astype(np.float32)
        counts = np.zeros(s.soft)
        counts[: min(s.soft, len(v.counts))] = v.counts[: s.soft]
        self.word_bias = np.log(counts + 1e-9).astype(np.float32)  # places without a word get nothing
        self.moments = {k: (np.zeros_like(getattr(self, k)), np.zeros_like(getattr(self, k))) for k in NAMES}
        self.updates = 0

    def get(self) -> bytes:
        return b"".join(getattr(self, k).astype(np.float32).tobytes() for k in NAMES)

    def put(self, data: bytes | np.ndarray) -> Network:
        flat, at = np.frombuffer(data, np.float32) if isinstance(data, bytes) else data.astype(np.float32), 0
        for k in NAMES:
            old = getattr(self, k)
            setattr(self, k, flat[at : at + old.size].reshape(old.shape).copy())
            at += old.size
        return self

    def turned(self) -> tuple[np.ndarray, np.ndarray]:
        """What inputs (rows) and a state (columns) add to the gates; update and reset gates negated."""
        sign = np.repeat([-1, -1, 1], self.v.s.hidden).astype(np.float32)
        return (self.embed + self.bias) * sign, np.multiply(self.carry.T, sign[:, None], order="C")

    @staticmethod
    def step(gates: np.ndarray, h: np.ndarray, carry: np.ndarray, path: np.ndarray, c: np.ndarray, new: np.ndarray) -> np.ndarray:
        """The new state, from the input's gates; a lane is a column.

        Update gate, reset gate and carried candidate are left in `path`, the candidate in `c`.
        """
        n = len(h)
        np.matmul(carry, h, out=path)
        zr = path[: 2 * n]
        zr += gates[: 2 * n]
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        np.multiply(zr[n:], path[2 * n :], out=c)
        c += gates[2 * n :]
        np.tanh(c, out=c)
        np.subtract(h, c, out=new)
        new *= zr[:n]
        new += c
        return new

    def outputs(self, h: np.ndarray, rank: np.ndarray, grad: bool = False):
        """Natural log-probabilities of the words given states; with `grad`, also the gradients.

        Exponentials stay as they are: what divides them by their sum is applied to the narrow side of each product.
        """
        s, v = self.v.s, self.v
        kind, size, n = v.kind[rank], len(h), s.hidden
        weights = np.concatenate((self.to_class, [self.class_bias - self.class_bias.max()]))
        state = np.ones((size, n + 1), np.result_type(h, weights))  # a last place of 1, so that products take the biases in
        state[:, :n] = h
        picked, total = np.empty(size, state.dtype), np.empty(size, state.dtype)
        if grad:
            to_class, to_word, word_bias = np.zeros((s.classes, n + 1), state.dtype), np.zeros((s.soft, n), np.float32), np.zeros(s.soft, np.float32)
            dh = np.empty((size, n), state.dtype)
        far, ones, back = self._far(weights), np.ones(s.classes, np.float32), self.to_class.T.copy()
        buffer = np.empty((min(size, ROWS), s.classes), state.dtype)
        for low in range(0, size, ROWS):
            own = slice(low, min(low + ROWS, size))
            e = self._raised(state[own], weights, far, buffer[: own.stop - low])
            at = np.arange(0, e.size, s.classes) + kind[own]
            picked[own] = e.reshape(-1)[at]
            np.matmul(e, ones, out=total[own])
            if grad:
                e.reshape(-1)[at] -= total[own]
                to_class += e.T @ (state[own] / total[own, None])
                np.matmul(e, back, out=dh[own])
        out = np.log(picked / total) + v.share[rank]
        if grad:
            dh /= total[:, None]
        order = by_value(kind, s.classes)
        cuts = np.searchsorted(kind[order], np.arange(s.word_classes + 1))
        order = order[: cuts[-1]]
        held, kind = state[order], kind[order]
        place = (np.arange(len(order)) - cuts[kind]) * s.words_per_class + rank[order] % s.words_per_class
        picked, total = np.empty(len(order), state.dtype), np.empty(len(order), state.dtype)
        dinner = np.empty((len(order), n), np.result_type(state, self.to_word)) if grad else None
        bias = self.word_bias.reshape(s.word_classes, s.words_per_class)
        weights = np.concatenate((self.to_word, (bias - bias.max(axis=1, keepdims=True)).reshape(-1, 1)), axis=1)
        far, ones = self._far(weights.T), np.ones(s.words_per_class, np.float32)
        buffer = np.empty((np.diff(cuts).max(), s.words_per_class), np.result_type(state, weights))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            own, part = slice(cuts[k], cuts[k + 1]), slice(k * s.words_per_class, (k + 1) * s.words_per_class)
            e, sums = self._raised(held[own], weights[part].T, far, buffer[: own.stop - own.start]), total[own]
            flat, at = e.reshape(-1), place[own]
            found = picked[own] = flat[at]
            np.matmul(e, ones, out=sums)
            if grad:
                flat[at] = found - sums
                over = 1 / sums
                np.matmul(e.T, held[own, :n] * over[:, None], out=to_word[part])
                np.matmul(over, e, out=word_bias[part])
                np.matmul(e, self.to_word[part], out=dinner[own])
        out[order] += np.log(picked / total)
        if grad:
            dinner /= total[:, None]
            dh[order] += dinner
            g = {"to_class": to_class[:, :n].T.copy(), "class_bias": to_class[:, n].copy(), "to_word": to_word, "word_bias": word_bias}
        return (out, dh, g) if grad else out

    @staticmethod
    def _far(weights: np.ndarray) -> bool:
        """Whether a state, whose places lie between -1 and 1, can bring a logit beyond 60."""
        return not (np.ones(len(weights), np.float32) @ np.abs(weights)).max() < 59

    @staticmethod
    def _raised(h: np.ndarray, weights: np.ndarray, far: bool, out: np.ndarray) -> np.ndarray:
        """Exponentials of the logits, below the largest bias, in `out`; far ones are cut off."""
        logits = np.matmul(h, weights, out=out)
        if far:
            np.clip(logits, -60, 60, out=logits)
        return np.exp(logits, out=logits)

    def train(self, ranks: np.ndarray, offsets: np.ndarray) -> float:
        """One pass over all words of the documents in a stream; the mean loss of a word."""
        s, n = self.v.s, self.v.s.hidden
        stream, fresh, start, length = packed(ranks, offsets, s)
        if not len(stream):
            return 0.0
        x = self.v.input[np.where(fresh, self.v.end, np.append(stream[:1], stream[:-1]))]
        h, loss, summed, size = np.zeros((n, len(start)), np.float32), 0.0, {}, 0
        for low in range(0, int(length[0]), s.window):
            # lanes are sorted: longer ones first
            steps = np.arange(low, min(low + s.window, int(length[0])))
            live = np.searchsorted(-length, -steps, side="left").tolist()
            every = np.concatenate([start[:k] + t for k, t in zip(live, steps.tolist())])
            own = [slice(end - k, end) for k, end in zip(live, np.cumsum(live).tolist())]
            read, stay = x[every], (~fresh[every]).astype(np.float32)
            table, carry = self.turned()
            rows, states, past = table.take(read, axis=0), np.empty((len(every), n), np.float32), []
            for part in own:
                before = h[:, : part.stop - part.start] * stay[part]
                path, c = np.empty((3 * n, before.shape[1]), np.float32), np.empty_like(before)
                h = self.step(rows[part].T.copy(), before, carry, path, c, np.empty_like(before))
                states[part] = h.T
                past.append((before, path, c))
            out, dh, g = self.outputs(states, stream[every], True)
            loss -= float(out.sum())
            g["carry"], back = np.zeros_like(self.carry), np.zeros((n, 0), np.float32)
            for part, (before, path, c) in zip(reversed(own), reversed(past)):
                d, z, r, held = dh[part].T.copy(), path[:n], path[n : 2 * n], path[2 * n :]
                d[:, : back.shape[1]] += back
                # of the gates: [update, reset, candidate]; of what the state brings to them, in place: the last one times the reset gate
                to_gates = np.empty_like(path)
                dz, dr, dc = to_gates[:n], to_gates[n : 2 * n], to_gates[2 * n :]
                keep = 1 - z
                np.multiply(c, c, out=dc)
                np.subtract(1, dc, out=dc)
                dc *= keep
                dc *= d
                rows[part, 2 * n :] = dc.T
                dc *= r
                np.subtract(1, r, out=dr)
                dr *= held
                dr *= dc
                np.subtract(before, c, out=dz)
                keep *= d
                dz *= keep
                dz *= z
                rows[part, : 2 * n] = to_gates[: 2 * n].T
                g["carry"] += before @ to_gates.T
                back = self.carry @ to_gates
                d *= z
                back += d
                back *= stay[part]
            by = by_value(read, len(self.embed))
            read = read[by]
            first = np.flatnonzero(np.append(True, read[1:] != read[:-1]))
            found = np.add.reduceat(turn(rows.take(by, axis=0)), first, axis=1)
            g |= {"embed": np.zeros_like(self.embed), "bias": found.sum(axis=1)}
            g["embed"][read[first]] = found.T
            for k in summed:
                g[k] += summed[k]
            summed, size = g, size + len(every)
            if 2 * size >= s.lanes * s.window:  # where few lanes are left, several windows make one update
                self.update(summed, size)
                summed, size = {}, 0
        if size:
            self.update(summed, size)
        return loss / len(stream)

    def update(self, g: dict[str, np.ndarray], size: int) -> None:
        """One step of Adam, in place."""
        self.updates += 1
        rate, over_m, over_w = self.v.s.rate * min(1.0, self.updates / 20), 1 - 0.9**self.updates, math.sqrt(1 - 0.99**self.updates)
        for k in NAMES:
            step, weights, (m, w) = g[k], getattr(self, k), self.moments[k]
            step *= 0.1 / size
            m *= 0.9
            m += step
            step *= step
            w *= 0.99
            w += step
            np.sqrt(w, out=step)
            step += 1e-6 * over_w
            np.divide(m, step, out=step)
            step *= rate * over_w / over_m
            weights -= step

    def score(self, ranks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Natural log-likelihood of each document in the stream."""
        s, v = self.v.s, self.v
        gates_of, carry = self.turned()
        size = np.diff(offsets)
        order = np.argsort(-size, kind="stable")
        out = np.zeros(len(size))
        for i in range(0, len(order), s.score_lanes):
            own = order[i : i + s.score_lanes]
            start, length = offsets[own], size[own]
            h = np.zeros((s.hidden, len(own)), np.float32)
            states, words, lanes, held = [], [], [], 0
            every = np.searchsorted(-length, -np.arange(int(length[0])), side="left").tolist()
            word = np.full(len(own), v.end)

            def settle() -> None:
                found = self.outputs(np.concatenate(states), np.concatenate(words))
                lane = np.concatenate([np.arange(k) for k in lanes])
                out[own[: lanes[0]]] += np.bincount(lane, found, lanes[0])
                for x in (states, words, lanes):
                    x.clear()

            for t, live in enumerate(every):
                gates = np.ascontiguousarray(gates_of.take(v.input[word[:live]], axis=0).T)
                path, (c, new) = np.empty_like(gates), np.empty((2, s.hidden, live), np.float32)
                h, word = self.step(gates, h[:, :live], carry, path, c, new), ranks[start[:live] + t]
                states.append(h.T.copy())
                words.append(word)
                lanes.append(live)
                held += live
                if held >= s.score_words:
                    settle()
                    held = 0
            if states:
                settle()
        return out


def turn(x: np.ndarray) -> np.ndarray:
    """Rows as columns; they lie an odd number of cache lines apart, as a power of 2 would bring all to the same places of a cache."""
    out = np.empty((x.shape[1], len(x) // 32 * 32 + 48), x.dtype)[:, : len(x)]
    out[:] = x.T
    return out


def by_value(x: np.ndarray, below: int) -> np.ndarray:
    """The stable order of numbers from 0 to under `below`; 16 bits are sorted in linear time."""
    return np.argsort(x.astype(np.uint16) if below <= 65_536 else x, kind="stable")


def packed(ranks: np.ndarray, offsets: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents on lanes, each on the one that is shortest so far: (words lane by lane, whether one begins a document, lanes' starts, lengths).

    Lanes come longest first; within a lane, documents stand in a fixed random order.
    """
    size = np.diff(offsets)
    lanes = [(0, k) for k in range(min(s.lanes, len(size)))]
    own: list[list[int]] = [[] for _ in lanes]
    for i in np.argsort(-size, kind="stable").tolist():
        length, k = heapq.heappop(lanes)
        own[k].append(i)
        heapq.heappush(lanes, (length + int(size[i]), k))
    rng = np.random.default_rng(s.seed)
    own = [[part[j] for j in rng.permutation(len(part))] for _, k in sorted(lanes, reverse=True) if (part := own[k])]
    length = np.array([size[part].sum() for part in own], np.int64)
    order = np.array([i for part in own for i in part], np.int64)
    begin = np.cumsum(size[order]) - size[order]
    at = np.repeat(offsets[order] - begin, size[order]) + np.arange(size.sum())
    fresh = np.zeros(len(at), bool)
    fresh[begin[size[order] > 0]] = True
    return ranks[at], fresh, np.cumsum(length) - length, length


# -- Spark -------------------------------------------------------------------------------


def vocabulary(counts: DataFrame, s: Settings) -> Vocabulary:
    """The head and the totals: at most `head` rows reach the driver."""
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    head = most_frequent(counts, s.head).toPandas().sort_values(["n", "word"], ascending=[False, True])
    return Vocabulary(head["word"].to_numpy(np.int64).view(np.uint64), head["n"].to_numpy(np.int64), int(total or 0), int(distinct or 0), s)


def train(docs: DataFrame, v: Vocabulary) -> Network:
    """Copies of the starting network, each trained on what one task reads, averaged by the words they saw."""
    network = Network(v)
    if not len(v.words):
        return network

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, held, gathered = Network(v), 0, [], 0
        for batch in batches:
            for _, words, offsets in tokens(batch.column("text")):
                held.append((v.find(words).astype(np.int32), np.diff(offsets)))
                gathered += len(words)
                if gathered >= v.s.stream:
                    own.train(*joined(held))
                    seen, gathered = seen + gathered, 0
                    held.clear()
        if held:
            own.train(*joined(held))
            seen += gathered
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([seen], pa.int64()), pa.array([own.get()], pa.binary())], ["part", "seen", "weights"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        seen = pdf["seen"].to_numpy()
        mean = sum(np.frombuffer(w, np.float32) * (n / seen.sum()) for w, n in zip(pdf["weights"], seen))
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0]) // v.s.average], "seen": [int(seen.sum())], "weights": [mean.astype(np.float32).tobytes()]})

    schema = "part int, seen long, weights binary"
    copies = materialize(docs.select("text").mapInArrow(learn, schema), "lm-copies")
    while (n := copies.count()) > 1:  # a group holds few copies, however many there are
        copies = materialize(copies.groupBy(F.expr(f"part div {v.s.average}").alias("group")).applyInPandas(add, schema), "lm-means")
    last = copies.select("weights").collect() if n else []  # one network
    return network.put(bytes(last[0].weights)) if last else network


def joined(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Words and offsets of several blocks as one stream."""
    return np.concatenate([w for w, _ in held]), np.concatenate(([0], np.cumsum(np.concatenate([n for _, n in held]))))


SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, head_tokens long, base double, score double, tail array<struct<word:long,n:int>>"


def scored_batches(batches: Iterator[pa.RecordBatch], own: Network, over: float) -> Iterator[pa.RecordBatch]:
    """SCORED rows of the texts; those of several batches are read side by side, about `stream` words at a time."""
    v, s = own.v, own.v.s
    log_count, n_head = np.append(np.log10(v.counts + 1.0) - over, 0.0), len(v.words)
    names = [f.split()[0] for f in SCORED.split(", ")]
    parts, held, gathered = [], [], 0

    def settled() -> pa.RecordBatch:
        found = pa.array(own.score(*joined(held)) / math.log(10))
        *columns, tails = (pa.concat_arrays(c) for c in zip(*parts))
        parts.clear()
        held.clear()
        return pa.RecordBatch.from_arrays([*columns, found, tails], names)

    for batch in batches:
        ids = [batch.column(c) for c in names[:3]]
        for rows, words, offsets in tokens(batch.column("text")):
            rank, n = v.find(words), len(offsets) - 1
            row = np.repeat(np.arange(n), np.diff(offsets))
            inside = rank < n_head
            base = np.bincount(row, log_count[rank], n)
            held.append((rank.astype(np.int32), np.diff(offsets)))
            out, at = words[~inside], row[~inside]
            by = np.lexsort((out, at))
            out, at = out[by], at[by]
            first = np.flatnonzero(np.append(True, (out[1:] != out[:-1]) | (at[1:] != at[:-1]))) if len(out) else np.zeros(0, np.int64)
            cuts = np.searchsorted(at[first], np.arange(n + 1)).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(out[first].view(np.int64)), pa.array(np.diff(np.append(first, len(out))).astype(np.int32))], ["word", "n"])
            columns = np.diff(offsets), np.bincount(row, inside, n).astype(np.int64), base
            parts.append((*(c.take(np.arange(rows.start, rows.stop)) for c in ids), *map(pa.array, columns), pa.ListArray.from_arrays(pa.array(cuts), pairs)))
            gathered += len(words)
            if gathered >= s.stream:
                yield settled()
                gathered = 0
    if parts:
        yield settled()


def score(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """A row for each row of `docs` (doc_id, text) with counts and log10 scores under counts and network.

    Null and empty texts are one END.  Without training documents every word is unseen and
    the totals are 0.  Equal rows are scored each.
    """
    docs = docs.select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    learn = docs.where(~F.col("held_out"))
    counts = word_counts(learn)
    v = vocabulary(counts, s)
    network = train(learn, v)
    weights, over = network.get(), math.log10(v.total + v.distinct + 1)
    rest_over = math.log10(max(0, v.rest[0]) + max(0, v.rest[1]) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from scored_batches(batches, Network(v).put(weights), over)

    scored = materialize(docs.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(run, SCORED), "lm-scored")
    # words outside the head meet their counts; none of them is frequent
    tail = scored.select("rid", F.inline("tail")).join(counts.withColumnRenamed("n", "c"), "word", "left")
    c = F.coalesce("c", F.lit(0))
    sums = tail.groupBy("rid").agg(F.sum(F.col("n") * F.log10(c + 1)).alias("logs"), F.sum("n").alias("rare"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("known"))
    rare, logs = (F.coalesce(x, F.lit(0)) for x in ("rare", "logs"))
    return scored.drop("tail").join(sums, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("head_tokens") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + logs - rare * F.lit(over)).alias("base_score"), (F.col("score") + logs - rare * F.lit(rest_over)).alias("score"),
    )


def op2(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
