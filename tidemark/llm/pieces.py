"""SentencePiece encoding and decoding, giant documents by a max-plus parallel scan.

A sequence of pieces is the BPE encoding of a text exactly if every two neighbours are
compatible, that is if the two alone encode to themselves (no merge ever crosses their
border).  With weight 0 for compatible neighbours and minus infinity for others, encoding
is a best-path problem over (max, +), and the path of weight 0 is unique.

A giant document is cut into chunks at any place.  A chunk's transfer matrix holds the
weight from each boundary state on its left (a piece that reaches over the border, and
how far) to each on its right.  Matrices combine associatively, first within blocks of
chunks and then across blocks; the states on the best path follow, and each chunk is
then traced back on its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from tidemark.llm._store import lean, materialize
from tidemark.llm._text import blocks, span_hashes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"

_CHUNK_CHARS = 16_384
_GIANT_BYTES = 32_768
_BLOCK_CHUNKS = 256
_TASK_CHUNKS = 64
_CACHE_UNITS = 400_000
_SLICE_ROWS = 250  # rows worked on at a time, so that a task holds little besides the batch it is given
_DECODE_IDS = 65_536  # ids decoded at a time, and those of one text at least
_TRACED_UNITS = 50_000
_WIDE = 48  # longer units are merged one by one
_NONE = np.int32(2**31 - 1)


class Pieces:
    """The vocabulary of a BPE model with byte fallback, and its encoder for one text."""

    def __init__(self, model: str = MODEL):
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.vocab_size()
        self.names = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) for i in range(n)]
        if not all(f"<0x{b:02X}>" in self.names for b in (0, 255)):
            raise ValueError("the model has no byte fallback")
        self.of_byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.ids = {name.replace(SPACE, " "): i for i, name in enumerate(self.names) if not special[i]}
        if any(" " in name.lstrip(" ") for name in self.ids) or any("\n" in name for name in self.ids):
            raise ValueError("a piece crosses a word border")
        self.longest = max(map(len, self.ids))
        _, place = np.unique([-sp.get_score(i) for i in self.ids.values()], return_inverse=True)
        self.rank = dict(zip(self.ids.values(), map(int, place)))
        merges = {(self.ids[t[:k]], self.ids[t[k:]]): i for t, i in self.ids.items() for k in range(1, len(t)) if t[:k] in self.ids and t[k:] in self.ids}
        self.merges = merges
        keys = np.array([a * n + b for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.size, self.keys = n, keys[order]
        self.merged = np.array(list(merges.values()), np.int32)[order]
        self.ranks = np.array([self.rank[i] for i in self.merged], np.int32)
        # bytes of each id, for decoding: control pieces have none
        text = [bytes([self.of_byte.index(i)]) if sp.is_byte(i) else b"" if special[i] else name.replace(SPACE, " ").encode() for i, name in enumerate(self.names)]
        self.flat = np.frombuffer(b"".join(text), np.uint8)
        self.bounds = np.cumsum([0, *map(len, text)])
        self.solo = lru_cache(1 << 16)(self._solo)
        self.compatible = lru_cache(1 << 17)(self._compatible)
        self.units = Units()

    def merge(self, text: str) -> list[int]:
        """The pieces of a text (spaces as they are): best rank first, leftmost of equals; characters without a piece are -1 - code."""
        ids = [self.ids.get(c, -1 - ord(c)) for c in text]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(ids):
                m = self.merges.get((ids[i], ids[after[i]]))
                if m is not None:
                    heapq.heappush(heap, (self.rank[m], i, ids[i], ids[after[i]]))

        for i in range(len(ids) - 1):
            offer(i)
        gone = [False] * len(ids)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if not gone[i] else len(ids)
            if j >= len(ids) or ids[i] != a or ids[j] != b:
                continue
            ids[i], gone[j], after[i] = self.merges[a, b], True, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [x for x, g in zip(ids, gone) if not g]

    def expand(self, ids: list[int]) -> list[int]:
        """Characters without a piece become bytes."""
        out: list[int] = []
        for i in ids:
            if i >= 0:
                out.append(i)
            else:
                out += [self.of_byte[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass")]
        return out

    def name(self, i: int) -> str:
        return self.names[i].replace(SPACE, " ") if i >= 0 else chr(-1 - i)

    def _solo(self, i: int) -> bool:
        return i < 0 or self.merge(self.name(i)) == [i]

    def _compatible(self, a: int, b: int) -> bool:
        return a < 0 or b < 0 or self.merge(self.name(a) + self.name(b)) == [a, b]

    def lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged piece) of pairs; rank _NONE where they don't merge."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        ok = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(ok, self.ranks[at], _NONE), self.merged[at]

    def merge_many(self, units: list[str]) -> list[list[int]]:
        """merge() of many short texts in lockstep: each round merges one pair in each text."""
        out: list[list[int]] = [[]] * len(units)
        sizes = np.array([len(u) for u in units])
        for i in np.flatnonzero(sizes > _WIDE):
            out[i] = self.merge(units[i])
        for low, high in ((0, 4), (4, 8), (8, 12), (12, 16), (16, 24), (24, _WIDE)):
            picked = np.flatnonzero((sizes > low) & (sizes <= high))
            for k in range(0, len(picked), 65_536):
                own = picked[k : k + 65_536]
                codes = np.frombuffer("".join([units[i] for i in own]).encode("utf-32-le", "surrogatepass"), np.uint32)
                kinds, where = np.unique(codes, return_inverse=True)
                ids = np.array([self.ids.get(chr(c), -1 - int(c)) for c in kinds], np.int32)[where]
                length = sizes[own]
                grid = np.full((len(own), high + 1), -(2**31), np.int32)  # pads never merge
                grid[np.repeat(np.arange(len(own)), length), np.arange(len(ids)) - np.repeat(np.cumsum(length) - length, length)] = ids
                self._rounds(grid, length)
                for i, row, n in zip(own, grid.tolist(), length.tolist()):
                    out[i] = row[:n]
        return out

    def _rounds(self, grid: np.ndarray, length: np.ndarray) -> None:
        width = grid.shape[1]
        columns = np.arange(width)
        ranks, _ = self.lookup(grid[:, :-1].ravel(), grid[:, 1:].ravel())
        ranks = np.concatenate((ranks.reshape(len(grid), width - 1), np.full((len(grid), 1), _NONE)), axis=1)
        rows = np.arange(len(grid))
        while len(rows):
            at = ranks.argmin(axis=1)
            keep = ranks[np.arange(len(rows)), at] < _NONE
            rows, at, ranks = rows[keep], at[keep], ranks[keep]
            if not len(rows):
                return
            every = np.arange(len(rows))
            part = grid[rows]
            _, merged = self.lookup(part[every, at], part[every, at + 1])
            source = np.minimum(columns + (columns > at[:, None]), width - 1)
            part, ranks = np.take_along_axis(part, source, 1), np.take_along_axis(ranks, source, 1)
            part[every, at] = merged
            part[:, -1], ranks[:, -1] = -(2**31), _NONE
            ranks[every, at], _ = self.lookup(part[every, at], part[every, at + 1])
            left = np.maximum(at - 1, 0)
            redone, _ = self.lookup(part[every, left], part[every, left + 1])
            ranks[every, left] = np.where(at > 0, redone, ranks[every, left])
            grid[rows] = part
            length[rows] -= 1

    # -- whole texts -------------------------------------------------------------------

    def decode_arrays(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of the texts of many id sequences and their bounds; the added first space is dropped."""
        size = self.bounds[ids + 1] - self.bounds[ids]
        ends = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(self.bounds[ids] - ends[:-1], size) + np.arange(ends[-1])
        data, bounds = self.flat[at], ends[offsets]
        first = bounds[:-1][np.diff(bounds) > 0]
        keep = np.ones(len(data), bool)
        keep[first] = data[first] != 0x20
        kept = np.concatenate(([0], np.cumsum(keep)))
        return data[keep].tobytes(), kept[bounds]


class Units:
    """Encoded units as arrays: hashes in order, the place of each, and the ids by place.

    A dict of the hashes takes several times the memory, in every worker and as long as it lives.
    """

    def __init__(self):
        self.hashes, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, unit: np.ndarray) -> np.ndarray:
        """Places of hashes; -1 for those not held."""
        if not len(self):
            return np.full(len(unit), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, unit), len(self) - 1)
        return np.where(self.hashes[at] == unit, self.places[at], -1).astype(np.int64)

    def add(self, unit: np.ndarray, coded: list[list[int]]) -> np.ndarray:
        """The places of new hashes, which come in order, and are given the ids `coded`."""
        at, places = np.searchsorted(self.hashes, unit), np.arange(len(self), len(self) + len(unit))
        self.hashes, self.places = np.insert(self.hashes, at, unit), np.insert(self.places, at, places)
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        self.ids = np.append(self.ids, np.fromiter((x for c in coded for x in c), np.int32, int(size.sum())))
        self.bounds = np.append(self.bounds, self.bounds[-1] + np.cumsum(size))
        return places


_loaded: dict[str, Pieces] = {}


def pieces(model: str = MODEL) -> Pieces:
    if model not in _loaded:
        _loaded[model] = Pieces(model)
    return _loaded[model]


def _plain(texts: pa.Array) -> pa.Array:
    """Texts as the model sees them: its own space sign is a space, and a text that isn't empty starts with one."""
    import pyarrow.compute as pc

    texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_utf8()), ""), SPACE, " ")
    some = pc.greater(pc.binary_length(texts), 0)
    return pc.if_else(some, pc.binary_join_element_wise(pa.scalar("", pa.large_utf8()), texts, pa.scalar(" ", pa.large_utf8())), texts)


def encode_batch(texts: pa.Array, p: Pieces) -> pa.ListArray:
    """Ids of each text.  A text falls into units, each the spaces before a word and the word, encoded once per process."""
    if len(p.units) > _CACHE_UNITS:
        p.units = Units()
    known = p.units
    out, counts = [], []
    for _, data, at in blocks(_plain(texts)):
        first = np.zeros(len(data) + 1, bool)
        space, line = data == 0x20, data == 0x0A
        first[:-1] = line
        first[1:-1] |= (space[1:] & ~space[:-1]) | line[:-1]
        first[at[at < len(data)]] = True
        begin = np.flatnonzero(first[:-1])
        end = np.append(begin[1:], len(data)) if len(begin) else begin
        unit, where = np.unique(span_hashes(data, begin, end), return_inverse=True)
        sample = np.zeros(len(unit), np.int64)
        sample[where] = np.arange(len(begin))
        places = known.find(unit)
        fresh = np.flatnonzero(places < 0)
        if len(fresh):
            raw = data.tobytes()
            own = [raw[begin[i] : end[i]].decode("utf-8", "surrogatepass") for i in sample[fresh]]
            coded = p.merge_many(own)
            places[fresh] = known.add(unit[fresh], [p.expand(c) if min(c) < 0 else c for c in coded])
        place = places[where]
        low = known.bounds[place]
        size = known.bounds[place + 1] - low
        ends = np.concatenate(([0], np.cumsum(size)))
        out.append(known.ids[np.repeat(low - ends[:-1], size) + np.arange(ends[-1])])
        counts.append(np.diff(ends[np.searchsorted(begin, at)]))
    offsets = np.concatenate(([0], np.cumsum(np.concatenate(counts)))) if counts else np.zeros(1, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(out) if out else [], pa.int32()))


def decode_batch(ids: pa.ListArray, p: Pieces) -> pa.Array:
    """The text of each id sequence."""
    if ids.null_count:
        ids = ids.fill_null(pa.scalar([], ids.type))
    offsets, values, parts, row = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False), [], 0
    while row < len(ids):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + _DECODE_IDS, side="right")) - 1)
        data, at = p.decode_arrays(values[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        try:
            data.decode()
            parts.append(pa.LargeStringArray.from_buffers(end - row, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)).cast(pa.utf8()))
        except UnicodeDecodeError:
            parts.append(pa.array([data[i:j].decode("utf-8", "replace") for i, j in zip(at[:-1], at[1:])], pa.utf8()))
        row = end
    return pa.concat_arrays(parts) if parts else pa.array([], pa.utf8())


def _slices(batches: Iterator[pa.RecordBatch], rows: int = _SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


# -- the scan over chunks of one document ---------------------------------------------------

#: A boundary state: the piece that starts left of the border and ends `over` characters right of it.
State = tuple[int, int]
CLEAN: State = (0, -1)  # the border lies between two units, so nothing on the left matters


def _starts(text: str, i: int) -> bool:
    return i <= 0 or i >= len(text) or "\n" in text[i - 1 : i + 1] or (text[i] == " " and text[i - 1] != " ")


def _pieces_at(p: Pieces, text: str, i: int, limit: int) -> Iterator[tuple[int, int]]:
    """(piece, end) of the pieces that start at i and end at most at `limit`."""
    one = p.ids.get(text[i])
    yield (-1 - ord(text[i]) if one is None else one), i + 1
    if one is not None:
        for j in range(i + 2, min(limit, i + p.longest) + 1):
            if (piece := p.ids.get(text[i:j])) is not None:
                yield piece, j


def _unit_end(text: str, i: int) -> int:
    """Where the unit that holds the border before i ends, as far as the text shows."""
    while i < len(text) and not _starts(text, i):
        i += 1
    return i


def states(p: Pieces, text: str, border: int) -> list[State]:
    """Boundary states at a border, from the text around it."""
    if _starts(text, border):
        return [CLEAN]
    low = border - 1
    while low > 0 and not _starts(text, low) and border - low < p.longest:
        low -= 1
    end = _unit_end(text, border)
    return sorted({(piece, j - border) for i in range(low, border) for piece, j in _pieces_at(p, text, i, end) if j >= border and p.solo(piece)})


def _walk(p: Pieces, text: str, at: int, last: int | None, stop: int, limit: int) -> dict[int, tuple[int, int]]:
    """(piece, start) that ends at each place reached from `at` after the piece `last`; pieces start before `stop` and end by `limit`."""
    reached: dict[int, tuple[int, int]] = {}
    seen = {at: last}
    for i in range(at, stop):
        if i not in seen:
            continue
        before = seen[i]
        for piece, j in _pieces_at(p, text, i, limit):
            if j not in seen and (p.solo(piece) if before is None else p.compatible(before, piece)):
                seen[j], reached[j] = piece, (piece, i)
    return reached


class Chunk:
    """A stretch text[low:high] of a document, seen with some text on both sides."""

    def __init__(self, p: Pieces, text: str, low: int, high: int):
        self.p, self.text, self.low, self.high = p, text, low, high
        self.left, self.right = states(p, text, low), states(p, text, high)
        self.head = low if self.left == [CLEAN] else _unit_end(text, low)  # where the first unit that starts in the chunk does
        tail = high
        while tail > self.head and not _starts(text, tail):
            tail -= 1
        self.tail = tail if self.right != [CLEAN] else high
        self.end = _unit_end(text, high)

    def _from(self, state: State, stop: int, limit: int) -> tuple[int, int | None, dict]:
        at, last = (self.low, None) if state == CLEAN else (self.low + state[1], state[0])
        return at, last, _walk(self.p, self.text, at, last, stop, limit)

    def _exits(self, at: int, last: int | None, reached: dict) -> np.ndarray:
        """Weights of the right states when the places `reached` from `at` are."""
        out = np.full(len(self.right), -np.inf, np.float32)
        for k, (piece, over) in enumerate(self.right):
            start = self.high + over - len(self.p.name(piece))
            before = last if start == at else reached.get(start, (None,))[0]
            if start == at and last is None or before is not None and self.p.compatible(before, piece):
                out[k] = 0
        return out

    def matrix(self) -> np.ndarray:
        """Weights from each left state to each right state."""
        out = np.full((len(self.left), len(self.right)), -np.inf, np.float32)
        inside = self.head <= self.high and (self.head < self.high or self.right == [CLEAN])
        if not inside:  # one unit reaches over the whole chunk
            for k, state in enumerate(self.left):
                at, last, reached = self._from(state, self.high, self.end)
                if at >= self.high:  # one piece does
                    out[k] = [0 if (piece, self.high + over) == (state[0], at) else -np.inf for piece, over in self.right]
                else:
                    out[k] = self._exits(at, last, reached)
            return out
        tail = np.zeros(1, np.float32) if self.right == [CLEAN] else self._exits(self.tail, None, _walk(self.p, self.text, self.tail, None, self.high, self.end))
        for k, state in enumerate(self.left):
            at, _, reached = self._from(state, self.head, self.head)
            if at == self.head or self.head in reached:
                out[k] = tail
        return out

    def trace(self, left: int, right: int) -> list[int]:
        """Ids of the pieces that start in the chunk, on the path from one state to another."""
        p, out = self.p, []

        def back(reached: dict, end: int, at: int) -> list[int]:
            ids = []
            while end > at:
                piece, end = reached[end]
                ids.append(piece)
            return ids[::-1]

        state, leave = self.left[left], self.right[right]
        inside = self.head <= self.high and (self.head < self.high or leave == CLEAN)
        last_start = None if leave == CLEAN else self.high + leave[1] - len(p.name(leave[0]))
        if not inside:
            at, _, reached = self._from(state, self.high, self.end)
            if at < self.high:
                out = [*back(reached, last_start, at), leave[0]]
            return p.expand(out)
        at, _, reached = self._from(state, self.head, self.head)
        out = back(reached, self.head, at)
        i = self.head
        while i < self.tail:
            j = min(_unit_end(self.text, i + 1), self.tail)
            out += _unit_ids(p, self.text[i:j])
            i = j
        if leave != CLEAN:
            out += [*back(_walk(p, self.text, self.tail, None, self.high, self.end), last_start, self.tail), leave[0]]
        return p.expand(out)


_units: dict[str, list[int]] = {}


def _unit_ids(p: Pieces, unit: str) -> list[int]:
    if len(_units) > _TRACED_UNITS:
        _units.clear()
    if unit not in _units:
        _units[unit] = p.merge(unit)
    return _units[unit]


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (max, +) product."""
    return (a[:, :, None] + b[None]).max(axis=1)


def split(text: str, p: Pieces, size: int = _CHUNK_CHARS) -> Iterator[tuple[int, str, int, int]]:
    """(chunk, text around, low, high) of a text as the model sees it."""
    around = 2 * p.longest
    for k, i in enumerate(range(0, len(text), size)):
        low, high = max(0, i - around), min(len(text), i + size)
        yield k, text[low : high + around], i - low, high - low


def best_states(matrices: list[np.ndarray]) -> list[int]:
    """The state at each border (the first and the last included) on the best path through a row of matrices."""
    ahead = [np.zeros(matrices[0].shape[0], np.float32)]
    for m in matrices:
        ahead.append((ahead[-1][:, None] + m).max(axis=0))
    behind = [np.zeros(matrices[-1].shape[1], np.float32)]
    for m in reversed(matrices):
        behind.append((m + behind[-1][None]).max(axis=1))
    return [int((a + b).argmax()) for a, b in zip(ahead, reversed(behind))]


def _pack(m: np.ndarray) -> dict:
    return {"rows": m.shape[0], "matrix": m.astype(np.float32).tobytes()}


def _unpack(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(m, np.float32).reshape(rows, -1) for rows, m in zip(pdf["rows"], pdf["matrix"])]


def _giants(docs: DataFrame, model: str, chunk_chars: int) -> DataFrame:
    """(rid, ids) of long documents: matrices of chunks, products of blocks, states of blocks, states of chunks, traces."""

    @lean
    def cut(batches):
        for batch in batches:
            p = pieces(model)
            for rid, text in zip(batch.column("rid").to_pylist(), _plain(batch.column("text"))):
                rows = [(rid, *row) for row in split(text.as_py(), p, chunk_chars)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["rid", "chunk", "around", "low", "high"])

    @lean
    def weigh(batches):
        p = pieces(model)
        for batch in _slices(batches, _TASK_CHUNKS):
            packed = [_pack(Chunk(p, r["around"], r["low"], r["high"]).matrix()) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("chunk"), pa.array([x["rows"] for x in packed], pa.int64()), pa.array([x["matrix"] for x in packed], pa.binary())], ["rid", "chunk", "rows", "matrix"])

    def product(key, pdf):
        m = _unpack(pdf.sort_values("chunk"))
        while len(m) > 1:  # pairs of neighbours: the order of products is free
            m = [times(*m[i : i + 2]) if i + 1 < len(m) else m[i] for i in range(0, len(m), 2)]
        return pd.DataFrame([{"rid": key[0], "block": key[1], **_pack(m[0])}])

    def across(key, pdf):
        pdf = pdf.sort_values("block")
        at = best_states(_unpack(pdf))
        return pd.DataFrame({"rid": key[0], "block": pdf["block"], "enter": at[:-1], "leave": at[1:]})

    def within(key, own, ends):
        own = own.sort_values("chunk")
        m = _unpack(own)
        enter, leave = int(ends["enter"].iloc[0]), int(ends["leave"].iloc[0])
        m[0] = m[0][enter : enter + 1]
        m[-1] = m[-1][:, leave : leave + 1]
        at = best_states(m)
        at[0], at[-1] = enter, leave
        return pd.DataFrame({"rid": key[0], "chunk": own["chunk"], "enter": at[:-1], "leave": at[1:]})

    @lean
    def trace(batches):
        p = pieces(model)
        for batch in _slices(batches, _TASK_CHUNKS):
            ids = [Chunk(p, r["around"], r["low"], r["high"]).trace(r["enter"], r["leave"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("chunk"), pa.array(ids, pa.list_(pa.int32()))], ["rid", "chunk", "ids"])

    chunks = materialize(docs.select("rid", "text").mapInArrow(cut, "rid long, chunk long, around string, low long, high long").withColumn("block", F.expr(f"chunk div {_BLOCK_CHUNKS}")), "piece-chunks")
    spread = chunks.repartition(max(1, -(-chunks.count() // _TASK_CHUNKS)), "rid", "chunk")  # chunks are few bytes but much work
    weights = materialize(spread.mapInArrow(weigh, "rid long, chunk long, rows long, matrix binary").withColumn("block", F.expr(f"chunk div {_BLOCK_CHUNKS}")), "piece-weights")
    blocks_ = weights.groupBy("rid", "block").applyInPandas(product, "rid long, block long, rows long, matrix binary")
    ends = blocks_.groupBy("rid").applyInPandas(across, "rid long, block long, enter long, leave long")
    at = weights.groupBy("rid", "block").cogroup(ends.groupBy("rid", "block")).applyInPandas(within, "rid long, chunk long, enter long, leave long")
    traced = chunks.join(at, ["rid", "chunk"]).select("rid", "chunk", "around", "low", "high", "enter", "leave").mapInArrow(trace, "rid long, chunk long, ids array<int>")
    return traced.groupBy("rid").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "ids"))), lambda c: c["ids"])).alias("ids"))


def encode(docs: DataFrame, model: str = MODEL, chunk_chars: int = _CHUNK_CHARS, giant_bytes: int = _GIANT_BYTES, decoded: bool = False) -> DataFrame:
    """`docs` with `ids`, the piece ids of `text`; a column of that name is replaced.

    With `decoded`, also the text that the ids give again, as decode() adds it.

    Null and empty texts have no ids.  Texts beyond `giant_bytes` go through the scan over
    chunks, the others are encoded in one step; the ids are the same either way, and the
    same as the library's.
    """
    docs = docs.drop("ids", *["decoded"] * decoded)
    names = docs.columns
    giant = F.coalesce(F.octet_length("text"), F.lit(0)) > giant_bytes

    @lean
    def run(batches):
        p, at = pieces(model), names.index("text")
        for batch in _slices(batches):
            ids = encode_batch(batch.column(at), p)
            out = [*batch.columns, ids, *[decode_batch(ids, p)] * decoded]
            yield pa.RecordBatch.from_arrays(out, [*names, "ids", *["decoded"] * decoded])

    schema = docs.select("*", F.array().cast("array<int>").alias("ids"), *[F.lit("").alias("decoded")] * decoded).schema
    short = docs.where(~giant).mapInArrow(run, schema)
    if docs.where(giant).isEmpty():
        return short
    long_ = materialize(docs.where(giant).withColumn("__row", F.monotonically_increasing_id()), "piece-giants")
    coded = _giants(long_.select(F.col("__row").alias("rid"), "text"), model, chunk_chars)
    coded = long_.join(coded.select(F.col("rid").alias("__row"), "ids"), "__row").select(*names, "ids")
    return short.unionByName(decode(coded, model) if decoded else coded)


def decode(coded: DataFrame, model: str = MODEL) -> DataFrame:
    """`coded` with `decoded`, the text of its `ids` (null: empty); a column of that name is replaced.

    Bytes that are no UTF-8 become replacement characters, as in the library.
    """
    coded = coded.drop("decoded")
    names = coded.columns

    @lean
    def run(batches):
        p = pieces(model)
        for batch in _slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, decode_batch(batch.column(names.index("ids")), p)], [*names, "decoded"])

    schema = coded.select("*", F.lit("").alias("decoded")).schema
    return coded.mapInArrow(run, schema)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = encode(docs, decoded=True)
    same = F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit(SPACE), F.lit(" "))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), F.sha2("decoded", 256).alias("decoded_sha256"), same.alias("round_trip"))
