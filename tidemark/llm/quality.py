"""Quality rules: distribution divergence from language references.

Every document's histogram of character classes and of common words is compared with
the reference histograms of languages, gathered from the whole corpus, by the
Jensen-Shannon distance (base 2, so from 0 to 1).  Guards of minimum length keep texts
too short for a histogram from being judged by it, and languages with too little text from
being a reference.  A text is left out of its own language's reference when it is compared
with it.  Every language with enough text has a reference: the driver and the tasks hold 50
words and 10 classes for each.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm._text import LOWER, NOT_SPACE, Words, blocks, mix, span_hashes, utf8, window_hashes

SYMBOLS = b"#*$%&|<>"

#: Class of each byte; continuation bytes (255) are no characters of their own.
_CLASS = np.full(256, 9, dtype=np.uint8)  # control and other ASCII
_CLASS[0x61:0x7B] = 0
_CLASS[0x41:0x5B] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[[0x20, *range(0x09, 0x0E)]] = 3
_CLASS[list(b".,;:!?'\"()-")] = 4
_CLASS[list(SYMBOLS)] = 5
_CLASS[list(b"@/\\_+=~^`[]{}")] = 6
_CLASS[0x80:0xC0] = 255
_CLASS[0xC0:0xE0] = 7  # two bytes: Latin letters with marks, Greek, Cyrillic
_CLASS[0xE0:] = 8
N_CLASSES = 10

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True


@dataclass(frozen=True)
class Rules:
    """Parameters of the verdict."""

    common_words: int = 50  # words in a language's reference histogram
    max_char_distance: float = 0.35
    max_word_distance: float = 0.5
    min_chars: int = 200  # the character histogram is judged from here
    min_words: int = 50  # the word histogram is judged from here
    min_reference: int = 2000  # words that a language's reference is made of at least


def features(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts of each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (nulls: all 0)."""
    parts = defaultdict(list)
    for _, data, at in blocks(texts):
        words, n = Words(data, at, NOT_SPACE), len(at) - 1
        lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        chars = np.concatenate(([0], np.cumsum(lead[words.ends] - lead[words.starts])))
        symbols = np.concatenate(([0], np.cumsum(_SYMBOL[data])))
        parts["n_words"].append(words.counts)
        parts["word_chars"].append(np.diff(chars[words.bounds]))
        parts["n_symbols"].append(np.diff(symbols[at]))
        parts["n_dup_lines"].append(_dup_lines(data, at, words))
        parts["n_repeat_words"].append(_repeat_words(words, n))
    return {k: np.concatenate(v).astype(np.int64) for k, v in parts.items()}


def _dup_lines(data: np.ndarray, at: np.ndarray, words: Words) -> np.ndarray:
    n = len(at) - 1
    breaks = np.flatnonzero(data == 10)
    starts, ends = np.sort(np.concatenate((at[:-1], breaks + 1))), np.sort(np.concatenate((breaks, at[1:])))
    row = np.repeat(np.arange(n), np.diff(np.searchsorted(breaks, at)) + 1)
    worded = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, row = starts[worded], ends[worded], row[worded]
    keys = mix(span_hashes(data, starts, ends) + row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, first = np.unique(keys, return_index=True)
    return np.bincount(row, minlength=n) - np.bincount(row[first], minlength=n)


def _repeat_words(words: Words, n: int) -> np.ndarray:
    grams, at, row = window_hashes(words.hashes(), words.bounds, 3)
    keys = mix(grams + row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    often = np.zeros(len(keys), dtype=bool)
    often[order[1:][same]] = often[order[:-1][same]] = True
    covered = np.zeros(len(words) + 3, dtype=bool)
    for i in range(3):
        covered[at[often] + i] = True
    return np.diff(np.concatenate(([0], np.cumsum(covered)))[words.bounds])


def _lang_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, item, n): words (w), their number (t) and character classes (c) of each language, summed over runs of batches."""
    classes: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(N_CLASSES, np.int64))
    counts: dict[str, Counter] = defaultdict(Counter)

    def out() -> pa.RecordBatch:
        rows = [(lang, "c", str(i), int(n)) for lang, v in classes.items() for i, n in enumerate(v)]
        rows += [(lang, "t", "", c.total()) for lang, c in counts.items()]
        rows += [(lang, "w", w.decode("utf-8", "replace"), n) for lang, c in counts.items() for w, n in c.items()]
        classes.clear()
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))], ["lang", "kind", "item", "n"])

    for batch in batches:
        langs = batch.column("lang").fill_null("").to_pylist()
        data, at = utf8(batch.column("text"))
        for i, lang in enumerate(langs):
            text = data[at[i] : at[i + 1]]
            classes[lang] += np.bincount(_CLASS[text], minlength=256)[:N_CLASSES]
            counts[lang].update(text.tobytes().lower().split())
        if sum(map(len, counts.values())) > 300_000:
            yield out()
    yield out()


def language_references(docs: DataFrame, rules: Rules = Rules()) -> list[dict]:
    """Reference histograms of every language, from all its documents: each of `common_words` words."""
    tagged = docs.where("lang <> ''")
    rows = tagged.select("lang", "text").mapInArrow(_lang_counts, "lang string, kind string, item string, n long")
    totals = rows.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "item"))
    top = totals.withColumn("place", place).where(F.col("place") <= F.lit(max(rules.common_words, N_CLASSES)))
    # a named language may be a typing error: only those of enough text leave Spark, (words + classes) rows each
    enough = F.max(F.when(F.col("kind") == "t", F.col("n"))).over(Window.partitionBy("lang")) >= rules.min_reference
    top = top.withColumn("enough", enough).where("enough").collect()
    out: dict[str, dict] = {}
    for r in sorted(top, key=lambda r: (r.lang, r.kind, r.place)):
        ref = out.setdefault(r.lang, {"lang": r.lang, "classes": np.zeros(N_CLASSES), "words": [], "counts": [], "total": 0})
        if r.kind == "c":
            ref["classes"][int(r["item"])] = r.n
        elif r.kind == "t":
            ref["total"] = r.n
        elif r.place <= rules.common_words:
            ref["words"].append(r["item"].encode())
            ref["counts"].append(r.n)
    return list(out.values())


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances of the rows of p from q."""
    m = (p + q) / 2

    def kl(a: np.ndarray) -> np.ndarray:
        a = np.broadcast_to(a, m.shape)
        return np.where(a > 0, a * np.log2(np.where(a > 0, a, 1.0) / np.where(m > 0, m, 1.0)), 0.0).sum(axis=1)

    return np.sqrt(np.clip((kl(p) + kl(q)) / 2, 0.0, 1.0))


_CELLS = 4 << 20  # counts of common words held at once


def distances(texts: pa.Array, langs: list[str | None], references: list[dict], rules: Rules = Rules()) -> tuple[np.ndarray, ...]:
    """(characters, distance of classes, words, distance of words) of each text, both distances from the language nearest by their sum.

    They are NaN where there is nothing to compare with: no reference at all, or a text of a
    named language that has none without this text.
    """
    spans = [(b"".join(r["words"]), np.cumsum([0, *map(len, r["words"])])) for r in references]
    hashed = [span_hashes(np.frombuffer(d, np.uint8), e[:-1], e[1:]) for d, e in spans]
    table = np.unique(np.concatenate(hashed)) if hashed else np.zeros(0, np.uint64)
    number = {r["lang"]: k for k, r in enumerate(references)}
    of_text = np.array([number.get(x, -2) if x else -1 for x in langs], np.int64)  # -1: no language, -2: one without a reference
    parts = []
    for rows, data, at in blocks(texts):
        n, lang = len(at) - 1, of_text[rows]
        kind = _CLASS[data].astype(np.int64)
        row = np.repeat(np.arange(n), np.diff(at))
        real = kind != 255
        classes = np.bincount(row[real] * N_CLASSES + kind[real], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
        words = Words(LOWER[data], at, NOT_SPACE)
        chars, n_words = classes.sum(axis=1), words.counts
        best, d_char, d_word = np.full(n, np.inf), np.full(n, np.nan), np.full(n, np.nan)
        if len(table):
            hashes = words.hashes()
            slot = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
            known = table[slot] == hashes
            of, slot, step = words.rows()[known], slot[known], max(1, _CELLS // len(table))
            for low in range(0, n, step):  # so many texts that their counts stay small, however many languages there are
                high = min(n, low + step)
                a, b = np.searchsorted(of, (low, high))
                common = np.bincount((of[a:b] - low) * len(table) + slot[a:b], minlength=(high - low) * len(table)).reshape(high - low, len(table))
                part, total = slice(low, high), n_words[low:high]
                for k, (ref, own) in enumerate(zip(references, hashed)):
                    mine = lang[part] == k  # these are part of the reference, so they are taken out of it
                    count = common[:, np.searchsorted(table, own)]
                    word, char = (
                        js_distance(_shares(count, total), _shares(ref["counts"] - count * mine[:, None], ref["total"] - total * mine)),
                        js_distance(_shares(classes[part]), _shares(ref["classes"] - classes[part] * mine[:, None])),
                    )
                    nearer = (word + char < best[part]) & ~(mine & (ref["total"] - total < rules.min_reference))
                    best[part] = np.where(nearer, word + char, best[part])
                    d_word[part], d_char[part] = np.where(nearer, word, d_word[part]), np.where(nearer, char, d_char[part])
                totals = np.array([r["total"] for r in references])
                alone = (lang[part] == -2) | ((lang[part] >= 0) & (totals[np.maximum(lang[part], 0)] - total < rules.min_reference))
                d_word[part] = np.where(alone, np.nan, d_word[part])
                d_char[part] = np.where(alone, np.nan, d_char[part])
        parts.append((chars, d_char, n_words, d_word))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0),) * 4


def _shares(counts: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
    """Rows of counts as shares; with `total`, a last share is that of all else."""
    if total is None:
        return counts / np.maximum(counts.sum(axis=1), 1)[:, None]
    p = counts / np.maximum(total, 1)[:, None]
    return np.column_stack((p, 1 - p.sum(axis=1)))


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"


def judge(docs: DataFrame, rules: Rules = Rules(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The counts, distances and verdict of each document, beside its columns `keep`.

    Null and empty texts have no words and fail the base rules.  Texts without a language are
    judged like others, against the nearest reference, but give none.  Where there is no
    reference (no tagged text, or a named language of too little text without this one)
    only the base rules count and the distances are null.  Columns of other names are left
    out.
    """
    references = language_references(docs, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            f = features(batch.column("text"))
            chars, d_char, n_words, d_word = distances(batch.column("text"), batch.column("lang__").to_pylist(), references, rules)
            failed = (f["n_words"] < 50) | (100 * f["n_repeat_words"] > 50 * f["n_words"])
            far = ((chars >= rules.min_chars) & (d_char > rules.max_char_distance)) | ((n_words >= rules.min_words) & (d_word > rules.max_word_distance))  # NaN is not beyond
            own = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, (*f.values(), failed, ~(failed | far))), *(pa.array(d, from_pandas=True) for d in (d_char, d_word))], [*keep, *f, "base_failed", "kept", "char_distance", "word_distance"])

    head = [docs.schema[c].simpleString().replace(":", " ", 1) for c in keep]
    return docs.select(*keep, "text", F.col("lang").alias("lang__")).mapInArrow(run, ", ".join([*head, SCHEMA.split(", ", 1)[1]]))


def op6(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
