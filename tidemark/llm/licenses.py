"""License scans by diagonal voting.

All rolling word k-gram hashes of the documents are joined with the positions of the
same k-grams in license templates.  A hit votes for its diagonal, the offset between the
place in the document and the place in the template.  Neighbouring diagonals merge into
spans, so that a few inserted or missing words do not break a license apart.  A span covers
no more diagonals than its template has words, and is verified word by word against the
text: it must hold most of the template, and densely.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm._store import broadcast_up_to, materialize, numbered
from tidemark.llm._text import ALNUM_LOWER, LOWER, Words, blocks, utf8, window_hashes

K = 3

#: Phrases that name a license (fixed values): every place where the words stand consecutively counts.
PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}

#: Notices and license texts (fixed values, public license wording), by the label of the license.
TEMPLATES = {
    "mit-text": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ],
    "apache-2": [
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "licensed under the apache license version 2 0",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "gpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "this work is licensed under the gnu general public license version 3",
    ],
    "mpl-2": [
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    ],
    "cc-by": ["this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-sa": ["this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc-by-nc": [
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
        "licensed under cc by nc 4 0",
    ],
}


@dataclass(frozen=True)
class Settings:
    max_gap: int = 8  # neighbouring diagonals at most this far apart merge
    min_share: float = 0.8  # of a template's words that a verified span holds
    min_density: float = 0.5  # of a verified span's words that are the template's
    max_broadcast: int = 500_000  # spans up to which they are broadcast to the texts; beyond, both are shuffled


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    phrase: bool  # matched only as a whole


def templates(phrases: dict[str, str] = PHRASES, texts: dict[str, list[str]] = TEMPLATES) -> list[Template]:
    out = [Template(label, tuple(text.encode().split()), True) for label, text in phrases.items()]
    out += [Template(label, tuple(text.encode().split()), False) for label, group in texts.items() for text in group]
    if any(len(t.words) < K for t in out):
        raise ValueError(f"templates need {K} words")
    return out


def _grams(column: pa.Array) -> Iterator[tuple[slice, Words, np.ndarray, np.ndarray, np.ndarray]]:
    for rows, data, at in blocks(column):
        words = Words(LOWER[data], at, ALNUM_LOWER)
        yield rows, words, *window_hashes(words.hashes(), words.bounds, K)


def template_positions(spark, items: list[Template]) -> DataFrame:
    """(hash, template, place): a table whose size is that of the templates, fixed in this module or by the caller."""
    rows = []
    for i, t in enumerate(items):
        for _, _, hashes, _, _ in _grams(pa.array([b" ".join(t.words).decode()])):
            rows += [(int(h), i, p) for p, h in enumerate(hashes.astype(np.int64))]
    return spark.createDataFrame(rows, "hash long, template int, place int")


def _document_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rid = batch.column("rid")
        for rows, words, hashes, at, row in _grams(batch.column("text")):
            cuts = np.searchsorted(row, np.arange(len(words.counts) + 1)).astype(np.int32)
            arrays = pa.ListArray.from_arrays(pa.array(cuts), pa.array(hashes.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([rid[rows], arrays], ["rid", "hashes"])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [Words(LOWER[data], at, ALNUM_LOWER).counts for _, data, at in blocks(batch.column("text"))]
        counts = pa.array(np.concatenate(n) if n else [], pa.int64())
        kept = [batch.column(c) for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*kept, counts], [*(c for c in batch.schema.names if c != "text"), "n_words"])


def candidate_spans(docs: DataFrame, items: list[Template], s: Settings) -> DataFrame:
    """(rid, template, first, last): merged diagonals with votes enough to be worth a look."""
    grams = docs.select("rid", "text").mapInArrow(_document_grams, "rid long, hashes array<long>")
    rolled = grams.select("rid", F.posexplode("hashes").alias("pos", "hash"))
    index = F.broadcast(template_positions(docs.sparkSession, items))  # the templates, whatever the corpus
    sizes = F.array(*[F.lit(len(t.words)) for t in items])
    phrase = F.array(*[F.lit(t.phrase) for t in items])
    votes = (
        rolled.join(index, "hash")
        .groupBy("rid", "template", (F.col("pos") - F.col("place")).alias("diagonal"))
        .agg(F.count("*").alias("votes"), F.min("pos").alias("first"), (F.max("pos") + K - 1).alias("last"))
        .withColumn("size", sizes[F.col("template")])
        .withColumn("phrase", phrase[F.col("template")])
    )
    whole = votes.where("phrase and votes = size - 2").select("rid", "template", "first", "last")
    # windows as wide as the template, overlapping by half, bound what merges; in one of them lies every
    # license whose inserted words are at most half its size
    half = F.greatest(F.lit(1), F.floor(F.col("size") / 2)).cast("int")
    windowed = votes.where("not phrase").withColumn("at", F.floor(F.col("diagonal") / half)).withColumn("window", F.explode(F.array(F.col("at"), F.col("at") - 1)))
    order = Window.partitionBy("rid", "template", "window").orderBy("diagonal", "first")  # at most as many rows as two halves have diagonals
    before = F.lag("diagonal").over(order)
    step = before.isNull() | (F.col("diagonal") - before > s.max_gap)
    merged = (
        windowed.withColumn("span", F.sum(step.cast("int")).over(order))
        .groupBy("rid", "template", "window", "span")
        .agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"), F.first("size").alias("size"))
        .where((F.col("votes") + K - 1) >= F.col("size") * F.lit(s.min_share) * 0.5)
        .select("rid", "template", "first", "last")
        .distinct()
    )
    return whole.unionByName(merged)


FOUND = "rid long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long,share:double>>"


def dense(own: list[bytes], template: tuple[bytes, ...], s: Settings) -> tuple[int, int, float] | None:
    """(first, last, share) of the part of `own` that holds enough of the template's words in order, and densely; else None.

    Matching runs at either end go as long as the rest is too thin and enough is left.
    """
    blocks_ = [(m.a, m.size) for m in SequenceMatcher(None, own, template, autojunk=False).get_matching_blocks() if m.size]
    total = sum(n for _, n in blocks_)
    while blocks_ and total >= s.min_share * len(template):
        (low, n), (high, m) = blocks_[0], blocks_[-1]
        if total >= s.min_density * (high + m - low):
            return low, high + m - 1, total / len(template)
        if len(blocks_) == 1:
            return None
        gap = lambda i, j: blocks_[j][0] - blocks_[i][0] - blocks_[i][1]
        drop = 0 if gap(0, 1) / n >= gap(-2, -1) / m else -1  # the end with the wider gap for its size
        total -= blocks_.pop(drop)[1]
    return None


def _verifier(items: list[Template], s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("rid", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())])))])
        for batch in batches:
            out = []
            data, at = utf8(batch.column("text"))
            for i, (rid, spans) in enumerate(zip(batch.column("rid").to_pylist(), batch.column("spans").to_pylist())):
                text = LOWER[data[at[i] : at[i + 1]]]
                words = Words(text, np.array([0, len(text)]), ALNUM_LOWER)
                raw = text.tobytes()
                base, found = [], []
                for span in spans:
                    t, first, last = items[span["template"]], span["first"], span["last"]
                    size = len(t.words)
                    if not t.phrase:  # room for template words before and after the outermost hits
                        first, last = max(0, first - size), min(len(words) - 1, last + size)
                    own = [raw[a:b] for a, b in zip(words.starts[first : last + 1], words.ends[first : last + 1])]
                    if t.phrase:
                        if tuple(own) == t.words:
                            base.append((t.label, first))
                        continue
                    if held := dense(own, t.words, s):
                        found.append((t.label, first + held[0], first + held[1], held[2]))
                if not base and not found:
                    continue
                starts = [p for _, p in base]
                every = {label for label, _ in base} | {f[0] for f in found}
                out.append({
                    "rid": rid, "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
                    "base_labels": ",".join(sorted({label for label, _ in base})), "labels": ",".join(sorted(every)),
                    "score": 1.0 if base else max(f[3] for f in found), "spans": [dict(zip(("label", "first", "last", "share"), f)) for f in sorted(set(found))],
                })
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def scan(docs: DataFrame, items: list[Template] | None = None, s: Settings = Settings()) -> DataFrame:
    """A row for each row of `docs` (doc_id, text): n_words, base phrases, labels, score and verified spans.

    Words are runs of ASCII digits, letters (A-Z lower-cased) and non-ASCII characters;
    a null text has none.  Texts without a license have n_base 0, empty labels, null
    first and last words and score 0.  Rows are told apart by a stored number, so equal rows
    and equal ids are each scanned.
    """
    items = items or templates()
    docs = numbered(docs.select("doc_id", "text"), "license-rows")
    spans = materialize(candidate_spans(docs, items, s), "license-spans")
    grouped = spans.groupBy("rid").agg(F.collect_list(F.struct("template", "first", "last")).alias("spans"))  # those of one text
    grouped = broadcast_up_to(grouped, spans.count(), s.max_broadcast)
    found = docs.select("rid", "text").join(grouped, "rid").mapInArrow(_verifier(items, s), FOUND)
    counts = docs.mapInArrow(_word_counts, "doc_id long, rid long, n_words long")
    return counts.join(found, "rid", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("spans", F.array().cast("array<struct<label:string,first:long,last:long,share:double>>")).alias("spans"),
    )


def op4(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
