"""Hard negatives, token counts and vector codes against brute force on small tables with hostile rows."""

import collections
import dataclasses
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import _vectors, codes, counts, negatives
from tidemark.llm._store import Scratch, _qualified, new_path

VECTORS = "vec_id long, embedding array<double>, label int"


def hostile(n=260, dim=8, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 1, (5, dim))
    v = centres[r.integers(0, 5, n)] + r.normal(0, 0.4, (n, dim))
    v[40:120] = v[40]  # a third of all rows is one vector
    rows = [(i, v[i].tolist(), int(r.integers(0, 4))) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [float("nan")] * dim, 1), (n + 2, [1.0] * (dim - 1) + [None], 2), (n + 3, [float("inf")] + [0.0] * (dim - 1), 2)]
    rows += [(n + 4, v[1].tolist(), None), (None, v[2].tolist(), 3), (n + 5, [1.0] * (dim + 4), 0), (n + 6, [], 0), (n + 7, [0.0] * dim, 0), (n + 8, [1.5], 0)]
    rows += [rows[0], rows[50], rows[50], (10, v[11].tolist(), 2)]  # repeated rows, and another vector under one id
    return rows


def ints_of(v, scale):
    return [max(-(1 << 40), min(1 << 40, math.floor(scale * x))) for x in v]


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def with_names(df, *names):
    return df.select("*", *(F.lit("x").alias(c) for c in names))


# -- exact arithmetic -----------------------------------------------------------------------


@pytest.mark.parametrize("size", [10, 1 << 20, 1 << 33, 1 << 40])
def test_arithmetic_is_exact_at_every_size(size):
    r = random.Random(size)
    x = np.array([[r.randint(-size, size) for _ in range(4)] for _ in range(30)], np.int64)
    book = np.concatenate((x[:5], x[:5] + 1, np.array([[r.randint(-5, 5)] * 4 for _ in range(4)], np.int64), x[3:5]))
    code, apart = _vectors.nearest(x, book)
    for row, c, d in zip(x.tolist(), code.tolist(), apart.tolist()):
        far = [sum((a - b) ** 2 for a, b in zip(row, e)) for e in book.tolist()]
        assert c == far.index(min(far)) and d == min(min(far), 1 << 61)
    got = _vectors.products(x, book, 1 << 62)
    assert got.tolist() == [[max(-(1 << 62), min(1 << 62, sum(a * b for a, b in zip(i, j)))) for j in book.tolist()] for i in x.tolist()]
    weight = np.array([r.randint(1, 1 << 40) for _ in range(30)])
    for c, n, total in zip(*_vectors.sums(x, code, weight)):
        own = [i for i in range(30) if code[i] == c]
        assert n == sum(int(weight[i]) for i in own) and total == [sum(int(weight[i]) * int(x[i, k]) for i in own) for k in range(4)]


# -- 11: hard negatives -------------------------------------------------------------------------


def mined(rows, scale=256, positives=5, k=3, dim=8):
    kept = sorted({(i, label, tuple(ints_of(v, scale))) for i, v, label in rows if i is not None and label is not None and usable(v) and len(v) == dim})
    out = []
    for a in kept:
        if a[0] % 10:
            continue
        scored = [(-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in kept if b is not a]
        for p in sorted(s for s in scored if s[2] == a[1])[:positives]:
            near = sorted(s for s in scored if s[2] != a[1] and 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0])[:k]
            out += [(a[0], p[1], rank, s[1], -p[0], -s[0]) for rank, s in enumerate(near, 1)]
    return out


@pytest.mark.parametrize("small", [{}, {"pivots": 3, "sample": 50, "cells": 12, "block_rows": 9, "first_cells": 1, "chunk": 4, "batch": 3}, {"pivots": 300, "cells": 1, "block_rows": 1}])
def test_hard_negatives(spark, small):
    rows = hostile()
    df = with_names(spark.createDataFrame(rows, VECTORS).repartition(3), "rid", "cell", "score", "ints", "asks")
    got = negatives.mine(df, F.col("vec_id") % 10 == 0, negatives.Settings(**small))
    want = mined(rows)
    assert len(want) > 60 and sorted(map(tuple, got.collect())) == sorted(want)


def test_hard_negatives_of_little(spark):
    one = [(0, [1.0, 2.0], 1)]
    for rows in ([], [(0, None, 1)], one, one + [(1, [1.0, 2.0], 1)], [(0, [0.0, 0.0], 1), (1, [0.0, 0.0], 1), (2, [0.0, 0.0], 2)], [(0, [1e300, -1e300], 1), (10, [1e300, 5.0], 1), (3, [1e20, 1.0], 2), (4, [3e9, 1.0], 2)]):
        got = negatives.mine(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 10 == 0).collect()
        assert [r.negative_id for r in got] == ([2] if len(rows) == 3 else []) or rows[0][1][0] == 1e300
    far = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [1.0, 0.0], 2)], VECTORS)
    assert negatives.mine(far, F.col("vec_id") == 0).count() == 0  # the only positive has a negative score


def test_scan_stops_before_the_far_cells(spark):
    """Two distant groups: the search in one certifies its answers without the other's blocks."""
    r = np.random.default_rng(1)
    v = np.concatenate((r.normal(0, 0.01, (200, 4)) + [1, 0, 0, 0], r.normal(0, 0.01, (200, 4)) + [0, 0, 0, -1]))
    rows = spark.createDataFrame([(i, v[i].tolist(), 0) for i in range(400)], VECTORS)
    s = negatives.Settings(pivots=4, block_rows=20, first_cells=1)
    store = Scratch(spark)
    ints, _ = _vectors.of_one_length(_vectors.integers(rows.withColumn("label", F.col("label").cast("long")), 256, "vec_id", "label"))
    index = negatives.build_index(ints, store, s)
    assert len(index.keys.ids) >= 8
    anchors = index.rows.where("vec_id = 5").select(F.col("rid").alias("qid"), "label", "ints", F.array(F.lit(1 << 62)).alias("highs"), F.array(F.lit(-(1 << 62))).alias("lows"))
    best = {r["vec_id"] for r in negatives.search(index, anchors, 5, True, store, s).collect()}
    near, _ = index.keys.away(np.array([anchors.first()["ints"]]))
    score = np.array([[sum(int(a) * int(b) for a, b in zip(ints_of(v[5], 256), ints_of(v[i], 256)))] for i in best])
    reach = index.keys.distance(np.array([sum(x * x for x in ints_of(v[5], 256))], float), score.astype(float)).max()
    assert len(best) == 5 and max(best) < 200 and (near > reach + 2 * index.keys.slack()).sum() >= len(index.keys.ids) // 3


# -- 12: token counts ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return counts.Tokenizer.of(public_tokenizers.path("piece_bpe_32k.model"))


def library(model):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model.data)


TEXTS = ["the same text"] * 40 + [None, "", " ", "a▁b", "a b", "▁", "</s> <0x0A> <unk>", "x" * 3000, "\n\n a \n", "日本語🎉" * 80, "word and more. " * 900, "a\x00b", "  two  spaces  "]


def test_token_counts(spark, model, tmp_path):
    cache = counts.CountCache(spark, f"file://{tmp_path}/counts")
    rows = [(i if i % 9 else None, t) for i, t in enumerate(TEXTS)]
    docs = with_names(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "digest", "n_tokens", "row", "n_bytes", "normal")
    sp = library(model)
    want = sorted(((i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in rows), key=repr)
    got = counts.count_tokens(docs, model, cache)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    distinct = len({(t or "").replace("▁", " ") for t in TEXTS})
    assert cache.read(model.version()).count() == distinct and len(cache.batches(model.version())) == 1  # copies, and spaces by either name, once

    again = counts.count_tokens(docs, model, cache)  # all known: nothing is added
    assert sorted(map(tuple, again.collect()), key=repr) == want and len(cache.batches(model.version())) == 1

    for bound in (1, 500_000):  # one or two new texts among known ones, by broadcast and by a join
        more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(70, f"new {bound}"), (71, f"new {bound}"), (72, f"newer {bound}")], "doc_id long, text string"))
        assert counts.count_tokens(more, model, cache, most_broadcast=bound).count() == len(rows) + 3
    assert len(cache.batches(model.version())) == 3 and cache.read(model.version()).count() == distinct + 4
    cache.compact(model.version())
    assert len(cache.batches(model.version())) == 1 and cache.read(model.version()).count() == distinct + 4


def test_stored_counts_are_used(spark, model, tmp_path):
    cache = counts.CountCache(spark, f"file://{tmp_path}/counts")
    docs = spark.createDataFrame([(1, "known"), (2, "other")], "doc_id long, text string")
    stored = spark.createDataFrame([("known",)], "t string").select(F.unhex(F.sha2("t", 256)).alias("digest"), F.lit(77).cast("long").alias("n_tokens"))
    for _ in range(2):  # two writers may add the same digest
        cache.append(model.version(), stored)
    path, system = _qualified(spark, f"{cache.root}/{model.version()}/broken/part-0.parquet")
    system.create(path).close()  # a writer that failed
    assert dict(counts.count_tokens(docs, model, cache).select("doc_id", "n_tokens").collect()) == {1: 77, 2: len(library(model).encode("other"))}
    assert dataclasses.replace(model).version() == model.version() != dataclasses.replace(model, data=model.data + b"\0").version()


def test_token_counts_by_the_other_library(spark, model, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    cache = counts.CountCache(spark, f"file://{tmp_path}/counts")
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        t, tokenizer = counts.Tokenizer.of(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
        got = counts.count_tokens(docs, t, cache).select("doc_id", "n_tokens").collect()
        assert dict(got) == {i: len(tokenizer.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(TEXTS)}
        assert t.version() != model.version() and cache.read(t.version()).count() > 5
    with pytest.raises(ValueError):
        counts.Tokenizer.of("vocabulary.txt")


def test_counts_of_cut_texts_equal_whole_ones(model):
    sp, r = library(model), random.Random(2)
    texts = [t or "" for t in TEXTS] + ["".join(r.choice("ab \n▁é日.\x00") for _ in range(2000)) for _ in range(5)]
    for longest in (1, 5, 64, 1 << 16):
        assert dataclasses.replace(model, longest=longest).counts(texts) == [len(sp.encode(t)) for t in texts]
    assert max(len(p) for p in dataclasses.replace(model, longest=64)._parts("word and more. " * 90)) < 80


def test_token_counts_of_an_empty_table(spark, model, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert counts.count_tokens(none, model, counts.CountCache(spark, new_path(spark, "counts"))).count() == 0


# -- 13: vector codes ----------------------------------------------------------------------------


def coded(rows, entries, scale=1024, parts=4, rounds=4, dim=8):
    kept = [(i, ints_of(v, scale), label) for i, v, label in rows if usable(v) and len(v) == dim]
    step = dim // parts
    cut = lambda x: [tuple(x[p * step : (p + 1) * step]) for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0], r[1]))[:entries]
    books = [[cut(r[1])[p] for r in first] for p in range(parts)]

    def nearest(p, x):
        far = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in books[p]]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            own = collections.defaultdict(list)
            for _, x, _ in kept:
                own[nearest(p, cut(x)[p])[0]].append(cut(x)[p])
            for e, members in own.items():
                books[p][e] = tuple(sum(c) // len(members) for c in zip(*members))
    out = []
    for i, x, label in kept:
        found = [nearest(p, cut(x)[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{c:02x}" for c, _ in found), sum(d for _, d in found)))
    return out, hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()


@pytest.mark.parametrize("entries", [7, 256])
def test_vector_codes(spark, entries):
    rows = hostile()
    df = with_names(spark.createDataFrame(rows, VECTORS).repartition(3), "rid", "part", "code", "error", "weight", "ints")
    got, books = codes.compress(df, codes.Settings(entries=entries))
    want, digest = coded(rows, entries)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and books.sha256() == digest
    totals = collections.Counter()
    for _, label, _, error in want:
        totals[label] += error
    summed = codes.with_label_error(got).collect()
    assert len(summed) == len(want) and {(r.label, r.label_error) for r in summed} == set(totals.items()) and None in totals


def test_vector_codes_of_little(spark):
    for rows in ([], [(1, None, 1)], [(1, [], 1)], [(1, [1.0, 2.0, 3.0], 1)]):
        got, books = codes.compress(spark.createDataFrame(rows, VECTORS))
        assert codes.with_label_error(got).count() == 0 and books.sha256() == hashlib.sha256(b"").hexdigest()
    big = [(1, [1e300, -1e300, 3e8, 1.0], 1), (2, [1e300, 5.0, 3e8, 1.0], 1), (3, [0.5] * 4, 1)]
    got, books = codes.compress(spark.createDataFrame(big, VECTORS), codes.Settings(entries=2))
    want, digest = coded(big, 2, dim=4)
    assert books.sha256() == digest and {(r.vec_id, r.code) for r in got.collect()} == {(w[0], w[2]) for w in want}
