"""Each training-data operator against a brute-force version on small tables with hostile rows."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import _store, ann, graph, jaccard, licenses, lm, mixing, pieces, quality, substrings, toxicity, warc
from tidemark.llm._text import LOWER, NOT_SPACE, Words, blocks, span_hashes, window_hashes

LOWER_AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(5)
VOCAB = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8))) for _ in range(400)] + ["é", "日本", "the", "of", "and"]


def sentence(n, r=rng):
    return " ".join(r.choice(VOCAB) for _ in range(n))


def corpus():
    passage = sentence(60)
    base = [sentence(rng.randint(30, 150)) for _ in range(40)]
    near = [b.split() for b in base[:6]]
    for w in near:
        w[len(w) // 2] = "changed"
    texts = base + base[:4] + [" ".join(w) for w in near] + [sentence(40) + " " + passage + " " + sentence(40) for _ in range(5)]
    texts += [None, "", " \t\n", "a", "a b c", "A B C", "x" * 5000, "And " * 300, sentence(6000), "line one\nline one\n\n \nline one", "   \x85 ok", "under the MIT License, UNDER the mit license", "é" * 150]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "é", None]), len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[0], (None, base[1], "en", "s1", 1), (1000, base[0], None, None, None)]


ROWS = corpus()
TEXT = [r[1] or "" for r in ROWS]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d.parquet")
    spark.createDataFrame(ROWS, DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "d.parquet")
    spark.createDataFrame([], DOCS).write.parquet(path)
    return spark.read.parquet(path)


def clashing(df):
    """The table with columns that the operators use as names themselves."""
    names = ("rid", "ids", "score", "predicted", "size", "copies", "target", "kept", "n", "ranges", "decoded", "n_words", "spans", "held_out", "tail", "root")
    return df.select("*", *(F.lit("x").alias(c) for c in names))


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


# -- text primitives ----------------------------------------------------------------------


def test_words_and_hashes():
    texts = [t for t in TEXT] * 3
    seen, found = {}, 0
    for rows, data, at in blocks(pa.array(texts), 3000):
        words = Words(LOWER[data], at, NOT_SPACE)
        own = [w.encode() for t in texts[rows] for w in WS.findall(t.translate(LOWER_AZ))]
        assert [words.data[a:b].tobytes() for a, b in zip(words.starts, words.ends)] == own
        for w, h in zip(own, words.hashes().tolist()):
            assert seen.setdefault(h, w) == w
        found += len(own)
        grams, at_, row = window_hashes(words.hashes(), words.bounds, 3)
        assert len(grams) == sum(max(0, len(WS.findall(t)) - 2) for t in texts[rows])
    assert found and len(set(seen.values())) == len(seen)


def test_empty_span_hash_is_the_end_token():
    data = np.frombuffer(b"abc", np.uint8)
    assert span_hashes(data, np.array([1]), np.array([1]))[0] == lm.END


# -- 1: pieces ---------------------------------------------------------------------------------


def test_pieces_equal_library(spark, docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = pieces.decode(pieces.encode(clashing(docs))).select("text", "ids", "decoded").collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert r.ids == sp.encode(r.text or "")
        assert r.decoded == (r.text or "").replace(pieces.SPACE, " ")
    assert pieces.decode(pieces.encode(none)).count() == 0


def test_pieces_scan_equals_one_step(spark, docs):
    one = pieces.encode(docs).select("text", "ids").distinct()
    cut = pieces.encode(docs, chunk_chars=37, giant_bytes=100).select("text", "ids").distinct()
    assert one.exceptAll(cut).count() == 0 and cut.exceptAll(one).count() == 0


def test_pieces_matrices_are_associative():
    p = pieces.pieces()
    text = pieces._plain(pa.array(["one two  three" * 20 + "x" * 70 + "日本語🎉" * 9]))[0].as_py()
    chunks = [pieces.Chunk(p, *c[1:]) for c in pieces.split(text, p, 11)]
    m = [c.matrix() for c in chunks]
    left = m[0]
    for x in m[1:]:
        left = pieces.times(left, x)
    right = m[-1]
    for x in reversed(m[:-1]):
        right = pieces.times(x, right)
    assert (left == right).all() and left.max() == 0
    at = pieces.best_states(m)
    assert [i for c, a, b in zip(chunks, at, at[1:]) for i in c.trace(a, b)] == p.expand(p.merge(text))


# -- 2: language model -----------------------------------------------------------------------------


def test_language_model(spark, docs, none):
    s = lm.Settings(head=60, words_per_class=4, word_classes=4, count_classes=3, lanes=2, window=8, stream=500, score_words=50, score_lanes=7, average=2)
    got = lm.score(clashing(docs), s).collect()
    tok = lambda t: WS.findall((t or "").translate(LOWER_AZ)) + [""]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = collections.Counter(w for r in ROWS if not out(r[0]) for w in tok(r[1]))
    n, v = sum(c.values()), len(c)
    want = [(r[0], out(r[0]), len(tok(r[1])), sum(c[w] > 0 for w in tok(r[1])), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok(r[1])), 6)) for r in ROWS]
    same([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got], want)
    assert all(r.score < 0 for r in got)
    assert lm.score(none, s).count() == 0


def small_network():
    s = lm.Settings(head=12, words_per_class=2, word_classes=3, count_classes=2, hidden=5, window=6, lanes=2)
    words = np.arange(12, dtype=np.uint64)  # 0 is the end token
    return lm.Network(lm.Vocabulary(words, np.arange(30, 6, -2), 500, 20, s))


def test_network_is_a_distribution():
    net = small_network()
    h = np.random.default_rng(0).normal(0, 1, (1, 5)).astype(np.float32)
    total = sum(math.exp(net.outputs(h, np.array([k]))[0]) for k in range(13))
    assert total == pytest.approx(1, abs=1e-5)


def test_network_gradients_and_carried_state():
    net = small_network()
    h = np.random.default_rng(1).normal(0, 1, (4, 5))
    rank = np.array([0, 3, 8, 12])
    net.to_class, net.to_word = net.to_class.astype(np.float64), net.to_word.astype(np.float64)
    _, dh, g = net.outputs(h, rank, True)
    eps = 1e-5
    for i in range(4):
        for j in range(5):
            up, down = h.copy(), h.copy()
            up[i, j] += eps
            down[i, j] -= eps
            assert dh[i, j] == pytest.approx(-(net.outputs(up, rank).sum() - net.outputs(down, rank).sum()) / (2 * eps), abs=1e-4)
    net = small_network()
    ranks = np.random.default_rng(2).integers(0, 13, 300)
    whole = net.score(ranks, np.array([0, 250, 300]))
    net.v.s.__dict__["score_words"] = 7
    assert net.score(ranks, np.array([0, 250, 300])) == pytest.approx(whole, rel=1e-4)


def slow_likelihood(net, ranks):
    """One document, step by step, with a full softmax over words written out."""
    v, s, n = net.v, net.v.s, net.v.s.hidden
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    h, before, total = np.zeros(n), v.end, 0.0
    for k in ranks:
        g, c = net.embed[v.input[before]].astype(float) + net.bias, h @ net.carry.astype(float)
        z, r = sigmoid(g[:n] + c[:n]), sigmoid(g[n : 2 * n] + c[n : 2 * n])
        h = z * h + (1 - z) * np.tanh(g[2 * n :] + r * c[2 * n :])
        classes = np.exp(h @ net.to_class + net.class_bias)
        p = classes[v.kind[k]] / classes.sum()
        if v.kind[k] < s.word_classes:
            own = [i for i in range(s.soft) if i // s.words_per_class == v.kind[k]]
            words = np.exp(net.to_word[own].astype(float) @ h + net.word_bias[own])
            p *= words[own.index(k)] / words.sum()
        else:
            p *= math.exp(v.share[k])
        total += math.log(p)
        before = k
    return total


def test_network_scores_whole_documents():
    net, r = small_network(), np.random.default_rng(5)
    net.v.s.__dict__.update(score_words=11, score_lanes=3)
    for k in ("embed", "carry", "to_class", "to_word"):
        setattr(net, k, r.normal(0, 0.7, getattr(net, k).shape).astype(np.float32))
    sizes = [1, 40, 7, 0, 130, 2]
    ranks, offsets = r.integers(0, 13, sum(sizes)), np.concatenate(([0], np.cumsum(sizes)))
    want = [slow_likelihood(net, ranks[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
    assert net.score(ranks, offsets) == pytest.approx(want, rel=1e-4)


def test_batches_are_scored_side_by_side():
    net = small_network()
    names, rows = ["rid", "doc_id", "held_out", "text"], [(i, None if i == 3 else 10 * i, i % 2 == 0, "a b " * i if i % 4 else None) for i in range(9)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[low : low + 2]], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_(), pa.string()))], names) for low in range(0, 9, 2)]
    whole, calls = net.score, []
    net.score = lambda ranks, offsets: calls.append(len(offsets) - 1) or whole(ranks, offsets)
    alone = [r for b in batches for out in lm.scored_batches(iter([b]), net, 2.0) for r in out.to_pylist()]
    calls.clear()
    together = [r for out in lm.scored_batches(iter(batches), net, 2.0) for r in out.to_pylist()]
    assert calls == [9]  # one pass over the texts of all batches
    assert [(r["rid"], r["doc_id"], r["held_out"]) for r in together] == [r[:3] for r in rows]
    for x, y in zip(together, alone):
        assert x.pop("score") == pytest.approx(y.pop("score"), rel=1e-5) and x == y
    net.v.s.__dict__["stream"] = 8
    calls.clear()
    assert sum(out.num_rows for out in lm.scored_batches(iter(batches), net, 2.0)) == 9 and len(calls) > 1 and sum(calls) == 9


def test_words_are_found_by_their_leading_bits():
    s, rng = lm.Settings(), np.random.default_rng(8)
    for words in (np.zeros(0, np.uint64), np.array([~np.uint64(0)]), np.arange(50, dtype=np.uint64)[::-1], np.arange(2**63, 2**63 + 300, 3, dtype=np.uint64)):
        v = lm.Vocabulary(words, np.ones(len(words), np.int64), 500, 400, s)
        asked = np.concatenate([words, words + np.uint64(1), np.array([0, 2**64 - 1, 2**63], np.uint64)])
        rank = {int(x): i for i, x in enumerate(words)}
        assert v.find(asked).tolist() == [rank.get(int(x), len(words)) for x in asked]
    words = np.unique(rng.integers(0, 2**64, s.head, np.uint64))
    v, asked, ordered = lm.Vocabulary(words, np.ones(len(words), np.int64), 10**6, 10**6, s), rng.choice(words, 400_000), np.sort(words)
    times = {}
    for _ in range(3):
        for k, f in (("bits", lambda: v.find(asked)), ("binary", lambda: ordered.searchsorted(asked))):
            begin = time.process_time()
            f()
            times[k] = min(times.get(k, 9.0), time.process_time() - begin)
    assert times["bits"] < times["binary"]  # a binary search took about five times as long


def test_lanes_hold_every_document_whole():
    r, s = random.Random(6), lm.Settings(lanes=4)
    for _ in range(50):
        docs_ = [[r.randint(1, 99) for _ in range(r.randint(0, 30))] for _ in range(r.randint(0, 25))]
        offsets = np.concatenate(([0], np.cumsum([len(d) for d in docs_]))).astype(np.int64)
        stream, fresh, start, length = lm.packed(np.array([x for d in docs_ for x in d], np.int64), offsets, s)
        assert len(start) <= 4 and sorted(length.tolist(), reverse=True) == length.tolist() and length.sum() == len(stream)
        cuts = [*np.flatnonzero(fresh).tolist(), len(stream)]
        got = [stream[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])]
        assert sorted(got) == sorted(d for d in docs_ if d) and all(fresh[a] for a, n in zip(start, length) if n)


def test_training_follows_the_loss():
    """The first update's direction against differences of the loss, over whole documents within one window."""
    net, r = small_network(), np.random.default_rng(3)
    net.v.s.__dict__.update(window=100, lanes=2)
    sizes = [9, 4, 6]
    ranks, offsets = r.integers(0, 13, sum(sizes)), np.concatenate(([0], np.cumsum(sizes)))
    caught = {}
    net.update = lambda g, size: caught.update({k: v.copy() for k, v in g.items()}) or setattr(net, "seen", size)
    net.train(ranks, offsets)
    assert net.seen == sum(sizes)
    loss = lambda: -sum(slow_likelihood(net, ranks[a:b]) for a, b in zip(offsets[:-1], offsets[1:]))
    for k in lm.NAMES:
        values = getattr(net, k).astype(np.float64)
        setattr(net, k, values)
        for at in [tuple(r.integers(0, n) for n in values.shape) for _ in range(6)]:
            keep, found = values[at], []
            for step in (1e-5, -1e-5):
                values[at] = keep + step
                found.append(loss())
            values[at] = keep
            assert caught[k][at] == pytest.approx((found[0] - found[1]) / 2e-5, abs=2e-3)


def test_network_learns():
    net = small_network()
    ranks, offsets = np.tile([0, 1, 2, 3, 4, 5], 400), np.arange(0, 2401, 6)
    first = net.train(ranks, offsets)
    for _ in range(6):
        last = net.train(ranks, offsets)
    assert last < 0.6 * first


def test_language_model_learns_from_every_training_document(spark):
    # every document alone moves the weights, and a null id counts like others
    words = np.array([0, 1], np.uint64)
    for i in (1, 3, 9, None):
        one = spark.createDataFrame([(i, "one two " * 50)], "doc_id long, text string")
        v = lm.Vocabulary(words, np.array([9, 8]), 20, 4, lm.Settings(words_per_class=2, word_classes=3, count_classes=2, hidden=5))
        assert lm.train(one, v).get() != lm.Network(v).get()


# -- 3: archives ----------------------------------------------------------------------------------------


def test_warc(spark, none):
    html = ["<p>a</p>" * 50, "<p>b</p>", "", None, "é" * 10]
    rows = [(i, f"http://x/{i}", html[i % 5]) for i in range(60)] + [(None, "u", "<p>b</p>"), (99, None, "only"), (99, None, "only"), (7, "http://x/\r\n7", "own")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = warc.archive(spark, pages.withColumn("digest", F.lit(1)).withColumn("owner", F.lit(1)), warc.Settings(archive_bytes=2000), payloads=True).collect()
    owner = {}
    count = collections.Counter(r[2] or "" for r in rows)
    for i, _, h in rows:
        owner[h or ""] = max(owner.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        h = h or ""
        revisit = count[h] > 1 and owner[h] >= 0 and i != owner[h]
        want.append((i, len(h.encode()), warc.base32_sha1(h.encode()), "revisit" if revisit else "response", owner[h] if revisit else None, None if revisit else h.encode()))
    same([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got], want)
    big = [r for r in warc.archive(spark, pages, warc.Settings(min_bytes=1000)).collect()]
    assert all(r.record_type == "response" for r in big)
    assert warc.archive(spark, none.selectExpr("doc_id page_id", "text url", "text html")).count() == 0


def test_warc_attempts_do_not_overwrite(spark):
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i}</p>" * 50) for i in range(40)], "page_id long, url string, html string")
    folder = _store.new_path(spark, "twice")
    first = warc.write(pages.repartition(3), folder, warc.Settings(archive_bytes=3000))
    again = warc.write(pages.orderBy(F.desc("page_id")).coalesce(3), folder, warc.Settings(archive_bytes=3000))  # as a repeated attempt, in another order
    for listed in (first, again):
        assert sorted(r.page_id for r in warc.read(listed, folder).collect()) == list(range(40))


def test_warc_sql(spark, tmp_path):
    rows = [(i, "u", f"page {i % 7}") for i in range(30)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    cur = con.execute(warc.OP3_SQL)
    names = [d[0] for d in cur.description]
    same([tuple(r[c] for c in names) for r in warc.op3(spark, str(tmp_path)).collect()], cur.fetchall())


# -- 4: licenses ----------------------------------------------------------------------------------------


def test_licenses(spark, docs, none):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = []
    for i, t, *_ in ROWS:
        w, places, labels = word.findall((t or "").translate(LOWER_AZ)), [], set()
        for label, phrase in licenses.PHRASES.items():
            q = phrase.split()
            for k in range(len(w) - len(q) + 1):
                if w[k : k + len(q)] == q:
                    places.append(k)
                    labels.add(label)
        want.append((i, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    got = licenses.scan(clashing(docs)).collect()
    same([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], want)
    assert licenses.scan(none).count() == 0


def test_license_texts_with_changes(spark, tmp_path):
    apache = licenses.TEMPLATES["apache-2"][0].split()
    bsd = licenses.TEMPLATES["bsd"][0].split()
    changed = [w for k, w in enumerate(apache) if k % 17] + ["more"]
    rows = [(1, "intro " * 30 + " ".join(changed)), (2, " ".join(bsd[: len(bsd) // 3])), (3, "CC BY-NC 4.0. cc by nc"), (4, " ".join(bsd) + " tail"), (5, sentence(200))]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    got = {r.doc_id: r for r in licenses.scan(spark.read.parquet(path)).collect()}
    assert "apache-2" in got[1].labels.split(",") and got[1].spans[0].first >= 25
    assert got[2].labels == "" and got[5].labels == "" and got[5].score == 0
    assert got[3].n_base == 2 and got[3].labels == "cc-by-nc"
    assert got[4].labels == "bsd" and got[4].score == 1 and (got[4].spans[0].first, got[4].spans[0].last) == (0, len(bsd) - 1)


def slow_license_labels(text, s):
    """Labels by the rules, from every place of every diagonal's neighbourhood, without Spark."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w, out = [x.encode() for x in word.findall((text or "").translate(LOWER_AZ))], set()
    for t in licenses.templates():
        n = len(t.words)
        if t.phrase:
            if any(tuple(w[i : i + n]) == t.words for i in range(len(w) - n + 1)):
                out.add(t.label)
            continue
        grams = collections.defaultdict(list)
        for p in range(n - 2):
            grams[t.words[p : p + 3]].append(p)
        votes = collections.Counter()
        where = collections.defaultdict(list)
        for pos in range(len(w) - 2):
            for p in grams.get(tuple(w[pos : pos + 3]), ()):
                votes[pos - p] += 1
                where[pos - p] += [pos, pos + 2]
        half = max(1, n // 2)
        for k in {d // half - i for d in votes for i in (0, 1)}:
            inside, span = sorted(d for d in votes if d // half - k in (0, 1)), []
            for d, after in zip(inside, [*inside[1:], None]):
                span.append(d)
                if after is None or after - d > s.max_gap:
                    if sum(votes[x] for x in span) + 2 >= n * s.min_share * 0.5:
                        places = [x for y in span for x in where[y]]
                        low, high = max(0, min(places) - n), min(len(w) - 1, max(places) + n)
                        if licenses.dense(w[low : high + 1], t.words, s):
                            out.add(t.label)
                    span = []
    return ",".join(sorted(out))


def test_license_votes(spark, tmp_path):
    r, s = random.Random(8), licenses.Settings()
    texts = [t for group in licenses.TEMPLATES.values() for t in group]
    mit = licenses.TEMPLATES["mit-text"][0].split()
    scattered = " ".join(w for i in range(0, len(mit), 4) for w in mit[i : i + 4] + sentence(8, r).split())  # a third of the words, in order: no license
    rows = ["of the software " * 3000, scattered, sentence(50, r) + " " + texts[0] + " " + sentence(400, r) + " of the software " + sentence(20, r)]
    for _ in range(60):
        w = sentence(r.randint(0, 60), r).split() + r.choice(texts).split() + sentence(r.randint(0, 60), r).split()
        for _ in range(r.choice([0, 3, 20, 60])):
            i = r.randrange(len(w) + 1)
            w[i : i + r.choice([0, 1])] = r.choice([[], ["new"], ["two", "more"]])
        rows.append(" ".join(w))
    rows += [" ".join(r.choice(texts).split()[:k]) for k in (5, 12, 30)] + [None, ""]
    path = str(tmp_path / "d")
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3).write.parquet(path)
    got = {x.doc_id: x for x in licenses.scan(spark.read.parquet(path)).collect()}
    assert [got[i].labels for i in range(len(rows))] == [slow_license_labels(t, s) for t in rows]
    assert got[0].labels == got[1].labels == "" and got[2].labels != ""
    assert all(x.last - x.first + 1 <= 200 for x in got[2].spans)


# -- 5: mixing ------------------------------------------------------------------------------------------


def test_mixing(spark, docs, none, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(mixing.OP5_SQL)
    names = [d[0] for d in cur.description]
    got = mixing.op5(spark, str(tmp_path)).select(*names).collect()
    same([tuple(r) for r in got], cur.fetchall())
    assert sum({r.source_size: r.target for r in got}.values()) == pytest.approx(1.5 * sum({r.source_size: r.source_size for r in got}.values()))
    assert all(r.taken <= 2 * r.size for r in got)
    planned = mixing.plan_mix(clashing(docs)).agg(F.sum("copies")).first()[0]
    mixed = mixing.mix(docs)
    assert mixed.count() == planned and mixed.columns == docs.columns
    assert mixing.mix(none).count() == 0


def test_targets_fill_up_to_caps(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 30), ("c", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 20 and got["c"] == 0 and got["b"] + got[None] + 20 == pytest.approx(1560)
    assert got[None] == 60 and got["b"] == pytest.approx(1480)


# -- 6: quality ---------------------------------------------------------------------------------------


def test_quality_counts(spark, docs, none):
    want = []
    for i, t, *_ in ROWS:
        t = t or ""
        w = WS.findall(t)
        c, covered = collections.Counter(zip(w, w[1:], w[2:])), set()
        for k in range(len(w) - 2):
            if c[w[k], w[k + 1], w[k + 2]] > 1:
                covered |= {k, k + 1, k + 2}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WS.search(line):
                dup += line in seen
                seen.add(line)
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    got = quality.judge(clashing(docs)).collect()
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got], want)
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.judge(none).count() == 0


def test_quality_verdict(spark, tmp_path):
    r = random.Random(1)
    common = ["the", "of", "and", "to", "in", "is", "that", "for"]
    clean = [" ".join(r.choice(common) if r.random() < 0.5 else sentence(1, r) for _ in range(200)) for _ in range(60)]
    junk = [" ".join(w + r.choice(["***", "%%%", "$$$"]) for w in t.split()) for t in clean[:5]] + ["".join(r.choice("0123456789#$%") + " " for _ in range(400))]
    path = str(tmp_path / "d")
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(clean + junk)], "doc_id long, text string, lang string").write.parquet(path)
    got = {r.doc_id: r.kept for r in quality.judge(spark.read.parquet(path)).collect()}
    assert all(got[i] for i in range(60)) and not any(got[i] for i in range(60, 66))


def slow_distances(rows, k, rules):
    """Both distances of text k, with counts over all others of each language, word by word."""
    words = lambda t: WS.findall((t or "").translate(LOWER_AZ))
    js = lambda p, q: math.sqrt(max(0.0, sum(x * math.log2(2 * x / (x + y)) for x, y in zip(p, q) if x > 0) + sum(y * math.log2(2 * y / (x + y)) for x, y in zip(p, q) if y > 0)) / 2)
    kinds = lambda t: np.bincount([c for c in quality._CLASS[np.frombuffer((t or "").encode(), np.uint8)] if c != 255], minlength=quality.N_CLASSES)
    _, text, lang = rows[k]
    found = {}
    for own in {r[2] for r in rows if r[2]}:
        every = collections.Counter(w for r in rows if r[2] == own for w in words(r[1]))
        if every.total() < rules.min_reference:
            continue
        top = [w for w, _ in sorted(every.items(), key=lambda x: (-x[1], x[0]))[: rules.common_words]]
        classes = sum(kinds(r[1]) for r in rows if r[2] == own)
        if own == lang:
            every = every - collections.Counter(words(text))
            classes = classes - kinds(text)
            if every.total() < rules.min_reference:
                continue
        p, n, m = collections.Counter(words(text)), max(1, len(words(text))), every.total()
        x, y = [p[w] / n for w in top], [every[w] / m for w in top]
        found[own] = js(x + [1 - sum(x)], y + [1 - sum(y)]), js(kinds(text) / max(1, kinds(text).sum()), classes / classes.sum())
    if not found or lang and lang not in found:
        return None, None
    word, char = min(found.values(), key=sum)
    return char, word


def test_quality_distances(spark, tmp_path, monkeypatch):
    r, rules = random.Random(2), quality.Rules(common_words=8, min_reference=300)
    own = lambda k, n: " ".join(f"{chr(97 + k)}{r.choice('abcdefghijklmnopqrst')}" + r.choice(["", "", ".", "é", "7"]) for _ in range(n))
    rows = [(i, own(i % 3, r.randint(0, 120)), f"l{i % 3}") for i in range(40)] + [(40, own(5, 900), "alone"), (41, own(6, 20), "small"), (42, own(1, 80), None), (43, own(2, 60), ""), (44, None, "l1"), (45, "#" * 500, "l0"), (46, "", None)]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(path)
    for cells in (4 << 20, 4 * 40):  # then a few texts at a time
        monkeypatch.setattr(quality, "_CELLS", cells)
        references = quality.language_references(spark.read.parquet(path), rules)
        assert {x["lang"] for x in references} == {"l0", "l1", "l2", "alone"}
        _, d_char, _, d_word = quality.distances(pa.array([t for _, t, _ in rows], pa.string()), [x for *_, x in rows], references, rules)
        for k in range(len(rows)):
            char, word = slow_distances(rows, k, rules)
            if char is None:
                assert math.isnan(d_char[k]) and math.isnan(d_word[k])
            else:
                assert (d_char[k], d_word[k]) == (pytest.approx(char, abs=1e-6), pytest.approx(word, abs=1e-6))
    got = {x.doc_id: x for x in quality.judge(spark.read.parquet(path), rules).collect()}
    assert len(got) == len(rows) and got[40].char_distance is None and got[40].kept != got[40].base_failed


def test_quality_of_many_languages(spark, tmp_path):
    r = random.Random(2)
    own = lambda k, n: " ".join(f"{chr(97 + k // 26)}{chr(97 + k % 26)}{r.choice('abcdefghijklmnopqrst')}" for _ in range(n))
    rows = [(8 * k + i, own(k, 300), f"l{k}") for k in range(80) for i in range(8)]
    rows += [(1000 + k, own(k + 1, 300), f"l{k}") for k in range(3)]  # under a wrong name, the nearest language counts
    rows += [(2000, "7 8 " * 200, "l5"), (2001, "7 8 " * 200, "new")]  # no language's text; a name of one text tells nothing
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(path)
    got = {x.doc_id: x for x in quality.judge(spark.read.parquet(path)).collect()}
    assert all(got[i].kept and got[i].word_distance < 0.3 and got[i].char_distance < 0.1 for i, _, lang in rows[:-2] if lang != "l5")
    assert not got[2000].kept and got[2000].word_distance > 0.9 and got[2001].word_distance is None


def test_js_distance():
    p, q = np.array([[1.0, 0.0], [0.5, 0.5]]), np.array([0.0, 1.0])
    assert quality.js_distance(p, q)[0] == pytest.approx(1) and quality.js_distance(p, np.array([0.5, 0.5]))[1] == pytest.approx(0)


# -- 7: repeated substrings ---------------------------------------------------------------------------


def repeats(texts, length):
    seen = collections.Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        mark = np.cumsum(gone)[:-1] > 0
        kept = bytes(x for x, g in zip(b, mark) if not g)
        out.append((len(b), int(mark.sum()), int((np.diff(np.concatenate(([0], mark.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("settings", [substrings.Settings(), substrings.Settings(crowded=2, bucket_bytes=4000, longest=150), substrings.Settings(length=40, gram=16)])
def test_repeats(spark, docs, none, settings):
    want = [(i, *r) for (i, *_), r in zip(ROWS, repeats([t.encode() for t in TEXT], settings.length))]
    got = substrings.remove_repeats(clashing(docs), settings).withColumn("sha", F.sha2("kept", 256)).collect()
    same([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in got], want)
    assert substrings.remove_repeats(none, settings).count() == 0


def test_interval_expansion():
    r = random.Random(2)
    for _ in range(60):
        base = "".join(r.choice("ab") for _ in range(50))
        segments = []
        for _ in range(r.randint(1, 9)):
            k = r.randint(0, 30)
            segments.append((base[k : k + r.randint(6, 30)] + "".join(r.choice("abc") for _ in range(r.randint(0, 9)))).encode())
        copies, length = np.array([r.choice([1, 1, 3]) for _ in segments]), r.choice([1, 5, 9])
        count = collections.Counter()
        for b, k in zip(segments, copies):
            for i in range(len(b) - length + 1):
                count[b[i : i + length]] += k
        got = substrings.repeated(segments, copies, length)
        assert [g.tolist() for g in got] == [[count[b[i : i + length]] > 1 for i in range(len(b) - length + 1)] for b in segments]


# -- 8: toxicity ----------------------------------------------------------------------------------------


def slow_toxicity(text, model):
    import zstandard

    s = model.settings
    words = re.findall(rb"[a-z\x80-\xff]+", (text or "").encode().lower())
    data, z = b" " + b" ".join(words) + b" ", []
    for h in model.halves:
        cut = [d[-s.dictionary_bytes :] for d in (h.toxic, h.ordinary)]
        cut = [bytes(s.dictionary_bytes - len(d)) + d + bytes(16) for d in cut]
        gains = []
        for i in range(0, max(1, len(data) - s.overlap), s.window - s.overlap):
            sizes = []
            for d in cut:
                p = zstandard.ZstdCompressionParameters(window_log=17, hash_log=14, chain_log=14, search_log=1, min_match=s.min_match, target_length=1, strategy=zstandard.STRATEGY_FAST, write_content_size=0, write_checksum=0, write_dict_id=0)
                sizes.append(len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=p).compress(bytes(64) + data[i : i + s.window])))
            gains.append(sizes[1] - sizes[0])
        counts = [sum(g >= v for g in gains) for v in s.thresholds]
        x = [math.log1p(c) for c in counts] + [math.sqrt(c / len(gains)) for c in counts]
        z.append(sum((a - m) / k * w for a, m, k, w in zip(x, h.mean, h.scale, h.weights)) + h.weights[-1])
    return 1 / (1 + math.exp(-max(-30, min(30, sum(z) / len(z)))))


def test_toxicity_leaning():
    s = toxicity.Settings(min_ratio=4.0)
    # the pair around a start counts, so copies count once, and so do passages
    toxic = [f" aa badword{'xyz'[i % 3]} {'pqr'[i // 3]} ".encode() for i in range(9)] * 3 + [b" same badness same "] * 9
    plain = [f" aa good{i} {'pqr'[i % 3]} ".encode() for i in range(9)]
    own, other = toxicity.Starts(toxic, s), toxicity.Starts(plain, s)

    def slow(texts, start):
        pairs = set()
        for w in [b"".join(texts).split()]:
            for a, x, b in zip([b""] + w[:-1], w, w[1:] + [b""]):
                if (b" " + x + b" ").startswith(start):
                    pairs.add((a, b))
        return len(pairs)

    for start in (b" badwo", b" badne", b" aa ", b" good0"):
        wanted = toxicity.span_hashes(np.frombuffer(start, np.uint8), np.array([0]), np.array([len(start)]))
        assert (own.of(0, wanted)[0], other.of(0, wanted)[0]) == (slow(toxic, start), slow(plain, start))
    got = toxicity.leaning(toxic, own, other, s)
    for ratio, start in got:
        wanted = toxicity.span_hashes(np.frombuffer(start, np.uint8), np.array([0]), np.array([len(start)]))
        assert math.isclose(ratio, own.of(0, wanted)[0] / own.total / ((other.of(0, wanted)[0] + 1) / other.total)) and ratio >= s.min_ratio
    every = toxicity.leaning(toxic, own, other, toxicity.Settings(starts=(6,), min_ratio=0.0))
    for most in (1, 5, 40, 1000):
        assert toxicity.most_leaning(toxic, own, other, s, most) == [w for _, w in sorted(every, key=lambda x: (-x[0], x[1]))[:most]]


def test_toxicity_sample_of_long_texts(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda rows, s: seen.extend(rows))
    d = spark.createDataFrame([(1, "ab" * 500), (2, "short"), (3, None), (1, "ab" * 500)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    toxicity.train(d, labels, toxicity.Settings(sample_pieces=3, piece_chars=10))
    want = " ".join(("ab" * 500)[a : a + 10] for a in (0, 495, 990))
    assert all(t in (want, "short", None) for t, _ in seen) and any(t == want for t, _ in seen) == bool([i for i in (1,) if zlib.crc32(b"1") % 5])


def test_toxicity(spark, tmp_path, none):
    r = random.Random(3)
    bad = ["worthless", "pathetic", "disgusting", "moron"]

    def text(toxic):
        words = sentence(150, r).split()
        for _ in range(6 if toxic else 0):
            words.insert(r.randint(0, len(words)), r.choice(bad))
        return " ".join(words)

    rows = [(i, text(i % 4 == 0)) for i in range(400)]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    d = spark.read.parquet(path)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(d, labels)
    got = toxicity.score(clashing(d), model).withColumn("out", toxicity.held_out(F.col("doc_id"))).collect()
    assert all(x.out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got)
    test = [x for x in got if x.out]
    assert sum(x.predicted == (x.doc_id % 4 == 0) for x in test) >= 0.95 * len(test)
    odd = toxicity.score(spark.createDataFrame([(1, None), (2, ""), (3, "x" * 200_000)], "doc_id long, text string"), model).collect()
    assert all(0 <= x.score <= 1 for x in odd)
    assert toxicity.train(d, labels.where("toxic = 0")) is None
    assert all(0 < len(h.toxic) <= 4096 and 0 < len(h.ordinary) <= 4096 for h in model.halves) and len(model.halves) == 2
    # a slow scorer: whole text, window by window, with encoders of its own
    for x in got[:25]:
        assert abs(x.score - slow_toxicity(x.text, model)) < 1e-9
    assert {x.score for x in toxicity.score(d, None).collect()} == {0.0}
    assert toxicity.score(none, model).count() == 0


# -- 9: similarity join --------------------------------------------------------------------------------


def linked(rows, k=5, percent=75):
    sets = []
    for _, t, *_ in rows:
        w = WS.findall((t or "").translate(LOWER_AZ))
        sets.append(frozenset(zip(*[w[i:] for i in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    smallest = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            smallest[find(i)] = min(smallest.get(find(i), r[0]), r[0])
    return [(r[0], len(s), smallest.get(find(i))) for i, (r, s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("settings", [jaccard.Settings(), jaccard.Settings(frequent=2, rounds=2, range_hashes=500), jaccard.Settings(frequent=2, salted=3, rounds=0, max_broadcast=0, place_rows=2)])
def test_jaccard(spark, docs, none, settings):
    got = jaccard.join(clashing(docs), settings).collect()
    want = linked(ROWS)
    for i, (a, n, c) in enumerate(want):  # an unlinked row names itself
        want[i] = (a, n, c if n else a)
    same([(r.doc_id, r.n_shingles, r.component_id) for r in got], want)
    assert jaccard.join(none, settings).count() == 0


def test_jaccard_on_many_near_copies(spark, tmp_path):
    r = random.Random(9)
    base = sentence(80, r).split()
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(VOCAB)
        rows.append((i, " ".join(w)))
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(path)
    for s in (jaccard.Settings(frequent=4), jaccard.Settings(frequent=4, salted=20, rounds=0, place_rows=7)):
        got = jaccard.join(spark.read.parquet(path), s).collect()
        same([(x.doc_id, x.n_shingles, x.component_id) for x in got], linked(rows))


def test_keys_meet_for_every_similar_pair():
    r, s = np.random.default_rng(1), jaccard.Settings(frequent=5)
    often = {int(h): int(r.choice([2, 2, 3, 7, 9, 100])) for h in r.integers(1, 1 << 62, 60)}
    universe = np.array(sorted(often), np.uint64)
    for _ in range(400):
        n = int(r.integers(3, 40))
        x = np.sort(r.choice(universe, n, replace=False))
        y = np.sort(np.unique(np.concatenate((r.choice(x, n - int(r.integers(0, n // 4 + 1)), replace=False), r.choice(universe, int(r.integers(0, 3)))))))
        both = len(np.intersect1d(x, y))
        if len(x) != len(y) and 100 * both >= 75 * (len(x) + len(y) - both) or (len(x) == len(y) and 100 * both >= 75 * (len(x) + len(y) - both) and both < len(x)):
            a, b = (set(jaccard.keys_of(z, np.array([often[int(h)] for h in z]), s)[0].tolist()) for z in (x, y))
            assert a & b


def test_pairs_are_told_once():
    r, told, seen = np.random.default_rng(3), jaccard._Told(200), set()
    for _ in range(60):
        a, b = np.sort(r.integers(-9, 9, (2, 40)), axis=0)
        got = list(zip(*(x.tolist() for x in told.fresh(a, b))))
        assert len(got) == len(set(got)) and set(got) == set(zip(a.tolist(), b.tolist())) - seen
        seen |= set(got)


def test_bitmap_bound():
    r = np.random.default_rng(3)
    for _ in range(200):
        x, y = (np.unique(r.integers(0, 200, int(r.integers(1, 150))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        assert jaccard.shared_at_most(jaccard.bitmap(x), jaccard.bitmap(y), len(x), len(y)) >= len(np.intersect1d(x, y))


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), (20, 1), (None, 1)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.id: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {k: got[k] for k in (1, 2, 3, 4, 20)} == dict.fromkeys((1, 2, 3, 4, 20), 1)
    assert {got[k] for k in (7, 8, 9)} == {7} and {got[k] for k in range(100, 141)} == {100} and 5 not in got
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("module", [jaccard, substrings, licenses])
def test_row_numbers_do_not_change_with_splits(spark, docs, monkeypatch, module):
    run = {jaccard: jaccard.join, substrings: substrings.remove_repeats, licenses: licenses.scan}[module]
    rows = lambda: [r.asDict() for r in run(docs).drop("rid", "root").collect()]
    want, write = rows(), _store._write

    def moved(df, path):
        out = write(df, path)
        spark.conf.set("spark.sql.files.minPartitionNum", "100")
        return out

    monkeypatch.setattr(_store, "_write", moved)
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        got = rows()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    same(got, want)


def test_counts_of_shingles_are_complete(spark, docs):
    """What blocks are told about their shingles, against counts over all sets."""
    store, s = _store.Scratch(spark), jaccard.Settings(frequent=3, range_hashes=700)
    table = _store.blocked(docs.select("doc_id", "text"), "test-blocks", store, block_bytes=2000)
    texts = [r.text for r in table.collect()]
    assert len({r.block for r in table.collect()}) > 10 and len({r.rid for r in table.collect()}) == len(ROWS)
    by_block = collections.defaultdict(set)
    for r in table.collect():
        for _, h, _ in jaccard.shingle_sets(pa.array([r.text]), 5):
            if len(h):
                by_block[r.block].add(tuple(h.tolist()))
    often = collections.Counter(x for sets in by_block.values() for h in sets for x in h)
    hashes = sum(len(h) for _, h, _ in jaccard.shingle_sets(pa.array(texts), 5))
    got = collections.defaultdict(set)
    for r in jaccard.postings(table, hashes, s).collect():
        got[r.id].add((r.n, tuple(sorted(r["keys"]))))
    want = collections.defaultdict(set)
    for sets in by_block.values():
        for h in sets:
            h = np.array(h, np.uint64)
            count = jaccard._OFTEN[jaccard._level(np.array([often[x] for x in h.tolist()]))]
            keys = jaccard.keys_of(h, count, s)[0].view(np.int64)
            want[int(jaccard.set_ids(h, np.array([0, len(h)]))[0])].add((len(h), tuple(sorted(keys.tolist()))))
    assert got == want


def test_shingles_of_most_texts_are_counted_once_a_block():
    footer = "all rights reserved by the owners of this page"
    texts = pa.array([sentence(12, random.Random(i)) + " " + footer for i in range(300)] + ["", None, "one two"])
    sent = list(jaccard._sent(5, 3)(iter([pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 7, 9], 101)), texts], ["block", "text"])])))
    table = pa.Table.from_batches(sent)
    sets = [h[a:b] for _, h, bounds in jaccard.shingle_sets(texts, 5) for a, b in zip(bounds[:-1], bounds[1:])]
    want = collections.Counter(int(c) for s in sets for c in jaccard._cells(s, 3))
    got = collections.Counter()
    for r in table.to_pylist():
        cells = np.frombuffer(r["data"], np.uint32)
        place, further = np.frombuffer(r["more"], np.uint32).reshape(2, -1)
        assert len(np.unique(cells)) == len(cells) and (further > 0).all()
        for c in cells.tolist():
            got[(r["range"] << 32) + c] += 1
        for p, n in zip(place.tolist(), further.tolist()):
            got[(r["range"] << 32) + int(cells[p])] += n
    assert got == want and max(want.values()) >= 300
    for number in range(3):
        own = table.filter(pa.array(np.array(table["range"]) == number))
        for r in jaccard._counted(own).to_pylist():
            cells = np.unique(np.concatenate([np.frombuffer(x["data"], np.uint32) for x in own.to_pylist() if x["block"] == r["block"]]))
            assert np.frombuffer(r["levels"], np.uint8).tolist() == jaccard._level(np.array([want[(number << 32) + int(c)] for c in cells])).tolist()


# -- 10: neighbours ---------------------------------------------------------------------------------------


def test_neighbours(spark, none):
    r = np.random.default_rng(8)
    v = r.normal(0, 1, (1500, 16)).astype(np.float32)
    v[700:900] = v[700]  # a crowd of equal vectors
    v[50] = v[49] * 2
    rows = [(i, [float(x) for x in v[i]]) for i in range(1500)]
    odd = [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, []), (2005, [float("inf")] * 16), (2050, [1.0] * 3), (2100, [2.0] * 3), (None, [1.0] * 16), rows[0]]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("shard", F.lit("x"))
    got = collections.defaultdict(list)
    for x in ann.search(df, df.where("vec_id % 50 = 0"), s=ann.Settings(shard_rows=400)).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x["rank"], x.vec_id, x.score))
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, 1500, 50):
        score = np.round(unit @ unit[q], 12)
        score[q] = -9
        want = np.lexsort((np.arange(1500), -score))[:5]
        assert [x[0] for x in got[q]] == [1, 2, 3, 4, 5] and q not in {x[1] for x in got[q]}
        hits += len(set(want.tolist()) & {x[1] for x in got[q]})
        total += 5
    assert hits >= 0.95 * total
    assert [x[1] for x in got[700]] == [701, 702, 703, 704, 705]
    assert [x[1] for x in got[2050]] == [2100] and not {2000, 2001, 2002} & set(got)
    two = spark.createDataFrame([(1, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.1, 1.0]), (3, [1.0, 0.1])], "vec_id long, embedding array<float>")
    assert [x.vec_id for x in ann.search(two, two.where("vec_id = 1"), k=1).collect()] == [2]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.search(empty, empty).count() == 0


def test_neighbours_of_streamed_queries_over_many_shards(spark):
    """More than ten shards at default settings but for their size, and queries in several chunks."""
    r = np.random.default_rng(5)
    v = (r.normal(0, 1, (40, 16))[r.integers(0, 40, 3000)] + r.normal(0, 0.5, (3000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(3000)], "vec_id long, embedding array<float>")
    got = collections.defaultdict(set)
    for x in ann.search(df, df.where("vec_id % 10 = 0"), s=ann.Settings(shard_rows=250, query_block=70, batch=16)).collect():
        got[x.query_id].add(x.vec_id)
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    score = unit[::10] @ unit.T
    score[np.arange(300), np.arange(0, 3000, 10)] = -9
    want = np.argsort(-score, axis=1)[:, :5]
    assert len(got) == 300 and all(len(x) == 5 for x in got.values())
    assert sum(len(got[10 * q] & set(want[q].tolist())) for q in range(300)) >= 0.98 * 1500


def test_quality_languages_of_little_text_stay_in_spark(spark):
    r = random.Random(1)
    rows = [(f"typo{i}", "a few words") for i in range(2000)] + [("en", " ".join(r.choice(VOCAB) for _ in range(400))) for _ in range(6)]
    references = quality.language_references(spark.createDataFrame(rows, "lang string, text string").repartition(3))
    assert [x["lang"] for x in references] == ["en"] and references[0]["total"] == 2400 and len(references[0]["words"]) == 50


def test_units_that_a_worker_keeps_and_decoding_take_little_memory():
    import tracemalloc

    r, p = random.Random(5), pieces.Pieces()
    texts = pa.array([" ".join("".join(r.choices("abcdefghij", k=7)) for _ in range(200)) for _ in range(200)])
    pieces.encode_batch(pa.array(["warm up"]), p)
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        ids = pieces.encode_batch(texts, p)
        kept = tracemalloc.get_traced_memory()[0] - before
        assert len(p.units) > 39_000 and kept < 70 * 40_000
        many = pa.concat_arrays([ids] * 4)
        before = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        again = pieces.decode_batch(many, p)
        assert len(many.values) > 400_000 and tracemalloc.get_traced_memory()[1] - before < 16_000_000
    finally:
        tracemalloc.stop()
    assert again.to_pylist() == texts.to_pylist() * 4


def test_network_cuts_logits_off_only_where_some_are_far(monkeypatch):
    net = small_network()
    r = np.random.default_rng(3)
    h, rank = r.uniform(-1, 1, (50, 5)).astype(np.float32), r.integers(0, 13, 50)

    def plain():
        s, v = net.v.s, net.v
        x = h.astype(float) @ net.to_class + net.class_bias
        kind = v.kind[rank]
        out = x[np.arange(50), kind] - np.log(np.exp(x).sum(axis=1)) + v.share[rank]
        for i in np.flatnonzero(kind < s.word_classes):
            part = slice(kind[i] * s.words_per_class, (kind[i] + 1) * s.words_per_class)
            y = net.to_word[part] @ h[i].astype(float) + net.word_bias[part]
            out[i] += y[rank[i] % s.words_per_class] - np.log(np.exp(y).sum())
        return out

    assert np.allclose(net.outputs(h, rank), plain(), atol=1e-4)
    cut, clip = [], np.clip
    monkeypatch.setattr(np, "clip", lambda *a, **b: cut.append(1) or clip(*a, **b))
    net.outputs(h, rank)
    assert not cut
    net.to_class *= 60 / np.abs(net.to_class).sum(axis=0).max()
    assert np.allclose(net.outputs(h, rank), plain(), atol=1e-2) and cut
