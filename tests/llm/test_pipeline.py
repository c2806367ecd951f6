"""The pipeline's stages against brute force, each judged on its own input."""

import collections

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from tests.llm.test_ops import linked, repeats, sentence

LENGTH = 200


def test_stages(spark, tmp_path):
    import random

    r = random.Random(12)
    bad = ["worthless", "pathetic", "disgusting", "moron"]
    shared = sentence(70, r)
    rows = []
    for i in range(300):
        words = sentence(r.randint(60, 160), r).split()
        if i % 4 == 0:
            for _ in range(6):
                words.insert(r.randint(0, len(words)), r.choice(bad))
        if i % 10 == 3:
            words[20:20] = shared.split()
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 0))
    rows += [(1000 + i, rows[4 * i + 1][1], "en", "s0", 0) for i in range(10)]
    rows += [(2000 + i, rows[4 * i + 1][1] + " tail", "en", "s1", 0) for i in range(10)] + [(3000, None, None, None, None), (3001, "", None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = rows
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{sf}/out{k}")
        docs = spark.read.parquet(f"{sf}/out{k}")
        got = [tuple(x) for x in docs.collect()]
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "toxicity":
            kept = {x[0] for x in got}
            assert len([i for i in range(300) if (i % 4 == 0) == (i in kept)]) <= 6 and {3000, 3001} <= kept
        elif name == "n-gram Jaccard join":
            want = {c for _, n, c in linked(before) if n}
            assert {x[0] for x in got} - {3000, 3001} == want and len(got) == len(want) + 2
        elif name == "suffix-array dedup":
            gone = {b[0]: x for b, x in zip(before, repeats([(b[1] or "").encode() for b in before], LENGTH))}
            assert len(got) == len(before)
            assert {x[0]: len((x[1] or "").encode()) for x in got} == {i: n - m for i, (n, m, *_) in gone.items()}
            assert any(m for _, m, *_ in gone.values())
        elif name.startswith("mixing"):
            had = collections.Counter(x[0] for x in before)
            assert all(n <= 2 * had[i] for i, n in collections.Counter(x[0] for x in got).items())
        else:
            assert len(got) == len(before) and docs.where(~F.col("round_trip")).count() == 0
        before = got
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(setting, "3m")
    assert pipeline.run(spark, sf).count() == len(before) and spark.conf.get(setting) == "3m"
    spark.conf.unset(setting)


def test_near_copies_with_null_and_reused_ids(spark, tmp_path):
    import random

    r = random.Random(4)
    a, b, c, d, e = (sentence(80, r) for _ in range(5))
    rows = [(None, a), (None, a), (None, b), (None, b + " tail"), (7, c), (7, d), (7, d), (9, e), (None, e)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(i, t, "en", "s0", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(path)
    got = sorted(((x.doc_id or 0, x.text.removesuffix(" tail")) for x in pipeline.near_copies_stage(spark, spark.read.parquet(path), str(tmp_path)).collect()))
    assert got == sorted([(0, a), (0, b), (7, c), (7, d), (9, e)])


CLASHING = ("rid", "block", "ranges", "size", "score", "kept", "copy", "copies", "predicted", "n_bytes", "n_removed", "n_spans", "target", "source_size", "root", "component_id", "n_shingles", "other_columns", "docs", "a.b")


def test_stages_carry_clashing_columns_and_take_empty_tables_and_null_labels(spark, tmp_path):
    import random

    r = random.Random(8)
    texts = [sentence(60, r) + (" worthless pathetic moron" * 5 if i % 4 == 0 else "") for i in range(60)]
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)] + [(100 + i, texts[i], None, None, None) for i in range(6)] + [(None, None, None, "s0", None), (None, "", "en", "s1", 0), (None, None, None, "s0", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    df.select("*", *(key.alias(c) for c in CLASHING)).repartition(2).write.parquet(f"{tmp_path}/clashing")
    df.repartition(2).write.parquet(f"{tmp_path}/plain")
    df.limit(0).select("*", *(key.alias(c) for c in CLASHING)).write.parquet(f"{tmp_path}/none")
    labels = [(i, None, int(i % 4 == 0)) for i in range(60)] + [(1, 1, None), (None, 1, 1), (None, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    clashing, plain, none = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("clashing", "plain", "none"))
    own = ("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, clashing, str(tmp_path))
        assert got.columns == clashing.columns, name
        found = got.collect()
        assert found and all(x[c] == ("none" if x.doc_id is None else str(x.doc_id)) for x in found for c in CLASHING), name
        same = sorted(map(repr, (tuple(x[c] for c in own) for x in stage(spark, plain, str(tmp_path)).collect())))
        assert sorted(map(repr, (tuple(x[c] for c in own) for x in found))) == same, name
        empty = stage(spark, none, str(tmp_path))
        assert empty.columns == none.columns and empty.count() == 0, name
    name, stage = pipeline.STAGES[-1]
    assert stage(spark, clashing, str(tmp_path)).count() == len(rows) and stage(spark, none, str(tmp_path)).count() == 0
