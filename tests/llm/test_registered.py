"""The registered queries over a small folder of tables, and their SQL where there is some."""

import duckdb
import numpy as np
import pytest

from tests.llm.test_ops import DOCS, ROWS, sentence
from tidemark.llm import queries

COLUMNS = {
    "op1_sentencepiece": "doc_id",
    "op2_language_model": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op3_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op4_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op5_mix_sources": "doc_id size source_size target taken",
    "op6_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op7_repeated_substrings": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op8_toxicity": "doc_id held_out score predicted",
    "op9_jaccard_join": "doc_id n_shingles component_id",
    "op10_nearest_neighbours": "query_id rank vec_id score",
    "op11_hard_negatives": "anchor_id positive_id rank negative_id positive_score negative_score",
    "op12_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op13_vector_codes": "vec_id code error label_error codebooks_sha256",
}


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    docs = [(i, *r[1:]) for i, r in enumerate(ROWS)]
    spark.createDataFrame(docs, DOCS).repartition(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 3 // 2) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    pages = [(i, f"http://x/{i}", None if i == 3 else sentence(20) if i % 4 else "<p>same é</p>") for i in range(30)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    v = np.random.default_rng(1).normal(0, 1, (120, 8))
    spark.createDataFrame([(i, [float(x) for x in v[i]], i % 2) for i in range(120)], "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return str(at)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_registered_query(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    rows = df.collect()
    assert rows if name == "op11_hard_negatives" else len(rows) == {"op3_warc": 30, "op10_nearest_neighbours": 15, "op13_vector_codes": 120}.get(name, len(ROWS))
    if name not in queries.ORACLES:
        return
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    rounded = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert sorted(repr(rounded([r[c] for c in names])) for r in rows) == sorted(repr(rounded(r)) for r in cur.fetchall())
