"""Registered queries of the training-data operators."""

from tidemark.llm import ann, codes, counts, jaccard, licenses, lm, mixing, negatives, oracles, pieces, quality, substrings, toxicity, warc

QUERIES = {
    "op1_sentencepiece": pieces.op1,
    "op2_language_model": lm.op2,
    "op3_warc": warc.op3,
    "op4_license_scan": licenses.op4,
    "op5_mix_sources": mixing.op5,
    "op6_quality_rules": quality.op6,
    "op7_repeated_substrings": substrings.op7,
    "op8_toxicity": toxicity.op8,
    "op9_jaccard_join": jaccard.op9,
    "op10_nearest_neighbours": ann.op10,
    "op11_hard_negatives": negatives.op11,
    "op12_token_counts": counts.op12,
    "op13_vector_codes": codes.op13,
}
ORACLES = {
    "op3_warc": warc.OP3_SQL,
    "op5_mix_sources": mixing.OP5_SQL,
    "op7_repeated_substrings": oracles.OP7_SQL,
    "op9_jaccard_join": oracles.OP9_SQL,
    "op11_hard_negatives": negatives.OP11_SQL,
    "op13_vector_codes": codes.OP13_SQL,
}
