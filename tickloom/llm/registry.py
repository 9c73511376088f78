"""The queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

from . import op1_exact_dedup, op10_language, op11_resampling, op12_embeddings, op13_intervals, op2_minhash, op3_chat, op4_sharding, op5_mixing, op6_fingerprint, op7_quality, op8_warc, op9_bpe

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup.query,
    "op2_minhash": op2_minhash.query,
    "op3_chat": op3_chat.query,
    "op4_sharding": op4_sharding.query,
    "op5_mixing": op5_mixing.query,
    "op6_fingerprint": op6_fingerprint.query,
    "op7_quality": op7_quality.query,
    "op8_warc": op8_warc.query,
    "op9_bpe": op9_bpe.query,
    "op10_language": op10_language.query,
    "op11_resampling": op11_resampling.query,
    "op12_embeddings": op12_embeddings.query,
    "op13_intervals": op13_intervals.query,
}

SQL = {
    "op1_exact_dedup": op1_exact_dedup.SQL,
    "op3_chat": op3_chat.SQL,
    "op8_warc": op8_warc.SQL,
    "op11_resampling": op11_resampling.SQL,
    "op12_embeddings": op12_embeddings.SQL,
    "op13_intervals": op13_intervals.SQL,
}
