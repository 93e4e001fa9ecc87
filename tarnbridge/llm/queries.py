"""The registered queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from . import chat, embedding_dedup, fingerprints, html_text, mixing, ngram_join, pieces, quality, runs, sharding, token_counts, token_files, vector_codes

QUERIES = {
    "op1_sentencepiece": pieces.op1_sentencepiece,
    "op2_quality": quality.op2_quality,
    "op3_sharding": sharding.op3_sharding,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_embedding_dedup": embedding_dedup.op5_embedding_dedup,
    "op6_fingerprints": fingerprints.op6_fingerprints,
    "op7_mixing": mixing.op7_mixing,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_html_extraction": html_text.op10_html_extraction,
    "op11_runs": runs.op11_runs,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_token_files": token_files.op13_token_files,
}

ORACLES = {
    "op3_sharding": sharding.ORACLE,
    "op4_ngram_join": ngram_join.ORACLE,
    "op5_embedding_dedup": embedding_dedup.ORACLE,
    "op6_fingerprints": fingerprints.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
}
