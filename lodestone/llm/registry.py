"""Queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from lodestone.llm import html, langid, lattice, mixing, pieces, pii, quality, simhash, tokens, urls

QUERIES = {
    "op1_url_filters": urls.query,
    "op2_language_id": langid.query,
    "op3_mixing": mixing.query,
    "op4_sentencepiece": pieces.query,
    "op5_embedding_near_dedup": lattice.query,
    "op6_token_ids": tokens.query,
    "op7_html_extraction": html.query,
    "op8_simhash_near_dedup": simhash.query,
    "op9_quality_rules": quality.query,
    "op10_pii": pii.query,
}
ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": urls.ORACLE,
    "op3_mixing": mixing.ORACLE,
    "op5_embedding_near_dedup": lattice.ORACLE,
}
