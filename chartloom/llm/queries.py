"""Registered queries of this folder and their SQL checks."""

from __future__ import annotations

from chartloom.llm import (
    decontaminate, factor_quality, html_lstm, merkle_manifest, metric_codes, piece_codec, poly_dedup, secret_forest, sentence_spans,
    separator_scan, simhash_cover, stable_buckets, token_files,
)

QUERIES = {
    "op1_secret_forest": secret_forest.op1_secret_forest,
    "op2_separator_scan": separator_scan.op2_separator_scan,
    "op3_simhash_cover": simhash_cover.op3_simhash_cover,
    "op4_html_lstm": html_lstm.op4_html_lstm,
    "op5_token_files": token_files.op5_token_files,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_poly_dedup": poly_dedup.op7_poly_dedup,
    "op8_factor_quality": factor_quality.op8_factor_quality,
    "op9_piece_codec": piece_codec.op9_piece_codec,
    "op10_sentence_spans": sentence_spans.op10_sentence_spans,
    "op11_merkle_manifest": merkle_manifest.op11_merkle_manifest,
    "op12_stable_buckets": stable_buckets.op12_stable_buckets,
    "op13_metric_codes": metric_codes.op13_metric_codes,
}
CHECKS = {
    "op6_decontaminate": decontaminate.OP6_SQL, "op7_poly_dedup": poly_dedup.OP7_SQL, "op11_merkle_manifest": merkle_manifest.OP11_SQL,
}
