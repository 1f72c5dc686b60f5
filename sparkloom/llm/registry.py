"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from . import ann_forest, bpe, divergence, html_text, lexical_search, line_dedup, mixing, ngram_jaccard, personal_data, quality_knn, quality_rules, tool_calls, warc

QUERIES = {
    "op1_bpe": bpe.query,
    "op2_mixing": mixing.query,
    "op3_ann_forest": ann_forest.query,
    "op4_quality_knn": quality_knn.query,
    "op5_tool_calls": tool_calls.query,
    "op6_ngram_jaccard": ngram_jaccard.query,
    "op7_line_dedup": line_dedup.query,
    "op8_warc": warc.query,
    "op9_quality_rules": quality_rules.query,
    "op10_html_text": html_text.query,
    "op11_divergence": divergence.query,
    "op12_lexical_search": lexical_search.query,
    "op13_personal_data": personal_data.query,
}
ORACLES: dict[str, str] = {
    "op2_mixing": mixing.ORACLE,
    "op5_tool_calls": tool_calls.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op8_warc": warc.ORACLE,
    "op11_divergence": divergence.ORACLE,
    "op12_lexical_search": lexical_search.ORACLE,
}
