"""Queries of the training-data operators."""

from __future__ import annotations

from spotloom.llm import align, byte_bpe, decontaminate, exact_substrings, fm_quality, gru_lm, line_dedup, quality_rules, secret_scan, simhash, toxicity, url_filter, word_runs

MODULES = (secret_scan, decontaminate, byte_bpe, fm_quality, simhash, quality_rules, url_filter, toxicity, exact_substrings, gru_lm, line_dedup, align, word_runs)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
