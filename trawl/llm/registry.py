"""The thin queries over these operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import importlib

MODULES = ("q_ngram_join", "q_toxicity", "q_suffix_dedup", "q_kd_shards", "q_warc", "q_sentencepiece", "q_substring_dedup", "q_decontaminate", "q_quality", "q_embedding_dedup")


def _modules():
    return [importlib.import_module(f"trawl.llm.{m}") for m in MODULES]


def queries() -> dict:
    return {m.NAME: m.query for m in _modules()}


def oracle_sql() -> dict:
    return {m.NAME: m.SQL for m in _modules() if getattr(m, "SQL", None)}
