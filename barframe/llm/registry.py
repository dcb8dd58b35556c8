"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

_WHERE = {
    "op1_html_extraction": "html",
    "op2_lm_scoring": "ppm",
    "op3_quality_rules": "quality",
    "op4_sharding": "sharding",
    "op5_sentencepiece": "pieces",
    "op6_ngram_jaccard": "jaccard",
    "op7_media_columns": "gif",
    "op8_packing": "packing",
    "op9_language_id": "langid",
    "op10_chat_formatting": "chat",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _WHERE.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None) for name, module in _WHERE.items()}
    return {k: v for k, v in found.items() if v}
