"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from importlib import import_module

MODULES = ["quality_rules", "chat_format", "license_scan", "set_join", "decontaminate", "pii", "mixing", "warc", "toxicity", "token_counts", "token_alignment", "html_extraction",
           "merkle_manifest"]


def queries() -> dict:
    found = {}
    for name in MODULES:
        found.update(import_module(f"daygraph.llm.{name}").QUERIES)
    return found


def oracle_sql() -> dict:
    found = {}
    for name in MODULES:
        found.update(import_module(f"daygraph.llm.{name}").ORACLE)
    return found
