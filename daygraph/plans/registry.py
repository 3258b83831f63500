"""All registered queries and their SQL, gathered from the topic modules."""

from __future__ import annotations

from importlib import import_module

TOPICS = ["graph", "verify", "journal", "prepare", "evaluate", "text", "io", "stream", "udf", "model", "report"]


def queries() -> dict:
    found = {}
    for topic in TOPICS:
        found.update(import_module(f"daygraph.plans.{topic}_queries").QUERIES)
    return found


def oracle_sql() -> dict:
    found = {}
    for topic in TOPICS:
        found.update(import_module(f"daygraph.oracle.{topic}").ORACLE)
    return found
