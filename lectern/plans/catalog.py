"""Importing the query modules fills the registry."""

import importlib

from lectern.plans import registry

MODULES = [
    "queries_retrieval",
    "queries_corpus",
    "queries_reading",
    "queries_grounding",
    "queries_scoring",
    "queries_sections",
    "queries_actions",
    "queries_review",
    "queries_io",
    "queries_streaming",
    "queries_misc",
]

for _module in MODULES:
    importlib.import_module(f"lectern.plans.{_module}")

QUERIES = registry.QUERIES
oracle_sql = registry.oracle_sql
