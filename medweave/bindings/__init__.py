"""Queries over the test tables: every operator with inputs made from them, and the same result in SQL."""

from __future__ import annotations

from importlib import import_module

from medweave.bindings.common import ORACLE, QUERIES

FAMILIES = ("eras", "people", "vocab", "feeds", "governance", "nested", "quality", "tables")


def load() -> tuple[dict, dict]:
    """All queries and their SQL."""
    for family in FAMILIES:
        import_module(f"medweave.bindings.{family}")
    return QUERIES, ORACLE
