"""Whole flows built from operators, and the registered queries."""

from __future__ import annotations

import importlib

QUERY_MODULES = ["queries_checks", "queries_data", "queries_rules"]


def catalogue_of_queries() -> tuple[dict, dict]:
    """(queries, SQL) of all query modules."""
    from siftline.plans import registry

    for name in QUERY_MODULES:
        importlib.import_module(f"siftline.plans.{name}")
    return dict(registry.QUERIES), dict(registry.ORACLES)
