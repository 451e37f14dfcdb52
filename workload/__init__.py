"""Registered queries over the driver's tables, each with its SQL counterpart where SQL can express it."""

from importlib import import_module

GROUPS = ("recommend_checks", "catalog_checks", "analysis_checks", "ingest_checks", "source_checks")


def all_checks():
    """The registry with every group loaded."""
    for group in GROUPS:
        import_module(f"workload.{group}")
    return import_module("workload.registry")
