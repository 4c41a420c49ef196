"""Queries over the bundled test tables, each with its reference SQL."""
import importlib

MODULES = ("ranking", "filters", "nulls", "estimands", "alignment", "pooling", "provenance", "reports", "sources")


def load() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
