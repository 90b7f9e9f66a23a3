"""Registered queries: name to (spark, sf_dir) callable, and their SQL twins."""

from importlib import import_module

from tidegrid.catalog.base import ORACLES, QUERIES

_MODULES = ("panel", "features", "operations", "quality", "evaluation", "models", "live")


def _load() -> None:
    for name in _MODULES:
        import_module(f"tidegrid.catalog.{name}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_oracles():
    _load()
    return dict(ORACLES)
