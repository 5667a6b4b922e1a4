"""Operators bound to the driver's tables."""

from importlib import import_module
from typing import NamedTuple

MODULES = ("runs", "normalization", "selections", "distance", "summaries", "alignment", "integrity", "sessions")


class Registered(NamedTuple):
    queries: dict
    oracles: dict


def load() -> Registered:
    """Import every module of registered queries."""
    from gapwise.bindings import registry

    for module in MODULES:
        import_module(f"gapwise.bindings.{module}")
    return Registered(registry.QUERIES, registry.ORACLES)
