"""Registered queries and the reference SQL each one is compared with."""

from __future__ import annotations

from importlib import import_module
from types import ModuleType

SECTIONS = ["series", "qualify", "market", "catalogue", "audit", "realseries", "ingest", "publish", "streaming", "files"]


def load_all() -> ModuleType:
    """Import every section and return the filled registry."""
    for section in SECTIONS:
        import_module(f"pricetrail.plans.{section}")
    return import_module("pricetrail.plans.registry")
