"""Queries over the given tables, and the flows that chain the operators."""

from __future__ import annotations

from importlib import import_module
from types import ModuleType

GROUPS = ["io", "prep", "split", "profile", "text", "keyrank", "phrase", "features", "rank", "model"]


def load_catalogue() -> ModuleType:
    """Import every group of queries and return the registry module."""
    for group in GROUPS:
        import_module(f"answerrec.plans.{group}_queries")
    return import_module("answerrec.plans.catalogue")
