"""Registered queries, grouped by area."""

from __future__ import annotations

import importlib

_AREAS = ("tasks", "corpus", "blocks", "tree", "toc", "evidence", "streaming")


def load_catalog():
    from clauseloom.plans.catalog import CATALOG
    for area in _AREAS:
        importlib.import_module(f"clauseloom.plans.{area}_queries")
    return CATALOG
