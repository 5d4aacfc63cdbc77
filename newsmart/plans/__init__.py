"""Registered queries, grouped by area."""

from __future__ import annotations

import importlib

MODULES = ["scalars", "feeds", "ingest", "clusters", "editions", "search", "knowledge", "markets", "audits"]


def load_all():
    from newsmart.plans.registry import REGISTRY

    for m in MODULES:
        importlib.import_module(f"newsmart.plans.{m}")
    return REGISTRY
