"""Registered queries."""

from __future__ import annotations

from importlib import import_module

from tallyframe.plans.registry import REGISTRY, Query

MODULES = ["scans", "joins", "aggregates", "windows", "detectors", "curves", "files"]


def all_queries() -> dict[str, tuple[Query, str | None]]:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return dict(REGISTRY)
