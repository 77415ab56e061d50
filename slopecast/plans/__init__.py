"""End-to-end plans over the driver's tables: fixtures, queries and their SQL twins."""

from __future__ import annotations

import importlib
import pkgutil

from .registry import REGISTRY, Query


def all_queries() -> dict[str, Query]:
    """Import every ``q_*`` module once and return the registry."""
    for mod in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.startswith("q_")):
        importlib.import_module(f"{__name__}.{mod}")
    return REGISTRY
