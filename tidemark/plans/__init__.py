"""The query registry: one entry per operator, with its oracle SQL."""

from __future__ import annotations

import importlib
import pkgutil

from tidemark.plans.registry import REGISTRY


def load_all():
    """Imports every query module (names start with q_) and returns the registry."""
    for m in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.startswith("q_")):
        importlib.import_module(f"{__name__}.{m}")
    return REGISTRY
