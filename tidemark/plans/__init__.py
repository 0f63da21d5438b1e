"""Registered queries, one module per family of operators."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    """Import every family and return the filled registry."""
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    return importlib.import_module(f"{__name__}.base")
