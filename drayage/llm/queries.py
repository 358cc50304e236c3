"""All queries of this subpackage."""

from __future__ import annotations

import importlib
import pkgutil

import drayage.llm
from drayage.llm.registry import REGISTRY, Registered


def load_all() -> dict[str, Registered]:
    for module in pkgutil.iter_modules(drayage.llm.__path__):
        if module.name.endswith("_query"):
            importlib.import_module(f"drayage.llm.{module.name}")
    return dict(REGISTRY)
