"""Loads every module that registers queries."""

from __future__ import annotations

import importlib
import pkgutil

import drayage.plans
from drayage.plans.registry import REGISTRY, Registered


def load_all() -> dict[str, Registered]:
    for module in pkgutil.iter_modules(drayage.plans.__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"drayage.plans.{module.name}")
    return dict(REGISTRY)
