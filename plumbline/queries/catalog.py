"""Loads every query module and exposes the filled registry."""

import importlib
import pkgutil

import plumbline.queries as package
from plumbline.queries.registry import ITEMS, ORACLE, QUERIES

for module in pkgutil.iter_modules(package.__path__):
    if module.name not in ("registry", "catalog"):
        importlib.import_module(f"{package.__name__}.{module.name}")

__all__ = ["ITEMS", "ORACLE", "QUERIES"]
