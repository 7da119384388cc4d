"""Every query of this library, by name, with its SQL where SQL can say it."""

from __future__ import annotations

import importlib

MODULES = ("retrieval", "catalog", "quality", "parsing")

QUERIES: dict = {}
SQL: dict = {}
for _name in MODULES:
    _module = importlib.import_module(f"tessella.plans.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
