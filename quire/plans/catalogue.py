"""All queries of the core operators, and the SQL that checks them."""

from __future__ import annotations

import importlib

MODULES = ("text_queries", "layout_queries", "table_queries", "kb_queries", "quality_queries", "register_queries")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
