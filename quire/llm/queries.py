"""All queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

MODULES = ("p1_pair_defects", "p2_sentence_pairs", "p3_lookalike", "p4_term_counts", "p5_survivor", "p6_packing", "p7_leaks", "p8_truncation")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
