"""All pN_ queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

MODULES = ["folding", "repeated_lines", "leakage", "history", "mojibake", "packing", "residue", "furniture", "truncation"]

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _m in MODULES:
    _mod = importlib.import_module(f"pressloom.llm.{_m}")
    QUERIES.update(_mod.QUERIES)
    ORACLES.update(getattr(_mod, "ORACLES", {}))
