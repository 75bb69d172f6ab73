"""All registered queries of the library's own operators, and their SQL."""

from __future__ import annotations

import importlib

from .register import ORACLE_SQL, QUERIES

for _name in ("functions", "relational", "windows", "retrieval", "texts", "sync", "records"):
    importlib.import_module(f"lexiloom.plans.{_name}")

__all__ = ["ORACLE_SQL", "QUERIES"]
