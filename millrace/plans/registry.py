"""All queries of the library and their SQL twins."""

from __future__ import annotations

import importlib

from millrace.plans.query import ORACLES, QUERIES

for _name in ("pricing", "catalog", "scalars", "feedback", "matching", "workbench", "templates", "sheets", "scans", "images", "streams", "stored"):
    importlib.import_module(f"millrace.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
