"""Registered queries over the provided tables."""

import importlib

from tracewell.plans.registry import ORACLES, QUERIES

MODULES = ("detection", "rollups", "checks", "splits", "relational", "signals", "detectors", "thermal", "learning", "streams", "storage")

for _name in MODULES:
    importlib.import_module(f"tracewell.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
