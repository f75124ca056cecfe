"""Collects every registered query."""

from __future__ import annotations

import importlib

from quotegrid.workloads.registry import ORACLE, QUERIES

MODULES = [
    "q_scan_filter",
    "q_join_agg",
    "q_window_top",
    "q_models",
    "q_forecast",
    "q_quality",
    "q_plans",
]

for _name in MODULES:
    importlib.import_module(f"quotegrid.workloads.{_name}")

__all__ = ["ORACLE", "QUERIES"]
