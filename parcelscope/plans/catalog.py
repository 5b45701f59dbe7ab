"""All registered queries, gathered from the section modules."""

import importlib

from parcelscope.plans.registry import ORACLES, QUERIES, full_sql  # noqa: F401

for _m in ("shared_sql", "tables_and_sources", "relational", "quality", "label_and_history", "routes_and_context", "freight_and_friction", "statistics", "evaluation"):
    importlib.import_module(f"parcelscope.plans.{_m}")
