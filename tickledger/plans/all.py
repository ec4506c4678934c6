"""Importing this module registers every query."""

import importlib
import pkgutil

from . import registry

for _m in pkgutil.iter_modules(__path__ if "__path__" in globals() else importlib.import_module("tickledger.plans").__path__):
    if _m.name.startswith("queries_"):
        importlib.import_module(f"tickledger.plans.{_m.name}")

QUERIES, CHECKS = registry.QUERIES, registry.CHECKS
