"""All registered queries."""

import importlib
import pkgutil

from residua.plans.catalog.registry import CATALOG, Query

for _module in pkgutil.iter_modules(__path__):
    importlib.import_module(f"{__name__}.{_module.name}")

__all__ = ["CATALOG", "Query"]
