"""Named queries over the domain tables."""

from __future__ import annotations

from lodespark.plans.catalog import CORE, Catalog


def all_plans() -> list[Catalog]:
    """Imports every module of queries and returns the catalogs they fill."""
    import importlib
    import pkgutil

    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    return [CORE]
