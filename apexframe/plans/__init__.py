"""Every registered query; importing the modules fills the registry."""

from __future__ import annotations

import importlib
import pkgutil

from apexframe.plans import registry


def _load() -> None:
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        if module != "registry":
            importlib.import_module(f"{__name__}.{module}")


def queries():
    _load()
    return dict(registry.QUERIES)


def oracle_sql():
    _load()
    return registry.oracle_sql()
