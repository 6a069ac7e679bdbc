"""The registered queries of the measurement operators and their SQL."""

from __future__ import annotations

import importlib
import pkgutil

from tabvox import plans
from tabvox.plans.base import QUERIES, SQL


def _load() -> None:
    for m in pkgutil.iter_modules(plans.__path__):
        importlib.import_module(f"tabvox.plans.{m.name}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
