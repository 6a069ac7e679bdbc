"""The registered queries of this subpackage: each applies one operator to whole tables."""

from __future__ import annotations

import importlib
import pkgutil


def _modules():
    return [importlib.import_module(f"{__name__}.{m.name}") for m in pkgutil.iter_modules(__path__) if m.name.startswith("op")]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in vars(m).items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of each module that has it."""
    return {k: m.ORACLE_SQL for m in _modules() if getattr(m, "ORACLE_SQL", None) for k in vars(m) if k.startswith("op")}
