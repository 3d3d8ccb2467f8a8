"""Registered queries of the engine's operators, each with the SQL that checks it where SQL can."""

from __future__ import annotations

import importlib
import pkgutil


def _modules():
    names = sorted(m.name for m in pkgutil.iter_modules(__path__) if not m.name.startswith("_"))
    return [importlib.import_module(f"{__name__}.{n}") for n in names]


def queries() -> dict:
    out: dict = {}
    for module in _modules():
        out |= module.QUERIES
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for module in _modules():
        out |= module.ORACLES
    return out
