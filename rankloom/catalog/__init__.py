"""Registered queries: every operator run on the driver's tables, with its SQL counterpart."""

from __future__ import annotations

import importlib

MODULES = ("cleaning", "features", "ranking", "exposure", "splits", "statistics", "audits", "models")


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for module in MODULES:
        found = getattr(importlib.import_module(f"rankloom.catalog.{module}"), attribute)
        clash = merged.keys() & found.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        merged.update(found)
    return merged


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("SQL")
