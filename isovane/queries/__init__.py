"""Queries over the given tables, named by operator, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["surface", "meshes", "normal_fields", "fields", "reconstruction", "stored"]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in import_module(f"isovane.queries.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in import_module(f"isovane.queries.{m}").SQL.items()}
