"""All named queries of the library, gathered from the modules that define them."""

from __future__ import annotations

from importlib import import_module

MODULES: tuple[str, ...] = ("places", "records", "rankings", "supply", "roads", "trials", "files")


def queries() -> dict:
    return {k: f for m in MODULES for k, (f, _) in import_module(f"sitewright.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: sql for m in MODULES for k, (_, sql) in import_module(f"sitewright.plans.{m}").QUERIES.items() if sql}
