"""Queries over the given tables with SQL for DuckDB that must agree."""

from importlib import import_module

MODULES = ("detection", "sources", "tokens", "history", "accuracy", "paired", "streams", "project")


def all_checks() -> None:
    for name in MODULES:
        import_module(f"checks.{name}")
