"""The queries of the street operators and their SQL, gathered for the entry module."""

from __future__ import annotations

from importlib import import_module

MODULES = ("topology", "planar")


def _gather(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"{__package__}.queries.{module}"), name)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE")
