"""Registered queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = ("redaction", "audit", "words", "reporting", "showcase", "lists", "stores")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for module in _MODULES:
        out.update(getattr(import_module(f"inkveil.plans.{module}"), attribute))
    return out


def all_queries() -> dict[str, Query]:
    return _merged("QUERIES")


def all_oracles() -> dict[str, str]:
    return _merged("ORACLES")
