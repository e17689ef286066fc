"""All named queries of the core, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import shipped
from . import agree, det, ev, extra, hyp, prep, sig

_MODULES = (hyp, ev, agree, sig, det, extra, prep)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in _MODULES:
        found |= {name: shipped(query) for name, query in module.QUERIES.items()}
    return found


def sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in _MODULES:
        found |= getattr(module, "SQL", {})
    return found
