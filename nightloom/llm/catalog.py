"""All named queries of the add-on, and their SQL."""

from __future__ import annotations

from ..session import shipped
from . import queries as _queries
from . import sql as _sql


def queries() -> dict:
    return {name: shipped(query) for name, query in _queries.QUERIES.items()}


def sql() -> dict[str, str]:
    return dict(_sql.SQL)
