"""Queries over the driver's tables, each with the SQL that must give the same rows."""

from .registry import ORACLE_SQL, QUERIES, Query


def all_queries() -> tuple[dict[str, Query], dict[str, str]]:
    from . import commerce, imports, mechanisms, relational, shop, streams, textual, writes  # noqa: F401  they file their queries

    return dict(QUERIES), dict(ORACLE_SQL)
