"""Every archive query and its SQL."""

from __future__ import annotations

from tabulary.plans import archive, enrichment, labels, pages, records, titles

_PARTS = (archive, enrichment, labels, pages, records, titles)


def queries() -> dict:
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
