"""The registered queries and, beside them, the SQL that says the same."""

from __future__ import annotations

from gossamer.plans import crawls, pages, work

_PARTS = (pages, work, crawls)


def queries() -> dict:
    return {k: v for m in _PARTS for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _PARTS for k, v in m.ORACLES.items()}
