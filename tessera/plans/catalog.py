"""All registered queries of the engine, with their SQL."""

from __future__ import annotations

from . import base, languages, relational  # noqa: F401  they register their queries


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
