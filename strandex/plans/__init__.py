"""Named query plans and the SQL they are checked against."""

from __future__ import annotations

from .common import Query, Registry


def registries() -> list[Registry]:
    from . import evidence, kept, relational, search, state, streams

    return [search.R_, relational.R, evidence.R, state.R, streams.R, kept.R]


def queries() -> dict[str, Query]:
    return {k: v for r in registries() for k, v in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for r in registries() for k, v in r.sql.items()}
