"""Registry of the core queries and their SQL twins."""

from __future__ import annotations

from sfumato.queries import harness, measures, models, more, reshape, twins, univariate

MODULES = (univariate, measures, models, more, harness, reshape)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in (*MODULES, twins) for k, v in m.SQL.items()}
