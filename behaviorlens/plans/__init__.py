"""Query catalogue: every registered query and its oracle SQL."""

from __future__ import annotations

from . import behavior, io, models, report, sql_behavior, sql_io, sql_models, sql_report, sql_text, text

_QUERY_MODULES = [behavior, models, text, report, io]
_SQL_MODULES = [sql_behavior, sql_models, sql_text, sql_report, sql_io]


def queries() -> dict:
    out = {}
    for m in _QUERY_MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict:
    out = {}
    for m in _SQL_MODULES:
        out.update(m.SQL)
    return out
