"""All registered queries of the library outside its optional subpackage."""

from __future__ import annotations

from . import features, inputs, markets, models, relational, search, statistics

MODULES = (features, markets, statistics, search, models, inputs, relational)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.R.queries.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.R.sql.items()}
