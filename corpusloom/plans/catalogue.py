"""All registered queries over the driver's tables, with SQL that gives the same rows where there is such SQL."""

from __future__ import annotations

from . import event_queries, graph_queries, stage_queries, text_queries
from .registry import Query

PARTS = (text_queries.REG, graph_queries.REG, stage_queries.REG, event_queries.REG)


def queries() -> dict[str, Query]:
    return {name: run for part in PARTS for name, run in part.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.sql.items()}
