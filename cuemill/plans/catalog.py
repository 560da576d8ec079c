"""Queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from cuemill.plans import file_queries, job_queries, rule_queries, stage_queries, transcript_queries
from cuemill.plans.registry import Query

FLAGSHIP = "w2_cue_times"
_ALL = (transcript_queries.query, job_queries.query, file_queries.query, rule_queries.query, stage_queries.query)


def queries() -> dict[str, Query]:
    return {name: f for part in _ALL for name, f in part.found.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _ALL for name, sql in part.sql.items()}
