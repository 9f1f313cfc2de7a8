"""All registered queries outside the training-data subpackage, with their SQL."""

from __future__ import annotations

from gradeloom.plans import cohort_queries, event_queries, extra_queries, more_queries, service_queries, text_queries

_PARTS = (cohort_queries, text_queries, event_queries, more_queries, extra_queries, service_queries)


def queries() -> dict:
    return {name: run for part in _PARTS for name, run in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.oracle_sql().items()}
