"""The queries of this package and their SQL."""

from __future__ import annotations

from . import queries_dedup, queries_filter, queries_mix, queries_scan

PARTS = (queries_filter, queries_dedup, queries_mix, queries_scan)


def queries():
    return {k: f for part in PARTS for k, f in part.QUERIES.items()}


def oracle_sql():
    return {k: f for part in PARTS for k, f in part.SQL.items()}
