"""Sinks that a retry overwrites: rows are partitioned by dispatch_id and only those partitions are replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _write(rows: DataFrame, target: str, kind: str, limit: int, **options) -> None:
    writer = rows.coalesce(limit).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dispatch_id")
    writer.format(kind).options(**options).save(target)


def write_jsonl(rows: DataFrame, target: str, limit: int = 8) -> None:
    _write(rows, target, "json", limit)


def write_csv(rows: DataFrame, target: str, limit: int = 8) -> None:
    _write(rows, target, "csv", limit, header=True)


SINKS = {"jsonl": write_jsonl, "csv": write_csv}
