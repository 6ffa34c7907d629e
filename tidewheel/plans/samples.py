"""Constant control tables, the same rows for Spark and for SQL."""

from __future__ import annotations

TABLES = {
    "checkpoints": ("key string, committed long", [("orders:events:0", 100), ("orders:events:1", 50), ("orders:events:2", 0)]),
    "stale_checkpoints": ("key string, committed long", [("orders:events:0", -5), ("orders:events:1", 99999999), ("orders:events:2", 10), ("orders:events:3", 20)]),
    "marks": ("partition int, low long, high long", [(0, 0, 10), (1, -1, 4), (2, 9, 3), (3, 5, 5)]),
    "handlers": (
        "handler_id string, grp string, physical_key string, source_id string, fetcher_id string, fetch_policy string, startup string, connection_id string, target string, sink_parallelism int, batch_size int, max_parallelism int, cpus_per_task double, fetch_cpus double, stateful boolean, priority int, active int, sink_active int",
        [
            ("jsonl", "fan", "log|b1|orders", "demo", "fetch", "0.25|2", "earliest", "files", "out/jsonl", 8, 10, 4, 1.0, 0.25, False, 0, 0, 0),
            ("csv", "fan", "log|b1|orders", "demo", "fetch", "0.25|2", "earliest", "files", "out/csv", 2, 5, 4, 1.0, 0.25, False, 0, 0, 0),
            ("audit", None, "log|b1|orders", "demo", None, None, "latest", "db", "audit", 3, 100, 2, 0.5, 0.25, False, 5, 1, 1),
            ("model", None, "table|d1|orders", "tab", None, None, "latest", "db", "audit", 6, 50, 3, 2.0, 0.25, True, 1, 0, 1),
            ("x1", "odd", "log|b1|pay", "pay", "f1", "0.25|2", "latest", "db", "x", 4, 20, 4, 1.0, 0.5, False, 0, 0, 0),
            ("x2", "odd", "log|b2|pay", "pay2", "f2", "0.50|2", "earliest", "db", "x", 4, 30, 4, 1.0, 0.5, False, 0, 1, 1),
            ("lone", "one", "log|b1|solo", "solo", "f", "0.25|1", "latest", "db", "solo", 4, 20, 4, 1.0, 0.25, False, 0, 0, 0),
        ],
    ),
    "groups": ("grp string, backlog long, free_slots int, free_cpus double", [("fan", 25, 8, 4.0), ("odd", 90, 20, 16.0), ("one", 0, 20, 16.0)]),
    "more_handlers": ("stem string, name string, handler_id string", [("orders", "main", None), ("orders", "side", "explicit"), ("solo", None, None), ("pay", "x1", None), ("dup", "y", "explicit")]),
    "states": (
        "key string, handler_id string, source_id string, kind string, shard string, committed long, observed long, backlog long, arrival_rate double, processing_rate double, active_batch_id string, retention_gap string, priority int, waited double",
        [
            ("d:s:0", "d", "s", "log", "0", 9, 10, 1, 0.0, 0.0, None, None, 1, 0.0),
            ("a:s:0", "a", "s", "log", "0", 0, 100, 100, 0.0, 0.0, None, None, 0, 0.0),
            ("b:s:0", "b", "s", "log", "0", 0, 50, 50, 2.5, 1.0, None, None, 0, 0.0),
            ("c:s:0", "c", "s", "log", "0", 0, 50, 50, 0.0, 10.0, None, None, 0, 5.0),
            ("e:s:0", "e", "s", "log", "0", 10, 10, 0, 0.0, 0.0, None, None, 9, 0.0),
            ("f:s:0", "f", "s", "log", "0", 0, 70, 70, 0.0, 0.0, "b1", None, 9, 0.0),
            ("g:s:0", "g", "s", "log", "0", 5, 70, 65, 0.0, 0.0, None, "committed 5 is below retained 10", 9, 0.0),
            ("h:s:1", "h", "s", "log", "1", 0, 12, 12, 0.0, 3.0, "b2", None, 0, 1.0),
        ],
    ),
    "wants": ("key string, backlog long, batch_size int, max_parallelism int, cpus_per_task double, stateful boolean, free_slots int, handler_slots int, sink_slots int, free_cpus double", [("a", 25, 10, 4, 1.0, False, 64, 4, 8, 8.0), ("b", 1000, 10, 4, 2.0, False, 64, 3, 8, 5.0), ("c", 1000, 10, 4, 2.0, True, 64, 4, 1, 0.0), ("d", 0, 10, 4, 1.0, False, 64, 4, 8, 8.0), ("e", 90, 10, 4, 1.0, False, 64, -1, 8, 8.0)]),
    "candidates": ("key string, rank int, want int, slots_each int", [("d", 1, 1, 1), ("a", 2, 4, 1), ("b", 3, 3, 3), ("c", 4, 2, 1), ("z", 5, 4, 1)]),
    "contenders": (
        "key string, rank int, handler_id string, sink string, backlog long, batch_size int, handler_room int, sink_room int, sink_share int, slots_each int, cpus_each double, shared boolean",
        [
            ("d", 1, "h1", "s1", 1, 10, 4, 3, 1, 1, 1.0, False),
            ("a", 2, "h1", "s1", 100, 10, 4, 3, 1, 1, 1.0, False),
            ("g", 3, "group1", "s1", 50, 10, 4, 3, 2, 3, 2.0, True),
            ("b", 4, "h2", "s2", 30, 10, 4, 8, 1, 1, 2.0, False),
            ("c", 5, "h3", None, 1000, 10, 4, 100, 1, 1, 0.0, False),
            ("k", 6, "group2", "s3", 50, 10, 9, 8, 2, 3, 0.25, True),
            ("z", 7, "h4", "s4", 10, 10, 4, 8, 1, 1, 0.5, False),
        ],
    ),
    "topic_marks": ("topic string, partition int, low long, high long", [("a", 0, 0, 100), ("a", 1, 5, 50), ("b", 0, 3, 30), ("b", 1, 0, 7)]),
    "topic_checkpoints": ("key string, committed long", [("a:a:0", 40), ("b:b:1", 2)]),
    "runs": (
        "run_id string, batch_id string, handler_id string, status string, kind string",
        [("r1", "b1", "jsonl", "succeeded", "handler"), ("r2", "b1", "csv", "failed", "handler"), ("r3", "b2", "audit", "running", "handler"), ("r4", "b2", "audit", "submitted", "handler"), ("r5", "b3", "jsonl", "running", "fetch"), ("r6", "b4", "model", "succeeded", "handler"), ("r7", "b4", "model", "succeeded", "handler"), ("r8", "b2", "model", "running", "handler")],
    ),
    "batches": (
        "batch_id string, key string, status string, outcome string, start_offset long, end_offset long, item_count long, reserved int",
        [("b1", "f:s:0", "running", "failed", 0, 20, 20, 0), ("b2", "h:s:1", "running", "succeeded", 0, 5, 5, 2), ("b3", "a:s:0", "running", "succeeded", 0, 10, 10, 4), ("b4", "c:s:0", "failed", "failed", 7, 9, 2, 0)],
    ),
    "saved": (
        "key string, kind string, value string, version int",
        [("k1", "offset", "42", 1), ("k1", "offset", "50", 2), ("k2", "cursor", '{"ts": "2026-01-01T00:00:00+00:00", "pk": 123}', 1), ("k3", "offset", "7", 3), ("k3", "offset", "6", 2)],
    ),
    "texts": ("id int, brokers string, cursor string, name string", [(1, "b1:9092, b2:9092", "2026-01-01T00:00:00Z", "orders"), (2, " b3:9092 ,,", "2026-02-03T04:05:06+00:00", "public.orders"), (3, "", "2026-03-01T12:30:00Z", "1bad"), (4, "x", "2025-12-31T23:59:59Z", "drop table")]),
    "batch_ranges": ("start_offset long, end_offset long", [(0, 10), (10, 20), (20, 25)]),
}


_SQL_TYPES = {"string": "varchar", "long": "bigint", "int": "integer", "double": "double", "boolean": "boolean"}


def _values(rows) -> str:
    def literal(v):
        return "null" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower()

    return ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)


def frame(spark, name):
    """The table as literals of the plan, whose size Spark knows, so that it joins them without a shuffle."""
    schema, rows = TABLES[name]
    columns = [c.split() for c in schema.split(", ")]
    names = ", ".join(f"`{c}`" for c, _ in columns)
    return spark.sql(f"select {', '.join(f'cast(`{c}` as {t}) as `{c}`' for c, t in columns)} from values {_values(rows)} as v({names})")


def cte(name: str) -> str:
    schema, rows = TABLES[name]
    columns = [c.split() for c in schema.split(", ")]
    values = _values(rows)
    names = ", ".join(f'"{c}"' for c, _ in columns)
    casts = ", ".join(f'cast("{c}" as {_SQL_TYPES[t]}) as "{c}"' for c, t in columns)
    return f"{name} as (select {casts} from (values {values}) as v({names}))"
