"""Options of Spark's own connectors for logs and tables, and the registry of source kinds.

The Kafka and JDBC jars are not part of this repository; these functions only map specifications.
"""

from __future__ import annotations

import json

from ..operators import keyset
from ..types import LogSource, SpecError, TableSource, quoted, quoted_table


def log_options(source: LogSource, max_offsets: int | None = None) -> dict[str, str]:
    out = {
        "kafka.bootstrap.servers": ",".join(source.brokers), "subscribe": source.topic, "startingOffsets": source.initial_offset,
        "failOnDataLoss": str(source.retention_policy == "error").lower(),
    }
    return out | ({"maxOffsetsPerTrigger": str(max_offsets)} if max_offsets else {})


def log_range_options(source: LogSource, ranges: dict[int, tuple[int, int]]) -> dict[str, str]:
    """Options of a batch read of exactly these ranges."""
    side = lambda i: json.dumps({source.topic: {str(p): r[i] for p, r in ranges.items()}})
    return {"kafka.bootstrap.servers": ",".join(source.brokers), "subscribe": source.topic, "startingOffsets": side(0), "endingOffsets": side(1)}


def read_log_stream(spark, source: LogSource, max_offsets: int | None = None):
    return spark.readStream.format("kafka").options(**log_options(source, max_offsets)).load()


def read_log_range(spark, source: LogSource, ranges):
    return spark.read.format("kafka").options(**log_range_options(source, ranges)).load()


def table_predicates(source: TableSource, found) -> list[str]:
    """A WHERE clause for each range row of keyset.ranges, for spark.read.jdbc(predicates=...)."""
    ts, pk = quoted(source.timestamp_column).replace("`", '"'), quoted(source.primary_key_column).replace("`", '"')

    def lit(v):
        return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    out = []
    for r in found:
        a, b, c, d = (lit(r[x]) for x in ("start_ts", "start_pk", "end_ts", "end_pk"))
        out.append(f"{ts} >= {a} AND ({ts} > {a} OR {pk} > {b}) AND {ts} <= {c} AND ({ts} < {c} OR {pk} <= {d})")
    return out


def read_table(spark, source: TableSource):
    """A table of the session's catalogue, or a JDBC table where the dsn is a JDBC url."""
    if source.dsn.startswith("jdbc:"):
        return spark.read.format("jdbc").options(url=source.dsn, dbtable=quoted_table(source.table).replace("`", '"')).load()
    return spark.table(quoted_table(source.table))


def table_ranges(rows, source: TableSource, start, end, max_ranges: int, batch_size: int):
    return keyset.ranges(rows, source.timestamp_column, source.primary_key_column, start, end, max_ranges, batch_size)


def source_from_config(raw) -> LogSource | TableSource:
    """A source from a mapping; brokers may be a comma-separated string."""
    from .registry import cursor_from_config

    if isinstance(raw, (LogSource, TableSource)):
        return raw
    raw = dict(raw)
    kind = str(raw.pop("kind", "")).lower()
    if kind in ("kafka", "log"):
        brokers = raw.pop("brokers")
        names = brokers.split(",") if isinstance(brokers, str) else brokers
        return LogSource(brokers=tuple(b.strip() for b in names if b.strip()), **raw)
    if kind in ("postgres", "table"):
        return TableSource(initial_cursor=cursor_from_config(raw.pop("initial_cursor", None)), **raw)
    raise SpecError(f"unknown source kind {kind!r}")
