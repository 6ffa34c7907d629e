"""What a planner asks of its sources, answered through Spark: tables, logs kept as tables, Kafka and JDBC.

Watermarks, counts and range boundaries are computed where the data is; only boundaries come to the driver.
"""

from __future__ import annotations

import threading
from datetime import UTC, datetime, timedelta
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import keyset, log
from ..types import Cursor, LogSource, Request, SourceDependency, TableSource
from .connectors import read_log_range, read_table
from .log_stream import RangeClient


class SourceClient(Protocol):
    """A planner's view of sources. `table_ranges` may be missing: windows are then not split."""

    def log_watermarks(self, source: LogSource) -> dict[int, tuple[int, int]]: ...

    def table_high_watermark(self, source: TableSource) -> Cursor | None: ...

    def table_count(self, source: TableSource, start: Cursor, end: Cursor) -> int: ...

    def table_ranges(self, source: TableSource, start: Cursor, end: Cursor, n: int, size: int) -> list[tuple[Cursor, Cursor, int]]: ...


class JvmConsumer:
    """Offsets of topics through the Kafka client that Spark's connector brings along; it belongs to no consumer group."""

    def __init__(self, spark, brokers):
        self.jvm = spark._jvm
        settings = self.jvm.java.util.Properties()
        text = "org.apache.kafka.common.serialization.ByteArrayDeserializer"
        for k, v in {"bootstrap.servers": ",".join(brokers), "enable.auto.commit": "false", "allow.auto.create.topics": "false", "key.deserializer": text, "value.deserializer": text}.items():
            settings.put(k, v)
        try:
            self.held = self.jvm.org.apache.kafka.clients.consumer.KafkaConsumer(settings)
        except TypeError as e:  # a package, not a class
            raise SourceDependency("Kafka's client is not on Spark's class path; add Spark's Kafka connector to spark.jars.packages") from e

    def offsets(self, topic: str, timeout: float) -> dict[int, tuple[int, int]] | None:
        """(low, high) of each partition, asked of the brokers now; None for an unknown topic."""
        limit = self.jvm.java.time.Duration.ofMillis(int(timeout * 1000))
        parts = self.held.partitionsFor(topic, limit)
        if not parts:
            return None
        places = [self.jvm.org.apache.kafka.common.TopicPartition(topic, p.partition()) for p in parts]
        low, high = self.held.beginningOffsets(places, limit), self.held.endOffsets(places, limit)
        return {p.partition(): (int(low[p]), int(high[p])) for p in places}

    def close(self) -> None:
        self.held.close()


class SparkSources:
    """logs: for topics that are not Kafka's, a RangeClient or a function that gives a frame (partition, off, ...).

    lag: rows younger than this are left for later, for tables whose rows may become visible late. Consumers are kept for
    each connection and tables' schemas for each table, until close().
    """

    def __init__(self, spark, logs=None, lag: timedelta = timedelta(0), kafka_timeout: float = 10.0, consumer=JvmConsumer):
        self.spark, self.logs, self.lag, self.kafka_timeout, self.make = spark, dict(logs or {}), lag, kafka_timeout, consumer
        self.consumers: dict[tuple, tuple] = {}
        self.tables: dict[tuple, DataFrame] = {}
        self.lock = threading.Lock()

    # ------------------------------------------------------------------ logs

    def log_watermarks(self, source: LogSource) -> dict[int, tuple[int, int]]:
        own = self.logs.get(source.topic)
        if isinstance(own, RangeClient):
            return own.watermarks()
        if own is not None:
            return {r.partition: (r.low, r.high) for r in log.watermarks(own()).collect()}
        key = (source.connection_id, *sorted(source.brokers))
        with self.lock:
            if key not in self.consumers:
                self.consumers[key] = self.make(self.spark, source.brokers), threading.Lock()
            consumer, alone = self.consumers[key]
        with alone:  # a consumer serves one thread at a time
            found = consumer.offsets(source.topic, self.kafka_timeout)
        if found is None:
            raise RuntimeError(f"topic {source.topic!r} was not found")
        return dict(sorted(found.items()))

    # ---------------------------------------------------------------- tables

    def _rows(self, source: TableSource) -> DataFrame:
        key = (source.dsn, source.table)
        with self.lock:
            if key not in self.tables:
                self.tables[key] = read_table(self.spark, source)
            rows = self.tables[key]
        if self.lag:
            kind = dict(rows.dtypes)[source.timestamp_column]
            rows = rows.where(F.col(source.timestamp_column) <= _literal(datetime.now(UTC) - self.lag, kind))
        return rows

    def _bound(self, source: TableSource, at: Cursor):
        return _literal(at.ts, dict(self._rows(source).dtypes)[source.timestamp_column]), F.lit(at.pk)

    def _cursor(self, row, ts: str, pk: str) -> Cursor:
        return Cursor(datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=row[ts]), row[pk])

    def table_high_watermark(self, source: TableSource) -> Cursor | None:
        top = keyset.high_watermark(self._rows(source), source.timestamp_column, source.primary_key_column)
        row = top.select(_micros("ts", dict(top.dtypes)["ts"]), "pk").first()
        return None if row is None else self._cursor(row, "ts", "pk")

    def table_count(self, source: TableSource, start: Cursor, end: Cursor) -> int:
        return keyset.window_count(self._rows(source), source.timestamp_column, source.primary_key_column, self._bound(source, start), self._bound(source, end)).first().n

    def table_ranges(self, source: TableSource, start: Cursor, end: Cursor, n: int, size: int):
        found = keyset.ranges(self._rows(source), source.timestamp_column, source.primary_key_column, self._bound(source, start), self._bound(source, end), n, size)
        ends = found.select(_micros("end_ts", dict(found.dtypes)["end_ts"]), "end_pk", "n_rows").collect()
        out = []
        for row in sorted(ends, key=lambda r: (r.end_ts, r.end_pk)):
            at = self._cursor(row, "end_ts", "end_pk")
            out.append((out[-1][1] if out else start, at, row.n_rows))
        return out

    # ----------------------------------------------------------------- reads

    def read(self, request: Request) -> DataFrame:
        """The rows of a request's span; a group's fetcher, or what a handler begins with."""
        s, span = request.source, request.span
        if not span.is_log:
            rows = self._rows(s)
            return rows.where(keyset.between(F.col(s.timestamp_column), F.col(s.primary_key_column), self._bound(s, span.start), self._bound(s, span.end)))
        own = self.logs.get(s.topic)
        if own is None:
            return read_log_range(self.spark, s, {span.shard: (span.start, span.end)})
        if isinstance(own, RangeClient):
            return self.spark.createDataFrame(list(own.read(span.shard, span.start, span.end)), own.columns)
        rows = own()
        return rows.where((F.col("partition") == span.shard) & (F.col("off") >= span.start) & (F.col("off") < span.end))

    def close(self) -> None:
        with self.lock:
            held, self.consumers, self.tables = [c for c, _ in self.consumers.values()], {}, {}
        for c in held:
            c.close()


def _literal(at: datetime, kind: str):
    """A time in the column's own type, so that the bound reaches the scan; times without a zone count as UTC."""
    if kind == "timestamp":
        return F.lit(at)
    return F.lit(at.astimezone(UTC).replace(tzinfo=None).isoformat(sep=" ")).cast(kind)


def _micros(name: str, kind: str):
    c = F.col(name)
    if kind != "timestamp":  # the same digits, read as UTC
        c = F.convert_timezone(F.lit("UTC"), F.current_timezone(), c.cast("timestamp_ntz")).cast("timestamp")
    return F.unix_micros(c).alias(name)
