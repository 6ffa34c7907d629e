"""Specifications, schemas and errors."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any


class SpecError(ValueError):
    """A specification that cannot work."""


class RetentionGap(RuntimeError):
    """The committed offset is no longer within what the log retains."""


class StaleBatch(RuntimeError):
    """A batch tried to commit after its source had moved on."""


class EmptyTable(RuntimeError):
    """A table source has no rows and no initial cursor."""


class SourceTimeout(TimeoutError):
    """A source or a store did not answer in time."""


class SourceDependency(RuntimeError):
    """A connector's library is missing."""


class DiscoveryError(RuntimeError):
    """A handler module is broken or none was found."""


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise SpecError(what)


@dataclass(frozen=True, order=True)
class Cursor:
    """A place in a table ordered by (timestamp, key)."""

    ts: datetime
    pk: Any

    def __post_init__(self):
        _need(self.ts.tzinfo is not None, "a cursor's timestamp needs a time zone")


@dataclass(frozen=True)
class LogSource:
    source_id: str
    brokers: tuple[str, ...]
    topic: str
    initial_offset: str = "latest"
    retention_policy: str = "error"
    connection_id: str | None = None

    def __post_init__(self):
        _need(self.initial_offset in ("latest", "earliest"), f"initial_offset {self.initial_offset!r}")
        _need(self.retention_policy in ("error", "reset_to_earliest"), f"retention_policy {self.retention_policy!r}")

    def physical(self):
        return ("log", self.connection_id or tuple(sorted(self.brokers)), self.topic)


@dataclass(frozen=True)
class TableSource:
    source_id: str
    dsn: str
    table: str
    timestamp_column: str
    primary_key_column: str
    initial_cursor: Cursor | None = None
    connection_id: str | None = None

    def __post_init__(self):
        for name in (*self.table.split("."), self.timestamp_column, self.primary_key_column):
            quoted(name)
        _need(self.table.count(".") <= 1, f"table {self.table!r}")

    def physical(self):
        return ("table", self.connection_id or self.dsn, self.table, self.timestamp_column, self.primary_key_column)


#: What an existing configuration gets where it is silent, and the names that its settings and the
#: records of a request have. They have to equal those that users have in their files, so they stand here together.
DEFAULTS = {
    "batch_size": 10_000, "max_parallelism": 4, "cpus_per_task": 1.0, "max_retries": 2, "priority": 0,
    "fetch_cpus": 0.25, "fetch_max_retries": 2, "sink_parallelism": 8, "method": "process", "entrypoint": "process",
}
LIMIT_NAMES = ("batch_size", "max_parallelism", "cpus_per_task", "max_retries", "priority")


@dataclass(frozen=True)
class Sink:
    """Where results go, by names that outside configuration resolves, and how many tasks may write there at once."""

    connection_id: str
    target: str
    output_format: str
    max_parallelism: int = DEFAULTS["sink_parallelism"]

    def __post_init__(self):
        missing = [n for n in ("connection_id", "target", "output_format") if not getattr(self, n)]
        _need(not missing, f"a sink lacks {', '.join(missing)}")
        _need(self.max_parallelism >= 1, f"a sink of {self.max_parallelism} tasks")

    @property
    def place(self) -> tuple[str, str]:
        return self.connection_id, self.target


@dataclass(frozen=True)
class Work:
    """What runs: a function of the request (of request and records, in a group), or a class of which one object
    is kept on its host and whose `method` is called. `args` maps a request to other arguments. `history` says that the
    object may keep what it has seen from call to call."""

    run: Callable
    method: str | None = None
    args: Callable | None = None
    history: bool = False

    def __post_init__(self):
        _need(callable(self.run), f"{self.run!r} cannot be called")
        _need(not self.stateful or bool(self.method), f"{self.run.__name__ if self.stateful else ''}: a class needs a method")
        _need(self.stateful or not self.history, "only a class has a history")

    @property
    def stateful(self) -> bool:
        return isinstance(self.run, type)


@dataclass(frozen=True)
class Limits:
    """How much of a backlog a handler takes at once, with what, and how often it tries."""

    batch_size: int = DEFAULTS["batch_size"]
    max_parallelism: int = DEFAULTS["max_parallelism"]
    cpus_per_task: float = DEFAULTS["cpus_per_task"]
    max_retries: int = DEFAULTS["max_retries"]
    priority: int = DEFAULTS["priority"]

    def __post_init__(self):
        for name, least in (("batch_size", 1), ("max_parallelism", 1), ("max_retries", 0)):
            _need(getattr(self, name) >= least, f"{name} is at least {least}")
        _need(self.cpus_per_task > 0, "cpus_per_task is positive")


@dataclass(frozen=True)
class SharedRead:
    """A group of handlers that have each range read once for all of them."""

    group: str
    fetch: Callable
    fetcher_id: str
    cpus: float = DEFAULTS["fetch_cpus"]
    max_retries: int = DEFAULTS["fetch_max_retries"]

    def __post_init__(self):
        _need(bool(self.group) and callable(self.fetch), "a shared group and a fetcher come together")
        _need(bool(self.fetcher_id), "a shared fetcher needs a fetcher_id")
        _need(self.cpus > 0 and self.max_retries >= 0, "a fetcher's cpus are positive and its retries not negative")


@dataclass(frozen=True)
class Handler:
    """Work over sources, within limits."""

    handler_id: str
    work: Work
    sources: tuple
    sink: Sink | None = None
    limits: Limits = Limits()
    shared: SharedRead | None = None

    def __post_init__(self):
        _need(bool(self.handler_id), "a handler needs a name")
        _need(bool(self.sources), f"{self.handler_id}: no source")
        if self.shared:
            _need(len(self.sources) == 1, f"{self.handler_id}: a member of a shared group has one source")
            _need(self.work.args is None, f"{self.handler_id}: a member of a shared group takes the request and the records")

    @property
    def stateful(self) -> bool:
        return self.work.stateful


def make_handler(handler_id: str, run: Callable, sources, output=None, **settings) -> Handler:
    """A handler from flat settings, as configurations give them."""
    settings = dict(settings)
    limits = Limits(**{n: settings.pop(n) for n in LIMIT_NAMES if n in settings})
    group, fetch = settings.pop("shared_source_group", None), settings.pop("fetch", None)
    _need((group is None) == (fetch is None), "a shared group and a fetcher come together")
    read = {new: settings.pop(old) for old, new in (("fetch_cpus", "cpus"), ("fetch_max_retries", "max_retries")) if old in settings}
    fetcher = settings.pop("fetcher_id", None)
    shared = SharedRead(group, fetch, fetcher, **read) if group is not None else None
    work = Work(run, settings.pop("method", None), settings.pop("args", None), bool(settings.pop("cache_history", False)))
    _need(not settings, f"{handler_id}: unknown settings {', '.join(sorted(settings))}")
    return Handler(handler_id, work, tuple(sources), output, limits, shared)


@dataclass(frozen=True)
class Span:
    """A range of a shard: offsets [start, end) of a partition, or cursors (start, end] of a table."""

    shard: int | str
    start: int | Cursor
    end: int | Cursor

    @property
    def is_log(self) -> bool:
        return not isinstance(self.start, Cursor)


@dataclass(frozen=True)
class Request:
    """One span of one source for one handler or fetcher: slice `task_index` of `task_count`."""

    dispatch_id: str
    handler_id: str
    source: LogSource | TableSource
    span: Span
    task_index: int = 0
    task_count: int = 1
    sink: Sink | None = None

    def record(self) -> dict[str, Any]:
        """The request as a flat record, under the names that existing handlers read (fixed)."""
        s, r, o = self.source, self.span, self.sink
        log = r.is_log
        return {
            "dispatch_id": self.dispatch_id, "worker_name": self.handler_id, "handler_id": self.handler_id, "source_id": s.source_id, "source_kind": "kafka" if log else "postgres",
            "task_index": self.task_index, "task_count": self.task_count, "partition": r.shard if log else None,
            "start_offset": r.start if log else None, "end_offset": r.end if log else None, "start_cursor": None if log else r.start, "end_cursor": None if log else r.end,
            "output_connection_id": o and o.connection_id, "output_target": o and o.target, "output_format": o and o.output_format,
            "source_connection_id": s.connection_id, "topic": s.topic if log else None, "table": None if log else s.table,
        }


def offset_kwargs(request: Request):
    """Arguments for handlers that want the bare range of a log; the names are fixed."""
    _need(request.span.is_log, "offset arguments need a log range")
    known = request.record()
    names = {"startoffset": "start_offset", "endoffset": "end_offset", "n": "task_count"}
    return (), {n: known[names.get(n, n)] for n in ("startoffset", "endoffset", "n", "task_index", "partition", "topic", "dispatch_id")}


IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_$]*")


def quoted(name: str) -> str:
    """A checked identifier in Spark's quotes."""
    _need(bool(IDENTIFIER.fullmatch(name)), f"unsafe identifier {name!r}")
    return f"`{name}`"


def quoted_table(name: str) -> str:
    parts = name.split(".")
    _need(len(parts) <= 2, f"unsafe table name {name!r}")
    return ".".join(map(quoted, parts))


@dataclass
class State:
    """What is known of one shard of one source for one handler or group."""

    key: str
    owner: str
    source: Any
    shard: Any
    committed: Any
    observed: Any
    backlog: int = 0
    arrival_rate: float = 0.0
    processing_rate: float = 0.0
    active_batch: str | None = None
    gap: str | None = None
    group: str | None = None
    observed_at: float = 0.0
    scheduled_at: float = 0.0


@dataclass
class Run:
    run_id: str
    batch_id: str
    handler_id: str
    kind: str
    request: Request
    status: str = "submitted"
    attempt: int = 0
    error: str | None = None
    future: Any = None


@dataclass
class Batch:
    batch_id: str
    key: str
    start: Any
    end: Any
    item_count: int
    handlers: tuple[str, ...]
    run_ids: list[str] = field(default_factory=list)
    fetch_ids: list[str] = field(default_factory=list)
    reserved: int = 0
    status: str = "running"
    began: float = 0.0
    replay_of: str | None = None  # a replay moves no position
    only: set | None = None  # (handler, slice) pairs to run; None: all


SOURCES_SCHEMA = "key string, handler string, shared_group string, source_id string, kind string, shard string, committed string, observed string, backlog long, arrival_rate double, processing_rate double, active_batch_id string, retention_gap string"
BATCHES_SCHEMA = "batch_id string, status string, handlers array<string>, item_count long, fetch_run_ids array<string>, run_ids array<string>"
RUNS_SCHEMA = "run_id string, batch_id string, handler string, status string, kind string, attempt int, error string, output_connection string, output_target string, output_format string, source_connection string, topic string, `table` string"
