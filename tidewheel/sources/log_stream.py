"""A partitioned log as a streaming source, with bounded waves and even slices.

The reader takes its watermarks from a client, so tests and production share the planning. The offset of
a batch is the map of shard to end offset; Spark's own log keeps it, and a restart replays the same range.
A wave starts at the offset that was planned last; after a restart the query's offset log gives it, so the
bound on a wave's size survives restarts.
"""

from __future__ import annotations

import importlib
import json

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..types import RetentionGap, SourceDependency


def even_slices(start: int, end: int, count: int):
    """[start, end) in `count` slices, the first ones an offset longer."""
    base, more = divmod(end - start, count)
    for i in range(count):
        size = base + (i < more)
        yield start, start + size
        start += size


class RangeClient:
    """What a log must offer. `watermarks` runs on the driver, `read` on executors."""

    columns = "partition int, off long"

    def watermarks(self) -> dict[int, tuple[int, int]]:
        raise NotImplementedError

    def read(self, partition: int, start: int, end: int):
        raise NotImplementedError


class DemoClient(RangeClient):
    """One partition, offsets 0 to high - 1, orders with a price that follows from the offset."""

    columns = "order_id long, topic string, partition int, amount double"

    def __init__(self, high: int = 25):
        self.high = high

    def watermarks(self):
        return {0: (0, self.high)}

    def read(self, partition, start, end):
        for o in range(start, end):
            yield o, "orders", partition, round(10 + 1.25 * o, 2)


class FileClient(RangeClient):
    """Watermarks from a JSON file {partition: [low, high]}; for tests that let a log grow."""

    columns = "partition int, off long"

    def __init__(self, path: str):
        self.path = path

    def watermarks(self):
        with open(self.path) as f:
            return {int(k): tuple(v) for k, v in json.load(f).items()}

    def read(self, partition, start, end):
        for o in range(start, end):
            yield partition, o


def logged_offset(checkpoint: str) -> dict[int, int] | None:
    """The end of the last batch in a query's offset log; None before its first."""
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(checkpoint) if "://" in checkpoint else (fs.LocalFileSystem(), checkpoint)
    names = [f for f in files.get_file_info(fs.FileSelector(f"{root}/offsets", allow_not_found=True)) if f.base_name.isdigit()]
    if not names:
        return None
    with files.open_input_file(max(names, key=lambda f: int(f.base_name)).path) as f:
        last = f.read().decode().strip().splitlines()[-1]
    return {int(k): v for k, v in json.loads(last).items()} if last.startswith("{") else None


class Slice(InputPartition):
    def __init__(self, partition, start, end):
        super().__init__((partition, start, end))


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, client: RangeClient, initial: str, retention: str, batch_size: int, tasks: int, checkpoint: str | None = None):
        self.client, self.initial, self.retention = client, initial, retention
        self.batch_size, self.tasks = batch_size, tasks
        self.planned: dict[int, int] | None = logged_offset(checkpoint) if checkpoint else None

    def initialOffset(self):
        at = 0 if self.initial == "earliest" else 1
        return {str(p): m[at] for p, m in sorted(self.client.watermarks().items())}

    def latestOffset(self):
        start = self.planned if self.planned is not None else {int(k): v for k, v in self.initialOffset().items()}
        end = {}
        for p, (low, high) in sorted(self.client.watermarks().items()):
            at = self._retained(p, start.get(p, low), low, high)  # a shard that appears later starts at its low
            end[p] = min(high, at + self.batch_size * self.tasks)
        self.planned = end
        return {str(p): v for p, v in end.items()}

    def _retained(self, p, at, low, high):
        if low <= at <= high:
            return at
        if self.retention == "error":
            side, bound = ("below", low) if at < low else ("above", high)
            raise RetentionGap(f"partition {p}: committed {at} is {side} retained {bound}")
        return low

    def partitions(self, start, end):
        out = []
        marks = self.client.watermarks()
        for p, e in sorted((int(k), v) for k, v in end.items()):
            low, high = marks.get(p, (0, e))
            s = self._retained(p, start.get(str(p), low), low, max(high, e))
            if e > s:
                n = min(self.tasks, -(-(e - s) // self.batch_size))
                out += [Slice(p, a, z) for a, z in even_slices(s, e, n)]
        if self.planned is None:  # the batch is a replay after a restart
            self.planned = {int(k): v for k, v in end.items()}
        return out or [Slice(-1, 0, 0)]

    def read(self, partition):
        p, start, end = partition.value
        return iter(()) if p < 0 else self.client.read(p, start, end)

    def commit(self, end):
        """Nothing to do: Spark's own log keeps the position, and `planned` may already be a batch ahead."""


class LogSourceFormat(DataSource):
    """format("range_log"); options: client (module:class), argument, initial, retention, batch_size, tasks,
    checkpoint (the query's checkpointLocation, from which a restart takes its place)."""

    @classmethod
    def name(cls):
        return "range_log"

    def _client(self) -> RangeClient:
        module, _, name = self.options["client"].partition(":")
        try:
            made = getattr(importlib.import_module(module), name)
        except ImportError as e:
            raise SourceDependency(str(e)) from e
        raw = self.options.get("argument")
        return made(json.loads(raw)) if raw is not None else made()

    def schema(self):
        return self._client().columns

    def streamReader(self, schema):
        o = self.options
        return LogStreamReader(self._client(), o.get("initial", "latest"), o.get("retention", "error"), int(o.get("batch_size", 10_000)), int(o.get("tasks", 4)), o.get("checkpoint"))
