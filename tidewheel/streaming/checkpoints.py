"""Where committed positions are kept."""

from __future__ import annotations

import hashlib
import json
import sqlite3
import time
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError

from ..functions.codec import decode, encode


class MemoryCheckpoints:
    def __init__(self, initial=None):
        self.values = dict(initial or {})

    def load(self, key):
        return self.values.get(key)

    def save(self, key, value) -> None:
        encode(value)
        self.values[key] = value


class SQLiteCheckpoints:
    """Durable positions of one planner in a local database file. The table's and columns' names are fixed: stores in use have them."""

    def __init__(self, path):
        self.path = str(path)
        with self._open() as db:
            db.execute("create table if not exists checkpoints (checkpoint_key text primary key, value_type text not null, value_json text not null, updated_at text not null)")

    def _open(self):
        db = sqlite3.connect(self.path)
        db.execute("pragma journal_mode = wal")
        db.execute("pragma synchronous = full")
        return db

    def load(self, key):
        db = self._open()
        try:
            row = db.execute("select value_type, value_json from checkpoints where checkpoint_key = ?", (key,)).fetchone()
        finally:
            db.close()
        return decode(*row) if row else None

    def save(self, key, value) -> None:
        db = self._open()
        try:
            with db:
                db.execute("insert or replace into checkpoints values (?, ?, ?, ?)", (key, *encode(value), datetime.now(UTC).isoformat()))
        finally:
            db.close()


class _Folder:
    """Small files in a folder of any file system that Spark reads; a name is taken by one writer only."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = self._at(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.files.mkdirs(self._at(path))

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def names(self, pattern: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self.files.globStatus(self._at(f"{self.path}/{pattern}")) or ())

    def write(self, name: str, text: str) -> None:
        out = self.files.create(self._at(f"{self.path}/{name}"), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, name: str) -> str:
        source = self.files.open(self._at(f"{self.path}/{name}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def delete(self, name: str) -> None:
        self.files.delete(self._at(f"{self.path}/{name}"), False)


class TableCheckpoints:
    """Positions in the shared store: a file for each key and version, of which the last two are kept.

    A save or a load looks at its key's files only and starts no job. Two writers cannot take one version: the second
    fails to create the file and takes the next. A file that was cut off in writing counts for nothing.
    """

    def __init__(self, spark, path: str):
        self.folder = _Folder(spark, path)

    @staticmethod
    def _stem(key: str) -> str:
        return hashlib.sha256(key.encode()).hexdigest()[:32]

    def load(self, key):
        for name in reversed(self.folder.names(f"{self._stem(key)}-*.json")):
            try:
                row = json.loads(self.folder.read(name))
            except ValueError:
                continue
            return decode(row["value_type"], row["value_json"])
        return None

    def save(self, key, value) -> None:
        kind, text = encode(value)
        row = json.dumps({"checkpoint_key": key, "value_type": kind, "value_json": text, "updated_at": datetime.now(UTC).isoformat()})
        for trial in range(5):
            old = self.folder.names(f"{self._stem(key)}-*.json")
            version = int(old[-1].split("-")[1].removesuffix(".json")) + 1 if old else 1
            try:
                self.folder.write(f"{self._stem(key)}-{version:015d}.json", row)
                break
            except Py4JJavaError:
                if trial == 4 or not self.folder.names(f"{self._stem(key)}-{version:015d}.json"):
                    raise
        for name in old[:-1]:
            self.folder.delete(name)


class Ledger:
    """Failed ranges in the shared store, a file for each, so that they can be replayed after a restart."""

    def __init__(self, spark, path: str):
        self.folder = _Folder(spark, path)

    def add(self, row: dict) -> None:
        parts = [[*p[:3], encode(p[3]), encode(p[4])] for p in row["parts"]]
        text = json.dumps({"batch_id": row["batch_id"], "key": row["key"], "status": row["status"], "parts": parts, "errors": [e for _, _, e in row.get("handlers", {}).values() if e]})
        self.folder.write(f"{row['batch_id']}-{time.time_ns():020d}.json", text)

    def find(self, batch_id: str) -> dict | None:
        """The range's last entry, unless it has been replayed."""
        names = self.folder.names(f"{batch_id}-*.json")
        row = json.loads(self.folder.read(names[-1])) if names else {"status": "none"}
        if row["status"] != "failed":
            return None
        return row | {"parts": [(*p[:3], decode(*p[3]), decode(*p[4])) for p in row["parts"]]}

    def table(self):
        """All entries: batch_id, key, status, parts, errors."""
        schema = "batch_id string, key string, status string, errors array<string>"
        return self.folder.spark.read.schema(schema).json(self.folder.path)
