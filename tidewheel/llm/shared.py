"""Helpers that several operators use: staged tables, word arrays over Arrow text, hashes, components."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES, SLICE_BYTES, ROWS = 1 << 18, 4 << 20, 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Only a local master may do without
    the setting: driver and tasks are then one process, and a folder of this process serves."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and the executors share")
    return _own_folder()


@cache
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="tidewheel-shared-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """df written to the shared folder and read again: lineage ends here and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete staged tables that are needed no longer."""
    for df in frames:
        spark = df.sparkSession
        for f in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded(batches, at: int, limit: int = SLICE_BYTES):
    """Arrow batches in slices of about `limit` bytes of text (column `at`) or ROWS rows, whole rows each; nothing is copied."""
    for batch in batches:
        _, offsets = buffers(batch.column(at))
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
            hi = min(max(hi, lo + 1), lo + ROWS, batch.num_rows)
            yield batch.slice(lo, hi - lo)
            lo = hi


def crc_mod5(col) -> F.col:
    """crc32(doc_id as text) mod 5; 0 marks the held-out fold. A null id counts as held out."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 5, F.lit(0))


# ------------------------------------------------------------------ hashes

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = {"n": 0}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int):
    if _POWERS["n"] < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
        _POWERS["n"] = size
    return _POWERS["up"], _POWERS["down"]


class Words:
    """Words of a chunk of texts: byte bounds, 64-bit hashes, and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hashed: bool = True):
        n = len(data)
        self.data, self.offsets = data, offsets
        solid = ~SPACE[data]
        at = offsets[:-1][offsets[:-1] < n]
        begin = solid.copy()
        begin[1:] &= ~solid[:-1]
        begin[at] = solid[at]
        end = solid.copy()
        end[:-1] &= ~solid[1:]
        cut = at[at > 0] - 1
        end[cut] = solid[cut]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        if hashed:
            self.hashes = self.hash_spans(_LOWER[data])

    def hash_spans(self, data: np.ndarray) -> np.ndarray:
        up, down = _powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES):
    """(lo, hi, bytes, offsets from 0) of runs of whole texts of about `limit` bytes."""
    raw, offsets = buffers(texts)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def shingle_sets(texts: pa.Array, k: int):
    """For each text the sorted distinct hashes of its k-word shingles; fewer words count as one shingle."""
    for lo, hi, data, offsets in chunks(texts):
        w = Words(data, offsets)
        h = w.hashes
        s = np.zeros(max(len(h) - k + 1, 0), np.uint64)
        for j in range(k):
            s = mix(s * np.uint64(3) + h[j : j + len(s)])
        for i in range(hi - lo):
            a, b = w.bounds[i], w.bounds[i + 1]
            if b - a >= k:
                yield np.unique(s[a : b - k + 1])
            elif b > a:
                x = np.array([b - a], np.uint64)
                for j in range(a, b):
                    x = mix(x * np.uint64(5) + h[j : j + 1])
                yield x
            else:
                yield np.zeros(0, np.uint64)


# -------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) of every id on an edge (a, b): comp is the smallest id reachable.

    Alternates large-star and small-star steps until the edges no longer change; the table shrinks to
    one edge per id and each step ends in a staged table. An id with many edges, the hub of a large
    component, is one key: the smallest neighbours are written before they are joined, so that both sides
    are plain shuffles and Spark may split the hub's edges.
    """
    e = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    while not e.isEmpty():
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = staged(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m")), "low")
        large = staged(both.join(low, both.a == low.k).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b"), "large")
        least = staged(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m"), "low")
        small = large.join(least, large.a == least.k).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
        nxt = staged(small.where("a <> b").distinct(), "edges")
        discard(e, low, large, least)
        e = nxt
        # done when every id has one parent and no parent has one: the edges are stars around the smallest ids
        seen = e.select(F.col("a").alias("id"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(e.select(F.col("b").alias("id"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
        if seen.groupBy("id").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).where("c > 1 or (c > 0 and p > 0)").isEmpty():
            break
    tops = e.select(F.col("b").alias("id")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("comp")).unionByName(tops.select("id", F.col("id").alias("comp"))).groupBy("id").agg(F.min("comp").alias("comp"))
