"""Document quality by boosted trees over document statistics.

The model is fitted on at most SAMPLE labelled rows outside the held-out fold, those of the smallest hash
of doc_id; every whole text is scored. A document with several labels counts as good if one of them says so.

Null and empty texts have all statistics 0 and get the model's score for them. Texts of any length are
scored whole. Rows that repeat a doc_id or a text are scored each by its own text, and count each towards
SAMPLE. Without labelled rows, or with labels of one class only, every text gets the smoothed share of good
labels (0.5 without any). An empty table gives no rows. A column `score` of the input is replaced; other
columns are kept, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boost import Boosted, fit
from .shared import Words, bounded, chunks, crc_mod5, mix

SAMPLE, STATISTICS = 20_000, 22
LIMIT = 0.3


def _class(which: str | bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(which.encode() if isinstance(which, str) else which)] = True
    return out


_KINDS = [
    _class(bytes(range(65, 91))),
    _class(bytes(range(97, 123))) | (np.arange(256) > 127),
    _class("0123456789"),
    _class("$%#&*@^~=<>{}[]_\\+"),
    _class("!?"),
    _class(".,;:"),
    _class("\n"),
    _class("|/"),
    np.arange(256) > 127,
]


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of document statistics for each text."""
    out = []
    for lo, hi, data, offsets in chunks(texts):
        w = Words(data, offsets)
        n = np.diff(w.bounds).astype(np.float64)
        size = np.maximum(np.diff(offsets), 1).astype(np.float64)
        some = np.maximum(n, 1)

        def per_text(values, at):
            return np.diff(np.r_[0, np.cumsum(values)][at]).astype(np.float64)

        kinds = [per_text(k[data], offsets) for k in _KINDS]
        letters = np.maximum(kinds[0] + kinds[1], 1)
        length = (w.ends - w.starts).astype(np.float64)
        mean = per_text(length, w.bounds) / some
        spread = np.sqrt(np.maximum(per_text(length**2, w.bounds) / some - mean**2, 0))
        doc = np.repeat(np.arange(hi - lo), np.diff(w.bounds))
        distinct, most = _distinct(doc, w.hashes, hi - lo)
        pair = mix(w.hashes[:-1] * np.uint64(3) + w.hashes[1:]) if len(doc) > 1 else np.zeros(0, np.uint64)
        same = doc[1:] == doc[:-1] if len(doc) > 1 else np.zeros(0, bool)
        pairs, top_pair = _distinct(doc[:-1][same] if len(doc) > 1 else doc[:0], pair[same], hi - lo)
        repeat = per_text(np.r_[False, same & (w.hashes[1:] == w.hashes[:-1])] if len(doc) else np.zeros(0), w.bounds)
        out.append(np.stack([
            np.log1p(n), mean, spread, kinds[0] / letters, *(k / size for k in kinds[2:]),
            distinct / some, most / some, pairs / some, top_pair / some, repeat / some, distinct / np.sqrt(some),
            per_text(length <= 3, w.bounds) / some, per_text(length > 15, w.bounds) / some, kinds[5] / some, kinds[4] / some, kinds[6] / some,
        ], axis=1))
    return np.concatenate(out) if out else np.zeros((0, STATISTICS))


def _distinct(doc, values, n):
    """Distinct values of each text, and how often its most frequent one occurs."""
    if not len(doc):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((values, doc))
    d, v = doc[order], values[order]
    first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (v[1:] != v[:-1])])
    runs = np.diff(np.r_[first, len(d)])
    most = np.zeros(n)
    np.maximum.at(most, d[first], runs)
    return np.bincount(d[first], minlength=n).astype(np.float64), most


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, target: str = "quality") -> Boosted:
    """A model of labels.<target>; the statistics of at most `sample` rows (STATISTICS numbers each) come to the driver."""
    labels = labels.select(F.col("doc_id").alias("doc_id"), F.col(target).alias("y")).where("y in (0, 1) and doc_id is not null").where(crc_mod5(F.col("doc_id")) != 0)
    labels = labels.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(labels), "doc_id").select("doc_id", "text", F.col("y").cast("double").alias("y"))

    def run(batches):
        for batch in bounded(batches, 1):
            x = statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    ids = dict(rows.dtypes)["doc_id"]
    found = rows.mapInArrow(run, f"doc_id {ids}, y double, x array<double>")
    got = found.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(sample).toArrow()  # ids may repeat: rows are bounded here
    if not got.num_rows:
        return fit(np.zeros((0, STATISTICS)), np.zeros(0))
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)
    return fit(x, got["y"].to_numpy())


def score_quality(docs: DataFrame, model: Boosted) -> DataFrame:
    """docs with a column score."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score")
    at = docs.columns.index("text")

    def run(batches):
        for batch in bounded(batches, at):
            s = held.value.score(statistics(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, docs.withColumn("score", F.lit(None).cast("double")).schema)
