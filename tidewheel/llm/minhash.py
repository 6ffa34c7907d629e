"""Near-duplicate documents by one-permutation hashing.

A document's shingles fall into `bins` bins by the leading bits of their hash and each bin keeps its
minimum; an empty bin takes the value of a bin found by a hash sequence of its own (optimal
densification). Bins form bands, bands are bucket keys. Identical sets are one class from the start.
In a bucket only star edges from one centre are candidates, so their number is at most that of the
members; the centre is the member that meets most others, a group's original rather than a variant.
Candidates are confirmed on whole sets. Where a bucket still holds several components, its members outside
the largest of them are compared with all its members, on whole sets, in tiles of at most TILE by TILE
documents that write out one link for each component met; so a bucket loses no link and writes no pairs.

What joins by bucket, class or text is written before the join, so both sides of it are plain shuffles and
Spark may split a key that holds many rows (adaptive skew joins); aggregates combine before they shuffle.

Null or wordless texts have an empty set and link with nothing; they take part in no join. Rows that repeat a
doc_id are kept, one result each: the members compared are nodes, pairs of a doc_id and the hash of its text, so each
text of a doc_id has its own links, and rows that repeat both are one member. A null doc_id links only with identical
sets. A text of fewer than `shingle` words is one shingle; texts of any length are compared whole. Of members that could be
centres alike the smallest doc_id is taken. An empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded, components, discard, mix, shingle_sets, staged

SHINGLE, PERCENT, BINS, ROWS = 5, 80, 160, 5
TILE = 512
NODE = ("doc_id", "text_hash")
_LINK = "a struct<doc_id: long, text_hash: long>, b struct<doc_id: long, text_hash: long>"


def densify_table(bins: int, tries: int = 512) -> np.ndarray:
    i = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(1, tries + 1, dtype=np.uint64)[None, :]
    return (mix(i + np.uint64(0xD1B54A32D192ED03)) % np.uint64(bins)).astype(np.int64)


def signature(s: np.ndarray, bins: int, table: np.ndarray) -> np.ndarray:
    """s: sorted distinct hashes, not empty."""
    at = ((s >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    sig, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    sig[at[first]], full[at[first]] = s[first], True
    empty = np.flatnonzero(~full)
    if len(empty):
        ok = full[table[empty]]
        pick = ok.argmax(axis=1)
        donor = np.where(ok[np.arange(len(empty)), pick], table[empty, pick], at[first[0]])
        sig[empty] = sig[donor]
    return sig


def _signatures(k: int, bins: int, rows: int):
    def run(batches):
        table = densify_table(bins)
        bands = bins // rows
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in bounded(batches, 2):
            n, k1, k2, keys = [], [], [], []
            for s in shingle_sets(batch.column(2), k):
                n.append(len(s))
                if not len(s):
                    k1.append(0), k2.append(0), keys.append([])
                    continue
                k1.append(int(np.bitwise_xor.reduce(mix(s)).view(np.int64)))
                k2.append(int(np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64)))
                g = signature(s, bins, table)[: bands * rows].reshape(bands, rows)
                h = salt
                for j in range(rows):
                    h = mix(h * np.uint64(3) + g[:, j])
                keys.append(h.view(np.int64))
            out = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "text_hash", "n_shingles", "k1", "k2", "bands"])

    return run


def _confirm(k: int, percent: int):
    def run(batches):
        for batch in bounded(batches, 2):
            sets = list(shingle_sets(batch.column(2), k))
            other = list(shingle_sets(batch.column(3), k))
            both = np.array([len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(sets, other, strict=True)], np.int64)
            union = np.array([len(a) + len(b) for a, b in zip(sets, other, strict=True)], np.int64) - both
            ok = (union > 0) & (100 * both >= percent * union)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], names=["a", "b"])

    return run


def _tile(k: int, percent: int):
    """Links between the members outside the largest component and all members of a tile, one for each component met."""

    def run(table: pa.Table) -> pa.Table:
        outside, places = table["outside"].to_numpy(), {}
        comp = np.array([places.setdefault(tuple(c.values()), len(places)) for c in table["comp"].to_pylist()], np.int64)
        sets = list(shingle_sets(table["text"], k))
        there, asking = np.flatnonzero(~outside), np.flatnonzero(outside)
        sizes = np.array([len(sets[i]) for i in there], np.int64)
        out: list[tuple[int, int]] = []
        if len(there) and len(asking):
            values, owner = np.concatenate([sets[i] for i in there]), np.repeat(np.arange(len(there)), sizes)
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            for x in asking:
                low, high = np.searchsorted(values, sets[x], "left"), np.searchsorted(values, sets[x], "right")
                n = high - low
                at = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(there))
                ok = np.flatnonzero((both > 0) & (100 * both >= percent * (len(sets[x]) + sizes - both)) & (comp[there] != comp[x]))
                for i in ok[np.unique(comp[there[ok]], return_index=True)[1]]:
                    out.append((x, there[i]))
        return pa.table([table["node"].take(pa.array([p[j] for p in out], pa.int64())) for j in (0, 1)], names=["a", "b"])

    return run


def text_hash(text: str = "text"):
    return F.xxhash64(F.col(text).cast("string")).alias("text_hash")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, kept."""
    return marked(docs, shingle, percent, bins, rows).select("doc_id", "n_shingles", "component_id", "kept")


def marked(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """near_duplicates with text_hash and first, which holds for one (doc_id, text_hash) of each component."""
    node = F.struct(*NODE)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(), F.col("text").cast("string").alias("text"))
    sig = staged(docs.mapInArrow(_signatures(shingle, bins, rows), "doc_id long, text_hash long, n_shingles long, k1 long, k2 long, bands array<long>"), "signatures")
    worded = sig.where("n_shingles > 0")
    lowest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), *NODE))  # a null doc_id only where there is no other
    classes = worded.groupBy("n_shingles", "k1", "k2").agg(lowest.alias("low"))
    classes = staged(classes.select("n_shingles", "k1", "k2", F.struct(*[F.col(f"low.{c}").alias(c) for c in NODE]).alias("rep")), "classes")
    reps = worded.dropDuplicates([*NODE]).join(classes.select("rep.*"), [*NODE], "left_semi")
    buckets = staged(reps.select(*NODE, F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket")), "buckets")
    shared = staged(buckets.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"), "shared")
    some = staged(buckets.join(shared, "bucket"), "buckets")
    discard(buckets, shared)
    weight = some.groupBy(*NODE).agg(F.sum("members").alias("w"))
    met = staged(some.join(weight, [*NODE]), "buckets")
    discard(some)
    # The nodes grow with the input, so they are merged at every size; the texts of all documents are shuffled here and only here.
    texts = docs.join(met.select(*NODE).distinct().hint("merge"), [*NODE], "left_semi").dropDuplicates([*NODE])
    texts = staged(texts.select(node.alias("node"), "text"), "texts")

    def confirm(pairs: DataFrame) -> DataFrame:
        one, two = texts.toDF("a", "text_a"), texts.toDF("b", "text_b")
        joined = pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
        return joined.mapInArrow(_confirm(shingle, percent), _LINK)

    top = F.max(F.struct("w", (-F.col("doc_id")).alias("neg"), "text_hash", "n")).alias("top")
    centre = met.groupBy("bucket").agg(top).select("bucket", F.struct((-F.col("top.neg")).alias("doc_id"), F.col("top.text_hash").alias("text_hash")).alias("centre"), F.col("top.n").alias("m"))
    centre = staged(centre, "centres")
    alike = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent  # sets of other sizes cannot link
    pairs = met.join(centre, "bucket").where(node != F.col("centre")).where(alike)
    pairs = staged(pairs.select(F.least(node, "centre").alias("a"), F.greatest(node, "centre").alias("b")).distinct(), "pairs")
    links = staged(confirm(pairs), "links")
    discard(pairs, centre)
    comps = staged(components(links), "components")

    # Buckets of several components: members outside a bucket's largest component against all, in tiles.
    now = met.where("members > 2").withColumn("node", node).join(comps, F.col("id") == F.col("node"), "left").select("bucket", "node", F.coalesce("comp", "node").alias("comp"))
    core = now.groupBy("bucket", "comp").agg(F.count("*").alias("m")).groupBy("bucket").agg(F.max_by("comp", "m").alias("core"), F.sum("m").alias("total"), (F.sum("m") - F.max("m")).alias("rest")).where("rest > 0")
    now, core = staged(now, "now"), staged(core, "cores")
    parts = lambda c: F.ceil(F.col(c) / TILE).cast("int")
    open_ = now.join(core, "bucket").select("bucket", "node", "comp", (F.col("comp") != F.col("core")).alias("outside"), parts("total").alias("jn"), parts("rest").alias("in"))
    open_ = staged(open_, "open")
    if not open_.isEmpty():
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        every_one = open_.select("bucket", "node", "comp", every("in").alias("i"), F.pmod(F.xxhash64("node"), "jn").cast("int").alias("j"), F.lit(False).alias("outside"))
        others = open_.where("outside").select("bucket", "node", "comp", F.pmod(F.xxhash64("node", F.lit(3)), "in").cast("int").alias("i"), every("jn").alias("j"), F.lit(True).alias("outside"))
        tiles = every_one.unionByName(others).join(texts, "node").select("bucket", "i", "j", "node", "comp", "outside", "text")
        more = staged(tiles.groupBy("bucket", "i", "j").applyInArrow(_tile(shingle, percent), _LINK), "links")
        if not more.isEmpty():
            comps = staged(components(links.unionByName(more)), "components")
    rep = staged(classes.join(comps, F.col("rep") == F.col("id"), "left").select("n_shingles", "k1", "k2", F.coalesce("comp", "rep").alias("component")), "components")
    out = worded.join(rep, ["n_shingles", "k1", "k2"]).select(*NODE, "n_shingles", "component")
    out = out.unionByName(sig.where("n_shingles = 0").select(*NODE, "n_shingles", node.alias("component")))
    out = out.withColumns({"component_id": F.col("component.doc_id"), "first": node.eqNullSafe(F.col("component"))}).drop("component")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
