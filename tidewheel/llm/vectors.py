"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors a, b with cos >= t have |a - b|^2 <= 2 - 2t. After a random rotation the dimensions are cut
into BLOCKS blocks; in one block at least the squared distance is within its proportional share of that
budget. Each block is range-joined on its own: a grid over its first GRID dimensions, cells four radii
wide; a vector is at home in one cell and visits those cells of higher number that its ball touches, so a
pair meets in exactly one cell of a block. Pairs within the block's budget are candidates; a pair counts in the first
block that finds it, is verified in double precision on the whole vectors, and is then folded into link counts and local roots where it was
found: neither candidates nor links are ever written out as pairs. Cells of over TILE rows are cut into
square tiles, so no task holds an unbounded cell. Equal vectors are one class and count by their number.

Vectors that are null, zero, or hold null or non-finite components, and those with a null label or a null
vec_id, link with nothing and take part in no join; vectors of different lengths never link. Rows that repeat a vec_id are
rows each: equal vectors link with one another, and a vec_id stands for all its rows where links are counted.
Extra columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, staged

BLOCKS, GRID, TILE, SEED = 8, 3, 4000, 11


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED + dim).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def block_edges(dim: int) -> np.ndarray:
    return np.linspace(0, dim, min(BLOCKS, dim) + 1).astype(int)


def _cells(threshold: float):
    budget = 2 - 2 * threshold

    def run(batches):
        for batch in batches:
            dims = batch.column(3).to_numpy()
            flat = batch.column(4).flatten().to_numpy(zero_copy_only=False)
            at = np.r_[0, np.cumsum(dims)]
            rows, block, cell, home = [], [], [], []
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                u = unit(flat[at[own][:, None] + np.arange(dim)]) @ rotation(dim)
                edges = block_edges(dim)
                r = math.sqrt(budget / (len(edges) - 1)) * (1 + 1e-9) + 1e-12
                width = max(4 * r, 2.0**-18)
                for b in range(len(edges) - 1):
                    x = u[:, edges[b] : edges[b + 1]][:, :GRID]
                    mid, low, high = (np.floor((x + d) / width).astype(np.int64) + (1 << 19) for d in (0, -r, r))
                    mine = _pack(mid)
                    for corner in range(1 << x.shape[1]):
                        up = (corner >> np.arange(x.shape[1])) & 1 == 1
                        fresh = ~np.any(up & (low == high), axis=1)
                        c = _pack(np.where(up, high, low))
                        take = np.flatnonzero(fresh & (c >= mine))
                        rows.append(own[take]), cell.append(c[take]), home.append(c[take] == mine[take])
                        block.append(np.full(len(take), b, np.int32))
            pick = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            out = batch.take(pa.array(pick))
            extra = [pa.array(np.concatenate(x)) if rows else pa.array([], t) for x, t in ((block, pa.int32()), (cell, pa.int64()), (home, pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*out.columns, *extra], names=[*batch.schema.names, "block", "cell", "home"])

    return run


def _pack(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for j in range(x.shape[1]):
        out = (out << 20) | x[:, j]
    return out


def _tile(threshold: float):
    budget = 2 - 2 * threshold

    def run(table: pa.Table) -> pa.Table:
        dim, b = table["dim"][0].as_py(), table["block"][0].as_py()
        ti, tj = table["ti"][0].as_py(), table["tj"][0].as_py()
        v = table["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        rep, n, home, part = (table[c].to_numpy() for c in ("rep", "n", "home", "part"))
        exact = unit(v)
        turned = exact @ rotation(dim)
        edges = block_edges(dim)
        share = budget / (len(edges) - 1)
        own = turned[:, edges[b] : edges[b + 1]]
        square = (own * own).sum(axis=1)
        links, root = np.zeros(len(rep), np.int64), np.arange(len(rep))

        def top(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        base = np.flatnonzero(home & (part == ti))
        if ti == tj:
            other = np.flatnonzero(part == tj)
            blocks = [(base, other)]
        else:  # base of either part against all of the other part, each pair once
            blocks = [(base, np.flatnonzero(part == tj)), (np.flatnonzero(home & (part == tj)), np.flatnonzero(~home & (part == ti)))]
        for left, right in blocks:
            for lo in range(0, len(left), 512):
                x = left[lo : lo + 512]
                near = square[x][:, None] + square[right][None, :] - 2 * (own[x] @ own[right].T) <= share + 1e-9  # the block's budget
                rows, cols = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
                x, y = x[rows], right[cols]
                i, j = np.nonzero(near[np.ix_(rows, cols)] & (exact[x] @ exact[y].T >= threshold - 1e-9))
                i, j = x[i], y[j]
                once = (i != j) & (~home[j] | (part[i] != part[j]) | (rep[i] < rep[j]))
                i, j = i[once], j[once]
                for s in range(0, len(i), 100_000):
                    p, q = i[s : s + 100_000], j[s : s + 100_000]
                    d = turned[p] - turned[q]
                    d *= d
                    first = np.ones(len(p), bool)
                    for k in range(b):
                        first &= d[:, edges[k] : edges[k + 1]].sum(axis=1) > share * (1 + 1e-9)
                    first &= d[:, edges[b] : edges[b + 1]].sum(axis=1) <= share * (1 + 1e-9)
                    p, q = p[first], q[first]
                    ok = np.einsum("ij,ij->i", exact[p], exact[q]) >= threshold
                    p, q = p[ok], q[ok]
                    np.add.at(links, p, n[q])
                    np.add.at(links, q, n[p])
                    for a, c in zip(p.tolist(), q.tolist(), strict=True):
                        a, c = top(a), top(c)
                        if a != c:
                            root[max(a, c)] = min(a, c)
        hit = np.flatnonzero(links)
        tops = np.array([rep[top(i)] for i in hit], np.int64)
        return pa.table({"a": pa.array(rep[hit], pa.int64()), "b": pa.array(tops, pa.int64()), "links": pa.array(links[hit], pa.int64())})

    return run


def near_vectors(rows: DataFrame, threshold: float = 0.98) -> DataFrame:
    """rows(vec_id, embedding, label) -> vec_id, n_links, component_id, kept."""
    spark = rows.sparkSession
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").alias("vec"))
    sound = F.col("label").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    keyed = rows.withColumn("sound", F.coalesce(sound, F.lit(False)) & F.col("vec_id").isNotNull())
    keyed = keyed.withColumn("k1", F.when(F.col("sound"), F.xxhash64("label", "vec")))
    keyed = keyed.withColumn("k2", F.when(F.col("sound"), F.xxhash64(F.lit(5), "vec", "label")))
    classes = staged(keyed.where("sound").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
    reps = keyed.where("sound").dropDuplicates(["k1", "k2"]).join(classes, ["k1", "k2"])
    flat = reps.select("rep", "n", "label", F.size("vec").alias("dim"), F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    types = "rep long, n long, label {}, dim int, vec array<double>, block int, cell long, home boolean".format(dict(rows.dtypes)["label"])
    placed = flat.mapInArrow(_cells(threshold), types)
    key = ["label", "dim", "block", "cell"]
    hot = placed.groupBy(*key).agg(F.count("*").alias("m")).where(F.col("m") > TILE).withColumn("parts", F.ceil(F.col("m") / TILE).cast("int")).drop("m")
    hot = staged(hot, "hot")
    cut = placed.join(hot, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int"))
    tiled = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiled = tiled.withColumns({"ti": F.least("part", "with").cast("int"), "tj": F.greatest("part", "with").cast("int")}).drop("with", "parts")
    found = staged(tiled.groupBy(*key, "ti", "tj").applyInArrow(_tile(threshold), "a long, b long, links long"), "links")
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    comps = components(found.select("a", "b"))
    of = classes.join(links, F.col("a") == F.col("rep"), "left").join(comps, F.col("id") == F.col("rep"), "left")
    of = of.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("comp", "rep").alias("component"))
    # written before the join: both its sides are then plain shuffles, and Spark may split a class of many rows
    out = keyed.where("sound").join(staged(of, "of"), ["k1", "k2"]).select("vec_id", "links", "component")
    out = out.unionByName(keyed.where("not sound").select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component")))
    return out.select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
