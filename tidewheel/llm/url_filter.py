"""Exact URL rules through a cascade of Bloom filters.

A rule is a host and a path prefix, written host + path (`net/`, `example.org/es/`). A url asks for the
keys suffix-of-host + prefix-of-path, with the prefix lengths that the rules have; all keys of all urls
are the universe. Level 1 holds the listed keys; level 2 the keys of the universe that level 1 takes
wrongly; level 3 the listed keys that level 2 takes, and so on until a level errs on nothing. The depth at
which a key first falls out tells exactly whether it is listed, without a join. Allow and block keys have
a cascade each. The first level's error rate follows from the sizes of list and universe, so each further
level is about as small as the list, whatever the corpus holds.

The rule list is a parameter whose size is bounded (MAX_RULES); filters are about 2 bytes a rule.
Null urls and urls without `://` have an empty host and path and meet no rule. Of the rules that fit, the
longest string wins, of equals the longer host; no rule: `default`. Repeated rows are judged alike.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mix

MAX_RULES = 5_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Bloom:
    def __init__(self, n: int, rate: float):
        self.size = max(64, math.ceil(-max(n, 1) * math.log(rate) / math.log(2) ** 2))
        self.k = max(1, round(-math.log2(rate)))
        self.bits = np.zeros(self.size // 8 + 1, np.uint8)

    def _at(self, h1, h2, level):
        a = mix(h1 ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (2**64 - 1)))
        b = mix(h2 + np.uint64(level)) | np.uint64(1)
        for i in range(self.k):
            yield ((a + np.uint64(i) * b) % np.uint64(self.size)).astype(np.int64)

    def add(self, h1, h2, level):
        for at in self._at(h1, h2, level):
            np.bitwise_or.at(self.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def has(self, h1, h2, level):
        ok = np.ones(len(h1), bool)
        for at in self._at(h1, h2, level):
            ok &= (self.bits[at >> 3] >> (at & 7)) & 1 == 1
        return ok


class Cascade:
    """Bloom filters of alternate sides; `level` says how many there are."""

    def __init__(self):
        self.levels: list[Bloom] = []

    def has(self, h1, h2):
        """Listed: the first level that refuses a key is one of the wrongly taken keys' (odd), or none refuses and the last is the list's."""
        out = np.full(len(h1), len(self.levels) % 2 == 1)
        open_ = np.arange(len(h1))
        for i, f in enumerate(self.levels):
            ok = f.has(h1[open_], h2[open_], i)
            out[open_[~ok]] = i % 2 == 1
            open_ = open_[ok]
        return out


def parts(urls: DataFrame, url: str = "url") -> DataFrame:
    """urls with host and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return urls.withColumns({"host": host, "path": path})


def _keys(lengths: list[int]):
    """All keys of a url, longest first: arrays of strings and of two hashes."""
    labels = F.split("host", r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))

    def of_length(m):
        head = F.substring("path", 1, m)
        return F.transform(suffixes, lambda s: F.struct((F.length(s) + m).alias("n"), F.length(s).alias("h"), F.concat(s, head).alias("key")))

    of = [of_length(m) for m in lengths]
    made = [F.when((F.length("path") >= m) & (F.length("host") > 0), x).otherwise(F.slice(x, 1, 0)) for m, x in zip(lengths, of, strict=True)]
    return F.transform(F.sort_array(F.concat(*made), asc=False), lambda x: x["key"])


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    bounds = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), bounds - bounds[0]


def build(keyed: DataFrame, listed: list[tuple[int, int]], universe: int) -> Cascade:
    """keyed(h1 array, h2 array): the universe's keys. What comes to the driver is about as large as the list."""
    out, spark = Cascade(), keyed.sparkSession
    inside = np.array(listed, np.int64).reshape(-1, 2).view(np.uint64)
    r = len(inside)
    rate = min(0.5, max(1e-9, r / (math.sqrt(2) * max(universe, 1)))) if r else 0.5
    first = Bloom(r, rate)
    first.add(inside[:, 0], inside[:, 1], 0)
    out.levels.append(first)
    known = spark.sparkContext.broadcast((first, np.unique(inside[:, 0])))

    def wrong(batches):
        f, own = known.value
        for batch in batches:
            h1, _ = _flat(batch.column(0))
            h2, _ = _flat(batch.column(1))
            ok = f.has(h1, h2, 0) & ~np.isin(h1, own)
            yield pa.RecordBatch.from_arrays([pa.array(h1[ok].view(np.int64)), pa.array(h2[ok].view(np.int64))], names=["h1", "h2"])

    most = 8 * r + 10_000
    found = keyed.mapInArrow(wrong, "h1 long, h2 long").distinct().limit(most + 1).collect() if r else []
    if len(found) > most:
        raise ValueError("the first level takes far more keys wrongly than its size allows for")
    sides = [inside, np.array([tuple(x) for x in found], np.int64).reshape(-1, 2).view(np.uint64)]
    level = 1
    while len(sides[level % 2]):
        mine = sides[level % 2]
        f = Bloom(len(mine), 0.5)
        f.add(mine[:, 0], mine[:, 1], level)
        out.levels.append(f)
        other = sides[(level + 1) % 2]
        sides[(level + 1) % 2] = other[f.has(other[:, 0], other[:, 1], level)]
        level += 1
    return out


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule (null where none fits) and verdict. rules: (`allow` or `block`, host + path)."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    spark = pages.sparkSession
    pages = pages.drop("host", "path", "rule", "verdict")
    lengths = sorted({len(r) - r.index("/") for _, r in rules}) or [1]
    keyed = parts(pages, url).withColumn("__keys", _keys(lengths))
    hashes = {"__h1": F.transform("__keys", lambda k: F.xxhash64(k)), "__h2": F.transform("__keys", lambda k: F.xxhash64(k, F.lit(7)))}
    keyed = keyed.withColumns(hashes)
    universe = keyed.agg(F.sum(F.size("__keys"))).first()[0] or 0
    sides = {}
    for verdict in ("allow", "block"):
        own = [r for v, r in dict((r, (v, r)) for v, r in rules).values() if v == verdict]
        mine = spark.createDataFrame([(r,) for r in own], "rule string").select(F.xxhash64("rule"), F.xxhash64("rule", F.lit(7))).collect()
        sides[verdict] = build(keyed.select("__h1", "__h2"), [tuple(x) for x in mine], universe)
    held = spark.sparkContext.broadcast(sides)

    def look_up(batches):
        for batch in batches:
            (h1, bounds), (h2, _) = _flat(batch.column(batch.num_columns - 2)), _flat(batch.column(batch.num_columns - 1))
            block = held.value["block"].has(h1, h2)
            hit = np.flatnonzero(block | held.value["allow"].has(h1, h2))
            row = np.searchsorted(bounds, hit, side="right") - 1
            at = np.full(batch.num_rows, -1)
            at[row[::-1]] = hit[::-1]  # a url's first key that is listed is its longest
            there = at >= 0
            names = np.where(there & block[np.where(there, at, 0)], "block", "allow") if len(h1) else np.full(batch.num_rows, "allow")
            pick = pa.array(at - bounds[:-1] + 1, pa.int32(), mask=~there)
            keep = [batch.column(i) for i in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*keep, pick, pa.array(names, pa.string(), mask=~there)], names=[*batch.schema.names[:-2], "__pick", "__verdict"])

    out = keyed.mapInArrow(look_up, keyed.drop("__h1", "__h2").withColumn("__pick", F.lit(None).cast("int")).withColumn("__verdict", F.lit(None).cast("string")).schema)
    return out.withColumn("rule", F.get("__keys", F.col("__pick") - 1)).withColumn("verdict", F.coalesce("__verdict", F.lit(default))).drop("__keys", "__pick", "__verdict")
