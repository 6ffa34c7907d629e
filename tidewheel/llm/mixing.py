"""Mixing sources to target weights with DataFrame operations only.

Each source's documents are packed, in an order that depends on the rows alone, into blocks of `block`
words. Targets share the total by weight, none above `repeats` times its source; a source's target is so
many slots of its own mean block length. The output is dealt in shards of `slots` slots. Each slot of a
shard draws its source by the target shares, so a shard's source counts are multinomial. Over all shards a
source's draws miss its number of slots by about their root: what is drawn beyond it is left out, what is
short is made up after the last shard, so totals are within a block of the targets.

The n-th slot of a source takes block p(n mod blocks) in pass n div blocks, where p is a pseudorandom
permutation of the source's and the pass's own: swap-or-not rounds, each of which exchanges pairs of
indices that add up to the round's key, so any number of blocks is permuted exactly and no product is formed.
Slots and blocks are joined by source and index, in a shuffle; a document takes the words that it has in the
blocks taken. No source, however large, meets in one task: offsets and slot numbers are summed in two levels,
over parts of about PART_ROWS rows and over groups of GROUP shards.

Null and empty texts have no words, take nothing and are returned with 0. A null source is a source of its
own, last in order. Documents of a source with no words take 0. Repeated rows, and rows that share a doc_id,
count each for itself; equal rows may exchange what they take. Texts of any length are counted whole. An
empty table gives no rows. Extra columns are ignored, whatever their names. At most `repeats` passes are
taken, so no document exceeds that many times its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged

BLOCK, SLOTS, REPEATS, WEIGHTS = 64, 4096, 3, (5, 2, 1)
PARTS, PART_ROWS, GROUP, BINS, ROUNDS, FEW_SOURCES, TASK_SLOTS = 1024, 1 << 16, 1024, 4096, 20, 10_000, 1 << 20
WORD = r"[^\x20\x09-\x0D]+"


def targets(sized: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(place, source, source_size, target) of sized(source, size): water-filling in closed form; place is a source's number.

    Sources in order of how soon they reach their limit: those before the first that stays below it are
    full, the others share what is left by weight. The windows run over one row a source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double"))
    per = per.withColumn("most", F.col("source_size") * F.lit(float(repeats)))
    soon = Window.orderBy(F.col("most") / F.col("weight"), "place")
    every = Window.partitionBy()
    before = soon.rowsBetween(Window.unboundedPreceding, -1)
    full = F.coalesce(F.sum("most").over(before), F.lit(0.0))
    open_ = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", (F.sum("source_size").over(every) - full) / open_)
    per = per.withColumn("level", F.max("level").over(every))  # it rises over full sources and falls after them
    return per.select("place", "source", "source_size", F.coalesce(F.least("most", F.col("level") * F.col("weight")), "most").alias("target"))


def permuted(at: Column, n: Column, *salt: Column, rounds: int = ROUNDS) -> Column:
    """The place of `at` in a permutation of 0 to n - 1 that follows from `salt`."""

    def swap(x, r):
        other = F.pmod(F.pmod(F.xxhash64(*salt, r), n) - x, n)
        return F.when(F.xxhash64(*salt, r, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), at, swap)


def _uniform(*cols):
    return (F.xxhash64(*cols).bitwiseAND(F.lit((1 << 52) - 1))) / F.lit(float(1 << 52))


def drawn(goal: DataFrame, slots: int = SLOTS, seed: int = 17) -> DataFrame:
    """(shard, place, blocks, wanted, from, count) of goal(place, blocks, wanted): the shards' multinomial counts,
    `from` being the number of the source's slots in shards before."""
    spark = goal.sparkSession
    total, sources = goal.agg(F.sum("wanted"), F.count("*")).first()
    upto = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    share = goal.where("wanted > 0").withColumn("high", F.sum("wanted").over(upto) / F.lit(float(total or 1)))
    share = share.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("place")), F.lit(0.0)))
    bins = share.withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") * BINS), F.least(F.lit(BINS - 1), F.floor(F.col("high") * BINS)))))
    shards = spark.range(-(-(total or 0) // slots)).withColumnRenamed("id", "shard")
    width = F.least(F.lit(slots), F.lit(total or 0) - F.col("shard") * slots)
    slot = shards.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), width - 1))).withColumn("u", _uniform(F.lit(seed), "shard", "slot"))
    slot = slot.select("shard", "u", F.floor(F.col("u") * BINS).alias("bin"))
    # a row for each source and bin: at most BINS more than sources, so it is broadcast where sources are few
    bins = F.broadcast(bins) if sources <= FEW_SOURCES else bins.hint("merge")
    counts = slot.join(bins, "bin").where("u >= low and u < high").groupBy("shard", "place", "blocks", "wanted").agg(F.count("*").alias("count"))
    counts = counts.withColumn("group", F.expr(f"shard div {GROUP}"))
    groups = counts.groupBy("place", "group").agg(F.sum("count").alias("own"))
    ahead = Window.partitionBy("place").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("place", "group", F.coalesce(F.sum("own").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("place", "group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.join(groups.hint("merge"), ["place", "group"])
    return counts.select("shard", "place", "blocks", "wanted", (F.col("base") + F.coalesce(F.sum("count").over(inside), F.lit(0))).alias("from"), "count")


def numbered(goal: DataFrame, slots: int = SLOTS, seed: int = 17) -> DataFrame:
    """(place, blocks, n): every slot of each source, 0 to wanted - 1, as drawn in shards and then made up."""
    shards = staged(drawn(goal, slots, seed), "shards")
    got = shards.groupBy("place").agg(F.sum("count").alias("got"))
    short = goal.join(got, "place", "left").select("place", "blocks", F.coalesce("got", F.lit(0)).alias("from"), F.col("wanted").alias("to"))
    spans = shards.select("place", "blocks", "from", F.least(F.col("from") + F.col("count"), "wanted").alias("to")).unionByName(short)
    tasks = max(int(goal.sparkSession.conf.get("spark.sql.shuffle.partitions")), (goal.agg(F.sum("wanted")).first()[0] or 0) // TASK_SLOTS)
    spans = spans.where("from < to").repartition(tasks, "place", "from")  # a span is a row here and up to `slots` rows after
    return spans.select("place", "blocks", F.explode(F.sequence(F.col("from"), F.col("to") - 1)).alias("n"))


def mix_sources(docs: DataFrame, block: int = BLOCK, slots: int = SLOTS, repeats: int = REPEATS, seed: int = 17) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, source, size, source_size, target, taken."""
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = staged(sized, "sizes")
    goal = targets(sized, repeats=repeats).withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    wanted = F.round(F.col("target") * F.col("blocks") / F.greatest("source_size", F.lit(1))).cast("long")
    goal = staged(goal.withColumn("wanted", F.least(wanted, F.col("blocks") * repeats)), "targets")

    parts = max(PARTS, sized.count() // PART_ROWS)
    placed = sized.join(goal.select("place", F.col("source").alias("s")), F.expr("source <=> s")).select("doc_id", "size", "place", F.pmod(F.xxhash64("doc_id", "size"), F.lit(parts)).alias("part"))
    before = placed.groupBy("place", "part").agg(F.sum("size").alias("own"))
    ahead = Window.partitionBy("place").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("place", "part", F.coalesce(F.sum("own").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("place", "part").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    off = F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    placed = staged(placed.join(before.hint("merge"), ["place", "part"]).select("doc_id", "size", "place", off.alias("off")), "placed")

    # a document with words is known by its source and offset
    span = F.sequence(F.expr(f"off div {block}"), F.expr(f"(off + size - 1) div {block}"))
    pieces = placed.where("size > 0").select("place", "off", "size", F.explode(span).alias("index"))
    words = F.least(F.col("off") + F.col("size"), (F.col("index") + 1) * block) - F.greatest(F.col("off"), F.col("index") * block)
    pieces = pieces.select("place", "off", "index", words.alias("words"))
    n, blocks = F.col("n"), F.col("blocks")
    index = permuted(n % blocks, blocks, F.lit(seed), F.col("place"), F.expr("n div blocks"))
    times = numbered(goal, slots, seed).select("place", index.alias("index")).groupBy("place", "index").agg(F.count("*").alias("times"))
    taken = pieces.join(times.hint("merge"), ["place", "index"]).groupBy("place", "off").agg(F.sum(F.col("words") * F.col("times")).alias("got"))
    out = placed.join(taken.hint("merge"), ["place", "off"], "left").join(goal.select("place", "source", "source_size", "target"), "place")
    got = F.when(F.col("size") > 0, F.coalesce("got", F.lit(0))).otherwise(0).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", got.alias("taken"))
