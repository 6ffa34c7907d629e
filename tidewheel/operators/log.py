"""Partitioned logs: watermarks, baselines, backlog, retention and bounded slices.

A range is [start, end): `high` is the next offset to be written. All tables here have a row a partition
or a slice; only the watermark scan and the range read touch the log, each with one partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


STEP = 1 << 16


def _blocks(events: DataFrame, partitions: int, step: int) -> tuple[DataFrame, DataFrame]:
    """The events with their partition and block of ids, and (p, b, n, base): how many a block holds and how many come before.

    Ranks are taken in two levels, so no task holds more of a partition than `step` ids: sums over blocks, then places inside.
    """
    own = events.withColumns({"partition": F.pmod("user_id", F.lit(partitions)).cast("int"), "block": F.expr(f"event_id div {step}")})
    counts = own.groupBy(F.col("partition").alias("p"), F.col("block").alias("b")).agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("p").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    return own, counts.withColumn("base", F.coalesce(F.sum("n").over(ahead), F.lit(0)))


def _placed(own: DataFrame, blocks: DataFrame) -> DataFrame:
    inside = Window.partitionBy("partition", "block").orderBy("event_id")
    joined = own.join(blocks, F.expr("partition <=> p and block = b"))
    return joined.withColumn("off", (F.col("base") + F.row_number().over(inside) - 1).cast("long")).drop("p", "b", "n", "base", "block")


def events_log(events: DataFrame, partitions: int = 4, step: int = STEP) -> DataFrame:
    """A log derived from the events table: events with (partition, off), offsets in order of event_id from 0."""
    return _placed(*_blocks(events, partitions, step))


def events_marks(events: DataFrame, partitions: int = 4) -> DataFrame:
    """The watermarks of that log: counts, so nothing is ranked and a partition sends one number a task."""
    return events.groupBy(F.pmod("user_id", F.lit(partitions)).cast("int").alias("partition")).agg(F.lit(0).cast("long").alias("low"), F.count("*").alias("high"))


def events_slices(events: DataFrame, cut: DataFrame, handler: str, source: str, partitions: int = 4, step: int = STEP) -> DataFrame:
    """read_slices of that log, of which only the blocks that a slice touches are placed."""
    own, blocks = _blocks(events, partitions, step)
    keyed = blocks.withColumn("key", state_key(handler, source, F.col("p")))
    touched = keyed.join(F.broadcast(cut), "key").where("base < end_offset and base + n > start_offset").select("p", "b", "n", "base").distinct()
    return read_slices(_placed(own, touched), cut, handler, source)


def watermarks(log: DataFrame) -> DataFrame:
    return log.groupBy("partition").agg(F.min("off").alias("low"), (F.max("off") + 1).alias("high"))


def invalid(low: Column, high: Column) -> Column:
    return (low < 0) | (high < low)


def state_key(handler: str, source: str, shard: Column) -> Column:
    return F.concat(F.lit(f"{handler}:{source}:"), shard.cast("string"))


def baseline(marks: DataFrame, checkpoints: DataFrame, handler: str, source: str, initial: str) -> DataFrame:
    """(key, partition, low, high, committed, from_checkpoint); checkpoints(key, committed)."""
    keyed = marks.withColumn("key", state_key(handler, source, F.col("partition")))
    start = F.col("low" if initial == "earliest" else "high")
    return keyed.join(checkpoints, "key", "left").select("key", "partition", "low", "high", F.coalesce("committed", start).alias("committed"), F.col("committed").isNotNull().alias("from_checkpoint"))


def backlog(states: DataFrame) -> DataFrame:
    return states.select("key", "committed", F.col("high").alias("observed"), F.greatest(F.lit(0), F.col("high") - F.col("committed")).cast("long").alias("backlog"))


def gaps(states: DataFrame) -> DataFrame:
    """States whose committed offset is out of [low, high], with the side and the bound that is broken."""
    side = F.when(F.col("committed") < F.col("low"), "below").when(F.col("committed") > F.col("high"), "above")
    return states.where(side.isNotNull()).select("key", side.alias("side"), F.when(side == "below", F.col("low")).otherwise(F.col("high")).alias("boundary"))


def reset(states: DataFrame) -> DataFrame:
    """What `reset_to_earliest` commits: low wherever there is a gap."""
    gap = (F.col("committed") < F.col("low")) | (F.col("committed") > F.col("high"))
    at = F.when(gap, F.col("low")).otherwise(F.col("committed"))
    return states.select("key", at.alias("committed"), (F.col("high") - at).alias("backlog"))


def wave(states: DataFrame, batch_size: int, tasks: int) -> DataFrame:
    """The next batch of each shard: at most batch_size * tasks offsets; the rest waits."""
    end = F.least("observed", F.col("committed") + batch_size * tasks)
    open_ = states.where("backlog > 0")
    return open_.select("key", F.col("committed").alias("start_offset"), end.alias("end_offset"), (end - F.col("committed")).alias("item_count"), (F.col("observed") - end).alias("remaining"))


def slices(waves: DataFrame, batch_size: int, tasks: int) -> DataFrame:
    """Each batch cut into even slices, the first ones an offset longer."""
    count = F.least(F.lit(tasks), F.ceil(F.col("item_count") / batch_size).cast("int"))
    cut = waves.withColumn("task_count", count).withColumn("task_index", F.explode(F.sequence(F.lit(0), F.col("task_count") - 1)))
    base, more = F.expr("item_count div task_count"), F.col("item_count") % F.col("task_count")
    start = F.col("start_offset") + F.col("task_index") * base + F.least(F.col("task_index").cast("long"), more)
    size = base + F.when(F.col("task_index") < more, 1).otherwise(0)
    return cut.select("key", "task_index", "task_count", start.alias("start_offset"), (start + size).alias("end_offset"))


def read_slices(log: DataFrame, cut: DataFrame, handler: str, source: str) -> DataFrame:
    """Rows of each slice. A row finds its slice by key and range; slices are at most `tasks` rows a shard, so they are broadcast."""
    keyed = log.withColumn("key", state_key(handler, source, F.col("partition")))
    joined = keyed.join(F.broadcast(cut), "key").where("off >= start_offset and off < end_offset")
    return joined.groupBy("key", "task_index").agg(F.count("*").alias("n_rows"), F.min("off").alias("min_offset"), F.max("off").alias("max_offset"), F.round(F.sum("value"), 4).alias("sum_value"))


def arrivals(log: DataFrame) -> DataFrame:
    """Arrivals of each partition and day against the day before: (partition, day, arrival_rate a second)."""
    daily = log.groupBy("partition", F.to_date("ts").alias("day")).agg((F.max("off") + 1).alias("high"))
    order = Window.partitionBy("partition").orderBy("day")
    elapsed = F.greatest(F.datediff("day", F.lag("day").over(order)) * 86400.0, F.lit(1e-6))
    rate = F.greatest(F.lit(0), F.col("high") - F.lag("high").over(order)) / elapsed
    return daily.select("partition", "day", F.coalesce(rate, F.lit(0.0)).alias("arrival_rate"))


def ewma(rates: DataFrame, alpha: float = 0.3) -> DataFrame:
    """The smoothed rate of each partition; a rate of 0 is seeded anew, so this is a fold in order of days."""
    series = rates.groupBy("partition").agg(F.array_sort(F.collect_list(F.struct("day", "arrival_rate"))).alias("s"))
    step = lambda old, x: F.when(old == 0, x["arrival_rate"]).otherwise(F.lit(alpha) * x["arrival_rate"] + F.lit(1 - alpha) * old)
    return series.select("partition", F.aggregate("s", F.lit(0.0), step).alias("rate"))
