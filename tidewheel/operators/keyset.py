"""Tables read in (timestamp, key) order: predicates, watermark, count and bounded ranges.

A range is open at its start and closed at its end. The predicates are written out column by column, so
that the scan gets a pushed-down lower and upper bound on the timestamp. Rows with a null timestamp or key
have no place in the order and are in no range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def after(ts: Column, pk: Column, at_ts, at_pk) -> Column:
    return (ts >= at_ts) & ((ts > at_ts) | (pk > at_pk))


def upto(ts: Column, pk: Column, at_ts, at_pk) -> Column:
    return (ts <= at_ts) & ((ts < at_ts) | (pk <= at_pk))


def between(ts: Column, pk: Column, start, end) -> Column:
    return after(ts, pk, *start) & upto(ts, pk, *end)


def high_watermark(rows: DataFrame, ts: str, pk: str) -> DataFrame:
    """The last (ts, pk); no row where the table has none. One partial maximum a partition."""
    known = rows.where(F.col(ts).isNotNull() & F.col(pk).isNotNull())
    top = known.agg(F.max(F.struct(F.col(ts).alias("ts"), F.col(pk).alias("pk"))).alias("top"))
    return top.where("top is not null").select("top.ts", "top.pk")


def high_watermark_or(rows: DataFrame, ts: str, pk: str, initial_ts: Column, initial_pk: Column) -> DataFrame:
    """The last (ts, pk), or the initial cursor of an empty table."""
    known = rows.where(F.col(ts).isNotNull() & F.col(pk).isNotNull())
    top = known.agg(F.max(F.struct(F.col(ts).alias("ts"), F.col(pk).alias("pk"))).alias("top"))
    return top.select(F.coalesce("top.ts", initial_ts).alias("ts"), F.coalesce("top.pk", initial_pk).alias("pk"))


def window_count(rows: DataFrame, ts: str, pk: str, start, end) -> DataFrame:
    return rows.where(between(F.col(ts), F.col(pk), start, end)).agg(F.count("*").alias("n"))


def ranges(rows: DataFrame, ts: str, pk: str, start, end, max_ranges: int, batch_size: int) -> DataFrame:
    """(start_ts, start_pk, end_ts, end_pk, n_rows): at most max_ranges ranges of batch_size rows.

    The limit is taken before the ranking, so each partition sends its first max_ranges * batch_size rows
    at most and the single ranked partition holds no more.
    """
    if max_ranges < 1 or batch_size < 1:
        raise ValueError("max_ranges and batch_size are at least 1")
    order = Window.orderBy("ts", "pk")
    first = rows.where(between(F.col(ts), F.col(pk), start, end)).select(F.col(ts).alias("ts"), F.col(pk).alias("pk")).orderBy("ts", "pk").limit(max_ranges * batch_size)
    ranked = first.select("ts", "pk", F.row_number().over(order).cast("long").alias("rn"), F.lead("ts").over(order).isNull().alias("last"))
    ends = ranked.where((F.col("rn") % batch_size == 0) | F.col("last"))
    start_ts, start_pk = (x if isinstance(x, Column) else F.lit(x) for x in start)
    return ends.select(
        F.coalesce(F.lag("ts").over(order), start_ts).alias("start_ts"),
        F.coalesce(F.lag("pk").over(order), start_pk).alias("start_pk"),
        F.col("ts").alias("end_ts"),
        F.col("pk").alias("end_pk"),
        (F.col("rn") - F.coalesce(F.lag("rn").over(order), F.lit(0))).cast("long").alias("n_rows"),
    )


def bounds(found: DataFrame) -> DataFrame:
    """The batch that a run of ranges makes up."""
    return found.agg(
        F.min(F.struct("start_ts", "start_pk")).alias("a"), F.max(F.struct("end_ts", "end_pk")).alias("z"), F.sum("n_rows").alias("item_count")
    ).select(F.col("a.start_ts").alias("start_ts"), F.col("a.start_pk").alias("start_pk"), F.col("z.end_ts").alias("end_ts"), F.col("z.end_pk").alias("end_pk"), "item_count")
