"""Planning over control tables: eligibility, limits, priority, task counts, greedy allocation, outcomes.

Control tables have a row a shard, handler, run or batch. They are small beside the data they speak of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACTIVE = ("submitted", "running")


def active_runs(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("status").isin(*ACTIVE))


def free_slots(runs: DataFrame, batches: DataFrame, most: int) -> DataFrame:
    """Slots left of `most` after active runs and what running batches hold back for their handlers."""
    running = runs.agg(F.count_if(F.col("status").isin(*ACTIVE)).alias("active"))
    held = batches.agg(F.coalesce(F.sum(F.when(F.col("status") == "running", F.col("reserved"))), F.lit(0)).alias("reserved"))
    return running.join(held).select("active", "reserved", F.greatest(F.lit(0), F.lit(most) - F.col("active") - F.col("reserved")).cast("long").alias("free"))


def in_flight_by_handler(runs: DataFrame) -> DataFrame:
    return runs.groupBy("handler_id").agg(F.count_if(F.col("status").isin(*ACTIVE)).alias("in_flight"))


def in_flight_by_sink(runs: DataFrame, handlers: DataFrame) -> DataFrame:
    """Handler runs only; fetches write to no sink."""
    own = active_runs(runs).where("kind = 'handler'").join(handlers, "handler_id")
    return own.groupBy("connection_id", "target").agg(F.count("*").alias("in_flight"))


def sink_limits(handlers: DataFrame) -> DataFrame:
    return handlers.where("connection_id is not null").groupBy("connection_id", "target").agg(F.min("sink_parallelism").alias("sink_limit"))


def eligible(states: DataFrame) -> DataFrame:
    return states.where("backlog > 0 and active_batch_id is null and retention_gap is null")


def ranked(states: DataFrame) -> DataFrame:
    """Eligible states by priority, backlog, time to clear it, and how long they have waited."""
    clear = F.when(F.col("processing_rate") > 0, F.col("backlog") / F.greatest(F.col("processing_rate"), F.lit(1e-6))).otherwise(F.col("backlog").cast("double"))
    order = Window.orderBy(F.desc("priority"), F.desc("backlog"), F.desc(clear), F.desc("waited"), F.asc("key"))
    return eligible(states).withColumn("rank", F.row_number().over(order))


def task_count(states: DataFrame) -> DataFrame:
    """Tasks for an independent handler's shard from its own limits and what is free."""
    cpu = F.when(F.col("stateful"), F.col("max_parallelism")).otherwise(F.floor(F.col("free_cpus") / F.col("cpus_per_task")))
    n = F.least("max_parallelism", F.ceil(F.col("backlog") / F.col("batch_size")), F.least("free_slots", "handler_slots", "sink_slots"), cpu)
    return states.select("key", F.greatest(F.lit(0), n).cast("int").alias("n"))


def shared_task_count(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Tasks for a shared group: members(grp, handler_id, connection_id, target, ...), groups(grp, backlog, free_slots, free_cpus)."""
    per = members.groupBy("grp").agg(
        F.count("*").alias("members"), F.min("batch_size").alias("batch"), F.min(F.col("max_parallelism") - F.col("active")).alias("room"),
        F.sum(F.when(~F.col("stateful"), F.col("cpus_per_task")).otherwise(0.0)).alias("member_cpus"), F.max("fetch_cpus").alias("fetch_cpus"),
    )
    sinks = members.groupBy("grp", "connection_id", "target").agg(F.count("*").alias("m"), F.min(F.col("sink_parallelism") - F.col("sink_active")).alias("left"))
    sink = sinks.groupBy("grp").agg(F.min(F.floor(F.col("left") / F.col("m"))).alias("sink_room"))
    n = F.least(F.ceil(F.col("backlog") / F.col("batch")), F.floor(F.col("free_slots") / (F.col("members") + 1)), F.col("room"), F.col("sink_room"), F.floor(F.col("free_cpus") / F.greatest("fetch_cpus", "member_cpus")))
    return groups.join(per, "grp").join(sink, "grp").select("grp", F.greatest(F.lit(0), n).cast("int").alias("n"))


def greedy(candidates: DataFrame, slots: int) -> DataFrame:
    """Walk candidates(key, rank, want, slots_each) in order of rank, each taking what is still free.

    The fold runs over one array of one row a shard; shards are few beside their data.
    """
    rows = candidates.agg(F.array_sort(F.collect_list(F.struct("rank", "key", "want", "slots_each"))).alias("c"))
    empty = F.array().cast("array<struct<key:string,n:int,free_after:int>>")

    def step(acc, x):
        n = F.least(x["want"], F.floor(acc["free"] / x["slots_each"]).cast("int"))
        left = (acc["free"] - n * x["slots_each"]).cast("int")
        took = F.struct(x["key"].alias("key"), n.alias("n"), left.alias("free_after"))
        return F.struct(left.alias("free"), F.when(n > 0, F.concat(acc["out"], F.array(took))).otherwise(acc["out"]).alias("out"))

    folded = rows.select(F.aggregate("c", F.struct(F.lit(slots).alias("free"), empty.alias("out")), step, lambda acc: acc["out"]).alias("out"))
    return folded.select(F.inline("out"))


def allocate(candidates: DataFrame, slots: int, cpus: float) -> DataFrame:
    """(key, n, free_after, cpus_after): tasks for contenders in order of rank, each from what those before it have left.

    candidates(key, rank, handler_id, sink, backlog, batch_size, handler_room, sink_room, sink_share, slots_each, cpus_each,
    shared): rooms are those before the walk. A contender takes slots, cpus (none if cpus_each is 0) and, if it is no group, room
    of its handler and its sink; a group's handlers start later, so it takes slots for them but no room. One that gets no task is
    passed over. The fold runs over one array of one row a shard.
    """
    c = ("rank", "key", "handler_id", "sink", "backlog", "batch_size", "handler_room", "sink_room", "sink_share", "slots_each", "cpus_each", "shared")
    rows = candidates.agg(F.array_sort(F.collect_list(F.struct(*c))).alias("c"))
    took = F.array().cast("array<struct<h:string,s:string,n:int>>")
    out = F.array().cast("array<struct<key:string,n:int,free_after:int,cpus_after:double>>")

    def used(acc, field, name):
        return F.aggregate(F.filter(acc["took"], lambda x: x[field] == name), F.lit(0), lambda a, x: a + x["n"])

    def step(acc, x):
        cpu = F.when(x["cpus_each"] > 0, F.floor(acc["cpus"] / x["cpus_each"])).otherwise(F.lit(1 << 30))
        most = F.least(F.ceil(x["backlog"] / x["batch_size"]), F.floor(acc["free"] / x["slots_each"]), cpu)
        n = F.greatest(F.lit(0), F.least(most, x["handler_room"] - used(acc, "h", x["handler_id"]), F.floor((x["sink_room"] - used(acc, "s", x["sink"])) / x["sink_share"]))).cast("int")
        free, left = (acc["free"] - n * x["slots_each"]).cast("int"), acc["cpus"] - n * x["cpus_each"]
        held = F.concat(acc["took"], F.array(F.struct(x["handler_id"].alias("h"), x["sink"].alias("s"), n.alias("n"))))
        row = F.struct(x["key"].alias("key"), n.alias("n"), free.alias("free_after"), left.alias("cpus_after"))
        return F.struct(
            free.alias("free"), left.alias("cpus"), F.when(x["shared"] | (n == 0), acc["took"]).otherwise(held).alias("took"),
            F.when(n > 0, F.concat(acc["out"], F.array(row))).otherwise(acc["out"]).alias("out"),
        )

    begin = F.struct(F.lit(slots).alias("free"), F.lit(cpus).alias("cpus"), took.alias("took"), out.alias("out"))
    return rows.select(F.aggregate("c", begin, step, lambda acc: acc["out"]).alias("out")).select(F.inline("out"))


def group_violations(members: DataFrame) -> DataFrame:
    """What makes a shared group unusable; a row a violation."""
    per = members.groupBy("grp").agg(
        F.count("*").alias("n"), F.countDistinct("physical_key").alias("physical"), F.countDistinct("fetcher_id").alias("fetchers"),
        F.countDistinct("fetch_policy").alias("policies"), F.countDistinct("source_id").alias("sources"), F.countDistinct("startup").alias("startups"),
    )
    tests = {"too few members": "n < 2", "different sources": "physical > 1", "different fetchers": "fetchers > 1", "different fetch policies": "policies > 1", "different source ids": "sources > 1", "different startup": "startups > 1"}
    found = F.array(*[F.when(F.expr(t), F.lit(name)) for name, t in tests.items()])
    return per.select("grp", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("violation"))


def physical_sources(bindings: DataFrame) -> DataFrame:
    """One observation for each physical source: (physical_key, n_handlers, observers)."""
    observer = F.coalesce("grp", "handler_id")
    return bindings.groupBy("physical_key").agg(F.countDistinct("handler_id").alias("n_handlers"), F.concat_ws(",", F.sort_array(F.collect_set(observer))).alias("observers"))


def batch_outcome(runs: DataFrame) -> DataFrame:
    """running until all runs are terminal; then failed if any failed, else succeeded."""
    done = F.bool_and(F.col("status").isin("succeeded", "failed"))
    outcome = F.when(~done, "running").when(F.bool_or(F.col("status") == "failed"), "failed").otherwise("succeeded")
    return runs.groupBy("batch_id").agg(outcome.alias("outcome"))


def settled(batches: DataFrame, states: DataFrame, outcome: str) -> DataFrame:
    """Source states after batches of one outcome; a stale batch (not active, or the source moved) changes nothing."""
    own = batches.where(F.col("outcome") == outcome).join(states, "key")
    fresh = (F.col("active_batch_id") == F.col("batch_id")) & (F.col("committed") == F.col("start_offset"))
    return own.select("batch_id", F.coalesce(~fresh, F.lit(True)).alias("stale"), F.when(fresh, F.col("end_offset")).otherwise(F.col("committed")).alias("committed_after"), F.when(fresh, F.greatest(F.lit(0), F.col("backlog") - F.col("item_count"))).otherwise(F.col("backlog")).cast("long").alias("backlog_after"))


def fan_out(cut: DataFrame, members: DataFrame) -> DataFrame:
    """Every slice for every member; members are the handlers of one group."""
    return cut.join(members, "grp")
