"""Every registered query of the range-processing engine with its SQL twin."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from .functions import codec, ids
from .operators import keyset, log
from .plans import control
from .plans.samples import TABLES, cte, frame

_QUERIES, _SQL = {}, {}
BATCH, TASKS = 40, 3
START, END = (datetime(1995, 1, 1), 100), (datetime(1995, 6, 30), 2_000_000_000)


def query(sql: str):
    def register(f):
        name = f.__name__.removeprefix("q_")
        _QUERIES[name], _SQL[name] = f, sql
        return f

    return register


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)


# ------------------------------------------------------------------- logs

LOG = """log as (select cast(user_id % 4 as integer) as partition, row_number() over (partition by user_id % 4 order by event_id) - 1 as off, ts, value from events),
marks_ as (select partition, min(off) as low, max(off) + 1 as high from log group by partition)"""
STATES = f"""{LOG}, {cte("checkpoints")},
st as (select 'orders:events:' || partition as key, partition, low, high, coalesce(c.committed, high) as committed, c.committed is not null as from_checkpoint
       from marks_ left join checkpoints c on c.key = 'orders:events:' || partition),
bl as (select key, committed, high as observed, cast(greatest(0, high - committed) as bigint) as backlog from st)"""
GAPPED = f"""{LOG}, {cte("stale_checkpoints")},
st as (select 'orders:events:' || partition as key, low, high, c.committed from marks_ join stale_checkpoints c on c.key = 'orders:events:' || partition)"""
WAVES = f"""{STATES}, wv as (select key, committed as start_offset, least(observed, committed + {BATCH * TASKS}) as end_offset, observed from bl where backlog > 0),
wc as (select *, end_offset - start_offset as item_count from wv),
cut as (select key, cast(i as integer) as task_index, n as task_count, start_offset + i * (item_count // n) + least(i, item_count % n) as start_offset,
               start_offset + (i + 1) * (item_count // n) + least(i + 1, item_count % n) as end_offset
        from (select *, cast(least({TASKS}, ceil(item_count / {BATCH})) as integer) as n from wc), lateral (select unnest(range(n)) as i))"""


def _log(spark, d):
    return log.events_log(spark.read.parquet(f"{d}/events.parquet"))


def _marks(spark, d):
    return log.events_marks(spark.read.parquet(f"{d}/events.parquet"))


def _states(spark, d, checkpoints="checkpoints"):
    return log.baseline(_marks(spark, d), frame(spark, checkpoints), "orders", "events", "latest")


def _waves(spark, d):
    return log.wave(log.backlog(_states(spark, d)), BATCH, TASKS)


def _slices(spark, d):
    return log.slices(_waves(spark, d), BATCH, TASKS)


@query(f"with {LOG} select partition, low, high from marks_")
def q_log_watermarks(spark, d):
    return _marks(spark, d)


@query(f"with {cte('marks')} select partition, low, high, low < 0 or high < low as is_invalid from marks")
def q_invalid_watermarks(spark, d):
    return frame(spark, "marks").withColumn("is_invalid", log.invalid(F.col("low"), F.col("high")))


@query(f"with {STATES} select key, committed, from_checkpoint from st")
def q_initial_baseline(spark, d):
    return _states(spark, d).select("key", "committed", "from_checkpoint")


@query(f"with {STATES} select * from bl")
def q_backlog(spark, d):
    return log.backlog(_states(spark, d))


@query(f"with {GAPPED} select key, case when committed < low then 'below' else 'above' end as side, case when committed < low then low else high end as boundary from st where committed < low or committed > high")
def q_retention_gap(spark, d):
    return log.gaps(_states(spark, d, "stale_checkpoints"))


@query(f"with {GAPPED}, r as (select key, high, case when committed < low or committed > high then low else committed end as committed from st) select key, committed, high - committed as backlog from r")
def q_retention_reset(spark, d):
    return log.reset(_states(spark, d, "stale_checkpoints"))


@query(f"with {WAVES} select key, start_offset, end_offset, item_count, observed - end_offset as remaining from wc")
def q_wave_cap(spark, d):
    return _waves(spark, d)


@query(f"with {WAVES} select * from cut")
def q_log_slices(spark, d):
    return _slices(spark, d)


@query(f"with {WAVES} select c.key, task_index, count(*) as n_rows, min(off) as min_offset, max(off) as max_offset, round(sum(value), 4) as sum_value from log join cut c on c.key = 'orders:events:' || partition and off >= start_offset and off < end_offset group by c.key, task_index")
def q_log_range_read(spark, d):
    return log.events_slices(spark.read.parquet(f"{d}/events.parquet"), _slices(spark, d), "orders", "events")


ARRIVALS = f"""{LOG}, daily as (select partition, cast(ts as date) as day, max(off) + 1 as high from log group by 1, 2),
rates as (select partition, day, coalesce(greatest(0, high - lag(high) over w) / greatest(date_diff('day', lag(day) over w, day) * 86400.0::double, 1e-6), 0.0::double) as arrival_rate from daily window w as (partition by partition order by day))"""


@query(f"with {ARRIVALS} select partition, strftime(day, '%Y-%m-%d') as day, round(arrival_rate, 9) as arrival_rate from rates")
def q_arrival_rate(spark, d):
    return log.arrivals(_log(spark, d)).select("partition", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("arrival_rate", 9).alias("arrival_rate"))


@query(f"with {ARRIVALS} select partition, round(list_reduce(list_prepend(0.0::double, list(arrival_rate order by day)), lambda o, x: case when o = 0 then x else 0.3 * x + 0.7 * o end), 9) as rate from rates group by partition")
def q_ewma_rate(spark, d):
    return log.ewma(log.arrivals(_log(spark, d))).select("partition", F.round("rate", 9).alias("rate"))


# ------------------------------------------------------------ ids and demo

KEY = "shared:orders-fanout:demo-orders:0"
GOLDEN = f"""{cte("batch_ranges")},
b as (select start_offset as bs, end_offset as be, substring(sha256('''shared''|''orders-fanout''|''{KEY}''|' || start_offset || '|' || end_offset), 1, 24) as batch_id from batch_ranges),
s as (select batch_id, cast(i as integer) as task_index, cast(n as integer) as task_count, bs + i * ((be - bs) // n) + least(i, (be - bs) % n) as start_offset, bs + (i + 1) * ((be - bs) // n) + least(i + 1, (be - bs) % n) as end_offset
      from (select *, cast(least(2, ceil((be - bs) / 5)) as bigint) as n from b), lateral (select unnest(range(n)) as i)),
f as (select *, substring(sha256('''' || batch_id || '''|''fetch''|' || task_index || '|' || start_offset || '|' || end_offset), 1, 24) as fetch_id from s),
records as (select o as order_id, 'orders' as topic, 0 as partition, round(10 + 1.25 * o, 2)::double as amount, fetch_id as dispatch_id from f, lateral (select unnest(range(start_offset, end_offset)) as o))"""


def _hid(handler: str) -> str:
    return f"substring(sha256('''' || batch_id || '''|''{handler}''|' || task_index || '|' || start_offset || '|' || end_offset || '|None|None'), 1, 24)"


def demo_slices(spark):
    """The demo's slices with their batch and fetch ids."""
    b = frame(spark, "batch_ranges").withColumn("batch_id", ids.shared_batch_id(F.lit("orders-fanout"), F.lit(KEY), F.col("start_offset"), F.col("end_offset")))
    waves = b.select(F.col("batch_id").alias("key"), "start_offset", "end_offset", (F.col("end_offset") - F.col("start_offset")).alias("item_count"))
    cut = log.slices(waves, 5, 2).withColumnRenamed("key", "batch_id")
    return cut.withColumn("fetch_id", ids.fetch_id(F.col("batch_id"), F.col("task_index"), F.col("start_offset"), F.col("end_offset")))


def demo_records(spark):
    rows = demo_slices(spark).withColumn("order_id", F.explode(F.sequence("start_offset", F.col("end_offset") - 1)))
    return rows.select("order_id", F.lit("orders").alias("topic"), F.lit(0).alias("partition"), F.round(10 + 1.25 * F.col("order_id"), 2).alias("amount"), F.col("fetch_id").alias("dispatch_id"))


@query("select cast(range as bigint) as offset_, 0 as partition from range(25)")
def q_demo_source(spark, d):
    return spark.range(25).select(F.col("id").alias("offset_"), F.lit(0).alias("partition"))


@query(f"with {GOLDEN} select * from records")
def q_range_projection(spark, d):
    return demo_records(spark)


@query(f"with {GOLDEN} select batch_id, task_index, fetch_id, {_hid('orders:orders_to_jsonl')} as jsonl_id, {_hid('orders:orders_to_csv')} as csv_id from f")
def q_stable_id(spark, d):
    at = [F.col(c) for c in ("task_index", "start_offset", "end_offset")]
    of = {n: ids.handler_id(F.col("batch_id"), F.lit(h), *at).alias(n) for n, h in (("jsonl_id", "orders:orders_to_jsonl"), ("csv_id", "orders:orders_to_csv"))}
    return demo_slices(spark).select("batch_id", "task_index", "fetch_id", *of.values())


@query(f"""with {GOLDEN}, {cte("handlers")} select substring(sha256('''' || batch_id || '''|''' || handler_id || '''|' || task_index || '|' || start_offset || '|' || end_offset || '|None|None'), 1, 24) as dispatch_id,
handler_id as handler, task_index, start_offset, end_offset, connection_id as output_connection, target as output_target from f, handlers where grp = 'fan'""")
def q_fanout_requests(spark, d):
    cut = demo_slices(spark).withColumn("grp", F.lit("fan"))
    out = control.fan_out(cut, frame(spark, "handlers").where("grp = 'fan'"))
    made = ids.handler_id(*(F.col(c) for c in ("batch_id", "handler_id", "task_index", "start_offset", "end_offset")))
    return out.select(made.alias("dispatch_id"), F.col("handler_id").alias("handler"), "task_index", "start_offset", "end_offset", F.col("connection_id").alias("output_connection"), F.col("target").alias("output_target"))


@query(f"""with {GOLDEN} select dispatch_id, '{{"order_id":' || order_id || ',"topic":"' || topic || '","partition":' || partition || ',"amount":' || amount || ',"dispatch_id":"' || dispatch_id || '"}}' as line from records""")
def q_jsonl_rows(spark, d):
    return demo_records(spark).select("dispatch_id", F.to_json(F.struct("order_id", "topic", "partition", "amount", "dispatch_id")).alias("line"))


@query(f"with {GOLDEN} select dispatch_id, order_id || ',' || topic || ',' || partition || ',' || amount || ',' || dispatch_id as line from records")
def q_csv_rows(spark, d):
    return demo_records(spark).select("dispatch_id", F.to_csv(F.struct("order_id", "topic", "partition", "amount", "dispatch_id")).alias("line"))


# ------------------------------------------------------------------ tables

WITHIN = f"(o_orderdate > timestamp '{START[0]}' or (o_orderdate = timestamp '{START[0]}' and o_orderkey > {START[1]})) and (o_orderdate < timestamp '{END[0]}' or (o_orderdate = timestamp '{END[0]}' and o_orderkey <= {END[1]}))"
RANGES = f"""ranked as (select o_orderdate as ts, o_orderkey as pk, row_number() over (order by o_orderdate, o_orderkey) as rn from orders where {WITHIN} order by rn limit 800),
ends as (select * from ranked, (select max(rn) as last from ranked) where rn % 200 = 0 or rn = last),
rng as (select coalesce(lag(ts) over (order by rn), timestamp '{START[0]}') as start_ts, coalesce(lag(pk) over (order by rn), {START[1]}) as start_pk, ts as end_ts, pk as end_pk, cast(rn - coalesce(lag(rn) over (order by rn), 0) as bigint) as n_rows from ends)"""


def _orders(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet")


def _bound(at):
    return F.lit(at[0]).cast("timestamp_ntz"), F.lit(at[1]).cast("long")


def _ranges(spark, d):
    return keyset.ranges(_orders(spark, d), "o_orderdate", "o_orderkey", _bound(START), _bound(END), 4, 200)


@query("select o_orderdate as ts, o_orderkey as pk from orders order by 1 desc, 2 desc limit 1")
def q_table_high_watermark(spark, d):
    return keyset.high_watermark(_orders(spark, d), "o_orderdate", "o_orderkey")


@query("select coalesce(max(o_orderdate), timestamp '2026-01-01 00:00:00') as ts, coalesce(max(o_orderkey), cast(0 as bigint)) as pk from orders where o_orderkey < 0")
def q_empty_source_baseline(spark, d):
    return keyset.high_watermark_or(_orders(spark, d).where("o_orderkey < 0"), "o_orderdate", "o_orderkey", *_bound((datetime(2026, 1, 1), 0)))


@query(f"select o_orderdate as ts, o_orderkey as pk from orders where {WITHIN}")
def q_keyset_filter(spark, d):
    rows = _orders(spark, d)
    return rows.where(keyset.between(rows.o_orderdate, rows.o_orderkey, _bound(START), _bound(END))).select(F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("pk"))


@query(f"select count(*) as n from orders where {WITHIN}")
def q_keyset_window_count(spark, d):
    return keyset.window_count(_orders(spark, d), "o_orderdate", "o_orderkey", _bound(START), _bound(END))


@query(f"with {RANGES} select * from rng")
def q_keyset_ranges(spark, d):
    return _ranges(spark, d)


@query(f"with {RANGES} select arg_min(start_ts, (start_ts, start_pk)) as start_ts, arg_min(start_pk, (start_ts, start_pk)) as start_pk, arg_max(end_ts, (end_ts, end_pk)) as end_ts, arg_max(end_pk, (end_ts, end_pk)) as end_pk, cast(sum(n_rows) as bigint) as item_count from rng")
def q_batch_bounds(spark, d):
    return keyset.bounds(_ranges(spark, d))


# ---------------------------------------------------------- control tables


@query(f"with {cte('handlers')} select physical_key, count(distinct handler_id) as n_handlers, string_agg(distinct coalesce(grp, handler_id), ',' order by coalesce(grp, handler_id)) as observers from handlers group by physical_key")
def q_physical_sources(spark, d):
    return control.physical_sources(frame(spark, "handlers"))


NAMED = f"{cte('more_handlers')}, named as (select coalesce(handler_id, case when name is not null then stem || ':' || name else stem end) as handler_id from more_handlers)"


def _named(spark):
    return frame(spark, "more_handlers").select(F.coalesce("handler_id", F.concat_ws(":", "stem", "name")).alias("handler_id"))


@query(f"with {NAMED} select handler_id from named")
def q_handler_name(spark, d):
    return _named(spark)


@query(f"with {NAMED}, {cte('handlers')}, u as (select handler_id from named union all select handler_id from handlers) select handler_id, count(*) > 1 as is_duplicate from u group by handler_id")
def q_handler_union(spark, d):
    both = _named(spark).unionByName(frame(spark, "handlers").select("handler_id"))
    return both.groupBy("handler_id").agg((F.count("*") > 1).alias("is_duplicate"))


@query(f"""with {cte('handlers')}, p as (select grp, count(*) as n, count(distinct physical_key) as k, count(distinct fetcher_id) as f, count(distinct fetch_policy) as o, count(distinct source_id) as s, count(distinct startup) as u from handlers where grp is not null group by grp)
select grp, 'too few members' as violation from p where n < 2 union all select grp, 'different sources' from p where k > 1 union all select grp, 'different fetchers' from p where f > 1
union all select grp, 'different fetch policies' from p where o > 1 union all select grp, 'different source ids' from p where s > 1 union all select grp, 'different startup' from p where u > 1""")
def q_group_violations(spark, d):
    return control.group_violations(frame(spark, "handlers").where("grp is not null"))


@query(f"with {cte('handlers')} select connection_id, target, min(sink_parallelism) as sink_limit from handlers group by 1, 2")
def q_sink_limits(spark, d):
    return control.sink_limits(frame(spark, "handlers"))


@query(f"with {cte('handlers')}, {cte('runs')} select connection_id, target, count(*) as in_flight from runs join handlers using (handler_id) where status in ('submitted', 'running') and kind = 'handler' group by 1, 2")
def q_sink_in_flight(spark, d):
    return control.in_flight_by_sink(frame(spark, "runs"), frame(spark, "handlers"))


@query(f"with {cte('runs')} select handler_id, count(*) filter (where status in ('submitted', 'running')) as in_flight from runs group by 1")
def q_handler_in_flight(spark, d):
    return control.in_flight_by_handler(frame(spark, "runs"))


@query(f"with {cte('runs')} select * from runs where status in ('submitted', 'running')")
def q_active_runs(spark, d):
    return control.active_runs(frame(spark, "runs"))


@query(f"with {cte('runs')}, {cte('batches')} select active, reserved, cast(greatest(0, 64 - active - reserved) as bigint) as free from (select count(*) filter (where status in ('submitted', 'running')) as active from runs), (select cast(coalesce(sum(reserved) filter (where status = 'running'), 0) as bigint) as reserved from batches)")
def q_free_slots(spark, d):
    return control.free_slots(frame(spark, "runs"), frame(spark, "batches"), 64)


@query(f"with {cte('states')} select key, backlog from states where backlog > 0 and active_batch_id is null and retention_gap is null")
def q_eligible_sources(spark, d):
    return control.eligible(frame(spark, "states")).select("key", "backlog")


@query(f"with {cte('states')} select key, cast(row_number() over (order by priority desc, backlog desc, case when processing_rate > 0 then backlog / greatest(processing_rate, 1e-6) else backlog end desc, waited desc, key) as integer) as rank from states where backlog > 0 and active_batch_id is null and retention_gap is null")
def q_priority_rank(spark, d):
    return control.ranked(frame(spark, "states")).select("key", "rank")


@query(f"with {cte('wants')} select key, cast(greatest(0, least(max_parallelism, ceil(backlog / batch_size), free_slots, handler_slots, sink_slots, case when stateful then max_parallelism else floor(free_cpus / cpus_per_task) end)) as integer) as n from wants")
def q_task_count(spark, d):
    return control.task_count(frame(spark, "wants"))


@query(f"""with {cte('handlers')}, {cte('groups')}, p as (select grp, count(*) as m, min(batch_size) as b, min(max_parallelism - active) as room, sum(case when stateful then 0.0 else cpus_per_task end) as cpus, max(fetch_cpus) as fc from handlers where grp is not null group by grp),
s as (select grp, min(left_ // m) as room from (select grp, connection_id, target, count(*) as m, min(sink_parallelism - sink_active) as left_ from handlers where grp is not null group by all) group by grp)
select grp, cast(greatest(0, least(ceil(backlog / b), free_slots // (m + 1), p.room, s.room, floor(free_cpus / greatest(fc, cpus)))) as integer) as n from groups join p using (grp) join s using (grp)""")
def q_shared_task_count(spark, d):
    return control.shared_task_count(frame(spark, "groups"), frame(spark, "handlers").where("grp is not null"))


@query(f"""with recursive {cte('candidates')}, walk as (select 0 as rank, '' as key, 0 as n, 10 as free_after
union all select c.rank, c.key, least(c.want, w.free_after // c.slots_each), w.free_after - least(c.want, w.free_after // c.slots_each) * c.slots_each from walk w join candidates c on c.rank = w.rank + 1)
select key, cast(n as integer) as n, cast(free_after as integer) as free_after from walk where n > 0""")
def q_greedy_schedule(spark, d):
    return control.greedy(frame(spark, "candidates"), 10)


TAKEN = "coalesce(list_sum(list_transform(list_filter(w.took, lambda x: x.{0} = c.{1}), lambda x: x.n)), 0)"


@query(f"""with recursive {cte('contenders')}, walk as (select 0 as rank, '' as key, 0 as n, 16 as free_after, 7.5::double as cpus_after, [{{'h': '', 's': '', 'n': 0}}] as took
union all select rank, key, n, free_after - n * slots_each, cpus_after - n * cpus_each, case when shared or n = 0 then took else list_append(took, {{'h': handler_id, 's': sink, 'n': n}}) end
from (select c.rank, c.key, c.handler_id, c.sink, c.slots_each, c.cpus_each, c.shared, w.free_after, w.cpus_after, w.took,
      cast(greatest(0, least(ceil(c.backlog / c.batch_size), w.free_after // c.slots_each, c.handler_room - {TAKEN.format('h', 'handler_id')}, (c.sink_room - {TAKEN.format('s', 'sink')}) // c.sink_share,
           case when c.cpus_each > 0 then floor(w.cpus_after / c.cpus_each) else 1000000 end)) as integer) as n
      from walk w join contenders c on c.rank = w.rank + 1))
select key, n, cast(free_after as integer) as free_after, cpus_after from walk where n > 0""")
def q_greedy_allocation(spark, d):
    return control.allocate(frame(spark, "contenders"), 16, 7.5)


@query(f"with {cte('runs')} select batch_id, case when not bool_and(status in ('succeeded', 'failed')) then 'running' when bool_or(status = 'failed') then 'failed' else 'succeeded' end as outcome from runs group by 1")
def q_batch_outcome(spark, d):
    return control.batch_outcome(frame(spark, "runs"))


def _settled(outcome):
    return f"""with {cte('batches')}, {cte('states')}, j as (select b.*, s.committed, s.backlog, coalesce(s.active_batch_id = b.batch_id and s.committed = b.start_offset, false) as fresh from batches b join states s using (key) where outcome = '{outcome}')
select batch_id, not fresh as stale, case when fresh then end_offset else committed end as committed_after, case when fresh then greatest(0, backlog - item_count) else backlog end as backlog_after from j"""


@query(_settled("succeeded"))
def q_commit_guard(spark, d):
    return control.settled(frame(spark, "batches"), frame(spark, "states"), "succeeded")


@query(_settled("failed"))
def q_skip_failed(spark, d):
    return control.settled(frame(spark, "batches"), frame(spark, "states"), "failed")


@query(f"with {cte('saved')} select key, arg_max(kind, version) as kind, arg_max(value, version) as value from saved group by key")
def q_checkpoint_upsert(spark, d):
    return frame(spark, "saved").groupBy("key").agg(F.max_by("kind", "version").alias("kind"), F.max_by("value", "version").alias("value"))


@query(f"with {cte('saved')} select key, version, kind, case when kind = 'offset' then cast(value as bigint) end as offset_, case when kind = 'cursor' then value ->> '$.ts' end as ts, case when kind = 'cursor' then cast(value ->> '$.pk' as bigint) end as pk from (select key, version, kind, case when kind = 'cursor' then value else value end as value from saved)")
def q_checkpoint_codec(spark, d):
    k, v = F.col("kind"), F.col("value")
    return frame(spark, "saved").select("key", "version", "kind", codec.offset_of(k, v).alias("offset_"), codec.cursor_part(k, v, "ts").alias("ts"), codec.cursor_part(k, v, "pk").cast("long").alias("pk"))


@query(f"with {cte('texts')} select id, cast(epoch(cast(replace(cursor, 'Z', '+00:00') as timestamptz)) as bigint) as at from texts")
def q_cursor_parse(spark, d):
    return frame(spark, "texts").select("id", F.unix_timestamp(F.to_timestamp("cursor")).alias("at"))


@query(f"with {cte('texts')} select id, trim(b) as broker from texts, lateral (select unnest(string_split(brokers, ',')) as b) where trim(b) <> ''")
def q_broker_split(spark, d):
    return frame(spark, "texts").select("id", F.explode(codec.split_list(F.col("brokers"))).alias("broker"))


@query(f"with {cte('texts')} select id, regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_$]*$') as plain, regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_$]*(\\.[A-Za-z_][A-Za-z0-9_$]*)?$') as qualified from texts")
def q_identifier_check(spark, d):
    name = F.col("name")
    return frame(spark, "texts").select("id", codec.is_identifier(name).alias("plain"), codec.is_identifier(name, True).alias("qualified"))


class _Marks:
    """A source client of constant answers."""

    def __init__(self, rows):
        self.marks = {}
        for topic, p, low, high in rows:
            self.marks.setdefault(topic, {})[p] = low, high

    def log_watermarks(self, source):
        return self.marks[source.topic]


@query(f"""with {cte('topic_marks')}, {cte('topic_checkpoints')}, named as (select topic || ':' || topic || ':' || partition as key, * from topic_marks)
select key, topic as handler, cast(null as varchar) as shared_group, topic as source_id, 'log' as kind, cast(partition as varchar) as shard, cast(coalesce(committed, case when topic = 'a' then low else high end) as varchar) as committed,
cast(high as varchar) as observed, high - coalesce(committed, case when topic = 'a' then low else high end) as backlog, 0.0::double as arrival_rate, 0.0::double as processing_rate, cast(null as varchar) as active_batch_id, cast(null as varchar) as retention_gap
from named left join topic_checkpoints using (key)""")
def q_snapshot_sources(spark, d):
    """What a planner that has observed its sources tells of them."""
    from .streaming.checkpoints import MemoryCheckpoints
    from .streaming.planner import Planner
    from .types import LogSource, make_handler

    handlers = [make_handler(t, print, (LogSource(t, ("b",), t, initial_offset="earliest" if t == "a" else "latest"),)) for t in ("a", "b")]
    planner = Planner(handlers, _Marks(TABLES["topic_marks"][1]), checkpoints=MemoryCheckpoints(dict(TABLES["topic_checkpoints"][1])))
    planner.observe()
    return planner.snapshot(spark)[0]
