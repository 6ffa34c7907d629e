"""The streaming source, fan-out and sinks; handler discovery."""

import json

import pytest

from tidewheel.sources.connectors import log_options, log_range_options, source_from_config, table_predicates
from tidewheel.sources.log_stream import LogSourceFormat, even_slices
from tidewheel.sources.registry import discover
from tidewheel.streaming import sinks
from tidewheel.streaming.fanout import FanOut, start
from tidewheel.types import DiscoveryError, LogSource, TableSource


def test_even_slices():
    assert list(even_slices(100, 125, 3)) == [(100, 109), (109, 117), (117, 125)]


def _stream(spark, marks, checkpoint, **options):
    spark.dataSource.register(LogSourceFormat)
    o = {"client": "tidewheel.sources.log_stream:FileClient", "argument": json.dumps(str(marks)), "initial": "earliest", "batch_size": 5, "tasks": 2, "checkpoint": str(checkpoint)} | options
    return spark.readStream.format("range_log").options(**o).load()


def test_bounded_waves_failure_ledger_and_restart(spark, tmp_path):
    marks, ck, ledger = tmp_path / "m.json", tmp_path / "ck", str(tmp_path / "ledger")
    marks.write_text(json.dumps({"0": [0, 25]}))
    got, tries = [], []

    def keep(frame, batch_id):
        got.append(sorted(r.off for r in frame.collect()))

    def broken(frame, batch_id):
        tries.append(batch_id)
        if batch_id == 1:
            raise ValueError("poison")

    fan = FanOut({"keep": (keep, 0), "broken": (broken, 2)}, ledger)
    q = start(_stream(spark, marks, ck), fan, str(ck))
    q.processAllAvailable(), q.stop()
    assert [x for x in got if x] == [list(range(10)), list(range(10, 20)), list(range(20, 25))]
    assert tries.count(1) == 3
    rows = spark.read.parquet(ledger).collect()
    assert [(r.batch_id, r.handler_id, r.attempts) for r in rows] == [(1, "broken", 3)]
    marks.write_text(json.dumps({"0": [0, 32]}))
    got.clear()
    q = start(_stream(spark, marks, ck), fan, str(ck))
    q.processAllAvailable(), q.stop()
    assert [x for x in got if x] == [list(range(25, 32))]


def test_retention_gap_stops_the_stream(spark, tmp_path):
    marks, ck = tmp_path / "m.json", tmp_path / "ck"
    marks.write_text(json.dumps({"0": [0, 8]}))
    fan = FanOut({}, str(tmp_path / "l"))
    q = start(_stream(spark, marks, ck), fan, str(ck))
    q.processAllAvailable(), q.stop()
    marks.write_text(json.dumps({"0": [10, 20]}))
    q = start(_stream(spark, marks, ck), fan, str(ck))
    with pytest.raises(Exception, match="below"):
        q.processAllAvailable()
    q.stop()


def test_sinks_overwrite_only_their_ranges(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "order_id long, dispatch_id string")
    for name, write in sinks.SINKS.items():
        out = str(tmp_path / name)
        write(rows, out), write(rows.where("order_id = 1"), out)
        reader = spark.read.option("header", True).option("inferSchema", True)
        back = (reader.csv(out) if name == "csv" else reader.json(out)).collect()
        assert sorted((r.order_id, r.dispatch_id) for r in back) == [(1, "a"), (2, "b")]


def test_discovery(tmp_path):
    (tmp_path / "_skip.py").write_text("raise ValueError")
    (tmp_path / "orders.py").write_text(
        "def run(r): pass\nHANDLERS = [{'name': 'a', 'sources': [{'kind': 'Kafka', 'source_id': 's', 'brokers': 'b1, b2', 'topic': 't'}]}, {'handler_id': 'own', 'sources': [{'kind': 'postgres', 'source_id': 't', 'dsn': 'd', 'table': 'x.y', 'timestamp_column': 'ts', 'primary_key_column': 'pk', 'initial_cursor': {'timestamp': '2026-01-01T00:00:00Z', 'primary_key': 1}}]}]\n"
    )
    (tmp_path / "solo.py").write_text("class Run:\n    def process(self, r): pass\nWORKER_CONFIG = {'entrypoint': 'Run', 'sources': [{'kind': 'log', 'source_id': 's', 'brokers': ['b'], 'topic': 'u'}]}\n")
    found = {h.handler_id: h for h in discover(tmp_path)}
    assert list(found) == ["orders:a", "own", "solo"] and found["solo"].stateful
    assert found["orders:a"].sources[0].brokers == ("b1", "b2") and found["own"].sources[0].initial_cursor.pk == 1
    (tmp_path / "bad.py").write_text("x = 1 / 0")
    with pytest.raises(DiscoveryError, match="bad.py"):
        discover(tmp_path)
    with pytest.raises(DiscoveryError):
        discover(tmp_path / "none")
    with pytest.raises(ValueError, match="kind"):
        source_from_config({"kind": "ftp"})


def test_connector_options():
    s = LogSource("s", ("b1", "b2"), "t", retention_policy="reset_to_earliest")
    assert log_options(s, 10)["failOnDataLoss"] == "false" and log_options(s, 10)["maxOffsetsPerTrigger"] == "10"
    assert json.loads(log_range_options(s, {0: (3, 9)})["endingOffsets"]) == {"t": {"0": 9}}
    t = TableSource("t", "jdbc:x", "public.orders", "ts", "pk")
    (p,) = table_predicates(t, [dict(start_ts="2026-01-01", start_pk=1, end_ts="2026-01-02", end_pk=5)])
    assert p.startswith("\"ts\" >= '2026-01-01' AND")


def test_demo_writes_the_known_files(tmp_path):
    from tidewheel.demo import run

    planner = run(str(tmp_path))
    names = {d: {f.stem for f in (tmp_path / d).iterdir()} for d in ("jsonl", "csv")}
    # fixed values: the ids that follow from the ranges
    assert names["jsonl"] == {"ad22a89c8cb28a33ed7f7a3b", "1a907b348ffef9ee2c728058", "b2a4f5676d47860c5036cd46", "d1dea7d7f20a0ca4e2b60d60", "bbc52521d46e11048b0c6dbe"}
    assert names["csv"] == {"f0dcf90e811e49c2b801b14b", "4b09d68a083a67f25a1d6471", "d46e850c5f47206654de0ed6", "47d8db7ffb4ec79958d46cba", "ae361c34c150d97fa9d0cac5"}
    rows = [json.loads(x) for f in (tmp_path / "jsonl").iterdir() for x in f.read_text().splitlines()]
    assert sorted(r["order_id"] for r in rows) == list(range(25)) and {r["amount"] for r in rows if r["order_id"] == 3} == {13.75}
    assert sum(r.kind == "fetch" for r in planner.runs.values()) == 5
    run(str(tmp_path))  # positions are kept: nothing is left to do


def test_settings_of_existing_configurations(tmp_path):
    source = "'sources': [{'kind': 'kafka', 'source_id': 's', 'brokers': ['b'], 'topic': 't'}]"
    (tmp_path / "m.py").write_text(
        f"""
def read(r): return []
def process(r, rows): pass
class Keep:
    def process(self, r): pass
    def other(self, r): pass
def own_args(r): return (r.task_index,), {{}}
def plain(i): pass
HANDLERS = [
    {{'name': 'g', {source}, 'shared_source_group': 'g', 'data_fetcher': 'read', 'fetch_cpus': 0.5}},
    {{'name': 'k', {source}, 'mode': 'actor', 'entrypoint': 'Keep', 'remote_method': 'other', 'cache_history': True}},
    {{'name': 'w', {source}, 'worker': plain, 'args_builder': own_args, 'cpus_per_task': 2, 'max_parallelism': 3}},
]
"""
    )
    g, k, w = discover(tmp_path)
    assert (g.work.run.__name__, g.shared.fetcher_id, g.shared.cpus, g.limits.batch_size) == ("process", "read", 0.5, 10_000)
    assert k.stateful and k.work.method == "other" and k.work.history and w.work.args and w.limits.cpus_per_task == 2
    for bad in ("HANDLERS = []", f"def process(r): pass\nWORKER_CONFIG = {{'mode': 'actor', {source}}}", f"def process(r): pass\nWORKER_CONFIG = {{'cache_history': True, {source}}}", f"def process(r): pass\nWORKER_CONFIG = {{'unheard': 1, {source}}}"):
        (tmp_path / "m.py").write_text(bad)
        with pytest.raises(DiscoveryError):
            discover(tmp_path)


def test_the_package_exports_its_names():
    import tidewheel

    assert all(getattr(tidewheel, n) is not None for n in tidewheel.__all__) and "Planner" in tidewheel.__all__
