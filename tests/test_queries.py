"""Every query of the engine against its SQL twin on the smallest tables."""

import math

import duckdb
import pytest

from tidewheel import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = ("events", "orders")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, db, name):
    frame = catalogue.queries()[name](spark, DATA)
    got = db.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(frame.columns)
    want = sorted(tuple(map(plain, r)) for r in got.fetchall())
    assert sorted(tuple(map(plain, r)) for r in frame.select(*columns).collect()) == want


def test_keyset_bounds_reach_the_scan(spark):
    plan = catalogue.queries()["keyset_filter"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThanOrEqual(o_orderdate" in plan


def test_golden_ids(spark):
    rows = {(r.batch_id, r.task_index): r for r in catalogue.queries()["stable_id"](spark, DATA).collect()}
    r = rows["b575d0171a135c188bafb919", 0]
    assert (r.fetch_id, r.jsonl_id, r.csv_id) == ("1ca8b243fae45ebd17bd9041", "ad22a89c8cb28a33ed7f7a3b", "f0dcf90e811e49c2b801b14b")
    assert rows["31bb45b539f0dbeaed066341", 0].csv_id == "ae361c34c150d97fa9d0cac5"
