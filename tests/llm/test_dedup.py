"""Near-duplicate operators against brute force on small fixtures."""

import re

import numpy as np
import pytest

from tidewheel.llm.minhash import near_duplicates
from tidewheel.llm.shared import components
from tidewheel.llm.vectors import near_vectors


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def sets_of(texts, k):
    out = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def closure(ids, links):
    top = {i: i for i in ids}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def corpus():
    r = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, i = [], 0
    for _ in range(12):
        base = list(r.choice(vocabulary, int(r.integers(4, 160))))
        for v in range(8):
            own = list(base)
            for _ in range(int(r.integers(0, 5)) if v else 0):
                own[int(r.integers(0, len(own)))] = str(r.choice(vocabulary))
            rows.append((i, " ".join(own)))
            i += 1
    same = " ".join(r.choice(vocabulary, 50))
    rows += [(i + j, same.upper() if j % 2 else same) for j in range(6)]
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "One two"), (904, "one  TWO"), (905, "É x"), (906, "é x"), (907, "x " * 30_000)]
    return rows


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_documents_equal_brute_force(spark, k, percent):
    rows = corpus()
    s = sets_of(rows, k)
    links = [(a, b) for a in s for b in s if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])]
    want = closure(s, links)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, component_id string").repartition(3)
    got = {r.doc_id: r for r in near_duplicates(docs, k, percent).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(x) for i, x in s.items()}
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


@pytest.mark.parametrize("turn", [False, True])
def test_texts_that_share_an_id_keep_their_own_links(spark, turn):
    r = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(400)]
    a, b, c = (" ".join(r.choice(vocabulary, 90)) for _ in range(3))
    both = [(5, a + " x"), (5, b + " y")]
    rows = [(1, a), (2, b), (3, c), *(both[::-1] if turn else both), (6, b + " z")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((x.doc_id, x.component_id, x.kept) for x in got) == [(1, 1, True), (2, 2, True), (3, 3, True), (5, 1, False), (5, 2, False), (6, 2, False)]


def test_empty_tables(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_components_of_chains(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 90), (95, 100), (7, 7)]
    got = {r.id: r.comp for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 90: 90, 95: 90, 100: 90}


def test_vectors_equal_brute_force(spark):
    r = np.random.default_rng(2)
    rows, dim = [], 16
    for g in range(20):
        base = r.normal(size=dim)
        for _ in range(6):
            rows.append([len(rows), [float(x) for x in base + r.normal(size=dim) * 0.12], int(g % 3)])
    rows += [[500, rows[0][1], 0], [501, [2 * x for x in rows[0][1]], 0], [502, None, 0], [503, [0.0] * dim, 0], [504, [float("nan")] * dim, 0], [505, [None] * dim, 0], [506, rows[0][1], None], [507, rows[0][1][:8], 0], [508, [], 0], [509, [float("inf")] * dim, 1]]
    frame = spark.createDataFrame([tuple(x) for x in rows], "vec_id long, embedding array<double>, label int")

    def unit(v):
        ok = v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        return np.array(v) / np.linalg.norm(v) if ok else None

    u = {i: (unit(v), lab) for i, v, lab in rows}
    links = [(a, b) for a in u for b in u if a < b and u[a][0] is not None and u[b][0] is not None and u[a][1] is not None and u[a][1] == u[b][1] and len(u[a][0]) == len(u[b][0]) and u[a][0] @ u[b][0] >= 0.98]
    assert len(links) > 30
    want = closure(u, links)
    got = {x.vec_id: x for x in near_vectors(frame).collect()}
    assert {i: x.component_id for i, x in got.items()} == want
    assert {i: x.n_links for i, x in got.items()} == {i: sum(i in p for p in links) for i in u}


def test_hot_cells_are_tiled(spark, monkeypatch):
    from tidewheel.llm import vectors

    r = np.random.default_rng(3)
    base = r.normal(size=8)
    rows = [(i, [float(x) for x in base + r.normal(size=8) * 0.05], 1) for i in range(120)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    whole = sorted(near_vectors(frame).collect())
    monkeypatch.setattr(vectors, "TILE", 25)
    assert sorted(near_vectors(frame).collect()) == whole
    u = np.array([x[1] for x in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    assert [x.n_links for x in whole] == [int(n) - 1 for n in (u @ u.T >= 0.98).sum(axis=1)]


@pytest.mark.parametrize("name", ["op2_minhash_near_dedup", "op3_embedding_near_dedup", "op8_secret_automaton"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from tidewheel.llm import registry

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{d}/{t}.parquet')")
    got = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    frame = registry.queries()[name](spark, d)
    assert sorted(frame.columns) == sorted(columns)
    assert sorted(map(tuple, frame.select(*columns).collect())) == sorted(got.fetchall())


def test_hot_groups_and_repeated_rows(spark):
    """A third of the rows are copies of one text, a third repeat one row, and many have no words."""
    r = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(500)]
    base = " ".join(r.choice(vocabulary, 60))
    rows = [(i, base) for i in range(200)] + [(1000, "one row that comes again and again")] * 200 + [(2000 + i, None) for i in range(100)] + [(None, "")] * 30
    rows += [(3000 + i, base + f" tail {i}") for i in range(40)] + [(5000, "other " * 30_000)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for x in got:
        want = 0 if x.doc_id is not None and (x.doc_id < 200 or 3000 <= x.doc_id < 4000) else x.doc_id
        assert (x.component_id, x.kept) == (want, x.doc_id == want or x.doc_id is None)


def test_unsound_and_repeated_vectors(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(i, None, 1) for i in range(50)] + [(100 + i, v, None) for i in range(50)] + [(None, v, 1), (None, v, 1)] + [(200, v, 1)] * 3 + [(201, [2.0, 4.0, 6.0, 8.0], 1), (202, v, 2)]
    got = near_vectors(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, links string")).collect()
    assert len(got) == len(rows)
    by = {}
    for x in got:
        by.setdefault(x.vec_id, set()).add((x.n_links, x.component_id))
    assert by[200] == {(3, 200)} and by[201] == {(3, 200)} and by[202] == {(0, 202)} and by[None] == {(0, None)}
    assert all(by[i] == {(0, i)} for i in (0, 49, 100, 149))
