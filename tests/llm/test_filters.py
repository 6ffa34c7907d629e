"""URL rules, quality, language, secrets, personal data and decontamination."""

import re

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import language, quality, queries_filter
from tidewheel.llm.automaton import Automaton
from tidewheel.llm.boost import fit
from tidewheel.llm.decontaminate import find_contamination
from tidewheel.llm.personal import ADDED, BASE, find_personal, find_spans, train
from tidewheel.llm.secrets import RULES, find_secrets, text_spans
from tidewheel.llm.url_filter import judge_urls

SMALL = "/root/testdata/sf0.001"


def test_urls_equal_sql(spark, tmp_path):
    urls = [None, "", "no scheme", "http://", "https://EXAMPLE.org/es/a?x#y", "ftp://a.example.org/en/12", "http://example.org", "http://xexample.org/es/", "a://b://c/d", "http://com/fr/", "http://a.com/de/#/es/", "http://É.ORG/", "http://a..org/x", "http://org/", "http://example.org/es/"]
    spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls * 2)], "page_id long, url string, rule string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = queries_filter.op1_url_filter_cascade(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.execute(f"select page_id, host, path, rule, verdict from ({queries_filter.SQL_OP1})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_url_cascade_is_exact_with_many_rules(spark):
    rules = [("block" if i % 2 else "allow", f"site{i}.net/p{i % 7}") for i in range(0, 4000, 3)]
    pages = spark.range(4000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://w.site"), F.col("id"), F.lit(".net/p"), F.col("id") % 7, F.lit("/q")).alias("url"))
    own = dict((r, v) for v, r in rules)
    for r in judge_urls(pages, rules).collect():
        key = f"site{r.page_id}.net/p{r.page_id % 7}"
        assert (r.rule, r.verdict) == ((key, own[key]) if key in own else (None, "allow"))
    assert judge_urls(pages.limit(0), rules).count() == 0 and judge_urls(pages.limit(5), []).where("rule is null and verdict = 'allow'").count() == 5


def test_boosting_learns_and_flattens():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    m = fit(x[:1500], y[:1500], trees=40, depth=3)
    assert ((m.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95

    def walk(row):  # the same tree, node by node
        total = m.prior
        for f, lim, leaf in zip(m.feature, m.limit, m.leaf, strict=True):
            n = 0
            while n < len(f):
                n = 2 * n + 1 + int(row[f[n]] > lim[n])
            total += leaf[n - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(m.score(x[:50]), [walk(v) for v in x[:50]])
    assert fit(np.zeros((0, 5)), np.zeros(0)).score(x[:3]).tolist() == [0.5] * 3


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    got = queries_filter.op4_quality_boosted(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 30 and (held.predicted == held.quality).mean() >= 0.9


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 9.0), (1, "", 9.0), (None, "a b", 1.0), (2, "word " * 50_000, 1.0)], "doc_id long, text string, score double")
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.score for r in quality.score_quality(docs, model).collect()] == [0.5] * 4
    assert quality.statistics(pa.array([None, "", "a"])).shape == (3, quality.STATISTICS)


def test_language(spark):
    d = "/root/testdata/sf0.01"
    got = queries_filter.op5_language_segmentation(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (got[got.held_out].lang_pred == got[got.held_out].lang).mean() > 0.95


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab"]
    p = np.random.default_rng(1).random((len(pieces), 2))
    lattice = language.Lattice(pieces)

    def total(w):
        return np.ones(2) if not w else sum((p[pieces.index(w[:n])] * total(w[n:]) for n in range(1, len(w) + 1) if w[:n] in pieces), np.zeros(2))

    words = ["ab", "aba", "babab", "ab" * 30]
    got = lattice.score(words, lattice.table(p))
    assert np.allclose(got[:3], np.log([total("▁" + w) for w in words[:3]])) and np.isfinite(got[3]).all()


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "12 !?", "x"), (3, "hello", "x")], "doc_id long, text string, lang_pred string")
    pieces = language.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    langs, table = language.fit([("en", "hello", 5), ("fr", "bonjour", 5)], pieces)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, langs, table, pieces).collect()}
    assert got[1] == got[2] == ("und", 0.0) and got[3][0] == "en"
    assert {r.lang_pred for r in language.identify(docs, [], np.zeros((len(pieces) + 2, 0)), pieces).collect()} == {"und"}


@pytest.mark.parametrize("rule", ["a(?:b|cd)*e", "x{2,4}y?", "[^-^]b+", r"\.[0-9]{3,}", "(?:ab|a)(?:c|bcd)"])
def test_automaton_equals_re(rule):
    r = np.random.default_rng(4)
    m, own = Automaton([rule]), re.compile(rule.encode())
    for _ in range(200):
        data = bytes(r.choice(list(b"abcdexy.-^0123 \n"), int(r.integers(0, 30))).tolist())
        found = m.scan(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        assert bool(len(found)) == bool(own.search(data))


SECRETS = [None, "", "é password = 'abcdefghijkl' x", "PASSWD:short", "token=password=abcdefghijkl", "AKIAABCDEFGHIJKLMN1 akia", "AKIA12", "deadbeef" * 4 + " api_key: zz", "ſecret=abcdefghijklmnop", "secret\n=abcdefghijklmnop", "ghp_" + "a1B2" * 9, "word " * 40_000 + "token=0123456789ab"]


def brute_secrets(t):
    name = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    rules = [(name + r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12), ("(AKIA[A-Z0-9]+)", 18), ("([0-9a-f]+)", 16)]
    return sorted((m.start(), k, m.end()) for k, (e, n) in enumerate(rules) for m in re.finditer(e, t or "") if len(m.group(1)) >= n)


def test_secrets_equal_brute_force(spark):
    docs = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    for t, spans in zip(SECRETS + docs, text_spans(pa.array(SECRETS + docs)), strict=True):
        assert [x for x in spans if x[1] < 3] == brute_secrets(t)
    got = find_secrets(spark.createDataFrame(list(enumerate(SECRETS)), "doc_id long, text string")).collect()
    assert [r.n_assign for r in got] == [0, 0, 1, 0, 1, 0, 0, 0, 0, 0, 0, 1]
    assert "github" in got[10].spans and got[0].spans == "" and len(RULES) == 7
    assert find_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0


PERSONAL = [None, "", "é a.b+c@x-y.example.org, d@e f@g.h", "1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8", "4111 1111 1111 1111 4111111111111112", "+1 (988) 555-2485 +123 +1 2345678901234567", "call 415-555-2671 now", "a@b@c.d", "5500-0055-5555-5559+1 202 555 0100", "ssn 123-45-6789.", "x@y." + "z" * 5000 + "@q.r", "account DE89370400440532013000 x"]


def brute_personal(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())

    def luhn(s):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0

    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.group().split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (e, ok) in enumerate(rules) for m in re.finditer(e, t or "") if ok(m))


def test_personal_equals_brute_force(spark):
    names = ("email", "ip", "card", "phone")
    docs = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows = find_personal(spark.createDataFrame(list(enumerate(PERSONAL + docs)), "doc_id long, text string")).collect()
    for r, t in zip(sorted(rows), PERSONAL + docs, strict=True):
        own = [s for s in r.spans.split(",") if s and s.split(":")[0] in names]
        assert own == [f"{names[k]}:{a}:{z}" for a, k, z in brute_personal(t)]
    by = {r.doc_id: r.spans for r in rows}
    assert "national_phone" in by[6] and "ssn" in by[9] and "iban" in by[11]
    assert find_personal(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_loose_forms_are_found():
    model, limits = train()
    forms = {
        "loose_card": ["4111.1111.1111.1111", "5500  0055  5555  5559", "3782 - 822463 - 10005"],
        "loose_email": ["jane.doe [at] example [dot] org", "jane(at)mail.example.org", "jane at example dot com", "jane @ example.org"],
        "national_phone": ["020 7946 0958", "01 23 45 67 89", "030 12345678", "0161 496 0123", "612 34 56 78", "415-555-2671"],
    }
    for kind, spans in forms.items():
        for x in spans:
            text = f"please contact or call us at once: {x} or write"
            a = text.index(x)
            assert (a, len(BASE) + ADDED.index(kind), a + len(x)) in find_spans(text, model, limits), x
    for x in ("4111.1111.1111.1112", "look at the dot there", "years 2010  2011  2012  2014 in turn", "on 01-02-2023 14 of them", "pi is 3.14159 and 2.71828"):
        assert find_spans(f"then the report of {x} was read", model, limits) == [], x


def test_decontamination(spark):
    item = "A train from Paris travels 120 km in 3 hours and then stops at Lyon before it turns back. How fast did Paris see it go?"
    changed = "Once more. A train from Berlin travels 250 km in 5 hours and then stops at Munich before it turns back. How fast did Berlin see it go? Yes."
    broken = "A train from Berlin travels 250 km in 5 hours and then stops at Berlin before it turns back. How fast did Munich see it go?"
    rows = [(1, changed), (2, "nothing of the kind happens here at all " * 30), (3, None), (4, ""), (5, item.upper()), (6, "x " * 30_000 + item), (7, "some short one"), (8, broken)]
    docs = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, contaminated boolean")
    bench = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, "Some short one")], "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in find_contamination(docs, bench).collect()}
    assert got[1] == got[6] == [10] and got[2] == got[3] == got[4] == [] and got[7] == [13]
    assert find_contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert find_contamination(docs.limit(0), bench).count() == 0


def test_conflicting_slots_cut_a_stretch(spark):
    item = "A train from Paris travels 120 km in 3 hours and then stops at Lyon before it turns back. How fast did Paris see it go?"
    broken = "A train from Berlin travels 250 km in 5 hours and then stops at Berlin before it turns back. How fast did Munich see it go?"
    twice = "Every box in the large store holds 3 red balls and each shelf carries 3 boxes, so how many balls are there on one of the shelves?"
    sums = "Compute 12 + 7 * 3 - 4 / 2 + 8 - 6"
    chance = "One from Oslo takes 12 and 7 and 3 and 4 in 5"
    rows = [(1, broken), (2, twice.replace("carries 3", "carries 4")), (3, "So: " + sums), (4, "Compute 1 + 2 * 5 - 9 / 11 + 13 - 15"), (5, chance)]
    bench = spark.createDataFrame([(10, item), (11, twice), (12, sums)], "item_id long, text string")
    got = {r.doc_id: (r.item_ids, r.longest) for r in find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {1: ([10], 22), 2: ([11], 19), 3: ([12], 8), 4: ([], 0), 5: ([], 0)}


def test_copies_in_another_case_are_found(spark):
    item = "A train from Paris travels 120 km in 3 hours and then stops at Lyon before it turns back. How fast did Paris see it go?"
    plain = item.replace(".", "").replace("?", "")
    texts = [item.upper(), item.lower(), item.title(), plain, "HEADLINE: " + plain.upper() + " END", item.title().replace("120", "90"), "Nothing From Paris Or Lyon Is Said In These 3 Hours"]
    bench = spark.createDataFrame([(10, item)], "item_id long, text string")
    got = {r.doc_id: r.longest for r in find_contamination(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench).collect()}
    assert got == {0: 26, 1: 26, 2: 26, 3: 26, 4: 26, 5: 26, 6: 0}


def test_planted_passages_are_found(spark):
    d = "/root/testdata/sf0.01"
    bench = {r.item_id: r.text.lower().split() for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet")
    want = set()
    for r in docs.collect():
        text = " ".join(r.text.lower().split())
        want |= {(r.doc_id, i) for i, w in bench.items() if " ".join(w) in text}
    got = {(r.doc_id, i) for r in find_contamination(docs, spark.read.parquet(f"{d}/benchmark.parquet")).collect() for i in r.item_ids}
    assert want and want <= got


def test_letters_are_unicode_letters():
    assert language.words("½ ² Ⅷ ① x1y É ʰ ª 中文") == {"x": 1, "y": 1, "é": 1, "ʰ": 1, "ª": 1, "中文": 1}
    pieces = ["▁", "a", "b", "▁ab"]
    p = np.random.default_rng(1).random((len(pieces), 2))
    lattice = language.Lattice(pieces)
    logs = np.log(lattice.table(p))

    def slow(w):  # plain sums of logarithms
        a = [np.zeros(2)]
        for e in range(1, len(w) + 1):
            parts = [a[e - n] + logs[pieces.index(w[e - n : e])] for n in (1, 2, 3) if e >= n and w[e - n : e] in pieces]
            a.append(np.logaddexp.reduce(parts) if parts else a[-1] + logs[len(pieces)])
        return a[-1]

    words = ["ab" * 4, "ab" * 20 + "a", "ab" * 3000, "zz" * 100]
    assert np.allclose(lattice.score(words, lattice.table(p)), [slow("▁" + w) for w in words])


def test_language_training_is_bounded_and_takes_every_language(spark):
    rows = [(i, "hello world of words", "en") for i in range(3000)] + [(i, "bonjour le monde", "fr") for i in range(5000, 5012)] + [(1, "hello world of words", "en")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, table = language.train(docs, ["▁", "▁hello", "▁bonjour"], sample=40)
    assert langs == ["en", "fr"]
    long = spark.createDataFrame([(1, "hello " + "x" * 20_000 + " hello"), (1, "bonjour"), (1, "bonjour")], "doc_id long, text string")
    got = sorted(r.lang_pred for r in language.identify(long, langs, table, ["▁", "▁hello", "▁bonjour"]).collect())
    assert got == ["en", "fr", "fr"]
    assert language.identify(long.limit(0), langs, table, ["▁"]).count() == 0


def test_quality_sample_is_bounded_with_repeated_ids(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(quality, "fit", lambda x, y: sizes.append(len(x)) or fit(x, y))
    docs = spark.range(5000).selectExpr("id % 3 + 1 as doc_id", "concat('text ', id) as text")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 4)], "doc_id long, quality int")
    quality.train(docs, labels, sample=2)
    assert sizes == [2]
    assert quality.score_quality(docs.limit(0), fit(np.zeros((0, 5)), np.zeros(0))).count() == 0


def test_all_secret_rules_equal_expressions_on_random_texts(monkeypatch):
    from tidewheel.llm import automaton, secrets

    r = np.random.default_rng(11)
    parts = ["token", "api_key", "PassWord", "=", ":", " ", "  ", '"', "'", "abcdefghijklmnop", "0123456789abcdef", "dead", "AKIA", "ABCDEFGH12345678", "gh", "p_", "a1B2" * 10, "xoxb-", "-----", "BEGIN ", "PRIVATE KEY", "RSA ", "eyJ", "abc.def", ".", "é", "ſ", "\n", "x"]
    texts = ["".join(r.choice(parts, int(r.integers(0, 40)))) for _ in range(1500)] + ["token=" * 300, "-----BEGIN " * 40 + "PRIVATE KEY-----", "a" * 3000 + "G" + "b" * 20]
    rules = [(e.replace("{16,}", "+") if k == "hex" else e, head, least) for k, e, least, head in secrets.RULES]

    def brute(t):
        out = []
        for k, (e, head, least) in enumerate(rules):
            for m in re.finditer(e, t):
                value = m.end() - (re.match(head, t[m.start() :]).end() + m.start() if head else m.start())
                if value >= least:
                    out.append((m.start(), k, m.end()))
        return sorted(out)

    want = [brute(t) for t in texts]
    assert {k for x in want for _, k, _ in x} == set(range(len(rules)))
    for lane in (512, 7):
        monkeypatch.setattr(automaton, "LANE", lane)
        assert list(text_spans(pa.array(texts))) == want


def test_personal_data_is_told_by_context():
    from tidewheel.llm.personal import KINDS, _examples, features, scored_spans

    model, limits = train()
    for x in ("order 415-555-2671 shipped", "serial 123-45-6789 of the pump", "lot 123-45-6789", "version 234.567.8901 release"):
        assert find_spans(x, model, limits) == [], x
    for x, kind in (("call 415-555-2671 now", "national_phone"), ("her ssn 123-45-6789 was", "ssn"), ("mobile: 0161 496 0123", "national_phone")):
        assert [KINDS[k] for _, k, _ in find_spans(x, model, limits)] == [kind], x
    mail = scored_spans("mail a@b.com", model, limits)[0][3]
    assert mail > 0.5 and scored_spans("version 1.2.3.4", model, limits)[0][1] == 1  # base spans stay
    assert len({round(x, 3) for x in limits.values()}) > 3
    rows = list(_examples(77))
    score = model.score(np.array([features(*x[:4]) for x in rows]))
    kinds, real = np.array([x[3] for x in rows]), np.array([x[4] for x in rows])
    for k in KINDS:
        own = kinds == k
        taken = score[own] >= limits[k]
        assert real[own][taken].mean() >= 0.9 and taken[real[own]].mean() >= 0.9, k


def test_long_lines_take_little_time():
    import time

    from tidewheel.llm.personal import find_spans, train

    model, limits = train()
    for piece in ("abc deadbeef ", "token=", "+", "(", "a@", "1.", "0 ", "[at] ", "12 ", "01 02 "):
        line = piece * (1_000_000 // len(piece))
        began = time.process_time()
        list(text_spans(pa.array([line])))
        assert time.process_time() - began < 4
        began = time.process_time()
        find_spans(line, model, limits)
        assert time.process_time() - began < 8, piece  # in proportion to the line: a square would take hours


def brute_contamination(docs, items, window=8, share=0.5, least=13, literal=5):
    """Every item against every document on every diagonal; a diagonal counts where a whole window is equal in either form."""
    from tidewheel.llm.decontaminate import diagonal, folded, template

    out = []
    for text in docs:
        kinds, values = template(text)
        names = folded(kinds, values).tolist()
        found = {}
        for i, item in items:
            own, own_values = template(item)
            own_names = folded(own, own_values).tolist()
            n = min(window, len(own))
            for shift in range(n - len(own), len(kinds) - n + 1) if n else ():
                ps = range(max(0, -shift), min(len(own), len(kinds) - shift) - n + 1)
                if any(own[p : p + n] == kinds[p + shift : p + shift + n] or own_names[p : p + n] == names[p + shift : p + shift + n] for p in ps):
                    best = diagonal(own, own_values, kinds, values, shift, literal)
                    if best and (best >= least or best >= share * len(own)):
                        found[i] = max(found.get(i, 0), best)
        out.append(found)
    return out


def test_decontamination_equals_brute_force(spark, monkeypatch):
    from tidewheel.llm import decontaminate

    r = np.random.default_rng(21)
    names, verbs = ["Paris", "Lyon", "Anna", "Oslo", "Bert"], ["runs", "buys", "moves", "sees", "holds", "and", "then", "with", "the", "box", "of", "red", "km", "kg"]

    def sentence(n):
        return " ".join(str(r.choice(names)) if x < 0.15 else str(r.integers(1, 90)) if x < 0.3 else str(r.choice(verbs)) for x in r.random(n))

    items = [(i, sentence(int(r.integers(3, 40)))) for i in range(30)]

    def changed(t):
        swap = dict(zip(names, r.permutation(names), strict=True))
        words = [swap.get(w, str(int(w) + 1) if w.isdigit() else w) for w in t.split()]
        for _ in range(int(r.integers(0, 2))):
            words[int(r.integers(0, len(words)))] = "other"
        return " ".join(words)

    forms = [str, str.upper, str.lower, str.title, changed, lambda t: changed(t).lower(), lambda t: " ".join(t.split()[: len(t.split()) // 2])]
    docs = [None, ""] + [f"{sentence(20)} {forms[j % len(forms)](items[j % 30][1])} {sentence(15)}" for j in range(90)]
    want = brute_contamination(docs, items)
    frame = spark.createDataFrame([(i, t, "c") for i, t in enumerate(docs)], "doc_id long, text string, longest string")
    bench = spark.createDataFrame([*items, (None, "x y z"), (99, None)], "item_id long, text string")
    for most, pairs in ((2_000_000, 1 << 20), (400, 3)):  # in one part, in many parts and small joins
        monkeypatch.setattr(decontaminate, "MAX_WINDOWS", most)
        monkeypatch.setattr(decontaminate, "PAIRS", pairs)
        got = {x.doc_id: x for x in find_contamination(frame, bench).collect()}
        assert [got[i].item_ids for i in range(len(docs))] == [sorted(x) for x in want]
        assert [got[i].longest for i in range(len(docs))] == [max(x.values(), default=0) for x in want]


def test_copies_of_benchmark_items_in_any_case_are_found(spark):
    d = "/root/testdata/sf0.001"
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    forms = {"as is": str, "lower": str.lower, "upper": str.upper, "title": str.title, "renumbered": lambda t: re.sub(r"\d", "7", t)}
    rows = [(f"{f}:{i}", "Some words before it. " + g(t) + " And some after.") for f, g in forms.items() for i, t in items]
    got = {x.doc_id: x.item_ids for x in find_contamination(spark.createDataFrame(rows, "doc_id string, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for f in forms:
        assert np.mean([i in got[f"{f}:{i}"] for i, _ in items]) >= 0.9, f


def test_every_row_of_the_decontamination_fixture(spark):
    item = "A train from Paris travels 120 km in 3 hours and then stops at Lyon before it turns back. How fast did Paris see it go?"
    rows = [(1, item.upper()), (2, "A train from Berlin travels 250 km in 5 hours and then stops at Berlin before it turns back. How fast did Munich see it go?"), (1, item.upper()), (3, item.replace("Paris", "Bonn").replace("Lyon", "Kiel").lower())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.item_ids, r.longest) for r in find_contamination(docs, spark.createDataFrame([(10, item), (10, item)], "item_id long, text string")).collect())
    assert got == [(1, [10], 26), (1, [10], 26), (2, [10], 22), (3, [10], 26)]
