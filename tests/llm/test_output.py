"""Mixing, token files and the pipeline."""

import io
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import mixing, token_files

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def water_fill(sizes, weights=(5, 2, 1), repeats=3):
    """Targets by resharing what is above the limit again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > repeats * sizes[s]}
        if not over:
            return full | {s: level * w[s] for s in open_}
        for s in over:
            full[s] = float(repeats * sizes[s])
            left -= full[s]
        open_ -= over
    return full


def test_mixing(spark):
    r = np.random.default_rng(1)
    rows = [(i, "w " * int(r.integers(1, 900)), ["b", "a", "é", None, "c"][min(4, int(r.integers(0, 12)))]) for i in range(900)]
    rows += [(2000, None, "a"), (2001, " \n", "zero"), (2002, "x " * 40_000, "b"), (2002, "x " * 40_000, "b")]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, source string, size int")
    got = mixing.mix_sources(docs).collect()
    assert sorted(got, key=str) == sorted(mixing.mix_sources(docs.repartition(7)).collect(), key=str)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((x.doc_id, x.size) for x in got) == sorted((i, size(t)) for i, t, _ in rows)
    totals = {}
    for _, t, s in rows:
        totals[s] = totals.get(s, 0) + size(t)
    want = water_fill(totals)
    for s, target in want.items():
        own = [x for x in got if x.source == s]
        assert all(abs(x.target - target) < 1e-6 * max(target, 1) and x.source_size == totals[s] for x in own)
        assert abs(sum(x.taken for x in own) - target) <= max(0.03 * target, 200)
    assert all(0 <= x.taken <= 3 * x.size for x in got)


def test_mixing_empty(spark):
    assert mixing.mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    only = mixing.mix_sources(spark.createDataFrame([(1, None, "a")], "doc_id long, text string, source string")).collect()
    assert [(x.size, x.taken) for x in only] == [(0, 0)]


@pytest.mark.parametrize("n", [0, 1, 7, 8, 65_536])
def test_chunk_round_trip(n):
    ids = np.random.default_rng(n).integers(0, 50_257, n).astype(np.uint32)
    data, sizes = token_files.encode_chunk(ids)
    assert (token_files.decode_chunk(data, sizes, n) == ids).all()
    big = np.full(5, 2**32 - 1, np.uint32)
    assert (token_files.decode_chunk(*token_files.encode_chunk(big), 5) == big).all()


def test_shard_round_trip():
    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    docs = [(i, np.arange(k, dtype=np.uint32)) for i, k in enumerate((1, 200_000, 3, 65_536, 1))]
    out = io.BytesIO()
    w = token_files.ShardWriter(out)
    for i, ids in docs:
        w.add(i, ids)
    w.close()
    for (i, a), (j, b) in zip(docs, token_files.read_shard(Source(out.getvalue())), strict=True):
        assert i == j and (a == b).all()


def test_tokens_equal_the_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    tok.encode_special_tokens = True  # their strings are ordinary text in a document
    rows = [(5, "Hello world"), (3, None), (9, ""), (4, "é ß # <x>"), (1, "word " * 60_000), (7, "a\n\nb"), (11, "a\n \nb  c \n d"), (12, " lead and trail "), (13, "it's <|endoftext|> 3.5\u00a0km don't"), (14, "x\n\n y"), (15, "tab\t z")]
    rows += [(100 + r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {r.doc_id: r for r in token_files.tokenise(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, start int"), TOKENIZER).collect()}
    start = 0
    for i, t in sorted(rows):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.tokenise(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER).count() == 0


def encoded(encoder, monkeypatch, texts, step):
    """Bytes of text that the library was given, and the ids."""
    import pyarrow as pa

    given, library = [], encoder._library
    monkeypatch.setattr(encoder, "_library", lambda x: given.append(sum(map(len, x))) or library(x))
    got = [ids for lo in range(0, len(texts), step) for ids in encoder.encode(pa.array(["  skipped"] + texts[lo : lo + step], pa.string()).slice(1))]
    return sum(given), [list(x) for x in got]


def test_frequent_pieces_outlive_rare_ones(monkeypatch):
    """When the known pieces grow beyond their bytes, words of every text are not encoded again."""
    from tokenizers import Tokenizer

    r = np.random.default_rng(3)
    common = [f"commonword{i}" for i in range(300)]
    texts = ["start " + " ".join([*common, *(f"x{int(r.integers(1 << 40))}" for _ in range(100))]) for _ in range(60)]
    monkeypatch.setattr(token_files, "KNOWN_BYTES", 200_000)
    with open(TOKENIZER, encoding="utf-8") as f:
        given, got = encoded(token_files.Encoder(f.read(), True), monkeypatch, texts, 2)
    tok = Tokenizer.from_file(TOKENIZER)
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert given < 1.1 * len(" ".join({" " + w for t in texts for w in t.split(" ")}))


@pytest.mark.parametrize("added", [True, False])
@pytest.mark.parametrize("known", [0, 20_000, 1 << 27])
def test_encoder_equals_the_library_on_odd_texts(monkeypatch, added, known):
    from tokenizers import Tokenizer

    r = np.random.default_rng(known % 97)
    parts = [" ", " ", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "\u180e", "\ufeff", "'s", "'", "a", "Bc", "é", "漢字", "🙂", "12", "٣", "...", "<|endoftext|>", "<|endof", "text|>", "\x00", "the"]
    texts = ["".join(r.choice(parts, int(r.integers(0, 14)))) for _ in range(1500)] + ["", "", None, "a " * 3000, " b" * 3000]
    monkeypatch.setattr(token_files, "KNOWN_BYTES", known)
    with open(TOKENIZER, encoding="utf-8") as f:
        _, got = encoded(token_files.Encoder(f.read(), added), monkeypatch, texts, 100)
    tok = Tokenizer.from_file(TOKENIZER)
    tok.encode_special_tokens = not added
    assert got == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_stages_keep_null_and_repeated_ids(spark, monkeypatch):
    import corpus_pipeline

    r = np.random.default_rng(8)
    text = lambda n=60: " ".join(r.choice([f"w{i}" for i in range(500)], n))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(None, a, "s"), (None, b, "s"), (None, b, "s"), (7, c, "s"), (7, d, "t"), (7, d, "t"), (8, d + " more", "t"), (3, a.upper(), "s"), (9, e, None), (None, None, "s"), (None, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    left = corpus_pipeline.drop_near_duplicates(spark, docs, None)
    want = [(None, b, "s"), (7, c, "s"), (7, d, "t"), (3, a.upper(), "s"), (9, e, None), (None, None, "s"), (None, "", "s")]
    assert sorted(map(tuple, left.collect()), key=str) == sorted(want, key=str)

    share = {x: n for n, x in enumerate((b, c, d, e), 1)}

    def fixed(frame):
        size = F.regexp_count("text", F.lit(mixing.WORD)).cast("long")
        n = F.coalesce(*[F.when(F.col("text") == x, F.lit(k)) for x, k in share.items()], F.lit(0))
        return frame.select("doc_id", "source", size.alias("size"), (size * n).alias("taken"))

    monkeypatch.setattr(corpus_pipeline, "mix_sources", fixed)
    for limit in ("10485760", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        got = sorted(map(tuple, corpus_pipeline.mix(spark, docs, None).collect()), key=str)
        assert got == sorted([x for x in rows for _ in range(share.get(x[1], 0))], key=str)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pipeline(spark):
    import corpus_pipeline
    from tidewheel.llm.decontaminate import find_contamination
    from tidewheel.llm.minhash import near_duplicates

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, docs = docs, stage(spark, docs, d).cache()
        assert docs.columns == before.columns
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    first, second, third, fourth = kept.values()
    assert fourth <= third <= second <= first and third
    labels = spark.read.parquet(f"{d}/labels.parquet").toPandas()
    good = set(labels[labels.quality == 1].doc_id)
    assert len(good & first) >= 0.95 * len(good)
    source = spark.read.parquet(f"{d}/documents.parquet")
    chosen = source.where(source.doc_id.isin(list(first)))
    assert second == {r.doc_id for r in near_duplicates(chosen).where("kept").collect()}
    assert third == second - {r.doc_id for r in find_contamination(chosen, spark.read.parquet(f"{d}/benchmark.parquet")).where("contaminated").collect()}
    rows = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in rows} == fourth and sorted(r.start for r in rows)[0] == 0


def test_the_query_takes_the_librarys_own_treatment_of_added_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    from tidewheel.llm.queries_mix import op10_token_bit_planes

    rows = [(None, "null id"), (2, "a <|endoftext|> b"), (1, "<|endoftext|>"), (3, "plain words here"), (4, "x<|endoftext|><|endoftext|> y  z"), *[(7, f"same id {i}") for i in range(5)]]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    tok = Tokenizer.from_file(TOKENIZER)
    want = {}
    for i, t in rows:
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    got = {}
    for r in sorted(op10_token_bit_planes(spark, str(tmp_path)).collect(), key=lambda r: r.start):
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert list(got) == [None, 1, 2, 3, 4, 7] and {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def xxh(*values, seed=42):
    """Spark's xxhash64: int as 4 bytes, long (here: a number in a list) as 8."""
    import struct

    import xxhash

    for v in values:
        if v is not None:
            raw = struct.pack("<q", v[0]) if isinstance(v, list) else struct.pack("<i", v)
            seed = xxhash.xxh64(raw, seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def swap_or_not(x, n, *salt):
    for r in range(1, mixing.ROUNDS + 1):
        other = (xxh(*salt, r) % n - x) % n
        if xxh(*salt, r, [max(x, other)]) & 1:
            x = other
    return x


def mixed(rows, block=64, repeats=3, seed=17):
    """(doc_id, size, taken) of (doc_id, words, source) by plain loops."""
    sizes = {}
    for _, k, s in rows:
        sizes[s] = sizes.get(s, 0) + k
    target = water_fill(sizes)
    out = []
    for place, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or ""))):
        own = sorted(((xxh([i], [k]) % mixing.PARTS, i, k) for i, k, t in rows if t == s), key=lambda x: x)
        blocks = -(-sizes[s] // block)
        times = [0] * blocks
        for n in range(min(int(target[s] * blocks / max(sizes[s], 1) + 0.5), blocks * repeats)):
            times[swap_or_not(n % blocks, blocks, seed, place, [n // blocks])] += 1
        off = 0
        for _, i, k in own:
            out.append((i, k, sum(times[w // block] for w in range(off, off + k))))
            off += k
    return sorted(out)


def test_mixing_equals_a_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r.source) for r in docs.collect()]
    got = mixing.mix_sources(docs, slots=64).select("doc_id", "size", "taken").collect()
    assert sorted(map(tuple, got)) == mixed(rows)


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000])
def test_permutations_are_exact(spark, n):
    frame = spark.range(n).select(*[mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(s)).alias(str(s)) for s in (1, 2)]).toPandas()
    assert sorted(frame["1"]) == sorted(frame["2"]) == list(range(n))
    if n > 60:
        assert list(frame["1"]) != list(frame["2"]) and list(frame["1"]) != list(range(n))


def test_permutations_of_large_sources(spark):
    n = 1 << 40
    frame = spark.range(n - 20_000, n).select("id", mixing.permuted(F.col("id"), F.lit(n), F.lit(7)).alias("at")).toPandas()
    assert frame["at"].nunique() == 20_000 and frame["at"].between(0, n - 1).all() and abs(frame["at"].mean() / n - 0.5) < 0.02
    assert frame["at"][5] == swap_or_not(int(frame["id"][5]), n, 7)


def test_shards_draw_their_sources(spark):
    goal = spark.createDataFrame([(0, 900, 2000), (1, 90, 100), (2, 5, 0), (3, 10, 5)], "place long, blocks long, wanted long")
    rows = mixing.drawn(goal, slots=100).collect()
    per = {}
    for r in rows:
        per.setdefault(r.shard, {})[r.place] = r["count"]
    assert sorted(per) == list(range(22)) and sum(sum(x.values()) for x in per.values()) == 2105
    assert len({x.get(0) for x in per.values()}) > 5  # counts vary as draws do
    for p in (0, 1, 3):
        at = 0
        for r in sorted((r for r in rows if r.place == p), key=lambda r: r.shard):
            assert r["from"] == at
            at += r["count"]
    n = mixing.numbered(goal, slots=100).groupBy("place").agg(F.count("*").alias("n"), F.countDistinct("n").alias("d"), F.max("n").alias("m")).collect()
    assert sorted(map(tuple, n)) == [(0, 2000, 2000, 1999), (1, 100, 100, 99), (3, 5, 5, 4)]


def test_every_stage_on_edge_rows(spark, tmp_path):
    import corpus_pipeline

    r = np.random.default_rng(4)
    text = lambda n: " ".join(r.choice([f"w{i}" for i in range(900)], n))
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, contaminated boolean, n int"
    rows = [(i, text(40), "en", None if i % 7 == 0 else f"s{i % 3}", 9, 0.1, True, 1) for i in range(60)]
    rows += [(None, None, None, None, None, None, None, None), (None, "", None, "s1", 0, 0.2, False, 2), (70, text(30_000), "en", "s2", 5, 0.3, None, 3), rows[3], rows[3]]
    spark.createDataFrame([(i, 1) for i in range(60)] + [(None, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "one question of some words that no text holds at all"), (None, "x"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns, name
        kept = sorted(map(tuple, got.collect()), key=str)
        assert set(kept) <= set(rows), name
        if name in ("quality classifier", "benchmark decontamination"):
            assert kept == sorted(rows, key=str)
        elif name == "MinHash near-dedup":
            assert kept == sorted(set(rows), key=str)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    last = corpus_pipeline.write_token_files(spark, docs, str(tmp_path))
    assert last.count() == len(rows) and corpus_pipeline.write_token_files(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_pipeline_equals_its_stages_by_plain_loops(spark):
    """Stages 2 and 3 against brute force on what the classifier kept; the mix and the files against the model and the library."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    d = "/root/testdata/sf0.001"
    docs = corpus_pipeline.keep_quality(spark, spark.read.parquet(f"{d}/documents.parquet"), d)
    rows = {x.doc_id: x for x in docs.collect()}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), x.text or "")) for i, x in rows.items()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} if w else set() for i, w in words.items()}
    top = {i: i for i in rows}
    for a in sorted(rows):
        for b in sorted(rows):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((top[a], top[b]))
                top = {i: low if t == high else t for i, t in top.items()}
    second = corpus_pipeline.drop_near_duplicates(spark, docs, d)
    assert sorted(x.doc_id for x in second.collect()) == sorted(i for i, t in top.items() if i == t)
    third = corpus_pipeline.drop_contaminated(spark, second, d).collect()
    fourth = corpus_pipeline.mix(spark, spark.createDataFrame(third, docs.schema), d)
    left = sorted((x.doc_id, x.text or "") for x in fourth.collect())
    tok, start, want = Tokenizer.from_file(TOKENIZER), 0, []
    for i, t in left:
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, corpus_pipeline.write_token_files(spark, fourth, d).collect())) == want
