"""Five stages from raw documents to token files. Each reads all that its predecessor kept.

Of every stage holds: rows with a null doc_id, source or text, and rows that share a doc_id, are rows like others;
texts are read whole, whatever their length; columns beyond doc_id, text and source are carried along by all stages but
the last; an empty table gives an empty one. What else a stage does with nulls, empty texts, ties and repeats
stands with it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tidewheel.llm import quality
from tidewheel.llm.decontaminate import find_contamination
from tidewheel.llm.minhash import marked, text_hash
from tidewheel.llm.mixing import mix_sources
from tidewheel.llm.shared import staged
from tidewheel.llm.token_files import tokenise

ORACLE_SQL = None


def keep_quality(spark, docs, sf_dir):
    """Documents whose score says that they are good.

    Null and empty texts have a score as others have, that of no words. Repeated rows go or stay together.
    Without labels of two classes the score is the share of good ones (0.5 without any) for all, and all stay
    if that is LIMIT or more.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score_quality(docs.withColumnsRenamed({"score": "__score"}), model)  # a column of that name is another
    return scored.where(F.col("score") >= quality.LIMIT).select(*[F.col("__score" if c == "score" else c).alias(c) for c in docs.columns])


def drop_near_duplicates(spark, docs, sf_dir):
    """One document, that of the smallest doc_id, of each group of near copies (five words, 0.8).

    Texts that share a doc_id are judged each for itself; rows that repeat doc_id and text count as one, and one
    of them, whichever, stays. A document without a doc_id goes only where another has the same set of shingles. Null and
    wordless texts are copies of nothing.
    """
    kept = marked(docs).where("first").select(F.struct(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).alias("__node")).distinct()
    keyed = docs.withColumn("__node", F.struct(F.col("doc_id").cast("long").alias("id"), text_hash().alias("hash")))
    return keyed.dropDuplicates(["__node"]).join(kept.hint("merge"), "__node", "left_semi").select(*docs.columns)


def drop_contaminated(spark, docs, sf_dir):
    """Documents without a benchmark item's template. Null and empty texts match nothing; repeated rows go or stay together."""
    marks = {c: f"__{c}" for c in ("contaminated", "item_ids", "longest") if c in docs.columns}  # the stage's own are others
    found = find_contamination(docs.withColumnsRenamed(marks), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~F.col("contaminated")).select(*[F.col(marks.get(c, c)).alias(c) for c in docs.columns])


def mix(spark, docs, sf_dir):
    """Each document as often as the mix takes it; a fraction of a copy is drawn by the document's hash.

    Null and wordless texts are not taken. Rows that are the same in all columns are taken as often as the mix takes
    them together. A null source is a source.
    """
    keyed = docs.withColumn("__key", F.struct("doc_id", F.xxhash64(*docs.columns).alias("row")))  # rows of one key are the same
    taken = mix_sources(keyed.select(F.col("__key").alias("doc_id"), "text", "source")).where("taken > 0").select(F.col("doc_id").alias("__key"), (F.col("taken") / F.col("size")).alias("share"))
    drawn = F.floor(F.col("share") + F.xxhash64("__key", F.lit(29)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52)))
    copies = taken.groupBy("__key").agg(F.sum(drawn).cast("int").alias("__n")).where("__n > 0")
    once = keyed.dropDuplicates(["__key"]).join(copies.hint("merge"), "__key")
    return once.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__copy")).drop("__copy")


def write_token_files(spark, docs, sf_dir, path=None):
    """Token files of what is left: doc_id, start, n_tokens, ids_crc32 of each document in them.

    Null and empty texts are an end id alone; a null doc_id comes first; repeated rows are written each.
    """
    return tokenise(docs, path or public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("source mixing", mix),
    ("token output", write_token_files),
]


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"pipeline{i}")
    return docs
