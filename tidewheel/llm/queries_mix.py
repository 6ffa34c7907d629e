"""Decontamination, mixing and token output queries, and the pipeline."""

from __future__ import annotations

import public_tokenizers

from .decontaminate import find_contamination
from .mixing import mix_sources
from .token_files import tokenise


def op6_source_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op7_template_decontamination(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "contaminated", "item_ids", "longest")


def op10_token_bit_planes(spark, sf_dir, path=None):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return tokenise(docs, path or public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True)


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op6_source_mixing": op6_source_mixing,
    "op7_template_decontamination": op7_template_decontamination,
    "op10_token_bit_planes": op10_token_bit_planes,
    "pipeline": pipeline,
}
SQL = {}
