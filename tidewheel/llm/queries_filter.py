"""Filter and classifier queries."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import language, quality
from .shared import crc_mod5
from .url_filter import judge_urls

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op1_url_filter_cascade(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


_VALUES = ", ".join(f"('{v}', '{r}', '{r[: r.index('/')]}', '{r[r.index('/'):]}')" for v, r in RULES)
SQL_OP1 = f"""
with rules(verdict, rule, rule_host, rule_path) as (values {_VALUES}),
cut as (select page_id, case when url is not null and instr(url, '://') > 0
                             then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
split as (select page_id,
                 translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
ranked as (select p.page_id, p.host, p.path, r.rule, r.verdict,
                  row_number() over (partition by p.page_id, p.host, p.path
                                     order by length(r.rule) desc nulls last, length(r.rule_host) desc) as rn
           from split p left join rules r
             on (p.host = r.rule_host or p.host like '%.' || r.rule_host) and starts_with(p.path, r.rule_path))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from ranked where rn = 1
"""


def op4_quality_boosted(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = quality.score_quality(docs, model)
    return out.select("doc_id", (crc_mod5(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= quality.LIMIT).cast("int").alias("predicted"))


def op5_language_segmentation(spark, sf_dir, path=None):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    pieces = language.vocabulary(path or public_tokenizers.path("piece_bpe_32k.model"))
    langs, table = language.train(docs, pieces)
    out = language.identify(docs.select("doc_id", "text"), langs, table, pieces)
    return out.select("doc_id", (crc_mod5(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


QUERIES = {"op1_url_filter_cascade": op1_url_filter_cascade, "op5_language_segmentation": op5_language_segmentation, "op4_quality_boosted": op4_quality_boosted}
SQL = {"op1_url_filter_cascade": SQL_OP1}
