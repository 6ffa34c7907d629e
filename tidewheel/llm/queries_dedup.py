"""Near-duplicate queries."""

from __future__ import annotations

from .minhash import near_duplicates
from .vectors import near_vectors


def op2_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, percent=85)


def op3_embedding_near_dedup(spark, sf_dir):
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.98)


_CLOSURE = """
both_ways as (select a, b from links union all select b, a from links),
reach(id, far) as (select id, id from ids union select r.id, l.b from reach r join both_ways l on l.a = r.far),
low as (select id, min(far) as component_id from reach group by id)"""

SQL_OP2 = rf"""
with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (select doc_id, unnest(list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                                       when len(w) > 0 then [array_to_string(w, ' ') || ' of ' || len(w)] else [] end)) as s from words),
sizes as (select doc_id, count(s) as n from words left join shingles using (doc_id) group by doc_id),
shared as (select x.doc_id as a, y.doc_id as b, count(*) as n from shingles x join shingles y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2),
links as (select a, b from shared c join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c.n >= 85 * (x.n + y.n - c.n)),
ids as (select doc_id as id from documents), {_CLOSURE}
select doc_id, cast(n as bigint) as n_shingles, component_id, doc_id = component_id as kept from sizes join low on id = doc_id
"""

SQL_OP3 = f"""
with recursive sound as (select vec_id, label, embedding::double[] as v from embeddings
                         where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select x.vec_id as a, y.vec_id as b from sound x join sound y on x.label = y.label and x.vec_id < y.vec_id and len(x.v) = len(y.v) where list_cosine_similarity(x.v, y.v) >= 0.98),
ids as (select vec_id as id from embeddings), {_CLOSURE},
direct as (select a, count(*) as n from both_ways group by a)
select vec_id, cast(coalesce(n, 0) as bigint) as n_links, component_id, vec_id = component_id as kept from embeddings join low on id = vec_id left join direct on a = vec_id
"""

QUERIES = {"op2_minhash_near_dedup": op2_minhash_near_dedup, "op3_embedding_near_dedup": op3_embedding_near_dedup}
SQL = {"op2_minhash_near_dedup": SQL_OP2, "op3_embedding_near_dedup": SQL_OP3}
