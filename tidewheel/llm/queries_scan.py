"""Scanning queries."""

from __future__ import annotations

from .personal import find_personal
from .secrets import RULES, find_secrets


def op8_secret_automaton(spark, sf_dir):
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_personal_data(spark, sf_dir):
    return find_personal(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans_sql(k: int) -> str:
    """Spans of a rule: matches are put between marks, and the lengths of what lies before them are summed."""
    kind, rule, least, head = RULES[k]
    rule = rule.replace("{16,}", "+")
    value = f"regexp_replace(m, {_literal('^' + head)}, '')" if head else "m"
    return rf"""
    select doc_id, {k} as k, '{kind}' as kind, pos + length(before) as a, pos + length(before) + length(m) as z from
      (select doc_id, before, m, coalesce(sum(length(before) + length(m)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as pos from
        (select doc_id, i, string_split(piece, chr(2))[1] as m, case when i = 1 then '' else coalesce(string_split(lag(piece) over (partition by doc_id order by i), chr(2))[2], lag(piece) over (partition by doc_id order by i)) end as before from
          (select doc_id, unnest(string_split(marked, chr(1))) as piece, unnest(range(1, len(string_split(marked, chr(1))) + 1)) as i from
            (select doc_id, regexp_replace(coalesce(text, ''), {_literal('(' + rule.replace('(?:', '(') + ')')}, chr(1) || '\1' || chr(2), 'g') as marked from documents))) where i > 1)
    where length({value}) >= {least}"""


SQL_OP8 = f"""
with spans as ({' union all '.join(_spans_sql(k) for k in range(len(RULES)))}),
named as (select *, kind || ':' || cast(a as varchar) || ':' || cast(z as varchar) as s from spans),
per as (select doc_id, count(*) filter (where k = 0) as n_assign, count(*) filter (where k = 1) as n_access, count(*) filter (where k = 2) as n_hex,
               string_agg(s, ',' order by a, k, z) filter (where k < 3) as base, string_agg(s, ',' order by a, k, z) as spans from named group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents left join per using (doc_id)
"""

QUERIES = {"op8_secret_automaton": op8_secret_automaton, "op9_personal_data": op9_personal_data}
SQL = {"op8_secret_automaton": SQL_OP8}
