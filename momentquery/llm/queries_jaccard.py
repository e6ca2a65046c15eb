"""Query op5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import jaccard
from .common import table


def op5_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.components(table(spark, sf_dir, "documents"), width=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


#: The set of a text t: 4-word shingles, or the whole sequence.
_SETS = """
words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
    from documents
),
sets as (
    select doc_id, case
        when len(w) = 0 then []::varchar[]
        when len(w) < 4 then [array_to_string(w, ' ')]
        else list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)])
    end as s
    from words
),
rows as (select doc_id, len(s) as n, unnest(s) as token from sets),
pairs as (
    select a.doc_id as x, b.doc_id as y
    from rows a join rows b on a.token = b.token and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
    group by a.doc_id, b.doc_id, a.n, b.n
    having 100 * count(*) >= {percent} * (a.n + b.n - count(*))
)
"""
ORACLE = {
    "op5_grouped_prefix_join": "with recursive"
    + _SETS.format(percent=85)
    + """,
edges as (select x, y from pairs union all select y, x from pairs),
reach as (select x as doc_id, x as other from edges union select r.doc_id, e.y from reach r join edges e on r.other = e.x),
least_of as (select doc_id, min(other) as component from reach group by doc_id)
select s.doc_id as doc_id, len(s.s)::bigint as n_shingles, coalesce(l.component, s.doc_id) as component_id
from sets s left join least_of l on s.doc_id = l.doc_id
"""
}
QUERIES = {"op5_grouped_prefix_join": op5_grouped_prefix_join}
