"""Query op3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import vptree
from .common import table


def op3_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vptree.nearest(rows.filter("vec_id % 20 = 0"), rows, k=20, factor=1.0)


QUERIES = {"op3_vantage_point_search": op3_vantage_point_search}
ORACLE = {
    "op3_vantage_point_search": """
with v as (
    select vec_id, embedding::double[] as e from embeddings
    where vec_id is not null and embedding is not null and len(embedding) > 0
        and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
        and len(list_filter(embedding, lambda x: x <> 0)) > 0
),
s as (
    select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.e, c.e) as score
    from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e)
    where q.vec_id % 20 = 0
),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
"""
}
