"""Query op2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import warc
from .common import fresh_path, table


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    records = pages.select(
        F.col("page_id").alias("record_id"), "url", F.col("html").alias("payload"), warc.digest(F.col("html")).alias("payload_digest")
    )
    headers = records.select("record_id", "payload_digest", F.octet_length(F.coalesce("payload", F.lit(""))).alias("payload_bytes"))
    revisits = (
        warc.resolve_revisits(headers)
        .filter("record_type = 'revisit'")
        .select(F.col("record_id").alias("_id"), F.col("payload_digest").alias("_digest"), "record_type", "refers_to")
        .distinct()
    )
    # Payloads stay where they were read: what is joined to them is the resolved headers of revisits.
    same = F.col("record_id").eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_digest"))
    path = fresh_path(spark, "warc")
    warc.write_warc(records.join(revisits, same, "left").withColumn("record_type", F.coalesce("record_type", F.lit("response"))), path)
    read = warc.with_payloads(warc.read_warc(spark, path))
    return read.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


QUERIES = {"op2_warc_revisits": op2_warc_revisits}
ORACLE = {
    "op2_warc_revisits": """
with p as (
    select page_id, url, coalesce(html, '') as payload, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest
    from pages
),
o as (select payload_digest, max(page_id) as original from p where payload_bytes >= 1000 group by payload_digest)
select page_id, payload_bytes, p.payload_digest as payload_digest,
    case when payload_bytes >= 1000 and page_id is distinct from original then 'revisit' else 'response' end as record_type,
    case when payload_bytes >= 1000 and page_id is distinct from original then original end as refers_to,
    url
from p left join o on p.payload_digest = o.payload_digest
"""
}
