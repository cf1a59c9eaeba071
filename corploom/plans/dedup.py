"""Exact deduplication: the first copy of a text wins, in document order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, table
from .registry import query


def first_copies(docs: DataFrame, text: str | None = "text", order: str = "doc_id") -> DataFrame:
    """Adds ``digest`` (SHA-256 hex of ``text``, unless it is there) and ``is_first``: whether no earlier row has the same text; ``text`` itself goes.

    Copies are combined before the shuffle; the join carries digests and the other columns only.
    """
    keyed = docs.withColumn("digest", F.sha2(F.col(text), 256)).drop(text) if text else docs
    first = keyed.groupBy("digest").agg(F.min(order).alias("first_order"))
    return keyed.join(first, "digest", "left").withColumn("is_first", F.col(order).eqNullSafe(F.col("first_order"))).drop("first_order")


def flagship(spark, sf_dir: str) -> DataFrame:
    """What exact deduplication keeps of each source: the earliest row of each digest comes out of one aggregation, no row is joined."""
    docs = table(spark, sf_dir, "documents")
    first = F.min(F.struct("doc_id", "source", F.octet_length("text").cast("long").alias("n_bytes"))).alias("first")
    kept = spread(docs.select("doc_id", "source", "text")).groupBy(F.sha2("text", 256)).agg(first).groupBy(F.col("first.source").alias("source")).agg(F.count("*").alias("kept"), F.sum("first.n_bytes").alias("kept_bytes"))
    counted = docs.groupBy("source").agg(F.count("*").alias("documents")).withColumnRenamed("source", "of")
    kept_n = F.coalesce("kept", F.lit(0))
    return counted.join(kept, F.col("of").eqNullSafe(F.col("source")), "left").select(F.col("of").alias("source"), "documents", kept_n.alias("kept"), (F.col("documents") - kept_n).alias("duplicates"), F.coalesce("kept_bytes", F.lit(0)).alias("kept_bytes"))


query("dedup_report_by_source", """
WITH d AS (SELECT source, text, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1 AS is_first FROM documents)
SELECT source, count(*)::BIGINT AS documents, count(*) FILTER (is_first)::BIGINT AS kept, count(*) FILTER (NOT is_first)::BIGINT AS duplicates,
       coalesce(sum(octet_length(encode(text))) FILTER (is_first), 0)::BIGINT AS kept_bytes FROM d GROUP BY source
""")(flagship)
