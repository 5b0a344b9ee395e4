"""Exact dedup on a 128-bit content hash, with the bytes compared inside each hash group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwave.llm.common import WS, stage

#: Above every distance between the largest long and a doc_id, so that (length, doc_id) packs into one decimal.
_SPAN = "20000000000000000000"


def normalised(text: Column) -> Column:
    """The text without any character of [\\x20\\x09-\\x0D]; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{WS}+", "")


def md5_128(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


def exact_dedup(docs: DataFrame, content_hash=md5_128) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised bytes are. Of equal texts the row with the most code points in the
    original text stays, of those the smallest doc_id. Null and empty texts form one group. Repeated rows (same
    doc_id) are separate members of their group, each of which is kept if it carries the keep_id. A row without
    doc_id stays only in a group without any. Very long texts are compared whole. Other columns of docs are ignored; an empty table gives an empty result.

    The group-by has the hash and the bytes as its key, hash-partitioned by the hash: copies collapse before the
    shuffle, and two texts that share a hash remain two groups. The groups are staged, so that the join in which
    documents find theirs, by hash and SHA-256 over rows without texts, is one that adaptive execution splits where
    one group holds much of the table.
    Should two different texts share both digests, the query stops rather than merge them.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = (
        docs.select("doc_id", text.alias("text"))
        .withColumn("norm", normalised(F.col("text")))
        .select("doc_id", F.char_length("text").alias("len"), "norm", content_hash(F.col("norm")).alias("h"))
    )
    digests = stage(keyed.select("doc_id", "len", "h", F.sha2("norm", 256).alias("text_sha256")), "exact-digests")

    # Longest original first, then smallest id: one comparable fixed-width value, so the aggregate hashes.
    rank = F.col("len").cast("decimal(10,0)") * F.lit(_SPAN).cast("decimal(20,0)") + (
        F.lit(2**63 - 1).cast("decimal(20,0)") - F.col("doc_id").cast("decimal(20,0)")
    )
    by_bytes = keyed.withColumn("rank", rank).groupBy("h", "norm").agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("group_size"))
    groups = (
        by_bytes.select("h", F.sha2("norm", 256).alias("text_sha256"), "rank", "group_size")
        .groupBy("h", "text_sha256")
        .agg(F.max("rank").alias("rank"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("variants"))
        .withColumn(
            "group_size",
            F.when(F.col("variants") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share both digests")).cast("long")),
        )
        .withColumn("keep_id", (F.lit(2**63 - 1).cast("decimal(20,0)") - (F.col("rank") % F.lit(_SPAN).cast("decimal(20,0)"))).cast("long"))
        .select("h", "text_sha256", "keep_id", "group_size")
    )
    groups = stage(groups, "exact-groups")
    return digests.join(groups.hint("merge"), ["h", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents),
w AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""
