"""A corpus pipeline: quality rules, exact dedup, near dedup, mixing, byte-level BPE.

run(spark, sf_dir) applies STAGES to documents. Each stage is a function (spark, docs, sf_dir) -> DataFrame whose
result is written as Parquet and read again as the next one's docs. All but the last return the columns of documents.

In every stage: null texts count as empty; very long texts are taken whole; columns beyond those of documents pass
through whatever their names, except in the last stage, which gives ids and digests; an empty table gives an empty
result. A null doc_id is an id of its own. Rows that repeat a doc_id stay or go together; of ties the smallest doc_id stays.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwave.llm.bpe import encode_decode
from rillwave.llm.common import shared_dir, staging
from rillwave.llm.exact_dedup import exact_dedup
from rillwave.llm.mixing import mix
from rillwave.llm.near_dedup import near_duplicates
from rillwave.llm.quality import quality

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _kept(docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id the verdict keeps; repeated rows stay or go together."""
    kept = verdict.where("kept").select(F.col("doc_id").alias("__kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__kept_id"]), "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that fail the base rules or the thresholds of their language and source."""
    return _kept(docs, quality(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    return _kept(docs, exact_dedup(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by five-word shingles at a similarity of 0.8."""
    return _kept(docs, near_duplicates(docs, shingle=5, percent=80))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents to the target weights of their sources; the order is a global shuffle."""
    return mix(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, with the digests of ids and decoded bytes."""
    return encode_decode(docs, public_tokenizers.path(VOCABULARY), ("ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact),
    ("near dedup", near),
    ("mixing", mixed),
    ("bpe", tokens),
]

#: MinHash near-dedup links by chance-built candidate lists and transitive closure; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for at, (_, function) in enumerate(STAGES):
        out = f"{folder}/{at}"
        with staging():
            function(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
