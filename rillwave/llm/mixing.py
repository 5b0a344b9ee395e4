"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwave.llm.common import join_checked, stage

#: Exponent of the target weights: a source's share of the output is its share of rows to this power, rescaled.
ALPHA = 0.5
SEED = "mix-1"
_BITS = 52


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) from the first 52 bits of a digest of seed and doc_id; null counts as an id of its own."""
    head = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13)
    return (F.conv(head, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**_BITS))


def poisson_count(u: Column, rate: Column) -> Column:
    """The smallest k with P(X <= k) > u for X ~ Poisson(rate), by the stepwise recurrence of the terms.

    Above a rate of 600, where exp(-rate) nears underflow, the recurrence starts 12 standard deviations below the
    mean, at a term from Stirling's series. u has 52 bits, so the tail ends before rate + 12 sqrt(rate) + 40 terms.
    """
    big = rate > 600
    k0 = F.when(big, F.floor(rate - 12 * F.sqrt(rate))).otherwise(F.lit(0)).cast("int")
    k = F.greatest(k0, F.lit(1)).cast("double")
    log_factorial = k * F.log(k) - k + 0.5 * F.log(2 * math.pi * k) + 1 / (12 * k) - 1 / (360 * k * k * k)
    term0 = F.when(big, F.exp(k * F.log(rate) - rate - log_factorial)).otherwise(F.exp(-rate))
    steps = F.sequence(k0 + 1, F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int"))
    start = F.struct(k0.alias("k"), term0.alias("term"), term0.alias("cdf"))

    def step(acc, i):
        term = acc["term"] * rate / i
        return F.when(acc["cdf"] > u, acc).otherwise(F.struct(i.alias("k"), term.alias("term"), (acc["cdf"] + term).alias("cdf")))

    return F.aggregate(steps, start, step, lambda acc: acc["k"])


def rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA) -> DataFrame:
    """source, rate: the mean number of times each document of the source is to appear.

    With target weights w, rate = w / sum(w) * rows / rows of the source. Without, w = rows of the source to the
    power alpha. Null is a source of its own; a source that weights leaves out gets weight 0.
    """
    counts = stage(docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    if weights is None:
        w = F.pow(F.col("n").cast("double"), F.lit(alpha))
    else:
        w = F.lit(0.0)
        for name, value in weights.items():
            if value < 0 or not math.isfinite(value):
                raise ValueError(f"weight of {name!r} must be finite and not negative")
            w = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(w)
    weighed = counts.withColumn("w", w)
    # One row; the sum is rounded so that it is the same in any order of rows.
    total = weighed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.round(F.sum("w"), 9), F.lit(0.0)).alias("weight")).first()
    rate = F.try_divide(F.col("w") * F.lit(total["rows"]), F.lit(total["weight"]) * F.col("n"))
    return weighed.select(F.col("source").alias("rate_source"), F.coalesce(F.round(rate, 9), F.lit(0.0)).alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, seed: str = SEED) -> DataFrame:
    """Documents replicated to the target weights and shuffled globally; adds copy_no (from 0), n_copies and shuffle_key.

    A document appears k times, k being the Poisson quantile (mean: its source's rate) of a hash of seed and
    doc_id: the same on every run and for any partitioning. Rows with a null doc_id share one draw, repeated
    rows too; ties in shuffle_key stand in any order. Null, empty and very long texts pass through. Every copy goes to the partition of its shuffle_key, a hash, and is sorted by it there: a random
    order in which no source or key is hot. The source table is joined by broadcast only below a counted bound.
    Extra columns pass through; an added column whose name is taken gets an underscore behind it. An empty table
    gives an empty result.
    """
    rate = stage(rates(docs, weights, alpha), "mix-rates").withColumnsRenamed({"rate_source": "__mix_source", "rate": "__mix_rate"})
    count, copy, order = (_free(name, docs.columns) for name in ("n_copies", "copy_no", "shuffle_key"))
    joined = join_checked(docs, rate, docs["source"].eqNullSafe(rate["__mix_source"]), "inner")
    counted = joined.withColumn(count, F.coalesce(poisson_count(uniform(docs["doc_id"], seed), F.col("__mix_rate")), F.lit(0)))
    copies = counted.where(F.col(count) > 0).drop("__mix_source", "__mix_rate").withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(count) - 1)))
    key = F.md5(F.concat(F.lit(f"{seed}/order:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col(copy).cast("string")))
    return copies.withColumn(order, key).repartition(order).sortWithinPartitions(order)


def _free(name: str, taken: list[str]) -> str:
    """The name, with underscores behind it while a column has it."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    return mix(docs).select("doc_id", "source", "lang", "copy_no", "n_copies", "shuffle_key", "text")


ORACLE = r"""
WITH RECURSIVE s AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.5) AS w FROM documents GROUP BY source),
t AS (SELECT sum(n)::BIGINT AS rows, round(sum(w), 9) AS weight FROM s),
r AS (SELECT source, round(w * rows / (weight * n), 9) AS rate FROM s, t),
d AS (
  SELECT doc_id, source, lang, text, rate,
         (('0x' || substr(md5('mix-1:' || doc_id), 1, 13))::BIGINT + 0.5) / pow(2.0, 52) AS u
  FROM documents JOIN r USING (source)),
p AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS term, exp(-rate) AS cdf FROM r
  UNION ALL
  SELECT source, rate, k + 1, term * rate / (k + 1), cdf + term * rate / (k + 1) FROM p
  WHERE k + 1 <= ceil(rate + 12 * sqrt(rate) + 40)),
c AS (
  SELECT d.doc_id, d.source, d.lang, d.text, (SELECT min(k) FROM p WHERE p.source = d.source AND p.cdf > d.u)::INT AS n_copies
  FROM d)
SELECT doc_id, source, lang, copy_no::INT AS copy_no, n_copies, md5('mix-1/order:' || doc_id || ':' || copy_no) AS shuffle_key, text
FROM (SELECT *, unnest(range(n_copies)) AS copy_no FROM c WHERE n_copies > 0)
"""
