"""Bounded samples of labelled rows, by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwave.llm.common import join_checked, stage

_GRAIN = 1_000_000


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 3."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def held_out(doc_id: Column) -> Column:
    """True for fold 1; rows without an id are not held out."""
    return F.coalesce(fold(doc_id) == 1, F.lit(False))


def learnable(doc_id: Column) -> Column:
    """True for folds 0 and 2; rows without an id are never learnt from."""
    return F.coalesce(fold(doc_id) != 1, F.lit(False))


def class_sample(rows: DataFrame, id_column: str, label: str, per_class: int) -> DataFrame:
    """About per_class ids of each value of label, one row each.

    An id is taken if its hash lies below the class's share: no sorting of the table, alike for any partitioning.
    Of rows that repeat an id under a label the one that is least in the other columns stays, so that the result is
    bounded by about per_class rows for each label whatever repeats.
    """
    counts = stage(rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")), "sample-counts").withColumnRenamed(label, "__label")
    share = F.least(F.lit(_GRAIN), (F.lit(_GRAIN * per_class) / F.col("n")).cast("long") + 1)
    wide = join_checked(rows, counts, F.col(label) == F.col("__label"), "inner")
    taken = wide.where(F.pmod(F.xxhash64(F.lit("sample"), id_column), F.lit(_GRAIN)) < share)
    rest = [c for c in rows.columns if c not in (id_column, label)]
    if not rest:
        return taken.select(id_column, label).distinct()
    least = F.min(F.struct(*rest)).alias("least")
    return taken.groupBy(id_column, label).agg(least).select(id_column, label, *[F.col(f"least.{c}").alias(c) for c in rest])
