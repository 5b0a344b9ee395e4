"""Reading and writing series tables: a key, a total order, a value."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FORMATS = ("parquet", "orc", "json", "csv")


def _format(path: str, fmt: str | None) -> str:
    fmt = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}, not {fmt!r}")
    return fmt


def _pruned(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    wanted = dict.fromkeys([*key, *order, value])
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return df.select(*wanted)


def read_series(
    spark: SparkSession, path: str, key: str | list[str], order: str | list[str], value: str = "value", *, fmt: str | None = None, schema: StructType | str | None = None
) -> DataFrame:
    """The columns of a series table and no others: what the scan reads is what views need.

    Text formats need a schema, as inferring one reads the data twice.
    """
    key, order = ([x] if isinstance(x, str) else list(x) for x in (key, order))
    fmt = _format(path, fmt)
    reader = spark.read.format(fmt)
    if fmt in ("json", "csv"):
        if schema is None:
            raise ValueError(f"{fmt} needs a schema")
        reader = reader.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    return _pruned(reader.load(path), key, order, value)


def stream_series(
    spark: SparkSession, path: str, key: str | list[str], order: str | list[str], value: str = "value", *, fmt: str = "parquet", schema: StructType | str, files_per_trigger: int = 1
) -> DataFrame:
    """The same columns of files as they arrive in a folder."""
    key, order = ([x] if isinstance(x, str) else list(x) for x in (key, order))
    df = spark.readStream.format(_format(path, fmt)).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return _pruned(df, key, order, value)


def from_values(spark: SparkSession, values: list[float | None], key: str = "series") -> DataFrame:
    """One series in the order of a list: columns key, t (from 0) and value."""
    return spark.createDataFrame(list(enumerate(values)), "t long, value double").select(F.lit(0).cast("long").alias(key), "t", "value")


def write_features(df: DataFrame, path: str, *, fmt: str | None = None, mode: str = "error", partition_by: list[str] | None = None) -> None:
    """Write outputs; partition_by names columns of few values."""
    writer = df.write.format(_format(path, fmt)).mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if _format(path, fmt) == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share. Where the session names none, in a temporary one in local mode;
    on a cluster that would be another folder on each machine, so it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="rillwave-")
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/{label}-{uuid.uuid4().hex}"
