"""What the operators share: reading tables, staging intermediate tables, joining a checked small side."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The white space of every contract: space and \t \n \v \f \r.
WS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: A side of a join is broadcast only if it was counted and has at most so many rows.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, a temporary one in local mode (tests);
    on a cluster that would be another folder on each machine, so it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="rillwave-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_local = threading.local()


def _scopes() -> list[list[DataFrame]]:
    """The open staging() blocks of this thread."""
    if not hasattr(_local, "scopes"):
        _local.scopes = []
    return _local.scopes


@contextmanager
def staging() -> Iterator[None]:
    """Removes the tables staged within, at the end: for whoever writes a result inside."""
    scopes = _scopes()
    scopes.append([])
    try:
        yield
    finally:
        unstage(*scopes.pop())


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and return the written table.

    Cuts the lineage: a lost executor costs only the files' re-read. How many tasks write is left to Spark: adaptive
    execution merges small partitions of a shuffle, and no bound stands in the way of large ones. Whoever writes the
    final result can do so within staging(), which removes the tables then; others go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_at = path
    _files(table, lambda fs, p: fs.deleteOnExit(p))
    scopes = _scopes()
    if scopes:
        scopes[-1].append(table)
    return table


def unstage(*tables: DataFrame) -> None:
    """Remove staged tables that nothing will read any more."""
    for t in tables:
        _files(t, lambda fs, p: (fs.delete(p, True), fs.cancelDeleteOnExit(p)))


def _files(staged: DataFrame, act) -> None:
    """act(file system, path) on the JVM's view of a staged table."""
    spark = staged.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(staged.staged_at)
    act(path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path)


def join_checked(df: DataFrame, small: DataFrame, on: Column, how: str, limit: int | None = None) -> DataFrame:
    """Join with a staged side: broadcast if its counted rows are within limit, else a shuffled join that
    adaptive execution splits on skewed keys."""
    if small.count() <= (BROADCAST_ROWS if limit is None else limit):
        small = F.broadcast(small)
    else:
        small = small.hint("merge")
    return df.join(small, on, how)


def schema_of(df: DataFrame, columns: list[str], ddl: str) -> StructType:
    """The fields of df's columns, then those of ddl."""
    return StructType(df.select(*columns).schema.fields + StructType.fromDDL(ddl).fields)
