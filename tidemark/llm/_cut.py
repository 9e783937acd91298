"""Lineage cuts and shared working folders.

Intermediate tables that are read more than once, or that an iterative operator builds on, are written to the folder
the cluster names in ``spark.checkpoint.dir``: a lost executor then costs a re-read, never a recomputation of the chain.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: While a table is written: shuffle files go with their query, and what Python workers get at once is bounded by bytes. Spark's own bounds,
#: 10,000 rows and 64 MB, let a task with long texts hold the same batch several times (vectors, socket buffer, worker); a longer row is a batch of its own.
WRITING = {
    CLEANUP: "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}
_owners: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where a session on one machine names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isEmpty():
            if not (context.master() == "local" or context.master().startswith("local[")):
                raise ValueError("CHECKPOINT_FOLDER_REQUIRED: set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        named = context.getCheckpointDir().get()
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def write(df: DataFrame, path: str) -> None:
    """``df`` written as Parquet under the settings of WRITING, which hold no longer than that."""
    spark = df.sparkSession
    before = {key: spark.conf.get(key, None) for key in WRITING}
    for key, value in WRITING.items():
        spark.conf.set(key, value)
    try:
        df.select("*").write.parquet(path)  # a plan of its own, made under these settings
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read back (lineage ends here)."""
    path = fresh_path(df.sparkSession, name)
    write(df, path)
    note(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Deletes a table that ``cut`` wrote, once nothing that is still to run reads it."""
    _delete(df.sparkSession, df._written_at)


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of queries that nothing refers to any more (it does so when the driver collects garbage)."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


def pinned(df: DataFrame) -> DataFrame:
    """``df`` checkpointed with its partitions and their order kept."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def owned(paths: list[str]) -> Iterator[None]:
    """Meanwhile the folders that operators write are listed in ``paths``."""
    _owners.append(paths)
    try:
        yield
    finally:
        _owners.pop()


def note(path: str) -> None:
    """Lists a folder with the present owner, if there is one."""
    if _owners:
        _owners[-1].append(path)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Deletes the folders in ``paths``; for callers whose results are written."""
    while paths:
        _delete(spark, paths.pop())
