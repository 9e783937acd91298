"""Tables and documents that appear whole or not at all, receipts by content, and verified copies.

A published table is a folder of its own; a small pointer file, replaced in one rename, says which folder is current. Readers
therefore see the old table until the new one is complete. All paths go through the Hadoop file system of their scheme.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import ledger, versions

POINTER = "CURRENT.json"


def _store(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    store, where = _store(spark, path)
    return store.exists(where)


def write_json(spark: SparkSession, path: str, value) -> None:
    """Writes a document beside its place and moves it there, over an older one."""
    store, target = _store(spark, path)
    made = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = store.create(made, True)
    try:
        out.write(bytearray(json.dumps(value, sort_keys=True, ensure_ascii=False).encode()))
        out.hsync()
    finally:
        out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(made, target, options)


def read_json(spark: SparkSession, path: str):
    """The document at ``path``; None where there is none."""
    if not exists(spark, path):
        return None
    return json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))  # one small document


def publish(rows: DataFrame, root: str, order: list[str]) -> str:
    """Publishes ``rows`` (sorted by ``order`` across files) as the current table of ``root``; returns its folder. Older ones stay for their readers."""
    spark, name = rows.sparkSession, f"table-{uuid.uuid4().hex}"
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{root}/{name}")
    write_json(spark, f"{root}/{POINTER}", {"table": name})
    return f"{root}/{name}"


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """The current table of ``root``; None before the first is published."""
    pointer = read_json(spark, f"{root}/{POINTER}")
    return spark.read.parquet(f"{root}/{pointer['table']}") if pointer else None


def checkpoint(rows: DataFrame, root: str) -> DataFrame:
    """Publishes the latest version of every ledger entity and returns it; a derived cache that the ledger can always rebuild."""
    publish(versions.latest(rows, ledger.KINDS, ledger.ORDER), root, ledger.KINDS)
    return current(rows.sparkSession, root)


def receipts(rows: DataFrame, root: str, payload: str = "payload") -> DataFrame:
    """Writes payloads once each under the hash of their content and returns (receipt_id, payload) of the new ones."""
    spark = rows.sparkSession
    made = rows.select(F.sha2(payload, 256).alias("receipt_id"), F.col(payload).alias("payload")).distinct()
    if exists(spark, root):
        made = made.join(spark.read.parquet(root).select("receipt_id"), "receipt_id", "left_anti")
    folder = f"{root}/part={uuid.uuid4().hex}"
    made.write.parquet(folder)
    return spark.read.schema(made.schema).parquet(folder)


def receipt_faults(spark: SparkSession, root: str) -> DataFrame:
    """Receipts whose content does not have the hash they stand under; to be set apart, never served."""
    return spark.read.parquet(root).filter(F.sha2("payload", 256) != F.col("receipt_id"))


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(path below root, length, sha256) of every file; contents are hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath()
    below = F.expr(f"substring(path, instr(path, '{base}') + {len(base)})")
    return files.select(below.alias("path"), "length", F.sha2("content", 256).alias("sha256"))


def copy(spark: SparkSession, source: str, target: str) -> DataFrame:
    """A copy of a folder and its inventory, written beside it; fails where the copy differs or the target is there already."""
    if exists(spark, target):
        raise ValueError("BACKUP_TARGET_EXISTS")
    (from_store, from_path), (to_store, to_path) = _store(spark, source), _store(spark, target)
    if not spark._jvm.org.apache.hadoop.fs.FileUtil.copy(from_store, from_path, to_store, to_path, False, spark._jsc.hadoopConfiguration()):
        raise ValueError("BACKUP_COPY_FAILED")
    inventory(spark, source).write.parquet(f"{target}.inventory")
    if not differences(spark, target).isEmpty():
        raise ValueError("BACKUP_VERIFICATION_FAILED")
    return spark.read.parquet(f"{target}.inventory")


def differences(spark: SparkSession, target: str) -> DataFrame:
    """Files that a copy lacks, has changed or has besides those of its inventory."""
    listed, found = spark.read.parquet(f"{target}.inventory"), inventory(spark, target)
    return ledger.cache_differences(listed, found)


def restore(spark: SparkSession, backup: str, target: str, now: str) -> DataFrame:
    """A verified copy back, and the state row that keeps captures off until the next UTC day."""
    if not differences(spark, backup).isEmpty():
        raise ValueError("BACKUP_VERIFICATION_FAILED")
    copy(spark, backup, target)
    at: Column = F.lit(now).cast("timestamp")
    until = F.date_format(F.date_add(F.to_date(at), 1), "yyyy-MM-dd'T'00:00:00'Z'")
    return spark.range(1).select(F.lit("SOURCE_STATE").alias("observation_kind"), F.lit("restore_fence").alias("entity_id"), until.alias("not_before_utc"))


def capture_snapshot(spark: SparkSession, path: str, rows: DataFrame, batch: str, event: str, as_of_us: Column) -> DataFrame:
    """Validates all rows before anything is written, records them as one batch with their receipts, and returns the event's replay."""
    if not ledger.violations(rows).isEmpty():
        raise ValueError("LEDGER_ROWS_REJECTED")
    ledger.append(spark, f"{path}/ledger", rows, batch)
    receipts(rows, f"{path}/receipts")
    return ledger.replay(ledger.read(spark, f"{path}/ledger"), event, as_of_us)
