"""Integer vectors in packed pieces, exact inner products, bounded best lists, and query sets that meet an index in blocks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ._cut import fresh_path, note

NONE = -(1 << 63) + 1  # below every score
LAST = (1 << 63) - 1  # where rows without an id stand among equal scores


def whole(rows: DataFrame, id_col: str, vector_col: str, scale: int, **more: Column) -> DataFrame:
    """(id, vector array<long>, dim, more ...) of the rows whose vector has finite components only; each component x is floor(scale * x)."""
    vector = F.col(vector_col).cast("array<double>")
    unfit = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.filter(vector.isNotNull() & ~unfit)
    return kept.select(
        F.col(id_col).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x * F.lit(float(scale)))).alias("vector"),
        F.size(vector).cast("long").alias("dim"), *[c.alias(n) for n, c in more.items()],
    )


def matrix(vectors: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """The rows of an array column, all of ``dim`` components."""
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(vectors), dim)


def packed(x: np.ndarray) -> bytes:
    """Whole numbers in the narrowest of four widths, after a byte that names it."""
    for width in (1, 2, 4):
        top = 1 << (8 * width - 1)
        if not x.size or (-top <= x.min() and x.max() < top):
            return bytes([width]) + x.astype(f"<i{width}").tobytes()
    return b"\x08" + x.astype("<i8").tobytes()


def unpacked(data: bytes, dim: int | None = None) -> np.ndarray:
    x = np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64)
    return x if dim is None else x.reshape(-1, dim) if dim else x.reshape(0, 0)


def peak(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def exact_type(dim: int, a: int, b: int) -> np.dtype:
    """The fastest type in which ``dim`` products of numbers up to ``a`` and ``b`` add up exactly."""
    most = max(dim, 1) * a * b
    if most >= LAST:
        raise ArithmeticError("inner products of these vectors do not fit in a long")
    return np.dtype(np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], most: Callable[[dict], int]) -> Iterator[pa.Table]:
    """Consecutive rows that agree in ``keys`` (whole numbers), in tables of at most ``most(first row's keys)`` rows."""
    held: pa.Table | None = None
    for batch in batches:
        new = pa.Table.from_batches([batch])
        table = new if held is None else pa.concat_tables([held, new])
        columns = [table[k].to_numpy() for k in keys]
        change = np.zeros(max(len(table) - 1, 0), bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        ends, start = [*(np.flatnonzero(change) + 1).tolist(), len(table)] if len(table) else [], 0
        for i, end in enumerate(ends):
            size = most({k: int(c[start]) for k, c in zip(keys, columns)})
            while end - start > size or (i + 1 < len(ends) and start < end):
                stop = min(end, start + size)
                yield table.slice(start, stop - start)
                start = stop
        held = table.slice(start).combine_chunks() if start < len(table) else None
    if held is not None:
        yield held


class Best:
    """The best ``k`` (score, id) of each of ``n`` lists: higher scores first, ties by smaller id, rows without an id last."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.scores = np.full((n, k), NONE)
        self.ids = np.full((n, k), LAST)
        self.missing = np.zeros((n, k), bool)
        self.floor = np.full(n, NONE) if floor is None else floor  # a score that k rows are known to reach

    def least(self) -> np.ndarray:
        """The score that a further row must reach."""
        return np.maximum(self.floor, self.scores[:, -1])

    def add(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        if not len(lists):
            return
        met = np.unique(lists)
        which = np.concatenate((np.repeat(met, self.k), lists))
        s = np.concatenate((self.scores[met].ravel(), scores))
        i = np.concatenate((self.ids[met].ravel(), ids))
        m = np.concatenate((self.missing[met].ravel(), missing))
        order = np.lexsort((m, i, -s, which))
        which = which[order]
        begins = np.searchsorted(which, met)
        place = (begins[:, None] + np.arange(self.k)).ravel()  # every list has k entries at least
        took = order[place]
        self.scores[met], self.ids[met], self.missing[met] = (a[took].reshape(len(met), self.k) for a in (s, i, m))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(list, score, id, missing) of all entries that reach their list's floor."""
        at = np.nonzero((self.scores > NONE) & (self.scores >= self.floor[:, None]))
        return at[0], self.scores[at], self.ids[at], self.missing[at]


def id_array(ids: np.ndarray, missing: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=missing)


def meet(index: DataFrame, queries: DataFrame, n_blocks: int, search: Callable[[pa.Table], Callable], schema: str, name: str) -> DataFrame:
    """The rows that ``search`` finds for each block of ``queries`` in all of ``index``, as a written table.

    ``queries`` is partitioned by a column ``block`` whose values hold a bounded number of bytes each; a block is sent to
    all tasks, and the index is scanned where it lies, once a block, without a shuffle.
    """
    spark = index.sparkSession
    path = fresh_path(spark, name)
    note(path)
    for block in range(n_blocks):
        table = queries.filter(F.col("block") == block).drop("block").toArrow()
        sent = spark.sparkContext.broadcast(table)
        index.mapInArrow(_with(sent, search), schema).write.mode("append").parquet(path)
        sent.destroy()
    return spark.read.schema(schema).parquet(path) if n_blocks else spark.createDataFrame([], schema)


def _with(sent, search: Callable[[pa.Table], Callable]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from search(sent.value)(batches)

    return run


def in_blocks(queries: DataFrame, size: int, block_bytes: int, name: str) -> tuple[DataFrame, int]:
    """``queries`` (with a column uid) written in blocks of about ``block_bytes`` of their ``size`` bytes, and the number of blocks."""
    spark = queries.sparkSession
    n = math.ceil(size / block_bytes)
    path = fresh_path(spark, name)
    note(path)
    placed = queries.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(max(n, 1))).cast("int"))
    placed.write.partitionBy("block").parquet(path)
    return spark.read.schema(placed.schema).parquet(path), n


def parts(spark: SparkSession, n_rows: int, piece: int) -> int:
    """Partitions for ``n_rows``: one piece each while they are few, then eight."""
    few = math.ceil(n_rows / piece)
    return max(1, few if few <= 8 * spark.sparkContext.defaultParallelism else math.ceil(n_rows / (8 * piece)))
