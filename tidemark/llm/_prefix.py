"""Running totals over a global order without a single-task window.

Rows are range-partitioned and sorted, checkpointed so that partitions cannot move, summed per partition, and each
partition then continues from the total of those before it. The driver sees one row per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T


def running_total(df: DataFrame, order: list[Column], value: str | None, out: str, group: str | None = None) -> DataFrame:
    """``df`` with a long column ``out``: the sum of ``value`` over all earlier rows (of the row's group).

    ``order`` must begin with ``group`` (ascending, no nulls) when a group is given and should be total; ``value`` is a
    long column without nulls, or None to count rows. Rows come back partitioned and sorted by ``order``.
    """
    from ._cut import pinned

    key = F.col(group) if group else F.lit(0)
    ranged = pinned(df.repartitionByRange(*order).sortWithinPartitions(*order))
    sums = (
        ranged.groupBy(F.spark_partition_id().alias("part"), key.alias("grp"))
        .agg(F.sum(value).alias("total") if value else F.count("*").alias("total"))
        .groupBy("part")
        .agg(F.max("grp").alias("last"), F.max_by("total", "grp").alias("total"))
        .collect()
    )
    carry: dict[int, tuple[object, int]] = {}
    held: tuple[object, int] = (None, 0)
    for row in sorted(sums, key=lambda r: r["part"]):
        carry[row["part"]] = held
        held = (row["last"], held[1] + row["total"] if row["last"] == held[0] else row["total"])

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        last, total = carry.get(TaskContext.get().partitionId(), (None, 0))
        for pdf in frames:
            if not len(pdf):
                continue
            size = pdf[value].to_numpy(np.int64) if value else np.ones(len(pdf), np.int64)
            before = np.cumsum(size) - size
            groups = pdf[group].to_numpy() if group else np.zeros(len(pdf), np.int64)
            starts = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
            base = np.repeat(before[starts], np.diff(np.append(starts, len(pdf))))
            before = before - base
            if groups[0] == last:
                before[: starts[1] if len(starts) > 1 else len(pdf)] += total
            last, total = groups[-1], int(before[-1] + size[-1])
            yield pdf.assign(**{out: before})

    return ranged.mapInPandas(local, T.StructType(ranged.schema.fields + [T.StructField(out, T.LongType())]))
