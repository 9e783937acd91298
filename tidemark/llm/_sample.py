"""Bounded samples of labelled rows, for fitting on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SPAN = 1 << 30


def bounded_ids(rows: DataFrame, key: str, id_col: str, bound: int, seed: int = 7) -> DataFrame:
    """(id, key) of about ``bound`` rows for each value of ``key`` (all of them where there are fewer).

    A row is in by a hash of its id alone, so samples agree between runs and partitionings; keys have one
    driver-side row each (languages, grades).
    """
    counts = {r[key]: r["n"] for r in rows.groupBy(key).agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(SPAN))
    share = F.lit(0)
    for value, n in counts.items():
        share = F.when(F.col(key) == F.lit(value), int(SPAN * min(1.0, bound / n))).otherwise(share)
    return rows.filter(draw < share).select(id_col, key)
