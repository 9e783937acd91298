"""Sharding by a k-d tree over document metadata.

Every level splits each open node at the weighted median of its widest dimension, found exactly by a distributed
running total over (node, coordinate); a node of n leaves gives its lower side n // 2 of them and that share of the
bytes. Only ids, sizes and coordinates take part, never texts.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ._cut import cut
from ._prefix import running_total


def ranked(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with a double ``out``: the place of the row's string among the distinct ones, by code point; null comes first.

    The distinct values are counted and joined, never gathered, so values may be as many as rows or one may hold most of them.
    """
    key = F.when(F.col(column).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(column)))
    keyed = df.withColumn("kd_key", key)
    places = running_total(keyed.select("kd_key").distinct(), [F.col("kd_key")], None, "kd_place")
    placed = keyed.join(cut(places, "kd-places"), "kd_key")
    return placed.withColumn(out, F.col("kd_place").cast("double")).drop("kd_key", "kd_place")


def shard(docs: DataFrame, size: str, dims: list[str], ids: list[str], shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """``docs`` with int ``shard`` and long ``slot`` (gapless from 0 in each shard, by ``ids``).

    ``size`` is a long column without nulls; ``dims`` are double columns without nulls; ``ids`` order rows that tie.
    Give ``shards``, or ``target_bytes``: the number of shards is then total bytes over it, rounded up. Rows with
    equal coordinates are cut by a hash of the first id and then by ids, so a value that holds any share of all rows
    still splits evenly; repeated rows are cut between them. An empty table gives no rows.
    """
    if shards is None:
        total = docs.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
        shards = max(1, math.ceil(total / target_bytes))
    leaves = cut(
        docs.select(*ids, size, *dims)
        .withColumn("kd_tie", F.xxhash64(*ids))
        .withColumn("kd_first", F.lit(0))
        .withColumn("kd_leaves", F.lit(shards)),
        "kd",
    )
    whole = leaves.agg(*[(F.max(d) - F.min(d)).alias(d) for d in dims]).first()
    tie = [F.col("kd_tie"), *[F.col(c) for c in ids]]
    for _ in range(max(0, math.ceil(math.log2(shards)))):
        width = [((F.max(d) - F.min(d)) / F.lit(whole[d] or 1.0)).alias(f"w_{d}") for d in dims]
        nodes = leaves.groupBy("kd_first").agg(F.sum(size).alias("kd_total"), *width)
        widest = F.greatest(*[F.col(f"w_{d}") for d in dims]) if len(dims) > 1 else F.col(f"w_{dims[0]}")
        pick = reduce(lambda rest, i: F.when(F.col(f"w_{dims[i]}") == widest, i).otherwise(rest), reversed(range(len(dims))), F.lit(0))
        nodes = nodes.select("kd_first", "kd_total", pick.alias("kd_dim"))
        placed = leaves.join(nodes, "kd_first")
        coordinate = reduce(lambda rest, i: F.when(F.col("kd_dim") == i, F.col(dims[i])).otherwise(rest), range(len(dims)), F.lit(0.0))
        placed = placed.withColumn("kd_at", coordinate)
        placed = running_total(placed, [F.col("kd_first"), F.col("kd_at"), *tie], size, "kd_before", "kd_first")
        half = F.floor(F.col("kd_leaves") / 2).cast("int")
        is_low = (2 * F.col("kd_before") + F.col(size)) * F.col("kd_leaves") <= 2 * F.col("kd_total") * half
        low = (F.col("kd_leaves") > 1) & is_low
        leaves = placed.select(
            *ids, size, *dims, "kd_tie",
            F.when((F.col("kd_leaves") > 1) & ~low, F.col("kd_first") + half).otherwise(F.col("kd_first")).alias("kd_first"),
            F.when(F.col("kd_leaves") == 1, 1).when(low, half).otherwise(F.col("kd_leaves") - half).cast("int").alias("kd_leaves"),
        )
    order = [F.col("kd_first"), *[F.col(c) for c in ids]]
    done = running_total(leaves, order, None, "slot", "kd_first")
    return done.select(*ids, size, F.col("kd_first").alias("shard"), "slot")


def by_metadata(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Documents as rows of doc_id, size, text_crc32, law, shard, slot, grown_shard (always null under law ``bytes``).

    Dimensions: source and language (by their ranks) and length in characters. Null text is empty (size 1); null ids keep their place as
    lowest; repeated rows each take a slot; very long texts count whole (a shard may exceed its share by one text); other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        "doc_id",
        F.crc32(text.cast("binary")).alias("text_crc32"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        "source",
        "lang",
        F.char_length(text).cast("double").alias("d_chars"),
    )
    base = ranked(ranked(cut(base, "kd-base"), "source", "d_source"), "lang", "d_lang")
    out = shard(base, "size", ["d_source", "d_lang", "d_chars"], ["doc_id", "text_crc32"], shards)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
