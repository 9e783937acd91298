"""Exact deduplication by skew-safe combining (DataFrame operations only).

Digests alone are counted first, so that the few hot ones are known. Then three stages group by the whole
normalised text and not only by its digest:

1. local: the map side of the first aggregation folds the copies inside one input partition into one row;
2. salted: rows meet by (digest, salt); a hot digest takes its input partition modulo ``salts`` as salt, any other 0;
3. global: the salt winners of hot digests meet by digest and text, at most ``salts`` rows each; the smallest id stays.

The documents then take their verdict from the digest table. Should two texts ever share a digest, their
documents are grouped by the text as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ._cut import cut

SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text with every run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, hot_rows: int = 1000, digest=None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null text is the empty text; an empty table gives no rows; other columns are ignored. Null ids sort last: they
    stay only where a group has no other id. Rows that repeat the kept id are all marked kept (they are the same row);
    ``group_size`` counts every row. ``digest`` maps the normalised text to a string (default SHA-256).
    """
    digest = digest or (lambda text: F.sha2(text, 256))
    base = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("body"))
    base = base.withColumn("digest", digest(F.col("body")))
    ids = cut(base.select("id", "digest"), "dedup-ids")
    floor = max(hot_rows, ids.count() // 1000)
    hot = ids.groupBy("digest").count().filter(F.col("count") > floor).select("digest", F.lit(True).alias("hot"))
    salted = (
        base.join(F.broadcast(hot), "digest", "left")  # fewer than 1000 digests hold over a thousandth of all rows each
        .withColumn("salt", F.when(F.col("hot"), F.spark_partition_id() % salts).otherwise(0))
        .groupBy("digest", "salt", "hot", "body")
        .agg(F.min("id").alias("keep_id"), F.count("*").alias("n"))
    )
    winners = salted.select("digest", F.when(F.col("hot"), F.col("body")).alias("body"), "hot", "keep_id", "n").repartition("digest")
    texts = winners.groupBy("digest", "body").agg(
        F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"), F.when(F.first("hot"), 1).otherwise(F.count("*")).alias("texts")
    )
    classes = cut(
        texts.groupBy("digest").agg(F.sum("texts").alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size")),
        "dedup-classes",
    )
    clash = classes.filter("texts > 1").select("digest")
    joined = ids.join(classes.filter("texts = 1").select("digest", "keep_id", "group_size"), "digest")
    joined = joined.select("id", "digest", "keep_id", "group_size")
    if not clash.isEmpty():
        again = base.join(clash, "digest", "left_semi")
        own = again.groupBy("digest", "body").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
        joined = joined.unionByName(again.join(own, ["digest", "body"]).select("id", "digest", "keep_id", "group_size"))
    return joined.select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
