"""Recency, health and cache projections against an injected clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

DAY, TWO_DAYS = 86_400, 172_800


def age_seconds(now: Column, at: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", at, now) / 1_000_000


def bucket(now: Column, at: Column, proxy: Column | None = None) -> Column:
    """LAST_24H, LAST_48H (both limits included), OLDER, UNKNOWN (null or proxy), INVALID_FUTURE."""
    age = age_seconds(now, at)
    unknown = at.isNull() if proxy is None else at.isNull() | proxy
    return (
        F.when(unknown, "UNKNOWN").when(age < 0, "INVALID_FUTURE").when(age <= DAY, "LAST_24H").when(age <= TWO_DAYS, "LAST_48H").otherwise("OLDER")
    )


def counts(rows: DataFrame, bucket_col: str) -> DataFrame:
    """One row of counts; the unknown count includes future times."""
    return rows.agg(
        F.count_if(F.col(bucket_col) == "LAST_24H").alias("last_24h"),
        F.count_if(F.col(bucket_col).isin("LAST_24H", "LAST_48H")).alias("last_48h"),
        F.count_if(F.col(bucket_col) == "OLDER").alias("older"),
        F.count_if(F.col(bucket_col).isin("UNKNOWN", "INVALID_FUTURE")).alias("unknown"),
    )


def parents_with_recent(members: DataFrame, parent: str, bucket_col: str) -> DataFrame:
    """Parents counted by whether any member is recent."""
    flags = members.groupBy(parent).agg(
        F.bool_or(F.col(bucket_col) == "LAST_24H").alias("d1"), F.bool_or(F.col(bucket_col).isin("LAST_24H", "LAST_48H")).alias("d2")
    )
    return flags.agg(F.count_if("d1").alias("parents_24h"), F.count_if("d2").alias("parents_48h"), F.count("*").alias("parents"))


def health(sources: DataFrame, source: str, last_success: str, now: Column, stale_after: int) -> DataFrame:
    """Status of each source: STALE beyond the limit, UNKNOWN for missing or future times, else FRESH."""
    last = sources.groupBy(source).agg(F.max(last_success).alias("last_success"))
    age = age_seconds(now, F.col("last_success"))
    status = F.when(F.col("last_success").isNull() | (age < 0), "UNKNOWN").when(age > stale_after, "STALE").otherwise("FRESH")
    return last.withColumn("status", status)


def overall(health_rows: DataFrame, required: list[str], source: str) -> DataFrame:
    """One row: HEALTHY when every required source is listed and fresh, PARTIAL when one is missing, else DEGRADED."""
    names = F.array(*[F.lit(r.lower()) for r in required])
    facts = health_rows.agg(F.collect_set(F.lower(source)).alias("have"), F.count_if(F.col("status") != "FRESH").alias("not_fresh"))
    missing = F.size(F.array_except(names, "have"))
    return facts.select(F.when(missing > 0, "PARTIAL").when(F.col("not_fresh") > 0, "DEGRADED").otherwise("HEALTHY").alias("overall"), missing.cast("long").alias("missing"))


def cache_status(now: Column, fetched: Column, ttl: int) -> Column:
    """STALE_CACHE from exactly ``ttl`` seconds on."""
    return F.when(fetched.isNull(), "NO_CACHE").when(age_seconds(now, fetched) >= ttl, "STALE_CACHE").otherwise("FRESH_CACHE")
