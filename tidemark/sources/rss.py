"""RSS items as news rows, with the reason of every rejection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.scalars import allowed_url, collapsed, rfc_instant, url_key, valid_url

ITEM = "title STRING, description STRING, link STRING, pubDate STRING, guid STRING, author STRING, `dc:creator` STRING"


def reject_reasons(rows: DataFrame, title: str, url: str, order: str, relevant: Column, attribution: Column | None = None, hosts: list[str] | None = None) -> DataFrame:
    """``rows`` with ``reason``: the first that applies of MISSING_TITLE, UNSAFE_SOURCE_URL, MISSING_ATTRIBUTION, NOT_MACRO_RELEVANT, DUPLICATE_URL; else ACCEPTED."""
    link = F.col(url)
    safe = allowed_url(link, hosts) if hosts else F.coalesce(link.rlike(r"^(?i)https://"), F.lit(False))
    why = F.when(F.coalesce(F.trim(title), F.lit("")) == "", "MISSING_TITLE").when(~safe, "UNSAFE_SOURCE_URL")
    if attribution is not None:
        why = why.when(F.coalesce(F.trim(attribution), F.lit("")) == "", "MISSING_ATTRIBUTION")
    why = why.when(~F.coalesce(relevant, F.lit(False)), "NOT_MACRO_RELEVANT")
    judged = rows.withColumn("_why", why).withColumn("_key", url_key(link))
    first = judged.filter("_why is null").groupBy("_key").agg(F.min(order).alias("_first"))
    out = judged.join(first, "_key", "left")
    again = F.col("_why").isNull() & F.col("_key").isNotNull() & (F.col(order) != F.col("_first"))
    return out.withColumn("reason", F.coalesce("_why", F.when(again, "DUPLICATE_URL"), F.lit("ACCEPTED"))).drop("_why", "_key", "_first")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """The <item> elements of RSS files, in file order as ``place``."""
    rows = spark.read.format("xml").option("rowTag", "item").schema(ITEM).load(path)
    return rows.withColumn("place", F.monotonically_increasing_id())


def headlines(items: DataFrame, hosts: list[str], source_name: str, observed_at: Column) -> DataFrame:
    """News rows of one provider: titled https items of its hosts, each url once (first wins).

    The headline is ``title - description`` unless they are equal in any case or there is no description; undated items keep
    an empty event time.
    """
    title, about = collapsed(F.col("title")), collapsed(F.col("description"))
    line = F.when((F.coalesce(about, F.lit("")) == "") | (F.lower(title) == F.lower(about)), title).otherwise(F.concat(title, F.lit(" - "), about))
    usable = items.withColumn("link", F.trim("link")).filter((F.coalesce(title, F.lit("")) != "") & allowed_url(F.col("link"), hosts) & valid_url(F.col("link")))
    usable = usable.withColumn("key", url_key(F.col("link")))
    first = usable.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("place"))).filter("_n = 1")
    event_time = F.coalesce(F.date_format(rfc_instant(F.col("pubDate")), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))
    return first.select(
        observed_at.alias("observed_time"), event_time.alias("event_time"), line.alias("headline_or_text"), F.lit(source_name).alias("source_name"), F.col("link").alias("source_url")
    )
