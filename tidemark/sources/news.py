"""News rows from collector files, and their projection to items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.arrow import html_to_text
from ..functions.scalars import collapsed, instant, text, url_key, valid_url
from ..operators import selection

#: Every column a row may carry; absent ones read as null.
COLUMNS = [
    "observed_time", "event_time", "headline_or_text", "source_name", "source_url", "title", "headline", "headline_or_discovery_text", "summary", "url",
    "source_publisher", "source_provider", "article_reference", "source_item_reference", "item_reference", "discovery_record_id", "canonical_event_id",
    "identity_evidence_ref", "identity_status", "project_first_seen_at", "observed_at", "source_published_at", "source_published_at_utc", "published_at",
    "event_time_is_proxy", "provisional_event_family", "event_family",
]
#: File name prefix and collector.
COLLECTORS = [("rss_headlines_", "rss"), ("gdelt_headlines_", "gdelt"), ("federal_register_headlines_", "federal_register")]


def collector_kind(name: Column) -> Column:
    return F.coalesce(*[F.when(F.lower(name).startswith(prefix), kind) for prefix, kind in COLLECTORS])


def _shaped(rows: DataFrame) -> DataFrame:
    """All of COLUMNS as strings, with the file's name and the row's place in reading order."""
    have = {c.lstrip("﻿"): c for c in rows.columns}
    named = [F.col(f"`{have[c]}`").cast("string").alias(c) if c in have else F.lit(None).cast("string").alias(c) for c in COLUMNS]
    return rows.select(*named, F.col("_metadata.file_name").alias("file_name"), F.monotonically_increasing_id().alias("_row"))


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """CSV, JSON (a list, an object with items or records, or one object) or JSON lines, as COLUMNS with collector and (file_name, _row) order."""
    if path.lower().endswith((".jsonl", ".ndjson")):
        rows = spark.read.option("mode", "FAILFAST").json(path)
    elif path.lower().endswith(".json"):
        rows = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
        wrapped = next((c for c in ("items", "records") if c in rows.columns and isinstance(rows.schema[c].dataType, T.ArrayType)), None)
        if wrapped:
            rows = rows.select("_metadata", F.explode(wrapped).alias("r")).select("_metadata", "r.*")
            rows = rows.withColumn("_place", F.monotonically_increasing_id())
            shaped = [F.col(c).cast("string").alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS]
            return rows.select(*shaped, F.col("_metadata.file_name").alias("file_name"), F.col("_place").alias("_row")).withColumn("collector", collector_kind(F.col("file_name")))
    else:
        options = {"header": True, "multiLine": True, "escape": '"', "pathGlobFilter": "*.csv", "encoding": "UTF-8"}
        rows = spark.read.options(**options).csv(path)
    return _shaped(rows).withColumn("collector", collector_kind(F.col("file_name")))


def inbox(spark: SparkSession, folder: str) -> DataFrame:
    """The collector CSV files of a folder, in order of their lower-cased names."""
    return read_rows(spark, folder).filter("collector is not null")


def article_key(rows: DataFrame) -> Column:
    """Hash of the explicit reference, else of source, event time and headline (and url for gdelt), else of source and url; null without them."""
    c = lambda *names: text(*[F.col(n) for n in names])
    reference, source = c("source_item_reference", "item_reference", "discovery_record_id"), F.lower(c("source_name", "source_publisher"))
    headline = F.lower(F.regexp_replace(c("headline_or_text", "title", "headline"), r"(?U)\s+", " "))
    event_time, url = c("event_time"), F.lower(c("source_url", "url"))
    dated = F.concat_ws("|", source, event_time, headline)
    dated = F.when(F.col("collector") == "gdelt", F.concat(dated, F.lit("|"), F.coalesce(url, F.lit("")))).otherwise(dated)
    material = F.when(reference.isNotNull(), F.concat(F.lit("article-reference|"), reference)).when(source.isNull() | headline.isNull(), None)
    return F.sha2(material.when(event_time.isNotNull(), dated).when(url.isNotNull(), F.concat(F.lit("article-url|"), source, F.lit("|"), url)), 256)


def keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with url_key, article_key and ``place`` (reading order) for the two-key deduplication."""
    url = text(F.col("source_url"), F.col("url"))
    order = F.struct(F.lower("file_name"), F.col("_row"))
    return rows.select("*", F.when(valid_url(url), url_key(url)).alias("url_key"), article_key(rows).alias("article_key"), order.alias("place"))


def _shown(raw: Column) -> Column:
    """Plain presentation text; only texts that may hold markup or control characters leave the JVM."""
    special = F.rlike(raw, F.lit(r"[<&\x1c-\x1f]"))
    return F.when(special, html_to_text(F.when(special, raw))).otherwise(F.nullif(collapsed(raw), F.lit("")))


def items(rows: DataFrame) -> DataFrame:
    """Items for display, the clocks apart: identity, references, shown and raw title and summary, family, clocks, source; what no row can prove is UNKNOWN.

    The first alias that is not blank counts, even where it cannot be read as a time. A publication time is the reported time; else the event time, unless that is the observed time; it is a proxy by the explicit
    mark, for the federal register, and for gdelt (as collector or source) without a publication. An identity counts with its evidence and the status CANONICAL only.
    """
    c = lambda *names: text(*[F.col(n) for n in names])
    raw = lambda *names: F.coalesce(*[F.when(text(F.col(n)).isNotNull(), F.col(n)) for n in names])
    said = lambda condition: F.coalesce(condition, F.lit(False))
    observed, event = instant(c("observed_time", "project_first_seen_at", "observed_at")), instant(c("event_time"))
    published = instant(c("source_published_at", "source_published_at_utc", "published_at"))
    reported = F.coalesce(published, F.when(~event.eqNullSafe(observed), event))
    gdelt = said(F.col("collector") == "gdelt") | said(F.lower(c("source_name")) == "gdelt")
    proxy = said(F.lower(c("event_time_is_proxy")) == "true") | said(F.col("collector") == "federal_register") | (gdelt & published.isNull())
    verified = said(c("canonical_event_id").isNotNull() & c("identity_evidence_ref").isNotNull() & (F.col("identity_status") == "CANONICAL"))
    url, family = c("source_url", "url"), c("provisional_event_family", "event_family")
    named = rows.select(
        F.when(verified, c("canonical_event_id")).alias("event_id"),
        F.when(verified, "VERIFIED_BY_SOURCE").otherwise("UNKNOWN").alias("identity_status"),
        F.when(verified, c("identity_evidence_ref")).alias("identity_evidence_ref"),
        c("discovery_record_id").alias("discovery_record_id"),
        F.coalesce(c("article_reference", "source_item_reference", "item_reference", "discovery_record_id"), F.when(valid_url(url), url)).alias("article_reference"),
        raw("title", "headline_or_discovery_text", "headline_or_text", "headline").alias("raw_title"),
        raw("summary", "headline_or_discovery_text", "headline_or_text").alias("raw_news_summary"),
        family.alias("event_family"),
        F.when(family.isNotNull(), "PROVISIONAL").otherwise("UNKNOWN").alias("event_family_status"),
        observed.alias("observed_at"),
        reported.alias("reported_at"),
        F.when(reported.isNull(), "UNKNOWN").when(proxy, "SOURCE_DATE_PROXY").otherwise("REPORTED_TIME").alias("reported_time_kind"),
        observed.alias("discovered_at"),
        F.lit("UNVERIFIED_NEWS").alias("verification_status"),
        c("source_publisher", "source_name", "source_provider").alias("source_name"),
        F.when(valid_url(url), url).alias("source_url"),
        instant(c("source_published_at", "source_published_at_utc")).alias("source_published_at"),
        F.lit(None).cast("string").alias("geography"),
        F.lit("UNKNOWN").alias("geography_status"),
        "collector",
    )
    return named.withColumns({"title": _shown(F.col("raw_title")), "news_summary": _shown(F.col("raw_news_summary"))})


def with_states(found: DataFrame, official: DataFrame, expectations: DataFrame, macros: DataFrame, otherwise: str) -> DataFrame:
    """``found`` with expectation_status and macroview_status, joined by discovery record; later rows of ``expectations`` and ``macros`` (in order of ``arrival``) stand for earlier ones of a reference.

    official: discovery_record_id, artifact_fingerprint of confirmed packets. expectations: discovery_record_id, event_reference, expectation_state, linkage_state. macros: the same references, sealed,
    event_reality_reference; only sealed ones count. A macro view is AVAILABLE where the single packet of its item carries the fingerprint that it was made of, else ``otherwise``.
    """
    c = lambda *names: text(*[F.col(n) for n in names])
    key = "discovery_record_id"
    state = expectations.select(c(key, "event_reference").alias(key), c("expectation_state", "linkage_state").alias("expectation_status"), "arrival").filter(F.col(key).isNotNull())
    macro = macros.filter("sealed").select(c("event_reference", key).alias(key), F.col("event_reality_reference").alias("_made_of"), "arrival").filter(F.col(key).isNotNull())
    packet = selection.unambiguous(official.filter(F.col(key).isNotNull()).select(key, F.nullif("artifact_fingerprint", F.lit("")).alias("_print")), key)
    out = found
    for side in (selection.last_wins(state, key, ["arrival"]).drop("arrival"), selection.last_wins(macro, key, ["arrival"]).drop("arrival"), packet):
        out = out.join(side, key, "left")
    available = F.coalesce(F.col("_made_of") == F.col("_print"), F.lit(False))
    return out.withColumn("macroview_status", F.when(available, "AVAILABLE").otherwise(otherwise)).drop("_made_of", "_print")
