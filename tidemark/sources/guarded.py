"""Files that count whole or not at all: every file has one row with its size and first fault, and only files without one give rows.

A file is parsed inside its own row, which the limits of size keep small, so neither a fault nor a large file reaches other files or the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.arrow import unescaped
from ..functions.scalars import allowed_url, collapsed, macro_relevant, rfc_instant, url_key
from . import news
from .rss import ITEM

# Limits of feeds, of one file, and of a folder of news files.
FEED_BYTES, FEED_ITEMS = 2 * 1024 * 1024, 5000
FILE_BYTES = 8 * 1024 * 1024
INBOX_FILES, INBOX_BYTES = 64, 32 * 1024 * 1024


@dataclass(frozen=True)
class Profile:
    """What a provider's items must be: their hosts, whether an author is needed and named, a rule for titles, whether the summary joins the title, whether the guid may be the url."""

    name: str
    hosts: tuple[str, ...]
    attribution: bool = False
    authors: bool = False
    relevant: Callable[[Column], Column] | None = None
    summary: bool = False
    guid: bool = False


#: Published feeds and their hosts.
PROFILES = {
    p.name: p
    for p in [
        Profile("EIA Today in Energy", ("www.eia.gov", "eia.gov"), summary=True),
        Profile("ECB Press", ("www.ecb.europa.eu",), summary=True),
        Profile("Global Voices", ("globalvoices.org",), attribution=True, authors=True, relevant=macro_relevant),
        Profile("UN News", ("news.un.org",), authors=True, relevant=macro_relevant, guid=True),
        Profile("Guardian World", ("www.theguardian.com",), authors=True, relevant=macro_relevant),
    ]
}


def files(spark: SparkSession, path: str, most_bytes: int, glob: str = "*") -> DataFrame:
    """(path, length, content) of the files below ``path``; the content of larger ones is null and never read. Spark's scan passes over files of no bytes, so these have no row."""
    scan = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    fine = scan.filter(F.col("length") <= most_bytes).select("path", "length", "content")
    return fine.unionByName(scan.filter(F.col("length") > most_bytes).select("path", "length", F.lit(None).cast("binary").alias("content")))


# Feeds

_RSS = "channel ARRAY<STRUCT<item: ARRAY<STRUCT<" + ITEM.replace(" STRING", ": STRING") + ">>>>, _malformed STRING"
_ASIDE = r"(\s|<!--.*?-->|<\?.*?\?>)*"


def feeds(found: DataFrame, most_bytes: int = FEED_BYTES, most_items: int = FEED_ITEMS) -> DataFrame:
    """``found`` (path, length, content) with ``items`` and ``fault``: the first of EMPTY_OR_OVERSIZED_RESPONSE, UNSAFE_XML_DECLARATION, MALFORMED_RSS, UNEXPECTED_RSS_ROOT, RSS_ITEM_LIMIT, or null.

    Feeds are UTF-8; other bytes are malformed. Items are null where there is a fault.
    """
    size_ok = F.col("content").isNotNull() & (F.col("length") > 0) & (F.col("length") <= most_bytes)
    body = found.withColumn("_text", F.when(size_ok, F.col("content").cast("string")))
    safe = F.upper("_text")
    unsafe = safe.contains("<!DOCTYPE") | safe.contains("<!ENTITY")
    broken = ~F.is_valid_utf8("_text")
    parsed = F.from_xml(F.when(~unsafe & ~broken, F.ltrim(F.regexp_replace("_text", "^﻿", ""))), _RSS, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"})
    read = body.withColumn("_rss", parsed).withColumn("_items", F.flatten(F.transform("_rss.channel", lambda c: F.coalesce(c["item"], F.array().cast(f"array<struct<{ITEM.replace(' STRING', ': STRING')}>>")))))
    root = F.col("_text").rlike(rf"(?s)^﻿?{_ASIDE}<rss[\s/>]")
    whole = ~root | F.col("_text").rlike(rf"(?s)(</rss\s*>|/>){_ASIDE}$")
    fault = (
        F.when(~size_ok, "EMPTY_OR_OVERSIZED_RESPONSE").when(unsafe, "UNSAFE_XML_DECLARATION")
        .when(broken | F.col("_rss._malformed").isNotNull() | ~whole, "MALFORMED_RSS").when(~root | F.col("_rss.channel").isNull(), "UNEXPECTED_RSS_ROOT")
        .when(F.size("_items") > most_items, "RSS_ITEM_LIMIT")
    )
    return read.select(*[c for c in found.columns if c != "content"], fault.alias("fault"), F.when(fault.isNull(), F.col("_items")).alias("items"))


def judged(read: DataFrame, profile: Profile) -> DataFrame:
    """One row an item of ``feeds`` (one without item for a feed that has none), with ``reason`` (ACCEPTED or why not), ``key`` of its url, and the feed's fault.

    Reasons in order: MISSING_TITLE, UNSAFE_SOURCE_URL, MISSING_ATTRIBUTION, NOT_MACRO_RELEVANT, DUPLICATE_URL (a feed's first accepted item of a url stays). A feed none of
    whose items comes as far as the rule for titles has the fault NO_USABLE_ARTICLES. A feed's items are bounded, so they meet in one window.
    """
    rows = read.select("path", "fault", F.posexplode_outer("items").alias("place", "i"))
    field = lambda c: F.coalesce(collapsed(F.col("i")[c]), F.lit(""))
    title, link, guid, about = field("title"), field("link"), field("guid"), field("description")
    rows = rows.select("path", "fault", "place", title.alias("title"), about.alias("about"), link.alias("link"), guid.alias("guid"), F.col("i.pubDate").alias("published"),
                       F.coalesce(F.nullif(field("dc:creator"), F.lit("")), field("author")).alias("_author"))
    if profile.authors:
        rows = rows.withColumn("_author", _plain("_author"))
    host_ok = lambda c: allowed_url(F.col(c), list(profile.hosts))
    if profile.guid:
        path = lambda c: F.regexp_extract(c, r"^(?i)https://[^/?#]*([^?#]*)", 1)
        same = host_ok("guid") & (path("guid") == F.replace(path("link"), F.lit("/feed/view/"), F.lit("/")))
        rows = rows.withColumn("url", F.when(same, F.col("guid")).otherwise(F.col("link")))
    else:
        rows = rows.withColumn("url", F.col("link"))
    why = F.when(F.col("place").isNull(), "NONE").when(F.col("title") == "", "MISSING_TITLE").when(~host_ok("link"), "UNSAFE_SOURCE_URL")
    if profile.attribution:
        why = why.when(F.col("_author") == "", "MISSING_ATTRIBUTION")
    rows = rows.withColumn("_early", why).withColumn("key", url_key(F.col("url")))
    if profile.relevant is not None:
        rows = rows.withColumn("_plain", _plain("title"))
        rows = rows.withColumn("_why", F.coalesce("_early", F.when(~F.coalesce(profile.relevant(F.col("_plain")), F.lit(False)), "NOT_MACRO_RELEVANT"))).drop("_plain")
    else:
        rows = rows.withColumn("_why", F.col("_early"))
    feed, same_url = Window.partitionBy("path"), Window.partitionBy("path", "key")
    first = F.min(F.when(F.col("_why").isNull(), F.col("place"))).over(same_url)
    reason = F.coalesce("_why", F.when(F.col("place") > first, "DUPLICATE_URL"), F.lit("ACCEPTED"))
    fault = F.coalesce("fault", F.when(F.count_if(F.col("_early").isNull()).over(feed) == 0, "NO_USABLE_ARTICLES"))
    return rows.select("path", fault.alias("fault"), "place", "title", "about", "url", "key", F.col("_author").alias("author"), "published", reason.alias("reason"))


def _plain(name: str) -> Column:
    """The text with its character references resolved; only texts that hold one leave the JVM."""
    return F.coalesce(unescaped(F.when(F.contains(name, F.lit("&")), F.col(name))), F.col(name))


def headlines(items: DataFrame, profile: Profile, observed_at: Column) -> DataFrame:
    """News rows of the accepted items of ``judged``, with ``path`` and ``key``, which order them. An undated item has an empty event time."""
    about = (F.col("about") == "") | (F.lower("title") == F.lower("about"))
    line = F.when(about, F.col("title")).otherwise(F.concat("title", F.lit(" - "), "about")) if profile.summary else F.col("title")
    named = F.when(F.col("author") == "", profile.name).otherwise(F.concat(F.lit(profile.name + " · "), "author")) if profile.authors else F.lit(profile.name)
    at = F.coalesce(F.date_format(rfc_instant(F.col("published")), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))
    return items.filter("fault is null and reason = 'ACCEPTED'").select(
        "path", "key", observed_at.alias("observed_time"), at.alias("event_time"), line.alias("headline_or_text"), named.alias("source_name"), F.col("url").alias("source_url")
    )


def cycles(items: DataFrame) -> DataFrame:
    """(path, status, input_item_count, accepted_item_count, rejected) of each feed: its fault or AVAILABLE, and how many items each reason rejected (a map, null where there is a fault)."""
    counts = items.groupBy("path", "fault", "reason").agg(F.count("place").alias("n"))
    total = lambda keep: F.sum(F.when(keep, F.col("n")).otherwise(0))
    rejected = F.map_from_entries(F.array_sort(F.collect_list(F.when((F.col("reason") != "ACCEPTED") & (F.col("n") > 0), F.struct("reason", "n")))))
    fine = F.col("fault").isNull()
    out = counts.groupBy("path", "fault").agg(total(F.lit(True)).alias("_all"), total(F.col("reason") == "ACCEPTED").alias("_kept"), rejected.alias("_rejected"))
    return out.select("path", F.coalesce("fault", F.lit("AVAILABLE")).alias("status"), *[F.when(fine, F.col(c)).alias(n) for c, n in [("_all", "input_item_count"), ("_kept", "accepted_item_count"), ("_rejected", "rejected")]])


# Evidence files

def evidence(found: DataFrame, most_bytes: int = FILE_BYTES) -> DataFrame:
    """``found`` (path, length, content) of JSON and JSON-lines files with ``rows`` (VARIANT objects) and ``fault``: the first of CONFIGURED_EVIDENCE_FILE_TOO_LARGE, CONFIGURED_EVIDENCE_READ_FAILED, CONFIGURED_EVIDENCE_SCHEMA_INVALID, or null.

    JSON is a list, an object with a list of items or else of records, or one object; every row must be an object. Files named .jsonl or .ndjson hold a row a line, blank ones aside.
    """
    fits = F.col("content").isNotNull() & (F.col("length") <= most_bytes)
    body = found.withColumn("_text", F.when(fits, F.col("content").cast("string")))
    lines = F.lower("path").rlike(r"\.(jsonl|ndjson)$")
    valid = F.is_valid_utf8("_text")
    many = F.transform(F.filter(F.split("_text", r"\r\n|[\r\n]"), lambda x: F.trim(x) != ""), lambda x: F.try_parse_json(x))
    body = body.withColumn("_lines", F.when(lines & valid, many)).withColumn("_one", F.when(~lines & valid, F.try_parse_json("_text")))
    at = lambda path: F.try_variant_get("_one", path, "array<variant>")
    single = F.when(F.schema_of_variant("_one").startswith("OBJECT"), F.array("_one"))
    body = body.withColumn("_rows", F.when(lines, F.col("_lines")).otherwise(F.coalesce(at("$"), at("$.items"), at("$.records"), single)))
    unread = ~valid | F.when(lines, F.exists("_lines", lambda x: x.isNull())).otherwise(F.col("_one").isNull())
    objects = F.forall("_rows", lambda x: F.coalesce(F.schema_of_variant(x), F.lit("")).startswith("OBJECT"))
    fault = F.when(~fits, "CONFIGURED_EVIDENCE_FILE_TOO_LARGE").when(unread, "CONFIGURED_EVIDENCE_READ_FAILED").when(~F.coalesce(objects, F.lit(False)), "CONFIGURED_EVIDENCE_SCHEMA_INVALID")
    return body.select(*[c for c in found.columns if c != "content"], fault.alias("fault"), F.when(fault.isNull(), F.col("_rows")).alias("rows"))


def evidence_rows(read: DataFrame, columns: list[str] = news.COLUMNS) -> DataFrame:
    """(path, place, columns as strings) of the rows of files without a fault; what a row lacks is null."""
    rows = read.select("path", F.posexplode("rows").alias("place", "r"))
    return rows.select("path", "place", *[F.try_variant_get("r", f"$.{c}", "string").alias(c) for c in columns])


# A folder of news files

def inbox_manifest(found: DataFrame, most_files: int = INBOX_FILES, most_total: int = INBOX_BYTES, most_bytes: int = FILE_BYTES) -> DataFrame:
    """(path, length, file_name, fault) of the collector files of a folder: NEWS_INBOX_FILE_LIMIT_EXCEEDED or NEWS_INBOX_SIZE_LIMIT_EXCEEDED for all where the folder holds too many files or bytes, CONFIGURED_EVIDENCE_FILE_TOO_LARGE and CONFIGURED_EVIDENCE_READ_FAILED (not UTF-8) for the file alone."""
    named = found.withColumn("file_name", F.regexp_extract("path", r"[^/]*$", 0)).filter(news.collector_kind(F.col("file_name")).isNotNull() & F.lower("file_name").endswith(".csv"))
    total = named.agg(F.count("*").alias("_files"), F.sum("length").alias("_bytes"))
    own = F.when(F.col("length") > most_bytes, "CONFIGURED_EVIDENCE_FILE_TOO_LARGE").when(~F.is_valid_utf8(F.col("content").cast("string")), "CONFIGURED_EVIDENCE_READ_FAILED")
    judged_files = named.select("path", "length", "file_name", own.alias("_own"))
    fault = F.when(F.col("_files") > most_files, "NEWS_INBOX_FILE_LIMIT_EXCEEDED").when(F.col("_bytes") > most_total, "NEWS_INBOX_SIZE_LIMIT_EXCEEDED").otherwise(F.col("_own"))
    return judged_files.join(F.broadcast(total)).select("path", "length", "file_name", fault.alias("fault"))


def inbox(spark: SparkSession, folder: str, **limits: int) -> tuple[DataFrame, DataFrame]:
    """(rows, manifest) of a folder: the rows of ``news.inbox`` of the files without a fault."""
    manifest = inbox_manifest(files(spark, folder, limits.get("most_bytes", FILE_BYTES)), **limits)
    return news.inbox(spark, folder).join(manifest.filter("fault is null").select("file_name"), "file_name", "left_semi"), manifest
