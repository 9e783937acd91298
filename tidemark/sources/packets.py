"""Inputs that are taken whole or not at all: market packets, sealed cases, snapshots, curated links, feeds with their copies."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.arrow import title_key
from ..functions.scalars import instant, precision, url_key, valid_url, without_tracking
from ..operators.reaction import read_rates

#: Instruments with the unit of their values.
UNITS = {"SPY": "PRICE", "QQQ": "PRICE", "VIX": "INDEX_LEVEL", "DXY": "INDEX_LEVEL", "US10Y": "YIELD_PERCENT"}
#: Who may see an observation.
SCOPES = ["PRIVATE_RESEARCH_ONLY", "PUBLIC_REDISTRIBUTABLE", "UNKNOWN"]
#: Tags of the documents.
MARKET_SCHEMA, LINKS_SCHEMA, CASE_SCHEMA = "MARKET_REALITY_INPUT_V0", "EXACT_MARKET_LINKS_V1", "ECB_DAILY_REACTION_CASE_V0"
_TIMED = "price_or_level double, market_timestamp string, observed_at string, source_observation_id string"
RECORD = (
    f"symbol string, event_id string, time_basis string, event_observed_at string, {_TIMED}, source struct<name:string,url:string>, value_unit string, "
    f"previous_close struct<{_TIMED.replace(' ', ':').replace(',:', ',')}>, data_usage_scope string, provider string, synthetic boolean"
)


def document(spark: SparkSession, path: str, most_bytes: int) -> bytes | None:
    """The bytes of one file; None where it is missing or larger than ``most_bytes``."""
    try:
        found = spark.read.format("binaryFile").load(path).filter(F.col("length") <= most_bytes).select("content").take(2)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    return bytes(found[0]["content"]) if len(found) == 1 else None


def _parsed(raw: bytes | None) -> dict | None:
    try:
        held = json.loads(raw) if raw is not None else None
    except ValueError:
        return None
    return held if isinstance(held, dict) else None


def _sound(price: Column, symbol: Column) -> Column:
    return price.isNotNull() & ~F.isnan(price) & (F.abs(price) < float("inf")) & ((symbol == "US10Y") | (price > 0))


def record_fault(known: str = "observed_at", market: str = "market_timestamp") -> Column:
    """The first fault of a market record (columns of ``RECORD``); null for a good one.

    Times need a zone, a market time is not after its knowledge, a yield may be negative and other values not, and an earlier close
    is neither younger nor known later than the value it precedes.
    """
    c, symbol, prior = F.col, F.col("symbol"), F.col("previous_close")
    unit = F.coalesce(*[F.when(symbol == s, u) for s, u in UNITS.items()])
    reference = lambda x: F.coalesce(F.length(x).between(1, 300), F.lit(False))
    good_prior = (
        (instant(prior[market]) <= instant(prior[known])) & (instant(prior[market]) <= instant(c(market))) & (instant(prior[known]) <= instant(c(known)))
        & reference(prior["source_observation_id"]) & _sound(prior["price_or_level"], symbol)
    )
    checks = [
        ("INVALID_MARKET_SYMBOL", unit.isNotNull()),
        ("INVALID_MARKET_EVENT", c("event_id").rlike(r"\Acanonical-event-v0-[0-9a-f]{64}\z")),
        ("NO_POINT_IN_TIME_SOURCE", c("time_basis") == "SYSTEM_RECORDED_TIME"),
        ("INVALID_MARKET_TIME", instant(c("event_observed_at")).isNotNull() & instant(c(market)).isNotNull() & instant(c(known)).isNotNull()),
        ("MARKET_TIME_AFTER_KNOWLEDGE", instant(c(market)) <= instant(c(known))),
        ("MARKET_PROVENANCE_REQUIRED", (F.trim("source.name") != "") & (F.length("source.name") <= 200) & reference(c("source_observation_id"))),
        ("INVALID_MARKET_SOURCE_URL", c("source.url").isNull() | (valid_url(c("source.url")) & ~c("source.url").rlike(r"^[^/]*//[^/?#]*@"))),
        ("INVALID_MARKET_VALUE", _sound(c("price_or_level"), symbol)),
        ("MARKET_UNIT_MISMATCH", c("value_unit") == unit),
        ("INVALID_PREVIOUS_CLOSE", prior.isNull() | good_prior),
        ("INVALID_MARKET_VISIBILITY", F.coalesce("data_usage_scope", F.lit("UNKNOWN")).isin(SCOPES) & ~F.coalesce("synthetic", F.lit(False))),
    ]
    return F.coalesce(*[F.when(~F.coalesce(holds, F.lit(False)), code) for code, holds in checks])


def conflicts(records: DataFrame) -> DataFrame:
    """(event_id, reason) of events with two observation times, or with a source's reference that stands for differing records."""
    anchors = records.groupBy("event_id").agg(F.count_distinct("event_observed_at").alias("n")).filter("n > 1")
    body = F.to_json(F.struct(*sorted(records.columns)))
    named = records.groupBy("event_id", "symbol", F.col("source.name"), "source_observation_id").agg(F.count_distinct(body).alias("n")).filter("n > 1")
    tag = lambda df, reason: df.select("event_id", F.lit(reason).alias("reason"))
    return tag(anchors, "CONFLICTING_EVENT_OBSERVATION_TIME").unionByName(tag(named, "CONFLICTING_MARKET_OBSERVATION")).distinct()


def read_market(spark: SparkSession, path: str | None, most: int = 4096, most_bytes: int = 8 << 20) -> tuple[DataFrame, str]:
    """(records, status) of one packet; a fault or conflict anywhere makes all of it UNAVAILABLE, and declared test data is never taken."""
    none = spark.createDataFrame([], RECORD)
    if path is None:
        return none, "NOT_CONFIGURED"
    raw = document(spark, path, most_bytes)
    held = _parsed(raw)
    rows = (held or {}).get("observations")
    if held is None or held.get("schema") != MARKET_SCHEMA or not isinstance(rows, list) or len(rows) > most or held.get("synthetic", False) is not False:
        return none, "UNAVAILABLE"
    if not rows:
        return none, "EMPTY"
    made = spark.createDataFrame([(json.dumps(r),) for r in rows], "record string").select(F.from_json("record", RECORD).alias("r")).select("r.*")
    if not made.filter(record_fault().isNotNull()).isEmpty() or not conflicts(made).isEmpty():
        return none, "UNAVAILABLE"
    return made.distinct(), "AVAILABLE"


def read_case(spark: SparkSession, case_path: str, data_path: str, expected: dict[str, str], rights: dict[str, str], most: int = 32) -> tuple[dict, DataFrame] | None:
    """(case, rates) of a sealed case; None unless its fields are the ``expected`` ones, its rights hold, its clocks are open and the data has its hash."""
    import hashlib

    raw, data = document(spark, case_path, 32_768), document(spark, data_path, 131_072)
    case = _parsed(raw)
    if case is None or data is None or case.get("schema") != CASE_SCHEMA or case.get("synthetic") is not False:
        return None
    open_clocks = all(case.get(k) is None for k in ("event_timestamp_utc", "event_effective_time", "source_published_at"))
    granted = isinstance(case.get("license"), dict) and all(case["license"].get(k) == v for k, v in rights.items()) and case["license"].get("conditions")
    if any(case.get(k) != v for k, v in expected.items()) or not open_clocks or case.get("event_timestamp_precision") != "DATE_ONLY" or not granted:
        return None
    if not str(case.get("fact_proposition") or "").strip() or hashlib.sha256(data).hexdigest() != case.get("market_data_sha256"):
        return None
    at = spark.range(1).select(*[instant(F.lit(case.get(k))).alias(k) for k in ("market_data_retrieved_at", "system_observed_at")]).first()
    try:
        rates = read_rates(spark, data_path, most=most)
    except ValueError:
        return None
    if at[0] is None or at[1] is None or not rates.filter(F.col("day") > F.lit(at[0]).cast("date")).isEmpty():
        return None
    return case, rates


def read_snapshot(spark: SparkSession, path: str, columns: list[str], good: Column, key: Column) -> DataFrame:
    """A bundled table; raises unless the header is exactly ``columns``, rows exist, each is ``good`` and ``key`` is unique."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if rows.columns != columns:
        raise ValueError("SNAPSHOT_SCHEMA_INVALID")
    facts = rows.agg(F.count("*").alias("n"), F.count_if(F.coalesce(good, F.lit(False))).alias("good"), F.count_distinct(key).alias("keys")).first()
    if not facts["n"] or facts["good"] != facts["n"] or facts["keys"] != facts["n"]:
        raise ValueError("SNAPSHOT_INVALID")
    return rows


def curated_links(spark: SparkSession, path: str | None) -> tuple[DataFrame | None, str]:
    """(links, status): (event_id, market_id) of a curator's document. Without one, matching is automatic (None); with one that cannot be read, nothing links."""
    if path is None:
        return None, "AUTOMATIC"
    held = _parsed(document(spark, path, 8 << 20))
    links = held.get("event_to_market") if held and held.get("schema") == LINKS_SCHEMA else None
    good = isinstance(links, dict)
    rows = [(k, m) for k, v in (links if good else {}).items() for m in (v if isinstance(v, list) else [v])]
    return spark.createDataFrame(rows, "event_id string, market_id string"), "CURATED" if good else "UNAVAILABLE"


def feed_articles(items: DataFrame) -> DataFrame:
    """(url, title, published, precision, aliases, conflicting) of feed items (link, title, pubDate): one row a url without tracking parameters.

    Copies conflict where their dates or their titles (by key) differ. Items whose link has no such url are left out.
    """
    dated = items.select(
        F.coalesce(without_tracking(F.trim("link")), url_key(F.col("link"))).alias("url"), F.trim("link").alias("link"), F.coalesce(F.trim("title"), F.lit("")).alias("title"),
        F.trim("pubDate").alias("published"),
    ).filter("url is not null")
    keyed = dated.withColumn("k", F.coalesce(title_key("title"), F.lit(""))).withColumn("p", F.coalesce("published", F.lit("")))
    out = keyed.groupBy("url").agg(
        F.min("title").alias("title"), F.min("published").alias("published"), F.array_sort(F.collect_set("link")).alias("aliases"),
        ((F.min("k") != F.max("k")) | (F.min("p") != F.max("p"))).alias("conflicting"),
    )
    return out.select("url", "title", "published", F.coalesce(precision(F.col("published")), F.lit("UNKNOWN")).alias("precision"), "aliases", "conflicting")
