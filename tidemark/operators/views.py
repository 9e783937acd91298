"""The parts of a view: memberships, recorded states, clocks of detection, geography, impact and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import valid_url
from . import context, versions


def memberships(articles: DataFrame, events: DataFrame, article: str, event: str) -> DataFrame:
    """``articles`` with ``event_count`` and the event of those that exactly one event holds."""
    held = events.filter(F.col(article).isNotNull()).groupBy(article).agg(F.count_distinct(event).alias("event_count"), F.min(event).alias("_one"))
    out = articles.join(held, article, "left")
    return out.withColumn("event_count", F.coalesce("event_count", F.lit(0))).withColumn(event, F.when(F.col("event_count") == 1, F.col("_one"))).drop("_one")


def recording_status(articles: DataFrame, ledger: DataFrame, key: str, content: str, order: list[str], as_of: Column) -> DataFrame:
    """``articles`` with recorded_status: whether the latest version known as of an instant has the article's content."""
    stored = ledger.withColumnRenamed(content, "_stored")
    last = versions.latest(stored, [key], order, as_of).select(key, "_stored", F.col(order[0]).alias("recorded_at"))
    out = articles.join(last, key, "left")
    status = F.when(F.col("recorded_at").isNull(), "NOT_RECORDED").when(F.col("_stored").eqNullSafe(F.col(content)), "RECORDED_EVIDENCE_LEDGER")
    return out.withColumn("recorded_status", status.otherwise("CAPTURED_EARLIER_VERSION")).drop("_stored")


def detection(articles: DataFrame, history: DataFrame, key: str, at: str, row_id: str, published: str) -> DataFrame:
    """``articles`` with the clocks of their recorded versions: first and last, their number, the delay of the first after the publication.

    A delay is measured only where the first version is not before the publication. Articles without a version are FIRST_SEEN_NOT_PROVEN.
    """
    held = history.groupBy(key).agg(F.min(F.struct(at, row_id)).alias("f"), F.max(F.struct(at, row_id)).alias("l"), F.count("*").alias("version_count"))
    out = articles.join(held, key, "left")
    first, last = F.col(f"f.{at}"), F.col(f"l.{at}")
    delay = F.when(first >= F.col(published), F.timestamp_diff("SECOND", F.date_trunc("second", F.col(published)), F.date_trunc("second", first)))
    status = F.when(first.isNull(), "FIRST_SEEN_NOT_PROVEN").when(F.col("version_count") == 1, "NEWLY_OBSERVED").otherwise("PREVIOUSLY_OBSERVED")
    return out.select(
        *articles.columns, F.coalesce("version_count", F.lit(0)).alias("version_count"), first.alias("first_observed_at"), last.alias("last_seen_at"),
        delay.alias("delay_seconds"), F.when(delay.isNotNull(), "MEASURED").otherwise("UNKNOWN").alias("latency_status"), status.alias("detection_status"),
    )


def market_read(content: DataFrame, receipts: DataFrame, key: str, at: str, private: Column, as_of: Column) -> DataFrame:
    """(key, at, receipt_at): content known as of an instant: public rows by their own registration, private ones that have receipts by the latest of these."""
    known = content.filter(F.col(at) <= as_of).withColumn("_private", private)
    last = receipts.filter(F.col(at) <= as_of).groupBy(key).agg(F.max(at).alias("receipt_at"))
    out = known.join(last, key, "left")
    public = ~F.col("_private") | F.col("receipt_at").isNull()
    return out.select(key, at, F.when(public, None).otherwise(F.col("receipt_at")).alias("receipt_at"), F.when(public, "REGISTRATION").otherwise("RECEIPT").alias("basis"))


def receipt_violations(content: DataFrame, receipts: DataFrame, key: str, at: str) -> DataFrame:
    """Receipts without content or from before it, with the reason."""
    stored = content.select(key, F.col(at).alias("_stored"))
    out = receipts.join(stored, key, "left").withColumn("reason", F.when(F.col("_stored").isNull(), "MARKET_RECEIPT_CONTENT_MISSING").when(F.col(at) < F.col("_stored"), "INVALID_MARKET_RECEIPT_BINDING"))
    return out.filter("reason is not null").drop("_stored")


def geographies(points: DataFrame, event: str, most: int = 16) -> DataFrame:
    """(event, geography_id, place_name, country_code, latitude, longitude): the distinct valid points of events.

    Of an event with more than ``most`` points none counts. A point needs a place, a valid reference, a country code of two capitals (or none) and
    coordinates in range.
    """
    many = points.groupBy(event).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(event)
    place, reference = F.trim("place_name"), F.trim("evidence_reference")
    good = (F.length(place).between(1, 200)) & F.length(reference).between(1, 1000) & valid_url(reference)
    good = good & (F.col("country_code").isNull() | F.rlike("country_code", F.lit("^[A-Z]{2}$")))
    good = good & F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180) & ~F.isnan("latitude") & ~F.isnan("longitude")
    kept = points.join(many, event, "left_anti").filter(F.coalesce(good, F.lit(False)))
    coordinate = lambda c: F.when(F.col(c) == 0, 0.0).otherwise(F.col(c).cast("double"))
    shaped = kept.select(
        event, place.alias("place_name"), "country_code", coordinate("latitude").alias("latitude"), coordinate("longitude").alias("longitude"), reference.alias("evidence_reference")
    ).distinct()
    parts = F.array(F.lit("EVENT_GEOGRAPHY_V1"), F.col(event).cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in shaped.columns[1:]])
    return shaped.withColumn("geography_id", F.concat(F.lit("event-geography-v1-"), F.sha2(F.to_json(parts), 256)))


def mapped_counts(events: DataFrame, points: DataFrame, event: str) -> DataFrame:
    """One row: how many events have a valid point and how many have none."""
    mapped = events.select(event).distinct().join(points.select(event, F.lit(1).alias("_p")).distinct(), event, "left")
    return mapped.agg(F.count("_p").alias("mapped_event_count"), F.count_if(F.col("_p").isNull()).alias("unmapped_event_count"))


def strict_points(points: DataFrame) -> DataFrame:
    """Points that a source itself states, with a reference; curated presentation does not establish a place."""
    return points.filter(F.col("evidence_type").isin("STRUCTURED_SOURCE", "EXPLICIT_SOURCE") & F.col("evidence_reference").isNotNull())


def impact(articles: DataFrame, mechanisms: Column) -> DataFrame:
    """``articles`` (with valid: provenance and one event) with mechanisms and impact_status."""
    held = F.when(F.col("valid"), mechanisms).otherwise(F.array().cast("array<string>"))
    out = articles.withColumn("mechanisms", held)
    return out.withColumn("impact_status", F.when(F.size("mechanisms") > 0, "CONDITIONAL_HYPOTHESIS_AVAILABLE").otherwise("IMPACT_NOT_ESTABLISHED"))


def impact_counts(impacts: DataFrame) -> DataFrame:
    return impacts.agg(
        F.count_if(F.size("mechanisms") > 0).alias("hypothesis_article_count"), F.count_if(F.size("mechanisms") == 0).alias("unknown_article_count")
    )


def brief_counts(cards: DataFrame, group: str) -> DataFrame:
    """One row of cards (macro, valid, recency, topic): eligible articles and developments, those of a day, and those without a topic."""
    both = F.col("macro") & F.col("valid")
    eligible = both & F.col("recency").isin("LAST_24H", "LAST_48H")
    return cards.agg(
        F.count_if(eligible).alias("eligible_article_count"), F.count_distinct(F.when(eligible, F.col(group))).alias("eligible_development_count"),
        F.count_if(both & (F.col("recency") == "LAST_24H")).alias("macro_relevant_last_24h"), F.count_if(F.col("topic").isNull()).alias("unknown_analysis_count"),
    )


def library_counts(cases: DataFrame) -> DataFrame:
    """One row of cases (status, priced, official, point_in_time)."""
    return cases.agg(
        F.count_if(F.col("status") == "AVAILABLE").alias("available"), F.count_if("priced").alias("priced"), F.count_if("official").alias("official"), F.count_if("point_in_time").alias("point_in_time")
    )


def round_robin_batches(rows: DataFrame, batch: str, ident: str, order: list[Column], depth: int = 3, most: int = 8) -> DataFrame:
    """The first ``most`` distinct ids, depth by depth over the batches: first ones of all, then second ones, ``depth`` at most."""
    placed = rows.withColumn("_depth", F.row_number().over(Window.partitionBy(batch).orderBy(*order))).filter(F.col("_depth") <= depth)
    first = placed.groupBy(ident).agg(F.min(F.struct("_depth", batch)).alias("_at"))
    chosen = first.orderBy("_at").limit(most).select(ident, "_at")  # ``most`` rows
    return chosen.withColumn("position", F.row_number().over(Window.orderBy("_at")).cast("long")).drop("_at")


def event_order(events: DataFrame, latest: str, event: str, most: int | None = None) -> DataFrame:
    """Events by the text of their latest time and then their id, both descending."""
    ordered = events.orderBy(F.desc(latest), F.desc(event))
    return ordered.limit(most) if most else ordered


def with_market_state(events: DataFrame, snapshots: DataFrame, event: str, anchor: str) -> DataFrame:
    """``events`` with market_status and market_rows: UNAVAILABLE where the snapshots of an event have more than one anchor."""
    held = snapshots.groupBy(event).agg(F.count_distinct(anchor).alias("_anchors"), F.count("*").alias("_rows"))
    out = events.join(held, event, "left")
    status = F.when(F.col("_anchors").isNull(), "NO_OBSERVATIONS").when(F.col("_anchors") > 1, "UNAVAILABLE").otherwise("AVAILABLE")
    return out.withColumn("market_status", status).withColumn("market_rows", F.when(F.col("_anchors") == 1, F.col("_rows")).otherwise(0)).drop("_anchors", "_rows")


def unique_records(rows: DataFrame, key: str, required: DataFrame, accepted: Column) -> DataFrame:
    """(key, verdict) for every required id: ACCEPTED where one and the same accepted record stands for it."""
    content = F.xxhash64(*[c for c in rows.columns if c != key])
    held = rows.withColumn("_content", content).withColumn("_ok", F.coalesce(accepted, F.lit(False)))
    held = held.groupBy(key).agg(F.count_distinct("_content").alias("_n"), F.min("_ok").alias("_ok"))
    verdict = F.when(F.col("_n").isNull(), "REFERENCED_EVIDENCE_MISSING").when(~F.col("_ok"), "EVIDENCE_AUTHORITY_OR_LINK_INVALID").when(F.col("_n") > 1, "CONFLICTING_EVIDENCE")
    return required.select(key).distinct().join(held, key, "left").select(key, verdict.otherwise("ACCEPTED").alias("verdict"))


def source_status(rows: DataFrame | None, readable: bool = True) -> str:
    """NOT_CONFIGURED without a source, UNAVAILABLE where it cannot be read, else EMPTY or AVAILABLE."""
    if rows is None:
        return "NOT_CONFIGURED"
    if not readable:
        return "UNAVAILABLE"
    return "EMPTY" if rows.isEmpty() else "AVAILABLE"


def trusted_input(rows: DataFrame, artifact: Column, sealed: Column, development: Column) -> DataFrame:
    """One row: AVAILABLE where a row is the artifact with a valid seal, else DEVELOPMENT_CONTRACT_NOT_FROZEN where one is in development."""
    facts = rows.agg(F.coalesce(F.bool_or(artifact & sealed), F.lit(False)).alias("trusted"), F.coalesce(F.bool_or(development), F.lit(False)).alias("draft"), F.count("*").alias("n"))
    status = F.when(F.col("n") == 0, "EMPTY").when(~F.col("trusted") & F.col("draft"), "DEVELOPMENT_CONTRACT_NOT_FROZEN").otherwise("AVAILABLE")
    return facts.select("trusted", status.alias("status"))


def ingest(view: dict[str, DataFrame], contract: str) -> DataFrame:
    """A view's tables (articles, events, evidence, markets; each with entity_id, canonical_event_id, payload, source_timestamp) as ledger rows.

    An article that two events hold is an error: ``AMBIGUOUS_ARTICLE_MEMBERSHIP``.
    """
    kinds = {"articles": "NEWS_ARTICLE", "events": "CANONICAL_EVENT_STATE", "evidence": "OFFICIAL_EVIDENCE", "markets": "MARKET_EXPECTATION", "sources": "SOURCE_STATE"}
    if "articles" in view:
        twice = view["articles"].groupBy("entity_id").agg(F.count_distinct("canonical_event_id").alias("n")).filter("n > 1")
        if not twice.isEmpty():
            raise ValueError("AMBIGUOUS_ARTICLE_MEMBERSHIP")
    provenance = F.to_json(F.struct(F.lit(contract).alias("input_contract"), F.lit("SYSTEM_RECORDED_TIME").alias("time_basis")))
    out = None
    for name, kind in kinds.items():
        if name in view:
            rows = view[name].select(F.lit(kind).alias("observation_kind"), "entity_id", "canonical_event_id", "source_timestamp", "payload", provenance.alias("provenance"))
            out = rows if out is None else out.unionByName(rows)
    return out


def of_contract(rows: DataFrame, contract: str) -> DataFrame:
    """Ledger rows whose provenance names a contract."""
    return rows.filter(F.get_json_object("provenance", "$.input_contract") == contract)


def recovered(attempts: DataFrame, key: str, order: list[str], status: str) -> DataFrame:
    """Attempts whose latest state is RESERVED, as rows that end them: INTERRUPTED_UNKNOWN."""
    last = versions.latest(attempts, [key], order)
    return last.filter(F.col(status) == "RESERVED").withColumn(status, F.lit("INTERRUPTED_UNKNOWN"))


def enriched(events: DataFrame, texts: DataFrame, sources: DataFrame, points: DataFrame, event: str) -> DataFrame:
    """``events`` with the context that their texts support, their institutions, and their own places where a source states these.

    ``texts`` has the event, tier and text; ``sources`` the event and source_name. Context is no place: event_geography is KNOWN by strict points only.
    """
    inferred = context.infer(texts, event, "text", sources).withColumnsRenamed({"region_id": "context_region", "method": "context_method", "status": "context_status"})
    houses = context.institutions(texts, event, "text", sources).groupBy(event).agg(F.array_sort(F.collect_set("institution_id")).alias("institutions"))
    stated = strict_points(points).select(event).distinct().withColumn("_stated", F.lit("KNOWN"))
    out = events.join(inferred.select(event, "context_region", "context_method", "context_status"), event, "left").join(houses, event, "left").join(stated, event, "left")
    out = out.withColumn("context_status", F.coalesce("context_status", F.lit("UNKNOWN"))).withColumn("institutions", F.coalesce("institutions", F.array().cast("array<string>")))
    return out.withColumn("event_geography", F.coalesce("_stated", F.lit("UNKNOWN"))).drop("_stated")
