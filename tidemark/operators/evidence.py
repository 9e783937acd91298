"""Official evidence packets: validation, identity and the link to canonical events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import evidence_id, instant, iso, text, valid_url
from .selection import resolve

REFERENCES = ["canonical_event_id", "article_reference", "source_item_reference", "item_reference", "discovery_record_id", "event_reference"]
PACKET = [
    "official_confirmation", "authority_role", "authority_name", "official_authority_name", "official_source", "source_url", "document_url", "official_document_reference",
    "document_reference", "official_document_title", "document_title", "official_fact_proposition", "fact_proposition", "official_published_at", "published_at",
    "official_project_first_seen_at", "project_first_seen_at", "official_retrieved_at", "retrieved_at", "artifact_fingerprint_valid", *REFERENCES,
]


def _with_columns(rows: DataFrame) -> DataFrame:
    missing = {c: F.lit(None).cast("string") for c in PACKET if c not in rows.columns}
    return rows.withColumns(missing) if missing else rows


def packets(rows: DataFrame) -> DataFrame:
    """``rows`` with the evidence fields and ``valid``.

    A packet counts with a confirmation (or a valid sealed fingerprint), the fact authority's role, an http(s) document, its reference, a proposition,
    first seen no later than retrieved, and a publication that is absent or no later than first seen; a publication that cannot be read invalidates it.
    """
    rows = _with_columns(rows)
    c = lambda *names: text(*[F.col(n) for n in names])
    raw = F.coalesce("official_published_at", "published_at")
    published, first, retrieved = instant(raw), instant(c("official_project_first_seen_at", "project_first_seen_at")), instant(c("official_retrieved_at", "retrieved_at"))
    url, document = c("official_source", "source_url", "document_url"), c("official_document_reference", "document_reference")
    proposition = F.coalesce(*[F.when(F.trim(x) != "", F.col(x)) for x in ("official_fact_proposition", "fact_proposition")])
    confirmed = (F.col("official_confirmation") == "OFFICIAL_CONFIRMED") | (F.col("artifact_fingerprint_valid") == "true")
    valid = (
        confirmed & (F.col("authority_role") == "FACT_AUTHORITY") & valid_url(url) & document.isNotNull() & proposition.isNotNull()
        & (raw.isNull() | published.isNotNull()) & (first <= retrieved) & (published.isNull() | (published <= first))
    )
    out = rows.select(
        *REFERENCES, c("authority_name", "official_authority_name").alias("authority_name"), F.when(valid_url(url), url).alias("document_url"), document.alias("document"),
        proposition.alias("proposition"), c("official_document_title", "document_title").alias("document_title_text"), iso(published).alias("published"),
        F.col("authority_role"), iso(first).alias("first_seen"), iso(retrieved).alias("retrieved"), F.coalesce(valid, F.lit(False)).alias("valid"),
    )
    return out.withColumn("evidence_id", evidence_id(F.col("authority_name"), F.col("document_url"), F.col("document"), F.col("proposition"), F.col("published")))


def project(rows: DataFrame, events: DataFrame) -> DataFrame:
    """One row per evidence id: event_id, evidence_status, link_status and the evidence fields.

    ``events``: event_id, article_references. Invalid packets are INCOMPLETE and attach to nothing; differing copies of an
    identity are AMBIGUOUS_EVIDENCE with those fields nulled.
    """
    made = packets(rows).withColumn("_row", F.monotonically_increasing_id())
    made = made.withColumns({c: F.when(F.lit(i == 0), F.concat(F.lit("event:"), c)).otherwise(F.concat(F.lit("ref:"), c)) for i, c in enumerate(REFERENCES)})
    known = events.select(F.concat(F.lit("event:"), "event_id").alias("ref"), "event_id")
    known = known.unionByName(events.select(F.explode("article_references").alias("r"), "event_id").select(F.concat(F.lit("ref:"), "r").alias("ref"), "event_id"))
    linked = resolve(made, "_row", REFERENCES, known, "ref", "event_id").withColumnRenamed("status", "link_status")
    fields = ["event_id", "link_status", "document_title_text", "authority_role", "first_seen", "retrieved", "valid"]
    judged = made.join(linked, "_row").withColumns({
        "link_status": F.when(F.col("valid"), F.col("link_status")).otherwise("PACKET_VALIDATION_FAILED"), "event_id": F.when(F.col("valid"), F.col("event_id")),
    })
    value = F.struct(*fields)
    grouped = judged.groupBy("evidence_id", "authority_name", "document_url", "document", "proposition", "published").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    same = F.col("lo").eqNullSafe(F.col("hi"))
    one = lambda f: F.when(same, F.col(f"lo.{f}"))
    status = F.when(~same, "AMBIGUOUS_EVIDENCE").when(~F.col("lo.valid"), "INCOMPLETE").when(F.col("lo.event_id").isNull(), "UNLINKED").otherwise("OFFICIAL_CONFIRMED")
    return grouped.select(
        "evidence_id", "authority_name", "document_url", "document", "proposition", "published", one("event_id").alias("event_id"), status.alias("evidence_status"),
        F.when(same, F.col("lo.link_status")).otherwise("CONFLICTING_EVIDENCE_COPIES").alias("link_status"), one("document_title_text").alias("document_title"),
        one("first_seen").alias("first_seen_at"), one("retrieved").alias("retrieved_at"),
        F.when(F.col("lo.authority_role").eqNullSafe(F.col("hi.authority_role")), F.col("lo.authority_role")).alias("authority_role"),
    )
