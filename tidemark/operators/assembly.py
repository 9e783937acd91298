"""The view: one nested row an event from six inputs, and one triage record an article.

What an event holds is dealt out as tagged rows in one union, so all inputs share the shuffles: counts combine on the map side, and of each
part only the first rows of an event (cut before the shuffle, too) are gathered. A hot event never stands whole in one row or task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import rules as R, scalars as S
from ..functions.lexicons import TOPICS

PARTS = ("articles", "official_evidence", "market_expectations", "geographies", "market_reality")
#: The actions that make a title important for research.
IMPORTANT = (
    r"(?i)\b(?:cuts|raises|hikes|lowers) (?:interest )?rates\b|\b(?:imposes|announces|introduces) (?:new )?(?:tariffs|sanctions)\b"
    r"|\b(?:invasion|bank failure|sovereign default|supply disruption)\b"
)
RESEARCH_SECONDS = 172_800
MOST_CASES = 512  # of a case library, which every comparable article lists


def _tagged(rows: DataFrame, part: str, event: str, order: list[Column], shown: Column, flag: Column) -> DataFrame:
    """(event_id, part, place, flag, row): ``place`` sorts an event's rows, least first."""
    return rows.filter(F.col(event).isNotNull()).select(F.col(event).cast("string").alias("event_id"), F.lit(part).alias("part"), F.struct(*order).alias("place"), flag.alias("flag"), F.to_json(shown, {"ignoreNullFields": "false"}).alias("row"))


def events_view(
    events: DataFrame, articles: DataFrame, official: DataFrame, expectations: DataFrame, points: DataFrame, market: DataFrame, most: int = 16,
) -> DataFrame:
    """One row an event of ``events`` (event_id, event_title): its parts as arrays of at most ``most`` JSON rows, the true counts, and its states.

    articles: article_reference, event_id, title, published (text), newest first. official: official_evidence_id, event_id, evidence_status, link_status, proposition; only confirmed ones with a
    proposition count. expectations: expectation_id, event_id, link_status, question; only linked ones. points: geography_id, event_id, place_name. market: symbol, event_id, anchor, status.
    verification_status: CONFLICTING_EVIDENCE where a confirmed fact's copies conflict, OFFICIAL_PARTIAL with any, else SOURCE_REPORTED_ONLY with an article, else NOT_VERIFIED. market_status:
    UNAVAILABLE where rows disagree on the event's anchor, else AVAILABLE, or NO_OBSERVATIONS. Rows of other events, and rows without one, are left out.
    """
    newest = [F.when(F.col("published").isNull(), 1).otherwise(0).cast("string"), F.translate(F.coalesce("published", F.lit("")), "0123456789", "9876543210"), F.col("article_reference").cast("string")]
    three = lambda *cols: [c.alias(n) for c, n in zip([*cols, F.lit(""), F.lit("")][:3], ("a", "b", "c"))]
    confirmed = official.filter((F.col("evidence_status") == "OFFICIAL_CONFIRMED") & (F.trim("proposition") != ""))
    no = F.lit("")
    tagged = [
        _tagged(articles, "articles", "event_id", three(*newest), F.struct("article_reference", "title", "published"), no),
        _tagged(confirmed, "official_evidence", "event_id", three(F.col("official_evidence_id").cast("string")), F.struct("official_evidence_id", "proposition", "link_status"), F.when(F.col("link_status") == "CONFLICTING_EVIDENCE_COPIES", "x").otherwise("")),
        _tagged(expectations.filter("link_status = 'LINKED'"), "market_expectations", "event_id", three(F.col("expectation_id").cast("string")), F.struct("expectation_id", "question"), no),
        _tagged(points, "geographies", "event_id", three(F.col("geography_id").cast("string")), F.struct("geography_id", "place_name"), no),
        _tagged(market, "market_reality", "event_id", three(F.col("symbol").cast("string")), F.struct("symbol", "status"), F.col("anchor").cast("string")),
    ]
    rows = tagged[0]
    for more in tagged[1:]:
        rows = rows.unionByName(more)
    counts = rows.groupBy("event_id").agg(
        *[F.count_if(F.col("part") == p).alias(f"{p}_count") for p in PARTS], F.coalesce(F.bool_or((F.col("part") == "official_evidence") & (F.col("flag") == "x")), F.lit(False)).alias("conflict"),
        F.min(F.when(F.col("part") == "market_reality", F.col("flag"))).alias("a0"), F.max(F.when(F.col("part") == "market_reality", F.col("flag"))).alias("a1"),
    )
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("event_id", "part").orderBy("place", "row"))).filter(F.col("n") <= most)
    lists = first.groupBy("event_id").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == p, F.struct("n", "row")))), lambda r: r["row"]).alias(p) for p in PARTS])
    own = events.select(F.col("event_id").cast("string").alias("event_id"), "event_title")
    out = own.join(counts, "event_id", "left").join(lists, "event_id", "left")
    filled = [F.coalesce(f"{p}_count", F.lit(0)).alias(f"{p}_count") for p in PARTS] + [F.coalesce(p, F.array().cast("array<string>")).alias(p) for p in PARTS]
    verification = F.when(F.col("conflict"), "CONFLICTING_EVIDENCE").when(F.col("official_evidence_count") > 0, "OFFICIAL_PARTIAL").when(F.col("articles_count") > 0, "SOURCE_REPORTED_ONLY").otherwise("NOT_VERIFIED")
    market_status = F.when(F.col("a0").isNull(), "NO_OBSERVATIONS").when(F.col("a0") != F.col("a1"), "UNAVAILABLE").otherwise("AVAILABLE")
    return out.select(
        "event_id", "event_title", *filled, verification.alias("verification_status"), F.when(F.col("geographies_count") > 0, "KNOWN").otherwise("UNKNOWN").alias("geography_status"), market_status.alias("market_status"),
    )


def priority(title: Column, published: Column, now: Column, proven: Column) -> Column:
    """struct(priority, event_importance, source_freshness) of an article: research order only, never a signal.

    ``proven``: a durable first observation of an article of one event with a source url, not of an earlier version.
    """
    age = (F.unix_micros(now) - F.unix_micros(published)) / 1_000_000.0
    fresh = F.when(age.isNull(), "UNKNOWN").when(age < 0, "INVALID_FUTURE").when(age <= RESEARCH_SECONDS, "FRESH_48H").otherwise("SOURCE_STALE")
    high = F.coalesce(F.rlike(title, F.lit(IMPORTANT)), F.lit(False))
    out = F.when(fresh == "SOURCE_STALE", "STALE_SOURCE_ARTICLE").when(fresh != "FRESH_48H", "INSUFFICIENT_EVIDENCE").when(high & F.coalesce(proven, F.lit(False)), "HIGH_PRIORITY_RESEARCH").otherwise("NORMAL_RESEARCH")
    return F.struct(out.alias("priority"), F.when(high, "HIGH").otherwise("NORMAL").alias("event_importance"), fresh.alias("source_freshness"))


def triage(articles: DataFrame, members: DataFrame, official: DataFrame, cases: DataFrame, sources: DataFrame, now: Column, most: int = 16) -> DataFrame:
    """One card an article: its single event, topic, terms, verification, the facts of its event, comparable cases, clocks and research priority.

    articles: article_reference, title, source_name, source_url, reported_at, reported_time_kind, observed_at, observation_time_basis (texts). members: article_reference, event_id. official: event_id,
    official_evidence_id, evidence_status, link_status, proposition. cases: research_case_id, status, receipt (boolean). sources: source_name, last_attempt_at, last_success_at, status. An article
    of no or several events has none. Comparable cases are offered for an explicit rate decision of the bank only. Facts are the first ``most`` of an event, counted whole.
    """
    held = members.groupBy("article_reference").agg(F.count_distinct("event_id").alias("_n"), F.min("event_id").alias("event_id"))
    held = held.select("article_reference", F.when(F.col("_n") == 1, F.col("event_id")).alias("event_id"))
    good = official.filter((F.col("evidence_status") == "OFFICIAL_CONFIRMED") & (F.trim("proposition") != "") & F.col("event_id").isNotNull())
    facts = good.groupBy("event_id").agg(F.count("*").alias("official_evidence_count"), F.bool_or(F.coalesce(F.col("link_status") == "CONFLICTING_EVIDENCE_COPIES", F.lit(False))).alias("conflict"))
    ranked = good.withColumn("n", F.row_number().over(Window.partitionBy("event_id").orderBy("official_evidence_id"))).filter(F.col("n") <= most)
    shown = ranked.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("official_evidence_id", "proposition"))).alias("official_propositions"))
    ids = sorted(r[0] for r in cases.filter((F.col("status") == "AVAILABLE") & F.col("receipt")).select("research_case_id").distinct().limit(MOST_CASES + 1).collect())
    if len(ids) > MOST_CASES:
        raise ValueError("CASE_LIBRARY_TOO_LARGE")
    states = sources.groupBy("source_name").agg(F.max(F.struct("last_attempt_at", "last_success_at", "status")).alias("source_state"))
    rows = articles.join(held, "article_reference", "left").join(facts, "event_id", "left").join(shown, "event_id", "left").join(states, "source_name", "left")
    title, url = F.col("title"), F.col("source_url")
    provenance = R.provenance_valid(title, F.col("source_name"), url)
    verification = F.when(F.col("conflict"), "CONFLICTING_EVIDENCE").when(F.col("official_evidence_count") > 0, "OFFICIAL_PARTIAL").when(provenance, "SOURCE_REPORTED_ONLY").otherwise("NOT_VERIFIED")
    comparable = F.col("event_id").isNotNull() & R.ecb_decision(title, url) & F.lit(bool(ids))
    clocks = R.research_clocks(F.col("reported_at"), F.col("reported_time_kind"), F.col("observed_at"), F.lit(None).cast("string"), F.col("observation_time_basis"))
    proven = F.col("event_id").isNotNull() & (F.col("observation_time_basis") == "FIRST_RECORDED_SOURCE_OBSERVATION") & url.isNotNull()
    bridge = F.struct(
        F.lit("NEWS_EVENT_RESEARCH_BRIDGE_V1").alias("contract"), F.when(F.col("event_id").isNotNull(), "CANONICAL_EVENT").otherwise("NO_UNAMBIGUOUS_CANONICAL_EVENT").alias("event_identity_status"),
        F.col("event_id").alias("canonical_event_id"), title.alias("original_headline"), F.col("source_name").alias("publisher"), url.alias("source_url"),
        F.coalesce("reported_time_kind", F.lit("UNKNOWN")).alias("publication_time_basis"), clocks.alias("clocks"),
        F.coalesce("source_state.last_attempt_at", "source_state.last_success_at").alias("latest_provider_check_at"), F.coalesce("source_state.status", F.lit("UNKNOWN")).alias("latest_provider_status"),
        verification.alias("verification_status"), F.when(F.col("official_evidence_count") > 0, "PARTIAL_ARTICLE_COVERAGE;EACH_FACT_PROPOSITION_SCOPED").otherwise("NO_PROPOSITION_LINKED").alias("official_scope"),
        F.coalesce("official_propositions", F.array().cast("array<struct<official_evidence_id:string,proposition:string>>")).alias("official_propositions"),
        F.when(comparable, "SAME_POLICY_TOPIC").otherwise("NO_VALID_HISTORICAL_ANALOGUE").alias("research_relation"), F.when(comparable, F.array(*[F.lit(i) for i in ids])).otherwise(F.array().cast("array<string>")).alias("research_case_ids"),
        F.when(comparable, "HISTORICAL_ECB_DAILY_REFERENCE_AVAILABLE").otherwise("MARKET_OBSERVATION_NOT_AVAILABLE").alias("market_observation_status"),
        F.lit("NOT_ESTABLISHED").alias("causality_status"), F.lit("REQUIRES_GENUINE_RECORDED_HISTORY").alias("point_in_time_status"),
    )
    return rows.select(
        "article_reference", "event_id", S.macro_relevant(title).alias("macro_relevant"), F.coalesce(S.first_topic(title, TOPICS), F.lit("UNKNOWN")).alias("topic"), S.matched_terms(title, [p for _, p in TOPICS]).alias("matched_terms"),
        F.coalesce("official_evidence_count", F.lit(0)).alias("official_evidence_count"), provenance.alias("provenance_valid"), priority(title, S.instant(F.col("reported_at")), now, proven).alias("research_priority"), bridge.alias("event_triage"),
    )
