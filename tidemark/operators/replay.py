"""Events as they were known at an instant, rebuilt from stored payloads alone.

One plan serves all events: the version in force of every entity is one map-side combining aggregate, its binding then says which event
it belongs to, and payloads are read by name from VARIANT. Nothing comes from today's registry, files or later versions.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import canonical_json as C
from ..functions.redaction import public
from ..lineage import cut
from . import versions
from .ledger import KINDS, ORDER

#: The members of each payload that a frozen view copies.
EVENT = ["event_id", "event_title", "verification_status", "event_occurred_at", "first_detected_at", "latest_article_at", "geography_status", "geography", "event_geography"]
CONTEXT = ["context_geography", "institution_context", "headline_explanation"]
NEWS = ["article_reference", "title", "news_source", "observed_at", "reported_at", "reported_time_kind", "event_occurred_at", "verification_status"]
OFFICIAL = [
    "official_evidence_id", "authority_name", "authority_role", "document_title", "document_url", "document_reference", "fact_proposition", "published_at", "first_seen_at",
    "retrieved_at", "effective_at", "evidence_status", "canonical_event_id", "link_status",
]
MARKET = [
    "expectation_id", "provider", "authority_role", "market_id", "market_slug", "question", "outcomes", "probabilities", "probability_semantics", "observed_at", "market_close_time",
    "market_url", "link_status", "canonical_event_id", "link_method",
]
PARTS = ("news", "official_evidence", "market_expectations")
MOST = 512  # references of one kind that an event may hold
STALE_US = 900_000_000
PRIVATE = "tiingo"


def instant(as_of_us: int, short: bool = False) -> str:
    """An instant as text, with six digits of a second; ``short`` leaves out a zero fraction."""
    at = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=as_of_us)
    return at.replace(tzinfo=None).isoformat(timespec="auto" if short else "microseconds") + "Z"


def public_payload(payload: Column | str, private: str = PRIVATE) -> Column:
    """Whether an observation's payload may be shown."""
    return F.coalesce(C.using(C.parsed(payload), lambda d: public(d, private)), F.lit(False))


def admitted(rows: DataFrame, as_of_us: int) -> DataFrame:
    """Ledger rows up to an instant that a replay may use."""
    kind = F.col("observation_kind")
    hidden = (kind == "MARKET_OBSERVATION") | ((kind == "MARKET_REALITY") & ~public_payload("payload")) | ((kind == "SOURCE_STATE") & F.startswith("entity_id", F.lit("private_market:")))
    return rows.filter((F.col("observed_us") <= as_of_us) & ~hidden)


def visible(rows: DataFrame, as_of_us: int) -> DataFrame:
    """The versions in force at an instant, each under the event that it is bound to then (source states under none).

    Checkpointed, as every part of a rebuilt event reads it.
    """
    return cut(versions.latest(admitted(rows, as_of_us), KINDS, ORDER))


def _of(seen: DataFrame, kind: str) -> DataFrame:
    return seen.filter((F.col("observation_kind") == kind) & F.col("canonical_event_id").isNotNull())


def _last(rows: DataFrame, **fields: Column) -> DataFrame:
    """The last row's fields of each event."""
    picked = F.max_by(F.struct(*[c.alias(n) for n, c in fields.items()]), F.struct(*ORDER)).alias("_f")
    return rows.groupBy("canonical_event_id").agg(picked).select("canonical_event_id", "_f.*")


def events(seen: DataFrame) -> DataFrame:
    """(canonical_event_id, state, refs, context): the last state and the last context of each event, decoded."""

    def state(d: Column) -> Column:
        texts = F.struct(*[C.member_text(d, n).alias(n) for n in EVENT])
        names = ["event_id", "verification_status", "geography_status", "event_occurred_at"]
        return F.struct(*[C.member(d, n).alias(n) for n in names], C.member(d, "article_references", "array<string>").alias("refs"), texts.alias("texts"))

    context = lambda d: F.struct(*[C.member_text(d, n).alias(n) for n in [*CONTEXT, "contract_version"]])
    states = _last(_of(seen, "CANONICAL_EVENT_STATE"), payload=F.col("payload")).select("canonical_event_id", C.using(C.parsed("payload"), state).alias("state"))
    contexts = _last(_of(seen, "CONTEXT_GEOGRAPHY"), payload=F.col("payload")).select("canonical_event_id", C.using(C.parsed("payload"), context).alias("context"))
    return states.join(contexts, "canonical_event_id", "left").withColumn("refs", F.col("state.refs"))


def evidence(seen: DataFrame, held: DataFrame) -> DataFrame:
    """(canonical_event_id, part, observation_id, ident, row, whole, timeless, unpriced): the news, facts and markets that an event's last state may rest on."""

    def shaped(kind: str, part: str, ident: str, names: list[str], dated: str, accepted: dict[str, str], where_present: list[str] = ()) -> DataFrame:
        def decode(d: Column) -> Column:
            good = F.lit(True)
            for name, value in accepted.items():
                good = good & C.member(d, name).eqNullSafe(F.lit(value))
            unpriced = F.coalesce(F.exists(C.member(d, "probabilities", "array<string>"), lambda p: p.isNull()), F.lit(True))
            return F.struct(
                good.alias("good"), C.member(d, "canonical_event_id").alias("event"), C.member(d, ident).alias("ident"), C.allow_listed(d, names, where_present).alias("row"),
                F.to_json(d).alias("whole"), (C.member_text(d, dated) == "null").alias("timeless"), unpriced.alias("unpriced"),
            )

        rows = _of(seen, kind).select("canonical_event_id", "entity_id", "observation_id", F.lit(part).alias("part"), C.using(C.parsed("payload"), decode).alias("d"))
        return rows.filter("d.good")

    news = shaped("NEWS_ARTICLE", "news", "article_reference", NEWS, "reported_at", {"verification_status": "UNVERIFIED_NEWS"})
    wanted = held.select("canonical_event_id", F.explode(F.array_distinct("refs")).alias("entity_id"))
    own = F.col("d.event") == F.col("canonical_event_id")
    facts = shaped("OFFICIAL_EVIDENCE", "official_evidence", "official_evidence_id", OFFICIAL, "published_at", {"authority_role": "FACT_AUTHORITY", "evidence_status": "OFFICIAL_CONFIRMED"})
    markets = shaped("MARKET_EXPECTATION", "market_expectations", "expectation_id", MARKET, "market_close_time", {"authority_role": "EXPECTATION_SENSOR", "link_status": "LINKED"}, ["event_expectation_link"])
    stated = held.select("canonical_event_id")
    out = news.join(wanted, ["canonical_event_id", "entity_id"], "left_semi").unionByName(facts.filter(own).unionByName(markets.filter(own)).join(stated, "canonical_event_id", "left_semi").select(news.columns))
    return out.select("canonical_event_id", "part", "observation_id", "d.ident", "d.row", "d.whole", "d.timeless", "d.unpriced")


def history(rows: DataFrame, as_of_us: int, seen: DataFrame | None = None) -> DataFrame:
    """(canonical_event_id, observation_kind, entity_id, observation_id, observed_us, active_at_as_of): every row up to the instant that is bound to an event that has a
    state by then, and whether the event as of then rests on it."""
    seen = seen or visible(rows, as_of_us)
    held = events(seen)
    whole = seen.filter(F.col("observation_kind").isin("CANONICAL_EVENT_STATE", "CONTEXT_GEOGRAPHY", "MARKET_REALITY")).select("observation_id")
    active = whole.unionByName(evidence(seen, held).select("observation_id")).distinct().withColumn("_a", F.lit(True))
    past = admitted(rows, as_of_us).join(held.select("canonical_event_id"), "canonical_event_id", "left_semi")
    out = past.join(active, "observation_id", "left")
    return out.select("canonical_event_id", *KINDS, "observation_id", "observed_us", F.coalesce("_a", F.lit(False)).alias("active_at_as_of"))


def market_state(rows: DataFrame, as_of_us: int, seen: DataFrame | None = None, in_basis_points: tuple[str, ...] = ("US10Y",)) -> DataFrame:
    """(canonical_event_id, market_reality): for each event and symbol the price in force, its status and its changes, as an array of structs sorted by symbol.

    A market time must lie within the instant; a price older than 900 s is STALE and null. Changes are against the last price at or before the event's first own row, if it was as
    fresh then, and against the previous close, in percent or, for yields, basis points.
    """

    def quote(d: Column) -> Column:
        micros = lambda path: F.unix_micros(F.try_to_timestamp(F.try_variant_get(d, path, "string")))
        number = lambda path: F.try_variant_get(d, path, "double")
        return F.struct(
            C.member(d, "symbol").alias("symbol"), micros("$.market_timestamp").alias("market_us"), number("$.price_or_level").alias("price"), number("$.previous_close.price_or_level").alias("prior"),
            micros("$.previous_close.market_timestamp").alias("prior_us"), micros("$.previous_close.observed_at").alias("prior_known"),
        )

    seen = seen or visible(rows, as_of_us)
    anchors = _of(admitted(rows, as_of_us), "CANONICAL_EVENT_STATE").groupBy("canonical_event_id").agg(F.min("observed_us").alias("anchor"))
    quotes = _of(seen, "MARKET_REALITY").select("canonical_event_id", F.col("observed_us").alias("known_us"), "observation_id", C.using(C.parsed("payload"), quote).alias("q"))
    quotes = quotes.select("canonical_event_id", "known_us", "observation_id", "q.*")
    within = quotes.join(anchors, "canonical_event_id").filter((F.col("market_us") <= as_of_us) & F.col("symbol").isNotNull())
    order, row = F.struct("market_us", "known_us", "observation_id"), F.struct("market_us", "price", "prior", "prior_us", "prior_known")
    early = (F.col("known_us") <= F.col("anchor")) & (F.col("market_us") <= F.col("anchor"))
    per = within.groupBy("canonical_event_id", "symbol", "anchor").agg(F.max_by(row, order).alias("r"), F.max_by(F.when(early, row), F.when(early, order)).alias("b"))
    fresh = F.lit(as_of_us) - F.col("r.market_us") <= STALE_US
    price = F.when(fresh, F.col("r.price"))
    change = lambda before: F.when(F.col("symbol").isin(*in_basis_points), (price - before) * 100).when(before != 0, (price / before - 1) * 100)
    base = F.when(F.col("anchor") - F.col("b.market_us") <= STALE_US, F.col("b.price"))
    prior = F.when((F.col("r.prior_us") <= as_of_us) & (F.col("r.prior_known") <= as_of_us), F.col("r.prior"))
    item = F.struct(
        "symbol", price.alias("price_or_level"), F.when(fresh, "AVAILABLE").otherwise("STALE").alias("availability_status"),
        change(base).alias("change_since_event"), change(prior).alias("change_from_previous_close"),
    )
    return per.groupBy("canonical_event_id").agg(F.array_sort(F.collect_list(item)).alias("market_reality"))


def rebuild(rows: DataFrame, as_of_us: int, asked: DataFrame | None = None, freeze_key: str | None = None, seen: DataFrame | None = None, payload: bool = False) -> DataFrame:
    """One row an event as it stood at an instant: replay_status, unknowns, event, news, official_evidence, market_expectations (canonical texts), their ids,
    fact_state, expectation_state, snapshot_sha256 and macroview_id; with ``payload`` also the frozen view's own canonical text.

    Without ``asked`` (canonical_event_id), all events that have a row by then. NO_OBSERVATIONS: no state of the event; PARTIAL_OBSERVATIONS: its references are
    not all observed, disagree, are none or more than 512 of a kind; the arrays are then null. Only events within the bound are gathered in arrays.
    """
    seen = seen or visible(rows, as_of_us)
    if asked is None:
        asked = admitted(rows, as_of_us).filter("observation_kind <> 'SOURCE_STATE' and canonical_event_id is not null")
    asked = asked.select("canonical_event_id").distinct()
    held = events(seen)
    proof = evidence(seen, held)
    # what no reference names is passed over; copies that agree are one
    named_news = held.select("canonical_event_id", F.explode(F.array_distinct("refs")).alias("ident"), F.lit("news").alias("part"))
    proof = proof.join(named_news.withColumn("_named", F.lit(True)), ["canonical_event_id", "part", "ident"], "left").filter("part <> 'news' or _named").drop("_named")
    single = proof.groupBy("canonical_event_id", "part", "ident").agg(
        F.min("row").alias("row"), F.max("timeless").alias("timeless"), F.max("unpriced").alias("unpriced"), F.count_distinct("whole").alias("copies")
    )
    single = cut(single)  # counted first, then gathered
    counts = single.groupBy("canonical_event_id").agg(
        *[F.count_if(F.col("part") == p).alias(f"n_{p}") for p in PARTS], F.max("copies").alias("copies"), F.count_if(F.coalesce(F.col("ident") == "", F.lit(True))).alias("nameless"),
    )
    judged = held.join(counts, "canonical_event_id", "left")
    for c in ("n_news", "n_official_evidence", "n_market_expectations", "nameless"):
        judged = judged.withColumn(c, F.coalesce(c, F.lit(0)))
    sound = (
        (F.col("state.event_id") == F.col("canonical_event_id")) & (F.col("state.verification_status") == "UNVERIFIED_NEWS") & F.col("refs").isNotNull()
        & F.size("refs").between(1, MOST) & ~F.exists("refs", lambda r: r.isNull() | (r == "")) & (F.greatest("n_official_evidence", "n_market_expectations") <= MOST) & (F.coalesce("copies", F.lit(1)) == 1) & (F.col("nameless") == 0)
    )
    judged = judged.withColumn("sound", F.coalesce(sound, F.lit(False)))
    named = F.struct("ident", "row", "timeless", "unpriced")
    gathered = single.join(judged.filter("sound").select("canonical_event_id"), "canonical_event_id", "left_semi").groupBy("canonical_event_id").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("part") == p, named))).alias(p) for p in PARTS]
    )
    out = asked.join(judged.join(gathered, "canonical_event_id", "left"), "canonical_event_id", "left")
    key = freeze_key or "REPLAY_AS_OF/" + instant(as_of_us)
    held_parts = {p: F.coalesce(p, F.array().cast("array<struct<ident:string,row:string,timeless:boolean,unpriced:boolean>>")).alias(p) for p in PARTS}
    given = F.struct("canonical_event_id", "state", "context", "sound", *held_parts.values())
    out = out.select("canonical_event_id", F.col("state").isNotNull().alias("stated"), C.using(given, lambda g: _assembled(g, key, instant(as_of_us, True), payload)).alias("v"))
    status = F.when(~F.col("stated"), "NO_OBSERVATIONS").when(F.col("v").isNotNull(), "AVAILABLE").otherwise("PARTIAL_OBSERVATIONS")
    reason = F.when(~F.col("stated"), F.array(F.lit("EVENT_NOT_OBSERVED_AT_AS_OF"))).otherwise(F.coalesce("v.unknowns", F.array(F.lit("REFERENCED_NEWS_NOT_OBSERVED"))))
    shown = ["event", *PARTS, "news_article_references", "official_evidence_ids", "market_expectation_ids", "fact_state", "expectation_state", "snapshot_sha256", "macroview_id", *(["payload"] if payload else [])]
    return out.select("canonical_event_id", status.alias("replay_status"), reason.alias("unknowns"), *[F.col(f"v.{c}").alias(c) for c in shown])


def _assembled(g: Column, key: str, frozen_at: str, payload: bool) -> Column:
    """The frozen view of one event of parts ``g``, or null where its references are not all there; every text is worked out once."""
    ids = {p: F.transform(g[p], lambda r: r["ident"]) for p in PARTS}
    rows = {p: F.transform(g[p], lambda r: r["row"]) for p in PARTS}
    whole = F.coalesce(g["sound"] & (ids["news"] == F.array_sort(F.array_distinct(g["state"]["refs"]))), F.lit(False))
    state, context, none = g["state"], g["context"], F.lit("null")
    texts = {n: state["texts"][n] for n in EVENT} | {n: F.coalesce(context[n], none) for n in CONTEXT} | {"context_contract": F.coalesce(context["contract_version"], none)}
    any_of = lambda p, flag: F.exists(g[p], lambda r: r[flag])
    empty = lambda p: F.size(g[p]) == 0
    unknowns = F.array_compact(F.array(
        F.when(state["event_occurred_at"].isNull(), "EVENT_OCCURRENCE_TIME_UNKNOWN"), F.when(~F.coalesce(state["geography_status"].isin("KNOWN", "MAPPED"), F.lit(False)), "GEOGRAPHY_UNKNOWN"),
        F.when(empty("official_evidence"), "NO_OFFICIAL_EVIDENCE"), F.when(empty("market_expectations"), "NO_LINKED_MARKET_EXPECTATION"),
        F.when(any_of("news", "timeless"), "NEWS_REPORTED_TIME_UNKNOWN"), F.when(any_of("official_evidence", "timeless"), "OFFICIAL_PUBLICATION_TIME_UNKNOWN"),
        F.when(any_of("market_expectations", "timeless"), "MARKET_CLOSE_TIME_UNKNOWN"), F.when(any_of("market_expectations", "unpriced"), "MARKET_PROBABILITIES_UNKNOWN"),
    ))
    fact_state = F.when(empty("official_evidence"), "NEWS_ONLY").otherwise("PARTIAL_OFFICIAL_EVIDENCE")
    expectation_state = F.when(empty("market_expectations"), "NONE").otherwise("EXPECTATION_PRESENT")

    def frozen(t: Column) -> Column:
        snapshot = C.object_text({"event": t["event"], **{p: t[p] for p in PARTS}})
        digest = lambda text: C.quoted(F.sha2(text, 256))
        list_text = lambda items: C.array_text(F.transform(items, lambda i: C.quoted(i)))

        def sealed(s: Column) -> Column:
            provenance = {"snapshot_sha256": digest(s), "news_sha256": digest(t["news"]), "official_sha256": digest(t["official_evidence"]), "expectation_sha256": digest(t["market_expectations"])}
            body = {
                "contract_version": F.lit('"MACROVIEW_FREEZE_V0"'), "canonical_event_id": C.quoted(g["canonical_event_id"]), "freeze_key": C.quoted(F.lit(key)), "frozen_at": C.quoted(F.lit(frozen_at)),
                "news_article_references": list_text(ids["news"]), "official_evidence_ids": list_text(ids["official_evidence"]), "market_expectation_ids": list_text(ids["market_expectations"]),
                "fact_state": C.quoted(fact_state), "expectation_state": C.quoted(expectation_state), "unknowns": list_text(unknowns), "snapshot": s, "provenance": C.object_text(provenance),
            }
            named = F.concat(F.lit("macroview-freeze-v0-"), F.sha2(C.object_text(body), 256))
            whole_text = [C.object_text(body | {"macroview_id": C.quoted(named)}).alias("payload")] if payload else []
            return F.struct(F.sha2(s, 256).alias("snapshot_sha256"), named.alias("macroview_id"), *whole_text)

        return C.using(C.using(snapshot, sealed), lambda z: F.struct(
            t["event"].alias("event"), *[rows[p].alias(p) for p in PARTS], ids["news"].alias("news_article_references"), ids["official_evidence"].alias("official_evidence_ids"),
            ids["market_expectations"].alias("market_expectation_ids"), fact_state.alias("fact_state"), expectation_state.alias("expectation_state"), unknowns.alias("unknowns"),
            z["snapshot_sha256"].alias("snapshot_sha256"), z["macroview_id"].alias("macroview_id"),
            *([z["payload"].alias("payload")] if payload else []),
        ))

    texts_of = F.struct(C.object_text(texts).alias("event"), *[C.array_text(rows[p]).alias(p) for p in PARTS])
    return F.when(whole, C.using(texts_of, frozen))


def research(rows: DataFrame, as_of_us: int, asked: DataFrame | None = None) -> DataFrame:
    """``rebuild`` with what a researcher may know at the instant: the articles' recorded clocks, the versions of the evidence, the market and the facts in force.

    detection: one struct an article of the event (entity, first and last recorded, versions); evidence_versions: how many versions the event's articles have and how many of them are in force.
    """
    seen = visible(rows, as_of_us)
    out = rebuild(rows, as_of_us, asked, seen=seen)
    past = history(rows, as_of_us, seen)
    news = past.filter("observation_kind = 'NEWS_ARTICLE'")
    clocks = news.groupBy("canonical_event_id", "entity_id").agg(F.min("observed_us").alias("first_us"), F.max("observed_us").alias("last_us"), F.count("*").alias("versions"), F.count_if("active_at_as_of").alias("active"))
    one = F.struct("entity_id", "first_us", "last_us", "versions")
    known = clocks.groupBy("canonical_event_id").agg(
        F.when(F.count("*") <= MOST, F.array_sort(F.collect_list(F.when(F.col("active") > 0, one)))).alias("detection"), F.sum("versions").alias("evidence_versions"), F.sum("active").alias("evidence_in_force")
    )
    facts = past.filter("observation_kind = 'OFFICIAL_EVIDENCE' and active_at_as_of").groupBy("canonical_event_id").agg(F.count("*").alias("official_propositions"))
    for part in (known, facts, market_state(rows, as_of_us, seen)):
        out = out.join(part, "canonical_event_id", "left")
    return out.withColumn("macroview_authority", F.lit("NON_AUTHORITATIVE_CURRENT_RULES_ON_ASOF_EVIDENCE;NOT_RECORDED_FORECAST"))
