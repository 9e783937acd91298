"""Named queries over what was known at an instant: ledger rows of nine kinds derived from the events table, replayed and rebuilt."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import canonical_json as C
from ..functions.lexicons import TOPICS
from ..lineage import shared_folder
from ..operators import assembly, canonical, freezes, replay
from ..streaming import polls
from .catalog import AS_OF, NOW, _ntz, _query, _read
from .views import _ARTICLES, _VALID, _articles, _quoted, bank_decision_sql

AT_US = 1705752000000000  # AS_OF in microseconds
KIND = ["CANONICAL_EVENT_STATE", "NEWS_ARTICLE", "NEWS_ARTICLE", "OFFICIAL_EVIDENCE", "MARKET_EXPECTATION", "CONTEXT_GEOGRAPHY", "SOURCE_STATE", "MARKET_REALITY", "NEWS_ARTICLE"]


def _pairs(**members: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in members.items()]), {"ignoreNullFields": "false"})


def ledger_rows(spark, sf_dir) -> DataFrame:
    """Each user is an event with a state, articles, facts, an expectation, a context and prices, in many versions; some versions are bound to the next user."""
    n, user = F.col("event_id"), F.col("user_id")
    step = n % 9
    kind = F.element_at(F.array(*[F.lit(k) for k in KIND]), (step + 1).cast("int"))
    event = lambda u: F.concat(F.lit("E"), u.cast("string"))
    bound = F.when(step == 6, None).otherwise(event(F.when(n % 11 == 0, user + 1).otherwise(user)))
    name = F.concat(event(user), F.lit("-"), F.lower(F.substring(kind, 1, 1)), F.when(step == 3, n % 2).when(step.isin(1, 2, 8), n % 3).when(step == 7, n % 2).otherwise(0).cast("string"))
    ref = lambda i: F.concat(event(user), F.lit(f"-n{i}"))
    refs = F.when(n % 4 == 0, F.array(ref(0), ref(1))).when(n % 4 == 1, F.array(ref(1))).when(n % 4 == 2, F.array(ref(2), ref(0), ref(2))).otherwise(F.array().cast("array<string>"))
    iso = lambda at: F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    title = F.concat(F.lit("T"), n.cast("string"))
    none = F.lit(None).cast("string")
    payload = (
        F.when(step == 0, _pairs(event_id=bound, event_title=title, verification_status=F.lit("UNVERIFIED_NEWS"), article_references=refs, geography_status=F.when(n % 2 == 0, "KNOWN").otherwise("UNKNOWN"), event_occurred_at=F.when(n % 5 == 0, "2024-01-01T00:00:00Z")))
        .when(step.isin(1, 2, 8), _pairs(article_reference=name, title=title, verification_status=F.when(n % 13 == 0, "OTHER").otherwise("UNVERIFIED_NEWS"), reported_at=F.when(n % 2 == 0, iso(F.col("ts"))), news_source=F.struct(F.lit("b").alias("url"), F.lit("a").alias("name"))))
        .when(step == 3, _pairs(official_evidence_id=name, canonical_event_id=bound, authority_role=F.lit("FACT_AUTHORITY"), evidence_status=F.when(n % 7 == 0, "DRAFT").otherwise("OFFICIAL_CONFIRMED"), published_at=F.when(n % 4 == 0, none).otherwise("2024-01-01T00:00:00Z")))
        .when(step == 4, _pairs(expectation_id=name, canonical_event_id=bound, authority_role=F.lit("EXPECTATION_SENSOR"), link_status=F.when(n % 3 == 0, "UNLINKED").otherwise("LINKED"), probabilities=F.array(F.col("value").cast("string"), F.when(n % 2 == 0, "0.5")), market_close_time=F.lit("2030-01-01T00:00:00Z")))
        .when(step == 5, _pairs(context_geography=F.struct(F.col("event_type").alias("region"), F.lit(1).alias("a")), institution_context=F.array(F.lit("ECB")), headline_explanation=none, contract_version=F.lit("C1")))
        .when(step == 7, _pairs(symbol=F.when(n % 2 == 0, "US10Y").otherwise("OIL"), price_or_level=F.col("value"), market_timestamp=iso(F.col("ts")), data_usage_scope=F.when(n % 5 == 0, "PRIVATE_RESEARCH_ONLY").otherwise("PUBLIC_REDISTRIBUTABLE"), provider=F.when(n % 17 == 0, "Tiingo").otherwise("exchange"), source=F.struct(F.lit("s").alias("name"), F.when(n % 19 == 0, "https://api.tiingo.com/x").alias("url"))))
        .otherwise(_pairs(status=F.col("event_type")))
    )
    return _read(spark, sf_dir, "events").select(
        F.lpad(n.cast("string"), 12, "0").alias("observation_id"), kind.alias("observation_kind"), name.alias("entity_id"), bound.alias("canonical_event_id"),
        canonical.micros(F.col("ts")).alias("observed_us"), payload.alias("payload"),
    )


_STEP = "event_id % 9"
_ROWS = f"""r AS (
  SELECT event_id, {_STEP} AS step, ts, value, event_type, user_id, CASE WHEN {_STEP} = 6 THEN NULL ELSE 'E' || CASE WHEN event_id % 11 = 0 THEN user_id + 1 ELSE user_id END END AS event,
         'E' || user_id || '-' || CASE WHEN {_STEP} IN (1, 2, 8) THEN 'n' || event_id % 3 WHEN {_STEP} = 3 THEN 'o' || event_id % 2 WHEN {_STEP} = 7 THEN 'm' || event_id % 2 WHEN {_STEP} = 4 THEN 'm0' WHEN {_STEP} = 6 THEN 's0' ELSE 'c0' END AS entity,
         CASE WHEN {_STEP} IN (1, 2, 8) THEN 'N' WHEN {_STEP} = 0 THEN 'S' WHEN {_STEP} = 3 THEN 'O' WHEN {_STEP} = 4 THEN 'M' WHEN {_STEP} = 5 THEN 'C' WHEN {_STEP} = 6 THEN 'X' ELSE 'R' END AS kind
  FROM events WHERE ts <= TIMESTAMP '{AS_OF}' AND NOT ({_STEP} = 7 AND (event_id % 5 = 0 OR event_id % 17 = 0 OR event_id % 19 = 0))),
v AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY kind, entity ORDER BY ts DESC, event_id DESC) = 1),
s AS (SELECT event, event_id, user_id, CASE event_id % 4 WHEN 0 THEN ['E' || user_id || '-n0', 'E' || user_id || '-n1'] WHEN 1 THEN ['E' || user_id || '-n1'] WHEN 2 THEN ['E' || user_id || '-n0', 'E' || user_id || '-n2'] ELSE [] END AS refs
      FROM v WHERE kind = 'S' QUALIFY row_number() OVER (PARTITION BY event ORDER BY ts DESC, event_id DESC) = 1),
c AS (SELECT event, event_type FROM v WHERE kind = 'C' QUALIFY row_number() OVER (PARTITION BY event ORDER BY ts DESC, event_id DESC) = 1),
e AS (SELECT v.event, v.kind, v.entity, v.event_id FROM v JOIN s ON s.event = v.event WHERE (v.kind = 'N' AND v.event_id % 13 <> 0 AND list_contains(s.refs, v.entity)) OR (v.kind = 'O' AND v.event_id % 7 <> 0) OR (v.kind = 'M' AND v.event_id % 3 <> 0))"""
_REBUILT = f"""{_ROWS},
n AS (SELECT event, count(*) FILTER (WHERE kind = 'N') AS news, count(*) FILTER (WHERE kind = 'O') AS official, count(*) FILTER (WHERE kind = 'M') AS markets,
  string_agg('T' || event_id, ',' ORDER BY entity) FILTER (WHERE kind = 'N') AS titles, bool_or(kind = 'N' AND event_id % 2 <> 0) AS undated, bool_or(kind = 'O' AND event_id % 4 = 0) AS unpublished, bool_or(kind = 'M' AND event_id % 2 <> 0) AS unpriced FROM e GROUP BY 1),
a AS (SELECT DISTINCT event FROM r WHERE event IS NOT NULL),
j AS (SELECT a.event, s.event_id, s.refs, coalesce(news, 0) AS news, coalesce(official, 0) AS official, coalesce(markets, 0) AS markets, titles, undated, unpublished, unpriced, c.event_type AS region,
  CASE WHEN s.event IS NULL THEN 'NO_OBSERVATIONS' WHEN len(s.refs) > 0 AND coalesce(news, 0) = len(s.refs) THEN 'AVAILABLE' ELSE 'PARTIAL_OBSERVATIONS' END AS status
  FROM a LEFT JOIN s ON s.event = a.event LEFT JOIN n ON n.event = a.event LEFT JOIN c ON c.event = a.event)"""


@_query(f"""WITH {_REBUILT}
SELECT event AS canonical_event_id, status AS replay_status, CASE WHEN status = 'AVAILABLE' THEN 'T' || event_id END AS title, CASE WHEN status = 'AVAILABLE' THEN titles END AS titles,
CASE WHEN status = 'AVAILABLE' THEN official END AS official, CASE WHEN status = 'AVAILABLE' THEN markets END AS markets, CASE WHEN status = 'AVAILABLE' THEN region END AS region,
CASE status WHEN 'NO_OBSERVATIONS' THEN 'EVENT_NOT_OBSERVED_AT_AS_OF' WHEN 'PARTIAL_OBSERVATIONS' THEN 'REFERENCED_NEWS_NOT_OBSERVED' ELSE concat_ws(',', CASE WHEN event_id % 5 <> 0 THEN 'EVENT_OCCURRENCE_TIME_UNKNOWN' END,
CASE WHEN event_id % 2 <> 0 THEN 'GEOGRAPHY_UNKNOWN' END, CASE WHEN official = 0 THEN 'NO_OFFICIAL_EVIDENCE' END, CASE WHEN markets = 0 THEN 'NO_LINKED_MARKET_EXPECTATION' END, CASE WHEN undated THEN 'NEWS_REPORTED_TIME_UNKNOWN' END,
CASE WHEN unpublished THEN 'OFFICIAL_PUBLICATION_TIME_UNKNOWN' END, CASE WHEN unpriced THEN 'MARKET_PROBABILITIES_UNKNOWN' END) END AS unknowns FROM j""")
def replay_rebuilt(spark, sf_dir):
    out = replay.rebuild(ledger_rows(spark, sf_dir), AT_US)
    titles = F.array_join(F.transform("news", lambda r: F.get_json_object(r, "$.title")), ",")
    number = lambda c: F.when(F.col(c).isNotNull(), F.size(c).cast("long"))
    return out.select(
        "canonical_event_id", "replay_status", F.get_json_object("event", "$.event_title").alias("title"), titles.alias("titles"), number("official_evidence").alias("official"),
        number("market_expectations").alias("markets"), F.get_json_object("event", "$.context_geography.region").alias("region"), F.array_join("unknowns", ",").alias("unknowns"),
    )


# of five events one is stored whole with another text, one with another digest of its view, one with another text and its digest

_DAMAGED = "user_id % 5 IN (0, 1, 2)"


@_query(f"""WITH {_REBUILT}, k AS (SELECT j.*, user_id FROM j JOIN s USING (event) WHERE status = 'AVAILABLE')
SELECT event AS canonical_event_id, 1 AS place, CASE WHEN {_DAMAGED} THEN 'FREEZE_INTEGRITY_FAILED' END AS fault, CASE WHEN NOT ({_DAMAGED}) THEN CASE WHEN official = 0 THEN 'NEWS_ONLY' ELSE 'PARTIAL_OFFICIAL_EVIDENCE' END END AS fact_state,
CASE WHEN NOT ({_DAMAGED}) THEN CASE WHEN markets = 0 THEN 'NONE' ELSE 'EXPECTATION_PRESENT' END END AS expectation_state FROM k""")
def freeze_list(spark, sf_dir):
    made = freezes.frozen(ledger_rows(spark, sf_dir), AT_US, AT_US + 1, "DAILY")
    user = F.get_json_object(F.get_json_object("payload", "$.snapshot.event"), "$.event_title")
    titles = _read(spark, sf_dir, "events").select(F.concat(F.lit("T"), F.col("event_id").cast("string")).alias("_title"), (F.col("user_id") % 5).alias("_kind"))
    rows = made.withColumn("_title", user).join(titles, "_title")
    other = F.concat("payload", F.lit(" "))
    renamed = F.replace("payload", F.lit('"freeze_key":"DAILY"'), F.lit('"freeze_key":"WEEKLY"'))
    rows = rows.withColumn("payload", F.when(F.col("_kind") == 0, other).when(F.col("_kind") == 2, renamed).otherwise(F.col("payload")))
    rows = rows.withColumn("payload_sha256", F.when(F.col("_kind") == 2, F.sha2("payload", 256)).otherwise(F.col("payload_sha256")))
    rows = rows.withColumn("snapshot_sha256", F.when(F.col("_kind") == 1, F.sha2("snapshot_sha256", 256)).otherwise(F.col("snapshot_sha256")))
    return freezes.listed(rows.drop("_title", "_kind")).select("canonical_event_id", F.col("place").cast("int").alias("place"), "fault", "fact_state", "expectation_state")


@_query(f"""WITH {_ROWS}, u AS (SELECT event_id FROM e UNION ALL SELECT event_id FROM v WHERE kind IN ('S', 'C', 'R'))
SELECT r.event AS canonical_event_id, r.event_id, u.event_id IS NOT NULL AS active_at_as_of FROM r JOIN s ON s.event = r.event LEFT JOIN u ON u.event_id = r.event_id""")
def replay_history(spark, sf_dir):
    out = replay.history(ledger_rows(spark, sf_dir), AT_US)
    return out.select("canonical_event_id", F.col("observation_id").cast("long").alias("event_id"), "active_at_as_of")


@_query(f"""WITH {_ROWS}, a AS (SELECT event, min(ts) AS anchor FROM r WHERE kind = 'S' GROUP BY 1),
q AS (SELECT r.event, r.event_id % 2 = 0 AS yield, r.ts, date_trunc('second', r.ts) AS made, r.event_id, r.value, a.anchor FROM v r JOIN a ON a.event = r.event WHERE r.kind = 'R'),
l AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY event, yield ORDER BY made DESC, ts DESC, event_id DESC) = 1)
SELECT event AS canonical_event_id, CASE WHEN yield THEN 'US10Y' ELSE 'OIL' END AS symbol, CASE WHEN made >= TIMESTAMP '{AS_OF}' - INTERVAL 900 SECOND THEN 'AVAILABLE' ELSE 'STALE' END AS status,
CASE WHEN made >= TIMESTAMP '{AS_OF}' - INTERVAL 900 SECOND THEN value END AS price FROM l""")
def replay_market_state(spark, sf_dir):
    rows = replay.market_state(ledger_rows(spark, sf_dir), AT_US).select("canonical_event_id", F.explode("market_reality").alias("m"))
    return rows.select("canonical_event_id", F.col("m.symbol").alias("symbol"), F.col("m.availability_status").alias("status"), F.col("m.price_or_level").alias("price"))


@_query(f"""WITH {_REBUILT}, f AS (SELECT event, count(*) AS facts FROM e WHERE kind = 'O' GROUP BY 1),
w AS (SELECT r.event, r.entity, count(*) AS versions, count(x.event_id) AS active FROM r JOIN s ON s.event = r.event LEFT JOIN e x ON x.event_id = r.event_id AND x.event = r.event WHERE r.kind = 'N' GROUP BY 1, 2),
k AS (SELECT event, CAST(sum(versions) AS BIGINT) AS evidence_versions, CAST(sum(active) AS BIGINT) AS evidence_in_force, string_agg(entity || ':' || versions, ',' ORDER BY entity) FILTER (WHERE active > 0) AS detection FROM w GROUP BY 1)
SELECT j.event AS canonical_event_id, status AS replay_status, f.facts AS official_propositions, k.evidence_versions, k.evidence_in_force, k.detection FROM j LEFT JOIN f ON f.event = j.event LEFT JOIN k ON k.event = j.event""")
def research_known(spark, sf_dir):
    out = replay.research(ledger_rows(spark, sf_dir), AT_US)
    clocks = F.array_join(F.transform("detection", lambda d: F.concat_ws(":", d["entity_id"], d["versions"].cast("string"))), ",")
    return out.select("canonical_event_id", "replay_status", "official_propositions", "evidence_versions", "evidence_in_force", F.when(clocks != "", clocks).alias("detection"))


# The view

@_query("""WITH o AS (SELECT o_custkey AS e, count(*) AS articles, array_to_string(list_slice(list(o_orderkey ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR)), 1, 3), ',') AS first FROM orders GROUP BY 1),
f AS (SELECT user_id AS e, count(*) FILTER (WHERE event_type = 'purchase') AS official, bool_or(event_type = 'purchase' AND event_id % 50 = 0) AS conflict, count(*) FILTER (WHERE event_type = 'click' AND event_id % 3 <> 0) AS expectations,
count(*) FILTER (WHERE event_type = 'signup' AND event_id % 4 = 0) AS points, count(*) FILTER (WHERE event_type = 'view') AS prices, count(DISTINCT event_id % 7 < 6) FILTER (WHERE event_type = 'view') AS anchors FROM events GROUP BY 1)
SELECT CAST(c_custkey AS VARCHAR) AS event_id, coalesce(articles, 0) AS articles, coalesce(first, '') AS first, coalesce(official, 0) AS official, coalesce(expectations, 0) AS expectations,
CASE WHEN conflict THEN 'CONFLICTING_EVIDENCE' WHEN official > 0 THEN 'OFFICIAL_PARTIAL' WHEN articles > 0 THEN 'SOURCE_REPORTED_ONLY' ELSE 'NOT_VERIFIED' END AS verification, CASE WHEN points > 0 THEN 'KNOWN' ELSE 'UNKNOWN' END AS geography,
CASE WHEN coalesce(prices, 0) = 0 THEN 'NO_OBSERVATIONS' WHEN anchors > 1 THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END AS market FROM customer LEFT JOIN o ON o.e = c_custkey LEFT JOIN f ON f.e = c_custkey""")
def event_view(spark, sf_dir):
    """Customers as events: orders are their articles, what they did is evidence, expectations, places and prices."""
    did = _read(spark, sf_dir, "events").withColumn("event_id_", F.col("user_id"))
    of = lambda kind, **cols: did.filter(F.col("event_type") == kind).select(F.col("event_id_").alias("event_id"), *[c.alias(n) for n, c in cols.items()])
    n = F.col("event_id")
    out = assembly.events_view(
        _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("event_id"), F.col("c_name").alias("event_title")),
        _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("article_reference"), F.col("o_custkey").alias("event_id"), F.col("o_orderstatus").alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("published")),
        of("purchase", official_evidence_id=n, evidence_status=F.lit("OFFICIAL_CONFIRMED"), link_status=F.when(n % 50 == 0, "CONFLICTING_EVIDENCE_COPIES").otherwise("LINKED"), proposition=F.lit("p")),
        of("click", expectation_id=n, link_status=F.when(n % 3 != 0, "LINKED").otherwise("UNLINKED"), question=F.lit("q")), of("signup", geography_id=n, place_name=F.lit("x")).filter("geography_id % 4 = 0"),
        of("view", symbol=n, anchor=F.when(n % 7 < 6, "t0").otherwise("t1"), status=F.lit("AVAILABLE")), most=3,
    )
    first = F.array_join(F.transform("articles", lambda a: F.get_json_object(a, "$.article_reference")), ",")
    return out.select(
        "event_id", F.col("articles_count").alias("articles"), first.alias("first"), F.col("official_evidence_count").alias("official"), F.col("market_expectations_count").alias("expectations"),
        F.col("verification_status").alias("verification"), F.col("geography_status").alias("geography"), F.col("market_status").alias("market"),
    )


def _topic_sql() -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(title, {_quoted('(?i)' + p)}) THEN '{name}'" for name, p in TOPICS) + " ELSE 'UNKNOWN' END"


@_query(f"""WITH {_ARTICLES}, m AS (SELECT p_partkey AS ref, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS event FROM part),
o AS (SELECT p_brand AS event, count(*) AS facts, bool_or(p_partkey % 300 = 0) AS conflict FROM part WHERE p_partkey % 30 = 0 GROUP BY 1),
t AS (SELECT a.*, m.event, coalesce(o.facts, 0) AS facts, o.conflict, {_VALID} AS valid, {bank_decision_sql()} AS decision, TIMESTAMP '{NOW}' - INTERVAL 1 HOUR * (p_partkey % 97 - 1) AS published FROM a JOIN m ON m.ref = a.p_partkey LEFT JOIN o ON o.event = m.event)
SELECT p_partkey AS article_reference, event AS event_id, {_topic_sql()} AS topic, facts, CASE WHEN conflict THEN 'CONFLICTING_EVIDENCE' WHEN facts > 0 THEN 'OFFICIAL_PARTIAL' WHEN valid THEN 'SOURCE_REPORTED_ONLY' ELSE 'NOT_VERIFIED' END AS verification,
CASE WHEN event IS NOT NULL AND decision THEN 'SAME_POLICY_TOPIC' ELSE 'NO_VALID_HISTORICAL_ANALOGUE' END AS relation,
CASE WHEN p_partkey % 97 > 49 THEN 'STALE_SOURCE_ARTICLE' WHEN p_partkey % 97 < 1 THEN 'INSUFFICIENT_EVIDENCE' WHEN event IS NOT NULL AND p_partkey % 2 = 0 AND regexp_matches(title, {_quoted(assembly.IMPORTANT)}) THEN 'HIGH_PRIORITY_RESEARCH' ELSE 'NORMAL_RESEARCH' END AS priority FROM t""")
def article_triage(spark, sf_dir):
    part, key = _read(spark, sf_dir, "part"), F.col("p_partkey")
    at = F.date_format(F.expr(f"timestamp_ntz '{NOW}' - make_interval(0, 0, 0, 0, cast(p_partkey % 97 - 1 as int))"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    basis = F.when(key % 2 == 0, "FIRST_RECORDED_SOURCE_OBSERVATION")
    articles = _articles(spark, sf_dir).select(
        key.alias("article_reference"), "title", F.col("name").alias("source_name"), F.col("url").alias("source_url"), at.alias("reported_at"), F.lit("REPORTED_TIME").alias("reported_time_kind"), at.alias("observed_at"), basis.alias("observation_time_basis"),
    )
    twice = part.filter("p_partkey % 5 = 0").select(key.alias("article_reference"), F.explode(F.array("p_brand", F.lit("other"))).alias("event_id"))
    members = part.filter("p_partkey % 5 <> 0").select(key.alias("article_reference"), F.col("p_brand").alias("event_id")).unionByName(twice)
    official = part.filter("p_partkey % 30 = 0").select(
        F.col("p_brand").alias("event_id"), key.cast("string").alias("official_evidence_id"), F.lit("OFFICIAL_CONFIRMED").alias("evidence_status"), F.when(key % 300 == 0, "CONFLICTING_EVIDENCE_COPIES").alias("link_status"), F.lit("p").alias("proposition"),
    )
    cases = _read(spark, sf_dir, "region").select(F.col("r_name").alias("research_case_id"), F.lit("AVAILABLE").alias("status"), (F.col("r_regionkey") < 2).alias("receipt"))
    sources = _read(spark, sf_dir, "nation").select(F.col("n_name").alias("source_name"), F.lit("x").alias("last_attempt_at"), F.lit("x").alias("last_success_at"), F.lit("OK").alias("status"))
    out = assembly.triage(articles, members, official, cases, sources, _ntz(NOW).cast("timestamp"))
    return out.select(
        "article_reference", "event_id", "topic", F.col("official_evidence_count").alias("facts"), F.col("event_triage.verification_status").alias("verification"), F.col("event_triage.research_relation").alias("relation"),
        F.col("research_priority.priority").alias("priority"),
    )


@_query("""SELECT event_id, '{"a":{"d":[1,{"y":null,"z":"' || event_type || '"}],"e":{}},"b":' || CAST(json_extract(props, '$.k') AS VARCHAR) || ',"u":' || user_id || '}' AS canonical, event_id % 2 = 0 AS sealed FROM events""")
def canonical_props(spark, sf_dir):
    """Nested documents with keys in any order come back canonical; every second one carries its own fingerprint."""
    rows = _read(spark, sf_dir, "events").select("event_id", F.concat(
        F.lit('{"u": '), F.col("user_id").cast("string"), F.lit(', "b":'), F.get_json_object("props", "$.k"), F.lit(' , "a": {"e":{}, "d":[1, {"z":"'), F.col("event_type"), F.lit('","y":null}]}}'),
    ).alias("doc"))
    seal = F.when(F.col("event_id") % 2 == 0, C.fingerprint("doc")).otherwise("none")
    carried = F.concat(F.lit('{"artifact_fingerprint":"'), seal, F.lit('",'), F.substring("doc", F.lit(2), F.length("doc")))
    return rows.select("event_id", C.canonical("doc").alias("canonical"), C.sealed(carried).alias("sealed"))


@_query("""SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE '{"bar":' || CASE WHEN event_type = 'click' AND event_id % 3 <> 0 THEN '{"contract_version":"MARKET_OBSERVATION_V0","data_usage_scope":"PUBLIC_REDISTRIBUTABLE","k":' || event_id || '}' ELSE 'null' END
|| ',"deep":[[{"n":[' || CASE WHEN event_id % 2 = 0 THEN '{"a":null,"v":' || user_id || '}' ELSE '' END || ']}]],"market_observations":[],"market_reality_observations":[' || CASE WHEN event_id % 3 <> 0 THEN '{"data_usage_scope":"PUBLIC_REDISTRIBUTABLE","k":1}' ELSE '' END || '],"t":"' || event_type || '"}' END AS shown FROM events""")
def redacted_documents(spark, sf_dir):
    """Nested documents without the members, rows and objects that may not be shown."""
    from ..operators.redact import dealt, redacted

    n, scope = F.col("event_id"), F.when(F.col("event_id") % 3 != 0, "PUBLIC_REDISTRIBUTABLE").otherwise("PRIVATE_RESEARCH_ONLY")
    none = F.lit(None).cast("string")
    doc = F.to_json(F.struct(
        F.col("event_type").alias("t"), F.when(F.col("event_type") == "error", "Tiingo").alias("provider"), F.array(F.struct(F.lit(1).alias("x"))).alias("private_market_observations"), F.array(F.lit(1), F.lit(2)).alias("market_observations"),
        F.array(F.struct(scope.alias("data_usage_scope"), F.lit(1).alias("k"))).alias("market_reality_observations"),
        F.struct(F.when(F.col("event_type") == "click", scope).alias("data_usage_scope"), F.lit("MARKET_OBSERVATION_V0").alias("contract_version"), n.alias("k")).alias("bar"),
        F.array(F.array(F.struct(F.array(F.struct(F.col("user_id").alias("v"), F.array(none)[0].alias("a"), F.when(n % 2 == 1, "UNKNOWN").alias("data_usage_scope"))).alias("n")))).alias("deep"),
    ))
    with_null = F.replace(doc, F.lit('{"v":'), F.lit('{"a":null,"v":'))
    rows = dealt(_read(spark, sf_dir, "events").select("event_id", "event_type", "user_id"))
    return redacted(rows.select("event_id", with_null.alias("shown")), "shown")


@_query("""WITH t AS (SELECT event_id, user_id, ts, event_type, lag(ts) OVER w AS before, lag(event_type) OVER w AS was FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, before IS NULL OR ts - before > INTERVAL 12 HOUR AS fresh FROM t)
SELECT event_id, CASE WHEN fresh THEN 'NEW' WHEN was = event_type THEN 'DUPLICATE' ELSE 'UPDATED' END AS change, epoch_us(max(CASE WHEN fresh THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS first_observed_us FROM n""")
def stream_versions(spark, sf_dir):
    """The events as polls in the order of their clock, in a stream that stops and goes on from its checkpoint three times."""
    rows = _read(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    folder = f"{shared_folder(spark)}/polls-{uuid.uuid4().hex}"
    edges = [AT_US - 7 * 86_400_000_000, AT_US]
    third = F.when(F.unix_micros("ts") < edges[0], 0).when(F.unix_micros("ts") < edges[1], 1).otherwise(2)
    build = lambda stream: polls.content_versions(stream, "user_id", "ts", ["event_id"], "event_type", keep="12 hours")
    for part in range(3):
        rows.filter(third == part).write.mode("append").parquet(f"{folder}/in")
        polls.advance(build, spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out").select("event_id", "change", "first_observed_us")


_DAY = "'2026-' || lpad(CAST(({k} % 336) // 28 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST({k} % 28 + 1 AS VARCHAR), 2, '0')"


@_query(f"""WITH e AS (SELECT s_suppkey AS event_id, s_suppkey % 2 AS actor, {_DAY.format(k="s_suppkey")} AS day, s_suppkey % 7 = 0 AS iffy FROM supplier),
m AS (SELECT p_partkey AS market_id, p_partkey % 2 AS actor, {_DAY.format(k="p_partkey")} AS day, p_partkey % 5 = 0 AS other FROM part),
p AS (SELECT event_id, market_id, CASE WHEN iffy THEN 'INSUFFICIENT_EVIDENCE' WHEN other OR e.day < '2026-03-01' OR e.day > '2026-12-01' THEN 'NO_MATCH' ELSE 'LINKED' END AS status FROM e JOIN m USING (actor, day))
SELECT event_id, market_id, CASE WHEN status = 'LINKED' AND count(*) FILTER (WHERE status = 'LINKED') OVER (PARTITION BY market_id) > 1 THEN 'AMBIGUOUS' ELSE status END AS link_status FROM p""")
def event_market_index(spark, sf_dir):
    """Suppliers' events and parts' markets meet by institution and day, not as a product."""
    from ..operators import linker

    def day(key: str) -> Column:
        two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
        return F.concat(F.lit("2026-"), two(F.floor(F.col(key) % 336 / 28) + 1), F.lit("-"), two(F.col(key) % 28 + 1))

    stamp = lambda v: F.lit(v).cast("timestamp")
    who = lambda key: F.when(F.col(key) % 2 == 0, "ECB").otherwise("Fed")
    events = _read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("event_id"), F.concat(who("s_suppkey"), F.lit(" to cut rates on "), day("s_suppkey"), F.when(F.col("s_suppkey") % 7 == 0, " if growth slows").otherwise("")).alias("event_title"),
        F.lit(None).cast("timestamp").alias("event_occurred_at"), stamp("2026-03-01 00:00:00").alias("first_detected_at"),
    )
    markets = _read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("market_id"), F.concat(F.lit("Will the "), who("p_partkey"), F.when(F.col("p_partkey") % 5 == 0, " hold rates on ").otherwise(" cut rates on "), day("p_partkey"), F.lit("?")).alias("question"),
        F.lit(None).cast("string").alias("description"), F.lit("").alias("resolution_criteria"), F.lit(False).alias("closed"), F.lit(True).alias("active"), F.lit(False).alias("incomplete"),
        stamp("2026-02-01 00:00:00").alias("observed_at"), stamp("2026-12-01 00:00:00").alias("market_close_time"), F.lit(True).alias("trusted"),
    )
    return linker.links(events, markets).select("event_id", "market_id", "link_status")


# Pairs

_SIX = "abs(date_diff('microsecond', a.ts, b.ts)) <= 21600000000"


def _timed(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", canonical.micros(F.col("ts")).alias("us"))


@_query(f"SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.event_id < b.event_id AND {_SIX}")
def merging_pairs_6h(spark, sf_dir):
    return canonical.merging_pairs(_timed(spark, sf_dir), ["user_id", "event_type"], "event_id", "us", canonical.SIX_HOURS).select("a", "b")


@_query(f"""WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
m AS (SELECT a.user_id, a.event_type, count(*) AS m FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.event_id < b.event_id AND {_SIX} GROUP BY 1, 2)
SELECT n.user_id, n.event_type, coalesce(m, 0) AS merging, CAST(n * (n - 1) // 2 - coalesce(m, 0) AS BIGINT) AS apart FROM n LEFT JOIN m ON m.user_id = n.user_id AND m.event_type = n.event_type""")
def merge_pair_counts(spark, sf_dir):
    rows, keys = _timed(spark, sf_dir), ["user_id", "event_type"]
    return canonical.pair_counts(rows, canonical.merging_pairs(rows, keys, "event_id", "us", canonical.SIX_HOURS), keys)
