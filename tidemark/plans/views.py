"""Named queries of the view operators and rules, over rows derived from the driver's tables.

``part`` numbers pick titles, sources and times from the fixture lists below, so that each rule meets rows that it takes and rows that it refuses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rules as R, scalars as S
from ..functions.arrow import html_to_text, title_key
from ..operators import canonical, context, linker, recency, views
from .catalog import AS_OF, NOW, _ntz, _query, _read

TITLES = [
    "ECB cuts interest rates by 25 basis points", "Fed raises rates by 50 bps.", "ECB meeting minutes show it cuts rates", "European Central Bank keeps key rates steady",
    "Why oil prices may rise", "Monetary policy decisions", "Taiwan and Japan sign energy accord", "Olive harvest in Spain", "World markets wait as ECB lowers rate",
    "Tariffs and sanctions hit crude oil supply", "Fed up with trains", "Interview: ECB holds rates", "Central bank of China and the US", "Quiet day",
]
URLS = [
    "https://www.ecb.europa.eu/press/pr/date/a.html", "https://www.ecb.europa.eu/press/key/date/b.html", "http://news.un.org/en/story?utm_source=x&id=4", "https://globalvoices.org/2024/x/",
    "https://user@host.org/", "ftp://files.org/a", "https://www.theguardian.com/world/a#top",
]
NAMES = ["Global Voices \u00b7 A. Writer", "UN News", "Guardian World \u00b7 B. Reporter", "ECB", ""]


def _pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def _list(values: list[str], n: str) -> str:
    return f"list_extract([{', '.join(chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39) for v in values)}], CAST({n} % {len(values)} + 1 AS INTEGER))"


def _articles(spark, sf_dir) -> DataFrame:
    key = F.col("p_partkey")
    return _read(spark, sf_dir, "part").select("p_partkey", _pick(TITLES, key).alias("title"), _pick(URLS, key).alias("url"), _pick(NAMES, key).alias("name"))


_ARTICLES = f"a AS (SELECT p_partkey, {_list(TITLES, 'p_partkey')} AS title, {_list(URLS, 'p_partkey')} AS url, {_list(NAMES, 'p_partkey')} AS name FROM part)"
_VALID = r"(title <> '' AND name <> '' AND regexp_matches(url, '^(?i)https?://[^/?#@]*[^/?#@:][^/?#@]*([/?#]|$)'))"
_HOST = r"lower(regexp_extract(url, '^(?i)https?://([^/?#:@]+)(?:[:/?#]|$)', 1))"


# Rules over articles

@_query(f"WITH {_ARTICLES} SELECT p_partkey, {_VALID} AS valid FROM a")
def provenance_rule(spark, sf_dir):
    return _articles(spark, sf_dir).select("p_partkey", R.provenance_valid(F.col("title"), F.col("name"), F.col("url")).alias("valid"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def bank_decision_sql() -> str:
    return f"""(NOT regexp_matches(title, {_quoted(R.NO_DECISION)}) AND NOT regexp_matches(url, {_quoted(R.NO_DECISION_PATH)})
AND ((regexp_matches(title, {_quoted(R.DECISION_ACTOR)}) AND regexp_matches(title, {_quoted(R.DECISION)}))
OR (lower(trim(title)) = 'monetary policy decisions' AND {_HOST} = 'www.ecb.europa.eu' AND contains(url, '/press/pr/'))))"""


@_query(f"WITH {_ARTICLES} SELECT p_partkey, {bank_decision_sql()} AS decision FROM a")
def bank_decision(spark, sf_dir):
    return _articles(spark, sf_dir).select("p_partkey", R.ecb_decision(F.col("title"), F.col("url")).alias("decision"))


@_query(f"""WITH {_ARTICLES}, t AS (SELECT *, p_partkey % 4 <> 0 AS timed FROM a)
SELECT p_partkey, CASE WHEN timed AND title IN ('{TITLES[0]}', '{TITLES[1]}') THEN 'REPORTED_RATE_DECISION'
WHEN regexp_matches(title, {_quoted('(?i)' + R.ANALYSIS_CUE)}) THEN 'ANALYSIS_OR_CONTEXT' ELSE 'ARTICLE_TYPE_UNKNOWN' END AS kind FROM t""")
def article_kinds(spark, sf_dir):
    decided = canonical.rate_signature(F.col("title")).isNotNull() & (F.col("p_partkey") % 4 != 0)
    return _articles(spark, sf_dir).select("p_partkey", R.article_kind(F.col("title"), decided).alias("kind"))


_DOT = "\u00b7"


@_query(f"""WITH {_ARTICLES}, h AS (SELECT *, {_HOST} AS host, CASE WHEN strpos(name, ' {_DOT} ') > 0 THEN substr(name, strpos(name, ' {_DOT} ') + 3) END AS who FROM a)
SELECT p_partkey, CASE WHEN host = 'globalvoices.org' AND starts_with(name, 'Global Voices {_DOT} ') THEN 'Global Voices' WHEN host = 'news.un.org' AND starts_with(name, 'UN News') THEN 'UN News'
WHEN host = 'www.theguardian.com' AND starts_with(name, 'Guardian World') THEN 'Guardian World' END AS source,
CASE WHEN (host = 'globalvoices.org' AND starts_with(name, 'Global Voices {_DOT} ')) OR (host = 'news.un.org' AND starts_with(name, 'UN News'))
OR (host = 'www.theguardian.com' AND starts_with(name, 'Guardian World')) THEN who END AS author FROM h""")
def source_attribution(spark, sf_dir):
    out = _articles(spark, sf_dir).select("p_partkey", R.attribution(F.col("name"), F.col("url")).alias("a"))
    return out.select("p_partkey", F.col("a.source").alias("source"), F.col("a.author").alias("author"))


@_query(f"""WITH {_ARTICLES} SELECT p_partkey, title AS title_key FROM a""")
def title_keys(spark, sf_dir):
    """Titles with typographic marks, markup and wide spaces come back as the plain ones."""
    odd = F.concat(F.lit("<p>\u00a0"), F.replace("title", F.lit(" "), F.lit("  ")), F.lit("</p> "))
    return _articles(spark, sf_dir).select("p_partkey", odd.alias("odd")).select("p_partkey", title_key("odd").alias("title_key"))


@_query(f"""WITH {_ARTICLES}, c AS (SELECT *, CASE WHEN regexp_matches(url, '^https://[^/?#@]+') THEN regexp_replace(regexp_replace(url, '#.*$', ''), '^(https://[^/?#]+)$', '\\1/') END AS clean FROM a)
SELECT p_partkey, 'news-content-v47-' || sha256('{{"precision":"DATE_ONLY","published":null,"publisher":"' || name || '","title":"' || title || '","url":' || coalesce('"' || clean || '"', 'null') || '}}') AS version,
'article-url-v47-' || sha256(clean) AS article FROM c""".replace("\\\\", "\\"))
def content_versions(spark, sf_dir):
    rows = _articles(spark, sf_dir)
    version = R.content_version("title", F.col("url"), F.col("name"), F.lit(None).cast("string"), F.lit("DATE_ONLY"))
    return rows.select("p_partkey", version.alias("version"), R.article_identity(F.col("url")).alias("article"))


@_query(f"""WITH {_ARTICLES} SELECT p_partkey, sha256('{{"article_reference":"' || p_partkey || '","discovered_at":null,"news_source":"' || name || '","observed_at":null,"reported_at":null,"reported_time_kind":"UNKNOWN","title":"' || title || '","verification_status":null}}') AS hash FROM a""")
def metadata_hashes(spark, sf_dir):
    fields = {"article_reference": F.col("p_partkey").cast("string"), "news_source": F.col("name"), "title": F.col("title"), "reported_time_kind": F.lit("UNKNOWN")}
    return _articles(spark, sf_dir).select("p_partkey", R.metadata_hash(fields).alias("hash"))


@_query("""WITH t AS (SELECT event_id, ts, event_id % 3 = 0 AS dated, event_id % 2 = 0 AS proven, ts + INTERVAL 1 MINUTE * (event_id % 50 - 10) AS seen FROM events)
SELECT event_id, CASE WHEN dated AND proven AND seen >= ts THEN CAST(epoch(date_trunc('second', seen)) - epoch(date_trunc('second', ts)) AS DOUBLE) END AS latency,
CASE WHEN dated AND proven AND seen >= ts THEN 'MEASURED' ELSE 'UNKNOWN' END AS status FROM t""")
def research_clock(spark, sf_dir):
    shown = lambda at: F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = _read(spark, sf_dir, "events").select("event_id", "ts", F.expr("ts + make_interval(0, 0, 0, 0, 0, cast(event_id % 50 - 10 as int))").alias("seen"))
    kind = F.when(F.col("event_id") % 3 == 0, "REPORTED_TIME").otherwise("SOURCE_DATE_PROXY")
    basis = F.when(F.col("event_id") % 2 == 0, "FIRST_RECORDED_SOURCE_OBSERVATION")
    clocks = R.research_clocks(shown("ts"), kind, shown("seen"), F.lit(None).cast("string"), basis)
    return rows.select("event_id", clocks.alias("c")).select("event_id", F.col("c.discovery_latency_seconds").alias("latency"), F.col("c.discovery_latency_status").alias("status"))


@_query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'https://m.example/' || p_partkey WHEN 1 THEN 'https://m.example/same' END AS url,
CASE p_partkey % 3 WHEN 0 THEN 'CLOB_TOKEN_ID' WHEN 1 THEN 'POSITION_ID' END AS kind FROM part""")
def provider_identifiers(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    four, three = F.col("p_partkey") % 4, F.col("p_partkey") % 3
    none = F.array().cast("array<string>")
    slugs = F.when(four == 0, F.array(key, F.lit("no slug"))).when(four == 1, F.array(F.lit("same"), F.lit("same"))).when(four == 2, F.array(F.lit("one"), F.lit("two"))).otherwise(none)
    labels = F.array(F.lit("Yes"), F.lit("No"))
    first = F.when(three == 0, F.array(key, F.lit("7"))).otherwise(F.array(key))
    second = F.when(three == 2, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(key, key))
    ids = R.aligned_identifiers(labels, ("CLOB_TOKEN_ID", first), ("POSITION_ID", second))
    return _read(spark, sf_dir, "part").select("p_partkey", R.slug_url(slugs, "https://m.example/").alias("url"), ids["kind"].alias("kind"))


@_query("""WITH r AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 429 WHEN event_id % 5 = 0 THEN 200 ELSE 503 END AS status, CASE event_id % 3 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN 'soon' END AS header,
CASE WHEN event_id % 5 = 0 THEN list_extract(['Read timeout', 'redirect', 'parse error', 'other'], CAST(event_id % 4 + 1 AS INTEGER)) END AS error FROM events)
SELECT event_id, CASE WHEN status = 429 THEN CASE WHEN regexp_matches(header, '^[0-9]{1,9}$') THEN least(86400, greatest(300, CAST(header AS INTEGER))) ELSE 21600 END END AS wait,
CASE WHEN status <> 200 THEN 'HTTP_' || status WHEN error = 'Read timeout' THEN 'TIMEOUT' WHEN error = 'redirect' THEN 'REDIRECT_REFUSED' WHEN error = 'parse error' THEN 'INVALID_RESPONSE' WHEN error IS NOT NULL THEN 'PROVIDER_UNAVAILABLE' END AS reason FROM r""".replace("CAST(header AS INTEGER)", "TRY_CAST(header AS INTEGER)"))
def provider_failures(spark, sf_dir):
    n = F.col("event_id")
    status = F.when(n % 2 == 0, 429).when(n % 5 == 0, 200).otherwise(503)
    header = F.when(n % 3 == 0, n.cast("string")).when(n % 3 == 1, "soon")
    error = F.when(n % 5 == 0, _pick(["Read timeout", "redirect", "parse error", "other"], n))
    return _read(spark, sf_dir, "events").select("event_id", R.retry_after(header, status, 300).alias("wait"), R.failure_reason(error, status).alias("reason"))


@_query("""SELECT c_custkey, trim(substr(trim(c_name), 1, 12)) AS short, CASE WHEN c_custkey % 3 = 0 THEN 900 WHEN c_custkey BETWEEN 10 AND 90 THEN CAST(c_custkey AS INTEGER) END AS setting FROM customer""")
def limited_texts(spark, sf_dir):
    value = F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey").cast("string"))
    padded = F.concat(F.lit("  "), "c_name", F.lit("\t"))
    return _read(spark, sf_dir, "customer").select("c_custkey", R.limited(padded, 12).alias("short"), R.bounded_int(value, 10, 90, 900).alias("setting"))


# Context and propositions, as the operators have them

_REGION = {
    TITLES[0]: "euro-area", TITLES[2]: "euro-area", TITLES[3]: "europe", TITLES[8]: "global", TITLES[11]: "euro-area",
}


@_query(f"""WITH {_ARTICLES} SELECT p_partkey, CASE title {' '.join(f"WHEN '{t}' THEN '{r}'" for t, r in _REGION.items())} END AS region_id,
CASE WHEN title IN ('{TITLES[6]}', '{TITLES[12]}') THEN 'MULTI_REGION' WHEN title IN ({', '.join(f"'{t}'" for t in _REGION)}) THEN 'INFERRED' ELSE 'UNKNOWN' END AS status,
CASE WHEN title IN ('{TITLES[6]}', '{TITLES[12]}') THEN 'LOW' WHEN title IN ('{TITLES[3]}', '{TITLES[8]}') THEN 'HIGH' WHEN title IN ({', '.join(f"'{t}'" for t in _REGION)}) THEN 'MEDIUM' END AS confidence FROM a""")
def region_context(spark, sf_dir):
    texts = _articles(spark, sf_dir).select("p_partkey", F.lit("HEADLINE").alias("tier"), "title")
    return context.infer(texts, "p_partkey", "title").select("p_partkey", "region_id", "status", "confidence")


_MARKETS = [
    ("Will the ECB cut rates by 25 bps on 29 October 2026?", "ECB", "CUT", "25bps", "2026-10-29"), ("Fed rate decision on October 28 2026", "FED", None, None, "2026-10-28"),
    ("Bank of Japan raises interest rates in November 2026", "BOJ", "RAISE", None, "2026-11"), ("Will rates remain unchanged after 31 February 2026", None, "HOLD", None, "INVALID_DATE"),
    ("Storm hits the coast", None, None, None, None),
]


def _field(place: int) -> str:
    return _list([m[place] or "" for m in _MARKETS], "p_partkey")


@_query(f"SELECT p_partkey, {_field(1)} AS actor, {_field(2)} AS action, {_field(3)} AS threshold, {_field(4)} AS scope, p_partkey % 5 = 3 AS deadline FROM part")
def propositions(spark, sf_dir):
    rows = _read(spark, sf_dir, "part").select("p_partkey", _pick([m[0] for m in _MARKETS], F.col("p_partkey")).alias("text"))
    p = lambda field: F.array_join(F.col(f"p.{field}"), ",")
    out = linker.with_proposition(rows, "text", "p")
    return out.select("p_partkey", p("actors").alias("actor"), p("actions").alias("action"), p("thresholds").alias("threshold"), p("date_scope").alias("scope"), F.col("p.deadline").alias("deadline"))


_LINKS = [(0, "LINKED"), (1, "NO_MATCH"), (2, "NO_MATCH"), (3, "INSUFFICIENT_EVIDENCE"), (4, "NO_MATCH")]


@_query(f"""SELECT n_nationkey AS event_id, CAST(n_nationkey AS VARCHAR) || '-m' AS market_id, CASE CAST(n_nationkey % 5 AS INTEGER) {' '.join(f"WHEN {k} THEN '{v}'" for k, v in _LINKS)} END AS link_status FROM nation""")
def event_market_links(spark, sf_dir):
    """Each nation's event against its own market; the decision sees nothing else."""
    n = F.col("n_nationkey")
    rows = _read(spark, sf_dir, "nation").select(
        n.alias("event_id"), F.concat(n.cast("string"), F.lit("-m")).alias("market_id"),
        _pick(["ECB to cut rates by 25 bps on 29 October 2026", "ECB to cut rates by 50 bps on 29 October 2026", "Fed rate decision on 28 October 2026", "ECB to cut rates if growth slows", "Storm hits the coast"], n).alias("event_title"),
        F.lit(_MARKETS[0][0]).alias("question"),
    )
    stamp = lambda v: F.lit(v).cast("timestamp")
    both = linker.with_proposition(linker.with_proposition(rows, "event_title", "e"), "question", "m")
    verdict = linker.decide(
        "e", "m", F.lit(None).cast("timestamp"), F.lit(False), F.lit(True), F.lit(False), stamp("2026-10-01 00:00:00"), stamp("2026-10-02 00:00:00"), stamp("2026-11-01 00:00:00"), F.lit(True)
    )
    return both.select("event_id", "market_id", verdict["link_status"].alias("link_status"))


@_query(f"""WITH {_ARTICLES} SELECT p_partkey, array_to_string(list_filter([CASE WHEN title IN ('{TITLES[0]}') THEN 'MONETARY_POLICY' END, CASE WHEN title = '{TITLES[9]}' THEN 'TRADE_POLICY' END,
CASE WHEN title IN ('{TITLES[4]}', '{TITLES[9]}') THEN 'OIL_SUPPLY' END], lambda x: x IS NOT NULL AND {_VALID} AND p_partkey % 11 <> 0), ',') AS mechanisms FROM a""")
def impact_records(spark, sf_dir):
    rows = _articles(spark, sf_dir)
    valid = R.provenance_valid(F.col("title"), F.col("name"), F.col("url")) & (F.col("p_partkey") % 11 != 0)
    return views.impact(rows.withColumn("valid", valid), S.mechanisms(F.col("title"))).select("p_partkey", F.array_join("mechanisms", ",").alias("mechanisms"))


@_query(f"""WITH {_ARTICLES} SELECT count(*) FILTER (WHERE hit) AS hypothesis_article_count, count(*) FILTER (WHERE NOT hit) AS unknown_article_count
FROM (SELECT title IN ('{TITLES[0]}', '{TITLES[4]}', '{TITLES[9]}') AND {_VALID} AS hit FROM a)""")
def impact_totals(spark, sf_dir):
    rows = _articles(spark, sf_dir)
    return views.impact_counts(views.impact(rows.withColumn("valid", R.provenance_valid(F.col("title"), F.col("name"), F.col("url"))), S.mechanisms(F.col("title"))))


# Memberships, recorded states and clocks

@_query("""WITH m AS (SELECT l_partkey AS p_partkey, count(DISTINCT l_orderkey) AS event_count, min(l_orderkey) AS one FROM lineitem WHERE l_orderkey % 40 = 0 GROUP BY 1)
SELECT p_partkey, coalesce(event_count, 0) AS event_count, CASE WHEN event_count = 1 THEN one END AS l_orderkey FROM part LEFT JOIN m USING (p_partkey)""")
def article_membership(spark, sf_dir):
    events = _read(spark, sf_dir, "lineitem").filter("l_orderkey % 40 = 0").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey")
    return views.memberships(_read(spark, sf_dir, "part").select("p_partkey"), events, "p_partkey", "l_orderkey")


@_query(f"""WITH a AS (SELECT DISTINCT user_id, CASE WHEN user_id % 2 = 0 THEN 'view' ELSE 'click' END AS event_type FROM events),
l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS stored FROM events WHERE ts <= TIMESTAMP '{AS_OF}' AND user_id % 5 <> 0 GROUP BY 1)
SELECT user_id, CASE WHEN stored IS NULL THEN 'NOT_RECORDED' WHEN stored = event_type THEN 'RECORDED_EVIDENCE_LEDGER' ELSE 'CAPTURED_EARLIER_VERSION' END AS recorded_status FROM a LEFT JOIN l USING (user_id)""")
def recorded_states(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    now = F.when(F.col("user_id") % 2 == 0, "view").otherwise("click")
    articles = rows.select("user_id", now.alias("event_type")).distinct()
    return views.recording_status(articles, rows.filter("user_id % 5 <> 0"), "user_id", "event_type", ["ts", "event_id"], _ntz(AS_OF)).select("user_id", "recorded_status")


@_query("""WITH a AS (SELECT c_custkey AS user_id, TIMESTAMP '2024-01-05' + INTERVAL 1 HOUR * (c_custkey % 48) AS published FROM customer),
h AS (SELECT user_id, min(ts) AS f, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT user_id, coalesce(n, 0) AS version_count, CASE WHEN f >= published THEN date_diff('second', published, date_trunc('second', f)) END AS delay_seconds,
CASE WHEN f >= published THEN 'MEASURED' ELSE 'UNKNOWN' END AS latency_status, CASE WHEN f IS NULL THEN 'FIRST_SEEN_NOT_PROVEN' WHEN n = 1 THEN 'NEWLY_OBSERVED' ELSE 'PREVIOUSLY_OBSERVED' END AS detection_status
FROM a LEFT JOIN h USING (user_id)""")
def detection_clocks(spark, sf_dir):
    published = F.expr("timestamp_ntz'2024-01-05 00:00:00' + make_interval(0, 0, 0, 0, cast(c_custkey % 48 as int))")
    articles = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), published.alias("published"))
    history = _read(spark, sf_dir, "events").filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    out = views.detection(articles, history, "user_id", "ts", "event_id", "published")
    return out.select("user_id", "version_count", "delay_seconds", "latency_status", "detection_status")


@_query("""WITH c AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS at, o_orderstatus = 'F' AS private FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1997-06-01'),
r AS (SELECT l_orderkey AS k, max(CAST(l_shipdate AS DATE)) AS receipt_at FROM lineitem WHERE CAST(l_shipdate AS DATE) <= DATE '1997-06-01' GROUP BY 1)
SELECT k, CASE WHEN private THEN receipt_at END AS receipt_at, CASE WHEN private AND receipt_at IS NOT NULL THEN 'RECEIPT' ELSE 'REGISTRATION' END AS basis FROM c LEFT JOIN r USING (k)""")
def market_read_as_of(spark, sf_dir):
    content = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("at"), "o_orderstatus")
    receipts = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.to_date("l_shipdate").alias("at"))
    out = views.market_read(content, receipts, "k", "at", F.col("o_orderstatus") == "F", F.lit("1997-06-01").cast("date"))
    return out.select("k", "receipt_at", "basis")


@_query("""SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS line, CASE WHEN l_orderkey % 9 = 0 THEN 'MARKET_RECEIPT_CONTENT_MISSING' ELSE 'INVALID_MARKET_RECEIPT_BINDING' END AS reason
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey % 9 = 0 OR CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE) + 30""")
def receipt_binding_errors(spark, sf_dir):
    content = _read(spark, sf_dir, "orders").filter("o_orderkey % 9 <> 0").select(F.col("o_orderkey").alias("k"), F.date_add(F.to_date("o_orderdate"), 30).alias("at"))
    receipts = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("line"), F.to_date("l_shipdate").alias("at"))
    return views.receipt_violations(content, receipts, "k", "at").select("k", "line", "reason")


@_query("""WITH a AS (SELECT s_suppkey, s_nationkey FROM supplier), h AS (SELECT s_nationkey, count(DISTINCT s_suppkey % 2) AS anchors, count(*) AS n FROM supplier WHERE s_nationkey % 4 <> 0 AND (s_nationkey % 3 <> 0 OR s_suppkey % 2 = 0) GROUP BY 1)
SELECT n_nationkey AS s_nationkey, CASE WHEN anchors IS NULL THEN 'NO_OBSERVATIONS' WHEN anchors > 1 THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END AS market_status, CASE WHEN anchors = 1 THEN n ELSE 0 END AS market_rows FROM nation LEFT JOIN h ON s_nationkey = n_nationkey""")
def events_with_market_state(spark, sf_dir):
    events = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"))
    rows = _read(spark, sf_dir, "supplier").filter("s_nationkey % 4 <> 0 and (s_nationkey % 3 <> 0 or s_suppkey % 2 = 0)").select("s_nationkey", (F.col("s_suppkey") % 2).alias("anchor"))
    return views.with_market_state(events, rows, "s_nationkey", "anchor")


# Geography

_POINTS = """p AS (SELECT s_nationkey AS event, s_suppkey, 'Place ' || (s_suppkey % 5) AS place, CASE s_suppkey % 3 WHEN 0 THEN 'DE' WHEN 1 THEN NULL ELSE 'de' END AS country,
CAST(s_suppkey % 110 AS DOUBLE) AS lat, CAST(s_suppkey % 200 AS DOUBLE) AS lon, CASE WHEN s_suppkey % 7 = 0 THEN 'none' ELSE 'https://maps.example/' || (s_suppkey % 5) END AS ref FROM supplier),
g AS (SELECT DISTINCT event, place, country, lat, lon, ref FROM p WHERE (SELECT count(*) FROM p q WHERE q.event = p.event) <= 16 AND (country IS NULL OR country = 'DE') AND lat <= 90 AND lon <= 180 AND ref <> 'none')"""


def _points(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey")
    return views.geographies(_read(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("event"), F.concat(F.lit("Place "), (k % 5).cast("string")).alias("place_name"), F.when(k % 3 == 0, "DE").when(k % 3 == 2, "de").alias("country_code"),
        (k % 110).cast("double").alias("latitude"), (k % 200).cast("double").alias("longitude"), F.when(k % 7 == 0, "none").otherwise(F.concat(F.lit("https://maps.example/"), (k % 5).cast("string"))).alias("evidence_reference"),
    ), "event")


@_query(f"WITH {_POINTS} SELECT event, place AS place_name, country AS country_code, lat AS latitude, lon AS longitude FROM g")
def event_geographies(spark, sf_dir):
    return _points(spark, sf_dir).select("event", "place_name", "country_code", "latitude", "longitude")


@_query(f"WITH {_POINTS} SELECT (SELECT count(DISTINCT event) FROM g) AS mapped_event_count, count(*) - (SELECT count(DISTINCT event) FROM g) AS unmapped_event_count FROM nation")
def mapped_event_counts(spark, sf_dir):
    return views.mapped_counts(_read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("event")), _points(spark, sf_dir), "event")


@_query("SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 < 2 AND s_suppkey % 4 <> 0")
def strict_geography(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = _read(spark, sf_dir, "supplier").select("s_suppkey", _pick(["STRUCTURED_SOURCE", "EXPLICIT_SOURCE", "CURATED_PRESENTATION"], k).alias("evidence_type"), F.when(k % 4 != 0, "ref").alias("evidence_reference"))
    return views.strict_points(rows).select("s_suppkey")


# Counts and orders

@_query(f"""WITH c AS (SELECT *, event_id % 2 = 0 AS macro, event_id % 3 <> 0 AS valid, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS topic,
CASE WHEN TIMESTAMP '{NOW}' < ts THEN 'INVALID_FUTURE' WHEN TIMESTAMP '{NOW}' - ts <= INTERVAL 86400 SECOND THEN 'LAST_24H' WHEN TIMESTAMP '{NOW}' - ts <= INTERVAL 172800 SECOND THEN 'LAST_48H' ELSE 'OLDER' END AS recency FROM events)
SELECT count(*) FILTER (WHERE macro AND valid AND recency IN ('LAST_24H', 'LAST_48H')) AS eligible_article_count, count(DISTINCT user_id) FILTER (WHERE macro AND valid AND recency IN ('LAST_24H', 'LAST_48H')) AS eligible_development_count,
count(*) FILTER (WHERE macro AND valid AND recency = 'LAST_24H') AS macro_relevant_last_24h, count(*) FILTER (WHERE topic IS NULL) AS unknown_analysis_count FROM c""")
def brief_totals(spark, sf_dir):
    n = F.col("event_id")
    rows = _read(spark, sf_dir, "events").select(
        "user_id", (n % 2 == 0).alias("macro"), (n % 3 != 0).alias("valid"), F.when(n % 5 != 0, F.col("event_type")).alias("topic"), recency.bucket(_ntz(NOW), F.col("ts")).alias("recency")
    )
    return views.brief_counts(rows, "user_id")


@_query("""SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS available, count(*) FILTER (WHERE o_totalprice > 100000) AS priced, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS official, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS point_in_time FROM orders""")
def library_totals(spark, sf_dir):
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "AVAILABLE").otherwise("UNAVAILABLE")
    return views.library_counts(_read(spark, sf_dir, "orders").select(status.alias("status"), (F.col("o_totalprice") > 100000).alias("priced"), (k % 2 == 0).alias("official"), (k % 3 == 0).alias("point_in_time")))


@_query("""WITH t AS (SELECT conv_id, 'NEWS' AS kind FROM conversations UNION ALL SELECT user_id, 'OFFICIAL' FROM events WHERE event_type = 'signup')
SELECT conv_id, count(*) FILTER (WHERE kind = 'NEWS') AS news_count, count(*) FILTER (WHERE kind = 'OFFICIAL') AS official_count FROM t GROUP BY conv_id""")
def timeline_counts(spark, sf_dir):
    news = _read(spark, sf_dir, "conversations").select("conv_id", F.lit("NEWS").alias("kind"))
    official = _read(spark, sf_dir, "events").filter("event_type = 'signup'").select(F.col("user_id").alias("conv_id"), F.lit("OFFICIAL").alias("kind"))
    return canonical.timeline_counts(news.unionByName(official), "conv_id", "kind")


@_query("SELECT max(ts) AS latest_observed FROM events")
def latest_observed(spark, sf_dir):
    return _read(spark, sf_dir, "events").agg(F.max("ts").alias("latest_observed"))


@_query("""WITH d AS (SELECT o_orderpriority AS batch, o_custkey AS ident, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS depth FROM orders),
f AS (SELECT ident, min((depth, batch)) AS turn FROM d WHERE depth <= 3 GROUP BY 1) SELECT ident, row_number() OVER (ORDER BY turn) AS position FROM f QUALIFY position <= 8""")
def batch_round_robin(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("batch"), F.col("o_custkey").alias("ident"), "o_orderkey")
    return views.round_robin_batches(rows, "batch", "ident", [F.col("o_orderkey")])


@_query("""SELECT user_id, latest FROM (SELECT user_id, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS latest FROM events GROUP BY 1) ORDER BY latest DESC, user_id DESC LIMIT 50""")
def event_order_topn(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("latest"))
    return views.event_order(rows, "latest", "user_id", 50)


# Ledger

@_query("""WITH r AS (SELECT DISTINCT l_orderkey AS k, l_returnflag AS flag FROM lineitem WHERE l_orderkey % 6 <> 0), h AS (SELECT k, count(*) AS n, min(CASE WHEN flag IN ('N', 'R') THEN 1 ELSE 0 END) AS ok FROM r GROUP BY 1)
SELECT o_orderkey AS k, CASE WHEN n IS NULL THEN 'REFERENCED_EVIDENCE_MISSING' WHEN ok = 0 THEN 'EVIDENCE_AUTHORITY_OR_LINK_INVALID' WHEN n > 1 THEN 'CONFLICTING_EVIDENCE' ELSE 'ACCEPTED' END AS verdict FROM orders LEFT JOIN h ON k = o_orderkey""")
def required_records(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").filter("l_orderkey % 6 <> 0").select(F.col("l_orderkey").alias("k"), "l_returnflag")
    return views.unique_records(rows, "k", _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), F.col("l_returnflag").isin("N", "R"))


@_query("""SELECT 'NEWS_ARTICLE' AS observation_kind, CAST(p_partkey AS VARCHAR) AS entity_id, p_brand AS canonical_event_id FROM part UNION ALL SELECT 'CANONICAL_EVENT_STATE', p_brand, p_brand FROM (SELECT DISTINCT p_brand FROM part)
UNION ALL SELECT 'SOURCE_STATE', n_name, NULL FROM nation""")
def ledger_ingest(spark, sf_dir):
    part, none = _read(spark, sf_dir, "part"), F.lit(None).cast("string")
    shaped = lambda df, entity, event: df.select(entity.alias("entity_id"), event.alias("canonical_event_id"), F.to_json(F.struct(entity.alias("e"))).alias("payload"), none.alias("source_timestamp"))
    brand = F.col("p_brand")
    view = {
        "articles": shaped(part, F.col("p_partkey").cast("string"), brand), "events": shaped(part.select("p_brand").distinct(), brand, brand),
        "sources": shaped(_read(spark, sf_dir, "nation"), F.col("n_name"), none),
    }
    rows = views.of_contract(views.ingest(view, "VIEW_V1"), "VIEW_V1")
    return rows.select("observation_kind", "entity_id", "canonical_event_id")


@_query("""SELECT user_id, event_id, 'INTERRUPTED_UNKNOWN' AS state FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND event_type = 'click'""")
def recovered_attempts(spark, sf_dir):
    state = F.when(F.col("event_type") == "click", "RESERVED").otherwise("DONE")
    rows = _read(spark, sf_dir, "events").select("user_id", "event_id", "ts", state.alias("state"))
    return views.recovered(rows, "user_id", ["ts", "event_id"], "state").select("user_id", "event_id", "state")


@_query("""SELECT bool_or(o_orderkey % 1000 = 7 AND o_orderstatus = 'F') AS trusted, CASE WHEN NOT bool_or(o_orderkey % 1000 = 7 AND o_orderstatus = 'F') AND bool_or(o_orderstatus = 'P') THEN 'DEVELOPMENT_CONTRACT_NOT_FROZEN' ELSE 'AVAILABLE' END AS status FROM orders""")
def trusted_macro(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders")
    return views.trusted_input(rows, F.col("o_orderkey") % 1000 == 7, F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "P")


@_query("""SELECT event_id, user_id FROM events e WHERE event_type <> 'signup' AND ts <= TIMESTAMP '2024-01-20 12:00:00' AND EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'purchase' AND x.ts <= TIMESTAMP '2024-01-20 12:00:00')""")
def capture_related_history(spark, sf_dir):
    from ..operators import versions

    rows = _read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return versions.related_history(rows, "user_id", "event_type", F.lit("purchase"), _ntz(AS_OF), "ts").filter("event_type <> 'signup'").select("event_id", "user_id")


@_query(f"""WITH {_ARTICLES} SELECT p_partkey, title || ' and more ' || name AS text FROM a""".replace("name AS text", "'x' AS text"))
def markup_text(spark, sf_dir):
    """Titles in markup come back as plain text: tags, CDATA, comments and one level of entities go."""
    marked = F.concat(F.lit("&lt;p class=\"a>b\"&gt;"), "title", F.lit("<br/>and<!-- no --><td>more</td> <![CDATA[<b>x</b>]]>"))
    return _articles(spark, sf_dir).select("p_partkey", marked.alias("m")).select("p_partkey", html_to_text("m").alias("text"))


# Evidence, markets and the ledger, through their operators

@_query("""WITH p AS (SELECT c_custkey, c_custkey % 5 <> 0 AS confirmed, c_custkey % 7 <> 0 AS authority, c_custkey % 11 <> 0 AS url, CASE c_custkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'late' WHEN 2 THEN 'early' ELSE 'bad' END AS pub FROM customer)
SELECT c_custkey, confirmed AND authority AND url AND pub IN ('none', 'early') AS valid FROM p""")
def official_packets(spark, sf_dir):
    from ..operators import evidence

    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    rows = _read(spark, sf_dir, "customer").select(
        k.cast("string").alias("canonical_event_id"), F.when(k % 5 != 0, "OFFICIAL_CONFIRMED").alias("official_confirmation"), F.when(k % 7 != 0, "FACT_AUTHORITY").otherwise("SENSOR").alias("authority_role"),
        F.when(k % 11 != 0, "https://a.example/d").otherwise("d").alias("official_source"), F.lit("d").alias("official_document_reference"), F.lit("Oil rose").alias("official_fact_proposition"),
        F.when(k % 4 == 1, "2026-10-06T04:00:00Z").when(k % 4 == 2, "2026-10-06T02:00:00Z").when(k % 4 == 3, "yesterday").otherwise(none).alias("official_published_at"),
        F.lit("2026-10-06T03:00:00Z").alias("official_project_first_seen_at"), F.lit("2026-10-06T03:00:01Z").alias("official_retrieved_at"),
    )
    return evidence.packets(rows).select(F.col("canonical_event_id").cast("long").alias("c_custkey"), "valid")


@_query("""SELECT DISTINCT c_custkey % 50 AS event, CASE WHEN c_custkey % 50 % 3 = 0 THEN 'AMBIGUOUS_EVIDENCE' WHEN c_custkey % 50 % 3 = 1 THEN 'OFFICIAL_CONFIRMED' ELSE 'UNLINKED' END AS evidence_status FROM customer""")
def official_evidence(spark, sf_dir):
    """Copies of one proposition an event: differing ones are ambiguous, and those whose event is not there are not linked."""
    from ..operators import evidence

    event = F.col("c_custkey") % 50
    rows = _read(spark, sf_dir, "customer").select(
        event.cast("string").alias("canonical_event_id"), F.lit("OFFICIAL_CONFIRMED").alias("official_confirmation"), F.lit("FACT_AUTHORITY").alias("authority_role"),
        F.lit("https://a.example/d").alias("official_source"), event.cast("string").alias("official_document_reference"), F.concat(F.lit("Fact "), event.cast("string")).alias("official_fact_proposition"),
        F.when(event % 3 == 0, (F.col("c_custkey") % 100).cast("string")).otherwise("t").alias("document_title"),
        F.lit("2026-10-06T03:00:00Z").alias("official_project_first_seen_at"), F.lit("2026-10-06T03:00:01Z").alias("official_retrieved_at"),
    )
    events = _read(spark, sf_dir, "customer").select(event.cast("string").alias("event_id")).distinct().filter("event_id % 3 <> 2").withColumn("article_references", F.array().cast("array<string>"))
    return evidence.project(rows, events).select(F.col("document").cast("long").alias("event"), "evidence_status")


@_query("""WITH m AS (SELECT CAST(p_partkey % 60 AS VARCHAR) AS market_id, p_partkey % 60 AS k, CASE WHEN p_partkey % 60 % 7 = 0 THEN p_name ELSE 'q' END AS question FROM part),
u AS (SELECT market_id, k FROM m GROUP BY 1, 2 HAVING count(DISTINCT question) = 1)
SELECT market_id, CASE k % 3 WHEN 0 THEN '0.25,0.75' WHEN 1 THEN NULL ELSE NULL END AS prices FROM u ORDER BY market_id LIMIT 20""")
def market_parse(spark, sf_dir):
    from ..operators import market

    k = F.col("p_partkey") % 60
    text = lambda x: F.lit(x)
    rows = _read(spark, sf_dir, "part").select(
        k.cast("string").alias("id"), F.when(k % 7 == 0, F.col("p_name")).otherwise("q").alias("question"), text('["Yes","No"]').alias("outcomes"),
        F.when(k % 3 == 0, '["0.25","0.75"]').when(k % 3 == 1, '["0.25"]').otherwise('["0.25","1.75"]').alias("outcomePrices"), text("2026-11-01T00:00:00Z").alias("endDate"),
        text("false").alias("closed"), text("true").alias("active"), text("false").alias("archived"),
    )
    return market.parse_markets(rows).select("market_id", F.array_join("prices", ",").alias("prices"))


@_query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity AS o, l_quantity + 2 AS h, l_quantity - 1 AS l, l_quantity + CASE WHEN l_orderkey % 5 = 0 THEN 3 ELSE 0 END AS c, CASE WHEN l_orderkey % 7 = 0 THEN -1 ELSE 1 END AS v FROM lineitem)
SELECT CASE WHEN least(o, h, l, c) <= 0 THEN 'NOT_POSITIVE' WHEN greatest(o, h, l, c) > h THEN 'RANGE' WHEN v < 0 THEN 'VOLUME' ELSE 'GOOD' END AS problem, count(*) AS bars FROM b GROUP BY 1""")
def bar_faults(spark, sf_dir):
    from ..operators import market

    q, k = F.col("l_quantity").cast("double"), F.col("l_orderkey")
    rows = _read(spark, sf_dir, "lineitem").select(q.alias("open"), (q + 2).alias("high"), (q - 1).alias("low"), (q + F.when(k % 5 == 0, 3).otherwise(0)).alias("close"), F.when(k % 7 == 0, -1).otherwise(1).alias("volume"))
    return rows.groupBy(F.coalesce(market.bar_problem(), F.lit("GOOD")).alias("problem")).agg(F.count("*").alias("bars"))


_LEDGER = "2024-01-15 00:00:00"


@_query(f"""WITH s AS (SELECT * FROM events WHERE ts <= TIMESTAMP '{_LEDGER}'), t AS (SELECT DISTINCT user_id FROM s WHERE event_type = 'purchase'),
r AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS last FROM s WHERE user_id IN (SELECT user_id FROM t))
SELECT event_id, last AS active_at_as_of, last AND event_type = 'purchase' AS visible FROM r""")
def ledger_replay(spark, sf_dir):
    """Users as entities bound to what they did; the event is the purchases."""
    from ..operators import ledger

    rows = _read(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("raw"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("observation_id"), F.lit("NEWS_ARTICLE").alias("observation_kind"),
        F.col("user_id").cast("string").alias("entity_id"), F.col("event_type").alias("canonical_event_id"), canonical.micros(F.col("ts")).alias("observed_us"),
    )
    at = canonical.micros(F.lit(_LEDGER).cast("timestamp_ntz"))
    return ledger.replay(rows, "purchase", at).select(F.col("raw").cast("long").alias("event_id"), "active_at_as_of", "visible")


@_query("""SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'LATE_CLOCK' WHEN event_id % 13 = 0 THEN 'HASH' ELSE 'KIND' END AS fault FROM events WHERE event_id % 10 = 0 OR event_id % 13 = 0 OR event_id % 17 = 0""")
def ledger_violations(spark, sf_dir):
    from ..operators import ledger

    n = F.col("event_id")
    late = F.when(n % 10 == 0, "2030-01-01T00:00:00Z").otherwise("2020-01-01T00:00:00Z")
    payload = F.to_json(F.struct(late.alias("retrieved_at")))
    rows = _read(spark, sf_dir, "events").select(
        "event_id", payload.alias("payload"), F.when(n % 13 == 0, "0").otherwise(F.sha2(payload, 256)).alias("payload_sha256"), F.when(n % 17 != 0, "NEWS_ARTICLE").alias("observation_kind"),
        F.col("user_id").cast("string").alias("entity_id"), canonical.micros(F.col("ts")).alias("observed_us"),
    )
    fault = F.when(n % 10 == 0, "LATE_CLOCK").when(n % 13 == 0, "HASH").otherwise("KIND")
    return ledger.violations(rows).select("event_id", fault.alias("fault"))


@_query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0")
def public_observations(spark, sf_dir):
    from ..operators import market

    k = F.col("o_orderkey")
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "PUBLIC_REDISTRIBUTABLE").otherwise("PRIVATE_RESEARCH_ONLY").alias("data_usage_scope"), F.when(k % 3 == 0, False).when(k % 3 == 1, True).alias("synthetic"))
    return rows.filter(market.public()).select("o_orderkey")


@_query(f"""WITH {_ARTICLES} SELECT p_partkey, title IN ('{TITLES[0]}', '{TITLES[3]}', '{TITLES[4]}', '{TITLES[6]}', '{TITLES[1]}', '{TITLES[5]}', '{TITLES[9]}', '{TITLES[12]}') AS relevant FROM a""")
def title_relevance(spark, sf_dir):
    return _articles(spark, sf_dir).select("p_partkey", S.macro_relevant(F.col("title")).alias("relevant"))


# Inputs taken whole or not at all

@_query("""WITH r AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders)
SELECT CASE WHEN k % 11 = 0 THEN 'INVALID_MARKET_SYMBOL' WHEN k % 13 = 0 THEN 'INVALID_MARKET_EVENT' WHEN k % 17 = 0 THEN 'NO_POINT_IN_TIME_SOURCE'
WHEN k % 19 = 0 THEN 'MARKET_TIME_AFTER_KNOWLEDGE' WHEN k % 23 = 0 THEN 'INVALID_MARKET_VALUE' WHEN k % 29 = 0 THEN 'MARKET_UNIT_MISMATCH' WHEN k % 6 = 0 THEN 'INVALID_PREVIOUS_CLOSE'
WHEN k % 31 = 0 THEN 'INVALID_MARKET_VISIBILITY' ELSE 'GOOD' END AS fault, count(*) AS records FROM r GROUP BY 1""")
def market_record_faults(spark, sf_dir):
    from ..sources import packets

    k = F.col("o_orderkey")
    pick = lambda n, bad, good: F.when(k % n == 0, bad).otherwise(good)
    close = F.struct(
        F.lit(1.0).alias("price_or_level"), F.lit("2024-01-01T08:00:00Z").alias("market_timestamp"), pick(6, "2024-01-03T00:00:00Z", "2024-01-01T09:00:00Z").alias("observed_at"), F.lit("p").alias("source_observation_id")
    )
    rows = _read(spark, sf_dir, "orders").select(
        pick(11, "XXX", "SPY").alias("symbol"), F.concat(F.lit("canonical-event-v0-"), F.repeat(pick(13, "g", "a"), F.lit(64))).alias("event_id"),
        pick(17, "GUESSED", "SYSTEM_RECORDED_TIME").alias("time_basis"), F.lit("2024-01-02T00:00:00Z").alias("event_observed_at"), (F.col("o_totalprice").cast("double") * pick(23, -1, 1)).alias("price_or_level"),
        pick(19, "2024-01-02T11:00:00Z", "2024-01-02T10:00:00Z").alias("market_timestamp"), F.lit("2024-01-02T10:30:00Z").alias("observed_at"), k.cast("string").alias("source_observation_id"),
        F.struct(F.lit("Desk").alias("name"), F.lit("https://desk.example/q").alias("url")).alias("source"), pick(29, "YIELD_PERCENT", "PRICE").alias("value_unit"),
        F.when(k % 2 == 0, close).alias("previous_close"), pick(31, "EVERYONE", "UNKNOWN").alias("data_usage_scope"), F.lit("desk").alias("provider"), F.lit(False).alias("synthetic"),
    )
    return rows.groupBy(F.coalesce(packets.record_fault(), F.lit("GOOD")).alias("fault")).agg(F.count("*").alias("records"))


@_query("""SELECT 'https://feed.example/' || l_orderkey AS url, min(CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS published, 'DATE_ONLY' AS "precision",
count(DISTINCT l_linenumber) AS aliases, count(DISTINCT CAST(l_shipdate AS DATE)) > 1 OR count(DISTINCT l_linenumber % 3 = 0) > 1 AS conflicting FROM lineitem GROUP BY l_orderkey""")
def feed_copies(spark, sf_dir):
    from ..sources import packets

    rows = _read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("https://Feed.example/"), "l_orderkey", F.lit("?utm_source="), "l_linenumber", F.lit("#top")).alias("link"),
        F.when(F.col("l_linenumber") % 3 == 0, "Other").when(F.col("l_linenumber") % 2 == 0, "It\u2019s").otherwise("It's").alias("title"), F.col("l_shipdate").cast("date").cast("string").alias("pubDate"),
    )
    return packets.feed_articles(rows).select("url", "published", "precision", F.size("aliases").cast("long").alias("aliases"), "conflicting")


@_query(f"""WITH v AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 'EVENT' ELSE 'NEWS' END AS kind FROM events WHERE ts <= TIMESTAMP '{AS_OF}'),
l AS (SELECT kind, user_id, arg_max(user_id % 50 + CASE WHEN event_type = 'click' THEN 50 ELSE 0 END, (ts, event_id)) AS e FROM v GROUP BY 1, 2)
SELECT CAST(e AS VARCHAR) AS canonical_event_id, count(*) AS parts FROM l GROUP BY e HAVING count(*) FILTER (kind = 'EVENT') > 0""")
def event_previews(spark, sf_dir):
    """Users as entities; clicks are bound to events that have no row of their own."""
    from ..operators import ledger

    rows = _read(spark, sf_dir, "events").select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("observation_id"), F.when(F.col("event_type") == "purchase", "EVENT").otherwise("NEWS").alias("observation_kind"),
        F.col("user_id").cast("string").alias("entity_id"), (F.col("user_id") % 50 + F.when(F.col("event_type") == "click", 50).otherwise(0)).cast("string").alias("canonical_event_id"),
        canonical.micros(F.col("ts")).alias("observed_us"), F.sha2(F.col("event_id").cast("string"), 256).alias("payload_sha256"),
    )
    found = ledger.previews(rows, canonical.micros(F.lit(AS_OF).cast("timestamp_ntz")))
    return found.select("canonical_event_id", F.col("parts").cast("long").alias("parts"))
