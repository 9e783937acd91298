"""Named queries over files that count whole or not at all, and over scoped receipts: feeds from pages, evidence files from events, receipts from orders and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import visibility
from ..sources import guarded, news
from .catalog import _query, _read

# Feeds: 20 pages each; of every eight feeds one has a DOCTYPE, a cut end, another root, no titles, each item twice, too many bytes.

# plain separators in the rule for titles: engines differ in whether a letter beyond ASCII ends a word
_PROFILE = guarded.Profile("Pages", ("feeds.example",), relevant=lambda title: title.rlike(r"(?i)(^|[ .,])(the|of|and|de|la|die)($|[ .,])"), summary=True)


def _feeds(spark, sf_dir) -> DataFrame:
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    feed = F.floor(F.col("page_id") / 20)
    title = F.when(feed % 8 == 4, "").otherwise(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    url = F.regexp_replace("url", "://[^/?#]*", "://feeds.example")
    item = F.concat(F.lit("<item><title>"), escaped(title), F.lit("</title><link>"), escaped(url), F.lit("</link></item>"))
    pages = _read(spark, sf_dir, "pages").select("page_id", feed.alias("feed"), F.when(feed % 8 == 5, F.concat(item, item)).otherwise(item).alias("item"))
    body = pages.groupBy("feed").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "item"))), lambda x: x["item"]), "").alias("items"))
    kind = F.col("feed") % 8
    root = F.when(kind == 3, "feed").otherwise("rss")
    text = F.concat(
        F.when(kind == 1, "<!doctype rss>").otherwise(""), F.lit("<"), root, F.lit("><channel>"), "items", F.lit("</channel>"),
        F.when(kind == 2, "").otherwise(F.concat(F.lit("</"), root, F.lit(">"))), F.when(kind == 6, F.concat(F.lit("<!--"), F.repeat(F.lit("x"), 200_000), F.lit("-->"))).otherwise(""),
    )
    found = body.select(F.col("feed").cast("string").alias("path"), text.cast("binary").alias("content"))
    return guarded.judged(guarded.feeds(found.withColumn("length", F.length("content").cast("long")), most_bytes=100_000, most_items=20), _PROFILE)


_FEEDS = r"""p AS (SELECT page_id, page_id // 20 AS feed, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\s+', ' ', 'g')) AS t, trim(regexp_replace(url, '://[^/?#]*', '://feeds.example')) AS url FROM pages),
i AS (SELECT feed, page_id * 2 + n AS place, CASE WHEN feed % 8 = 4 THEN '' ELSE t END AS title, url FROM p, (SELECT unnest([0, 1]) AS n) WHERE n = 0 OR feed % 8 = 5),
w AS (SELECT *, CASE WHEN title = '' THEN 'MISSING_TITLE' WHEN NOT regexp_matches(url, '^(?i)https://') THEN 'UNSAFE_SOURCE_URL' END AS early, regexp_replace(url, '#.*$', '') AS key FROM i),
v AS (SELECT *, coalesce(early, CASE WHEN NOT regexp_matches(title, '(?i)(^|[ .,])(the|of|and|de|la|die)($|[ .,])') THEN 'NOT_MACRO_RELEVANT' END) AS why FROM w),
j AS (SELECT *, coalesce(why, CASE WHEN place > min(CASE WHEN why IS NULL THEN place END) OVER (PARTITION BY feed, key) THEN 'DUPLICATE_URL' ELSE 'ACCEPTED' END) AS reason FROM v),
f AS (SELECT feed, CASE WHEN feed % 8 = 6 THEN 'EMPTY_OR_OVERSIZED_RESPONSE' WHEN feed % 8 = 1 THEN 'UNSAFE_XML_DECLARATION' WHEN feed % 8 = 2 THEN 'MALFORMED_RSS' WHEN feed % 8 = 3 THEN 'UNEXPECTED_RSS_ROOT'
WHEN count(*) > 20 THEN 'RSS_ITEM_LIMIT' WHEN count(*) FILTER (early IS NULL) = 0 THEN 'NO_USABLE_ARTICLES' ELSE 'AVAILABLE' END AS status, count(*) AS items, count(*) FILTER (reason = 'ACCEPTED') AS accepted,
count(*) FILTER (reason = 'UNSAFE_SOURCE_URL') AS unsafe, count(*) FILTER (reason = 'NOT_MACRO_RELEVANT') AS irrelevant, count(*) FILTER (reason = 'DUPLICATE_URL') AS again FROM j GROUP BY 1)"""


@_query(f"""WITH {_FEEDS} SELECT CAST(feed AS VARCHAR) AS path, status, CASE WHEN status = 'AVAILABLE' THEN items END AS items, CASE WHEN status = 'AVAILABLE' THEN accepted END AS accepted,
CASE WHEN status = 'AVAILABLE' THEN unsafe END AS unsafe, CASE WHEN status = 'AVAILABLE' THEN irrelevant END AS irrelevant, CASE WHEN status = 'AVAILABLE' THEN again END AS again FROM f""")
def feed_cycles(spark, sf_dir):
    out = guarded.cycles(_feeds(spark, sf_dir))
    of = lambda reason: F.when(F.col("status") == "AVAILABLE", F.coalesce(F.try_element_at("rejected", F.lit(reason)), F.lit(0)))
    return out.select("path", "status", F.col("input_item_count").alias("items"), F.col("accepted_item_count").alias("accepted"), of("UNSAFE_SOURCE_URL").alias("unsafe"), of("NOT_MACRO_RELEVANT").alias("irrelevant"), of("DUPLICATE_URL").alias("again"))


@_query(f"""WITH {_FEEDS} SELECT CAST(feed AS VARCHAR) AS path, key, title AS headline, '' AS event_time, 'Pages' AS source_name FROM j JOIN f USING (feed) WHERE status = 'AVAILABLE' AND reason = 'ACCEPTED'""")
def feed_headlines(spark, sf_dir):
    rows = guarded.headlines(_feeds(spark, sf_dir), _PROFILE, F.lit("2024-01-30T00:00:00Z"))
    return rows.select("path", "key", F.col("headline_or_text").alias("headline"), "event_time", "source_name")


# Evidence files: 50 events each, in nine forms.

_FORM = "event_id // 50 % 9"


def _evidence(spark, sf_dir) -> DataFrame:
    number = F.floor(F.col("event_id") / 50)
    row = F.to_json(F.struct(F.concat(F.lit("T"), F.col("event_id").cast("string")).alias("title"), F.col("event_type").alias("event_family"), F.col("event_id").alias("summary")))
    events = _read(spark, sf_dir, "events").select("event_id", number.alias("file"), row.alias("row"))
    joined = lambda by: F.array_join(F.transform("_rows", lambda x: x["row"]), by)
    made = events.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("event_id", "row"))).alias("_rows"))
    form, listed = F.col("file") % 9, joined(",")
    text = (
        F.when(form == 0, F.concat(F.lit("["), listed, F.lit("]"))).when(form == 1, F.concat(F.lit('{"items":['), listed, F.lit('],"records":5}')))
        .when(form == 2, F.concat(F.lit('{"items":5,"records":['), listed, F.lit("]}"))).when(form == 3, F.col("_rows")[0]["row"]).when(form == 4, F.concat(F.lit("["), listed, F.lit(",7]")))
        .when(form == 5, F.lit("7")).when(form == 6, F.concat(F.lit("["), listed)).when(form == 7, F.concat(joined("\r\n"), F.lit("\n\n"))).otherwise(F.concat(joined("\n"), F.lit("\n[1]")))
    )
    path = F.concat(F.col("file").cast("string"), F.when(form >= 7, ".jsonl").otherwise(".json"))
    found = made.select(path.alias("path"), text.cast("binary").alias("content"))
    return guarded.evidence(found.withColumn("length", F.length("content").cast("long")))


_FAULT = f"CASE WHEN {_FORM} = 6 THEN 'CONFIGURED_EVIDENCE_READ_FAILED' WHEN {_FORM} IN (4, 5, 8) THEN 'CONFIGURED_EVIDENCE_SCHEMA_INVALID' END"
_PATH = f"(event_id // 50) || CASE WHEN {_FORM} >= 7 THEN '.jsonl' ELSE '.json' END"


@_query(f"SELECT {_PATH} AS path, {_FAULT} AS fault, CASE WHEN {_FAULT} IS NOT NULL THEN NULL WHEN {_FORM} = 3 THEN 1 ELSE count(*) END AS n FROM events GROUP BY event_id // 50")
def evidence_files(spark, sf_dir):
    return _evidence(spark, sf_dir).select("path", "fault", F.when(F.col("rows").isNotNull(), F.size("rows").cast("long")).alias("n"))


@_query(f"""SELECT path, title, event_family, summary FROM (SELECT {_PATH} AS path, 'T' || event_id AS title, event_type AS event_family, CAST(event_id AS VARCHAR) AS summary, {_FAULT} AS fault,
{_FORM} AS form, row_number() OVER (PARTITION BY event_id // 50 ORDER BY event_id) AS n FROM events) WHERE fault IS NULL AND (form <> 3 OR n = 1)""")
def evidence_file_rows(spark, sf_dir):
    return guarded.evidence_rows(_evidence(spark, sf_dir), ["title", "event_family", "summary"]).drop("place")


# Items of news rows, whose aliases, clocks and marks come in all mixtures

_NAMED = ["title", "article_reference", "event_id", "identity_status", "reported_time_kind", "source_name", "collector"]


@_query("""WITH n AS (SELECT *, date_trunc('second', ts) AS o, event_id % 6 AS k, event_id % 5 AS p FROM events),
r AS (SELECT *, CASE WHEN p = 0 THEN o - INTERVAL 2 HOUR WHEN p = 2 THEN o - INTERVAL 3 HOUR END AS published FROM n),
q AS (SELECT *, coalesce(published, CASE WHEN event_id % 4 = 1 THEN o - INTERVAL 1 HOUR END) AS reported FROM r)
SELECT CASE WHEN event_id % 2 = 0 THEN 'T' ELSE 'H' END || event_id AS title, CASE event_id % 3 WHEN 0 THEN 'd' || event_id WHEN 1 THEN 'https://x/' || event_id END AS article_reference,
CASE WHEN event_id % 8 = 0 THEN 'e' || event_id END AS event_id, CASE WHEN event_id % 8 = 0 THEN 'VERIFIED_BY_SOURCE' ELSE 'UNKNOWN' END AS identity_status,
CASE WHEN reported IS NULL THEN 'UNKNOWN' WHEN event_id % 7 = 0 OR k = 1 OR (k = 0 AND published IS NULL) THEN 'SOURCE_DATE_PROXY' ELSE 'REPORTED_TIME' END AS reported_time_kind, event_type AS source_name,
CASE k WHEN 0 THEN 'gdelt' WHEN 1 THEN 'federal_register' WHEN 2 THEN 'rss' END AS collector, epoch_us(reported) AS reported_us FROM q""")
def news_items(spark, sf_dir):
    n = F.col("event_id")
    at = lambda hours: F.date_format(F.col("ts") - F.expr(f"interval {hours} hours"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    by = lambda m, *values: F.element_at(F.array(*[v if not isinstance(v, str) else F.lit(v) for v in values]), (n % m + 1).cast("int"))
    none, number = F.lit(None).cast("string"), n.cast("string")
    given = {
        "observed_time": at(0), "event_time": by(4, at(0), at(1), none, "bad"), "source_published_at": by(5, at(2), "2024-01-01", none, none, none), "published_at": by(5, none, at(3), at(3), none, none),
        "event_time_is_proxy": F.when(n % 7 == 0, " TRUE"), "discovery_record_id": F.when(n % 3 == 0, F.concat(F.lit("d"), number)), "url": F.when(n % 3 == 1, F.concat(F.lit("https://x/"), number)).otherwise("x"),
        "title": F.when(n % 2 == 0, F.concat(F.lit("T"), number)).otherwise("  "), "headline_or_text": F.concat(F.lit("<b>H</b>"), number), "canonical_event_id": F.concat(F.lit("e"), number),
        "identity_evidence_ref": F.lit("r"), "identity_status": by(8, "CANONICAL", "GUESS", none, none, none, none, none, none), "source_name": F.col("event_type"),
    }
    rows = _read(spark, sf_dir, "events").select(*[given.get(c, none).alias(c) for c in news.COLUMNS], by(6, "gdelt", "federal_register", "rss", none, none, none).alias("collector"))
    return news.items(rows).select(*_NAMED, F.unix_micros("reported_at").alias("reported_us"))


# Scopes

_KNOWN = "1997-06-01"
_SCOPED = f"""c AS (SELECT o_orderkey AS k, o_orderkey % 1000 AS entity, CAST(o_orderdate AS DATE) AS at, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 0 ELSE 1 END AS s FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '{_KNOWN}'),
r AS (SELECT l_orderkey % 1000 AS entity, max((CAST(l_shipdate AS DATE), l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 0 ELSE 1 END)) AS m FROM lineitem WHERE CAST(l_shipdate AS DATE) <= DATE '{_KNOWN}' GROUP BY 1),
l AS (SELECT entity, m[1] AS receipt_at, m[2] AS k, m[4] AS s FROM r),
u AS (SELECT k, NULL AS receipt_at, 'REGISTRATION' AS basis, s FROM c WHERE s < 2 OR entity NOT IN (SELECT entity FROM l) UNION ALL SELECT k, receipt_at, 'RECEIPT', greatest(c.s, l.s) FROM l JOIN c USING (k))"""


def _receipts(spark, sf_dir) -> DataFrame:
    scope = lambda c, private, public: F.when(F.col(c) == private, visibility.SCOPES[2]).when(F.col(c) == public, visibility.SCOPES[0]).alias(visibility.SCOPE)
    content = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 1000).alias("entity"), F.to_date("o_orderdate").alias("at"), scope("o_orderstatus", "F", "O"))
    receipts = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_orderkey") % 1000).alias("entity"), F.to_date("l_shipdate").alias("at"), "l_linenumber", scope("l_returnflag", "R", "A"))
    receipts = receipts.withColumn("_rank", visibility.rank(F.col(visibility.SCOPE)))
    return visibility.with_receipts(content, receipts, "k", "entity", "at", ["at", "k", "l_linenumber", "_rank"], F.lit(_KNOWN).cast("date"))


@_query(f"WITH {_SCOPED} SELECT k, receipt_at, basis, ['PUBLIC_REDISTRIBUTABLE', 'UNKNOWN', 'PRIVATE_RESEARCH_ONLY'][s + 1] AS scope FROM u")
def scoped_receipts(spark, sf_dir):
    return _receipts(spark, sf_dir).select("k", "receipt_at", "basis", F.col(visibility.SCOPE).alias("scope"))


@_query(f"WITH {_SCOPED} SELECT k, receipt_at, basis FROM u WHERE s = 0")
def public_receipts(spark, sf_dir):
    return visibility.public(_receipts(spark, sf_dir)).select("k", "receipt_at", "basis")
