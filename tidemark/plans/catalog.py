"""Named queries over the driver's tables and the equivalent SQL.

``events`` stands for the ledger (entity: user_id, kind: event_type, clock: ts, content: props and value), ``documents`` and
``pages`` for articles, ``orders`` and ``lineitem`` for events and members, ``part`` for provider markets. The clock is injected (NOW).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import scalars as S
from ..operators import asof, canonical, market, reaction, recency, selection, versions

NOW, AS_OF = "2024-01-30 00:00:00", "2024-01-20 12:00:00"
_found: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _query(sql: str | None):
    def add(function):
        _found[function.__name__] = (function, sql)
        return function

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bounded(rows: DataFrame, name: str, most: int) -> DataFrame:
    """``rows``, all of them; an error if there are more than ``most``."""
    if (n := rows.count()) > most:
        raise ValueError(f"{name} has {n} rows, the product takes {most} at most")
    return rows


def _ntz(value: str) -> Column:
    return F.lit(value).cast("timestamp_ntz")


# Versions and replay

@_query(f"""SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value
FROM events WHERE ts <= TIMESTAMP '{AS_OF}' GROUP BY user_id, event_type""")
def latest_version_asof(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return versions.latest(rows, ["user_id", "event_type"], ["ts", "event_id"], _ntz(AS_OF)).select("user_id", "event_type", "event_id", "value")


@_query("""SELECT user_id, event_id, event_type FROM (
SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
WHERE n = 1 OR b IS DISTINCT FROM event_type""")
def version_changes(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return versions.changes(rows, ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


@_query(f"""SELECT event_id, user_id, event_type FROM events e WHERE ts <= TIMESTAMP '{AS_OF}' AND EXISTS (
SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'signup' AND x.ts <= TIMESTAMP '{AS_OF}')""")
def related_entity_history(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return versions.related_history(rows, "user_id", "event_type", F.lit("signup"), _ntz(AS_OF), "ts").drop("ts")


@_query(f"""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n
FROM events WHERE ts <= TIMESTAMP '{AS_OF}') WHERE n = 1 AND event_type = 'purchase'""")
def replay_visible(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return versions.visible(rows, ["user_id"], ["ts", "event_id"], _ntz(AS_OF), "event_type", F.lit("purchase")).select("user_id", "event_id")


@_query(f"""SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS active_at_as_of
FROM events WHERE ts <= TIMESTAMP '{AS_OF}'""")
def history_active_flag(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return versions.active_flags(rows, ["user_id"], ["ts", "event_id"], _ntz(AS_OF)).select("event_id", "user_id", "active_at_as_of")


@_query("""SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_value, arg_max(event_id, (ts, event_id)) AS last_value, count(*) AS versions,
date_diff('second', date_trunc('second', min(ts)), date_trunc('second', max(ts))) AS span_seconds FROM events GROUP BY user_id""")
def first_last_version_latency(spark, sf_dir):
    out = versions.first_and_last(_read(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], "event_id")
    seconds = F.timestamp_diff("SECOND", F.date_trunc("second", "first_at"), F.date_trunc("second", "last_at"))
    return out.select("user_id", "first_value", "last_value", "versions", seconds.alias("span_seconds"))


@_query("""SELECT event_type, arg_max(props, (ts, event_id)) AS props, max(ts) AS ts FROM events GROUP BY event_type""")
def latest_by_record_type(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("event_type", "props", "ts", "event_id")
    return versions.latest(rows, ["event_type"], ["ts", "event_id"]).select("event_type", "props", "ts")


@_query("""WITH old AS (SELECT * FROM events WHERE event_id % 4 <> 0 AND ts < TIMESTAMP '2024-01-16'), inc AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND (event_id % 4 = 0 OR ts >= TIMESTAMP '2024-01-16' OR event_id % 5 = 0)),
st AS (SELECT user_id, max(ts) AS l, arg_max(event_type, (ts, event_id)) AS c FROM old GROUP BY user_id),
j AS (SELECT i.*, st.l, st.c, EXISTS (SELECT 1 FROM old o WHERE o.event_id = i.event_id) AS known FROM inc i LEFT JOIN st USING (user_id)),
w AS (SELECT *, coalesce(lag(ts) OVER k, l) AS prev, CASE WHEN lag(ts) OVER k IS NOT NULL THEN lag(event_type) OVER k ELSE c END AS was FROM j WINDOW k AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN known THEN 'SKIP_DUPLICATE_ID' WHEN ts < l THEN 'BACKDATED' WHEN ts = prev AND was IS DISTINCT FROM event_type THEN 'CONFLICT'
WHEN prev IS NOT NULL AND was IS NOT DISTINCT FROM event_type THEN 'SKIP_UNCHANGED' ELSE 'APPEND' END AS verdict FROM w""")
def append_classify(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    middle = _ntz("2024-01-16")
    old = rows.filter((F.col("event_id") % 4 != 0) & (F.col("ts") < middle))
    new = rows.filter((F.col("ts") >= _ntz("2024-01-10")) & ((F.col("event_id") % 4 == 0) | (F.col("ts") >= middle) | (F.col("event_id") % 5 == 0)))
    return versions.classify_append(old, new, ["user_id"], "ts", "event_id", "event_type").select("event_id", "verdict")


@_query("""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS attempts FROM events GROUP BY 1, 2""")
def quota_by_day(spark, sf_dir):
    return _read(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count("*").alias("attempts"))


# As-of and offset windows: views are quotes, known some minutes after they were made; purchases are anchors

_QUOTES = """q AS (SELECT user_id, ts AS made, ts + INTERVAL 1 MINUTE * (event_id % 90) AS known, event_id AS id, value FROM events WHERE event_type = 'view'),
a AS (SELECT user_id, event_id, ts, value FROM events WHERE event_type = 'purchase')"""


def _sides(spark, sf_dir):
    events = _read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value", "event_type")
    known = F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 90).cast("int"))
    quotes = events.filter("event_type = 'view'").select("user_id", F.col("ts").alias("made"), known.alias("known"), F.col("event_id").alias("id"), F.col("value").alias("quoted"))
    return events.filter("event_type = 'purchase'").drop("event_type"), quotes


@_query(f"""WITH {_QUOTES} SELECT a.event_id, arg_max(q.id, (q.made, q.known, q.id)) AS quote_id, arg_max(q.value, (q.made, q.known, q.id)) AS quoted
FROM a LEFT JOIN q ON q.user_id = a.user_id AND q.made <= a.ts AND q.known <= a.ts GROUP BY a.event_id""")
def asof_two_clock(spark, sf_dir):
    anchors, quotes = _sides(spark, sf_dir)
    out = asof.asof_join(anchors, quotes, "user_id", "ts", "made", "known", "id", "quoted")
    return out.select("event_id", F.col("quote.id").alias("quote_id"), F.col("quote.value").alias("quoted"))


_OFFSETS = [0, 300, 1800, 3600]


@_query(f"""WITH {_QUOTES}, t AS (SELECT a.*, o.o AS "offset", a.ts + INTERVAL 1 SECOND * o.o AS target FROM a, (VALUES (0), (300), (1800), (3600)) o(o)),
j AS (SELECT t.event_id, t."offset", any_value(t.target) AS target, max(q.made) AS made, arg_max(q.value, (q.made, q.known, q.id)) AS quoted
FROM t LEFT JOIN q ON q.user_id = t.user_id AND q.made <= t.target AND q.known <= t.target GROUP BY t.event_id, t."offset")
SELECT event_id, "offset", CASE WHEN made IS NULL THEN 'MISSING' WHEN target - made > INTERVAL 86400 SECOND THEN 'STALE' ELSE 'AVAILABLE' END AS status,
CASE WHEN target - made <= INTERVAL 86400 SECOND THEN quoted END AS quoted FROM j""")
def asof_offset_windows(spark, sf_dir):
    anchors, quotes = _sides(spark, sf_dir)
    out = asof.asof_join(asof.offset_windows(anchors, "ts", _OFFSETS), quotes, "user_id", "target", "made", "known", "id", "quoted")
    old = asof.stale(F.col("target"), F.col("quote.made"), 86_400)
    status = F.when(F.col("quote").isNull(), "MISSING").when(old, "STALE").otherwise("AVAILABLE")
    return out.select("event_id", "offset", status.alias("status"), F.when(~old, F.col("quote.value")).alias("quoted"))


@_query(f"""WITH {_QUOTES}, t AS (SELECT a.*, a.ts + INTERVAL 3600 SECOND AS target FROM a),
b AS (SELECT t.event_id, arg_max(q.value, (q.made, q.known, q.id)) AS v0 FROM t LEFT JOIN q ON q.user_id = t.user_id AND q.made <= t.ts AND q.known <= t.ts GROUP BY t.event_id),
c AS (SELECT t.event_id, arg_max(q.value, (q.made, q.known, q.id)) AS v1 FROM t LEFT JOIN q ON q.user_id = t.user_id AND q.made <= t.target AND q.known <= t.target GROUP BY t.event_id)
SELECT event_id, CASE WHEN v0 <> 0 THEN (v1 / v0 - 1) * 100 END AS change_pct FROM b JOIN c USING (event_id)""")
def change_since_anchor(spark, sf_dir):
    anchors, quotes = _sides(spark, sf_dir)
    out = asof.asof_join(anchors, quotes, "user_id", "ts", "made", "known", "id", "quoted").withColumnRenamed("quote", "base")
    out = out.withColumn("target", F.col("ts") + F.make_dt_interval(hours=F.lit(1)))
    out = asof.asof_join(out, quotes, "user_id", "target", "made", "known", "id", "quoted")
    change = F.when(F.col("base.value") != 0, (F.col("quote.value") / F.col("base.value") - 1) * 100)
    return out.select("event_id", change.alias("change_pct"))


@_query("""WITH o AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS d, max(o_totalprice) AS v FROM orders GROUP BY 1, 2),
a AS (SELECT k, min(d) + CAST(datediff('day', min(d), max(d)) // 2 AS INTEGER) AS e FROM o GROUP BY k)
SELECT a.k AS custkey, CAST(e AS VARCHAR) AS event_date, CAST(max(d) FILTER (WHERE d < e) AS VARCHAR) AS pre_date, arg_max(v, d) FILTER (WHERE d < e) AS pre_value,
CAST(min(d) FILTER (WHERE d > e) AS VARCHAR) AS post_date, arg_min(v, d) FILTER (WHERE d > e) AS post_value FROM a JOIN o ON o.k = a.k GROUP BY a.k, e""")
def nearest_before_after(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("custkey"), F.to_date("o_orderdate").alias("d")).agg(F.max("o_totalprice").alias("v"))
    middle = F.date_add(F.min("d"), F.floor(F.datediff(F.max("d"), F.min("d")) / 2).cast("int"))
    out = asof.nearest(rows.groupBy("custkey").agg(middle.alias("event_date")), rows, "custkey", "event_date", "d", "v")
    return out.withColumns({c: F.col(c).cast("string") for c in ("event_date", "pre_date", "post_date")})


@_query("""WITH o AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events), s AS (SELECT user_id, min(d) AS lo, max(d) AS hi FROM o GROUP BY 1),
g AS (SELECT user_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS missing_date FROM s)
SELECT user_id, CAST(missing_date AS VARCHAR) AS missing_date FROM g ANTI JOIN o ON o.user_id = g.user_id AND o.d = g.missing_date""")
def missing_dates(spark, sf_dir):
    return asof.missing_dates(_read(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("d")), "user_id", "d").withColumn("missing_date", F.col("missing_date").cast("string"))


# Recency and health

_BUCKET = """CASE WHEN ts IS NULL THEN 'UNKNOWN' WHEN ts > TIMESTAMP '{n}' THEN 'INVALID_FUTURE' WHEN TIMESTAMP '{n}' - ts <= INTERVAL 86400 SECOND THEN 'LAST_24H'
WHEN TIMESTAMP '{n}' - ts <= INTERVAL 172800 SECOND THEN 'LAST_48H' ELSE 'OLDER' END""".format(n=NOW)


def _bucketed(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("user_id", "event_type", recency.bucket(_ntz(NOW), F.col("ts")).alias("bucket"))


@_query(f"""WITH b AS (SELECT {_BUCKET} AS b FROM events) SELECT count(*) FILTER (WHERE b = 'LAST_24H') AS last_24h, count(*) FILTER (WHERE b IN ('LAST_24H', 'LAST_48H')) AS last_48h,
count(*) FILTER (WHERE b = 'OLDER') AS older, count(*) FILTER (WHERE b IN ('UNKNOWN', 'INVALID_FUTURE')) AS unknown FROM b""")
def recency_buckets(spark, sf_dir):
    return recency.counts(_bucketed(spark, sf_dir), "bucket")


@_query(f"""WITH b AS (SELECT user_id, {_BUCKET} AS b FROM events), p AS (SELECT user_id, bool_or(b = 'LAST_24H') AS d1, bool_or(b IN ('LAST_24H', 'LAST_48H')) AS d2 FROM b GROUP BY 1)
SELECT count(*) FILTER (WHERE d1) AS parents_24h, count(*) FILTER (WHERE d2) AS parents_48h, count(*) AS parents FROM p""")
def recent_parent_counts(spark, sf_dir):
    return recency.parents_with_recent(_bucketed(spark, sf_dir), "user_id", "bucket")


_HEALTH = f"""h AS (SELECT user_id, max(ts) AS last_success, CASE WHEN max(ts) > TIMESTAMP '{NOW}' THEN 'UNKNOWN' WHEN TIMESTAMP '{NOW}' - max(ts) > INTERVAL 21600 SECOND THEN 'STALE' ELSE 'FRESH' END AS status FROM events GROUP BY user_id)"""


@_query(f"WITH {_HEALTH} SELECT user_id, last_success, status FROM h")
def source_health(spark, sf_dir):
    return recency.health(_read(spark, sf_dir, "events"), "user_id", "ts", _ntz(NOW), 21_600)


@_query(f"""WITH h AS (SELECT event_type, CASE WHEN max(ts) > TIMESTAMP '{NOW}' THEN 'UNKNOWN' WHEN TIMESTAMP '{NOW}' - max(ts) > INTERVAL 21600 SECOND THEN 'STALE' ELSE 'FRESH' END AS status FROM events GROUP BY 1),
m AS (SELECT count(*) AS missing FROM (VALUES ('click'), ('view'), ('refund')) r(x) WHERE x NOT IN (SELECT lower(event_type) FROM h))
SELECT CASE WHEN missing > 0 THEN 'PARTIAL' WHEN (SELECT count(*) FROM h WHERE status <> 'FRESH') > 0 THEN 'DEGRADED' ELSE 'HEALTHY' END AS overall, missing FROM m""")
def overall_health(spark, sf_dir):
    rows = recency.health(_read(spark, sf_dir, "events"), "event_type", "ts", _ntz(NOW), 21_600)
    return recency.overall(rows, ["Click", "view", "refund"], "event_type")


@_query(f"""SELECT event_id, CASE WHEN ts IS NULL THEN 'NO_CACHE' WHEN TIMESTAMP '{NOW}' - ts >= INTERVAL 604800 SECOND THEN 'STALE_CACHE' ELSE 'FRESH_CACHE' END AS cache FROM events""")
def cache_freshness(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", recency.cache_status(_ntz(NOW), F.col("ts"), 604_800).alias("cache"))


# Merges, conflicts, rankings

@_query("""WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events) WHERE n = 1),
h AS (SELECT user_id, count(*) AS held FROM f WHERE event_type = 'signup' GROUP BY 1),
r AS (SELECT f.*, row_number() OVER (PARTITION BY f.user_id ORDER BY ts DESC, event_id) AS rk FROM f WHERE event_type <> 'signup')
SELECT event_id, user_id FROM f WHERE event_type = 'signup' UNION ALL SELECT r.event_id, r.user_id FROM r LEFT JOIN h USING (user_id) WHERE rk <= 10 - coalesce(held, 0)""")
def first_wins_retention(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts").withColumn("key", F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")))
    once = selection.first_wins(rows, "key", ["ts", "event_id"])
    return selection.retain(once, "user_id", F.col("event_type") == "signup", [F.desc("ts"), F.col("event_id")], 10).select("event_id", "user_id")


@_query("""SELECT md5(coalesce(text, '')) AS text_key, count(*) AS copies, count(DISTINCT coalesce(source, '~')) = 1 AND count(DISTINCT coalesce(lang, '~')) = 1 AS consistent, min(doc_id) AS first_at
FROM documents GROUP BY 1""")
def copy_consistency(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").select(F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_key"), "source", "lang", "doc_id")
    return selection.consistent_copies(rows, "text_key", ["source", "lang"], "doc_id")


@_query("""WITH c AS (SELECT md5(coalesce(text, '')) AS k, count(*) AS copies, min((coalesce(source, ''), coalesce(lang, ''))) = max((coalesce(source, ''), coalesce(lang, ''))) AS same, min(source) AS s, min(lang) AS l FROM documents GROUP BY 1)
SELECT k AS text_key, copies, CASE WHEN same THEN 'CONFIRMED' ELSE 'AMBIGUOUS_EVIDENCE' END AS evidence_status, CASE WHEN same THEN s END AS source, CASE WHEN same THEN l END AS lang FROM c""")
def evidence_conflict_status(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").select(F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_key"), "source", "lang")
    return selection.evidence_status(rows, "text_key", ["source", "lang"])


@_query("""SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING count(*) = 1)""")
def unambiguous_reference(spark, sf_dir):
    return selection.unambiguous(_read(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_name"), "s_nationkey").select("s_suppkey", "s_name")


@_query("""WITH refs AS (SELECT CAST(o_orderkey AS VARCHAR) AS ref, CAST(o_custkey AS VARCHAR) AS target FROM orders UNION ALL SELECT 'c' || c_mktsegment, CAST(c_custkey AS VARCHAR) FROM customer),
f AS (SELECT ref, count(DISTINCT target) AS n, min(target) AS one FROM refs GROUP BY 1),
r AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_orderkey + (CASE WHEN l_linenumber % 5 = 0 THEN 100000000 ELSE 0 END) AS VARCHAR) END AS a,
CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_orderkey + (CASE WHEN l_linenumber % 4 = 0 THEN 1 ELSE 0 END) AS VARCHAR) WHEN l_linenumber = 7 THEN 'cBUILDING' END AS b FROM lineitem),
u AS (SELECT DISTINCT row_id, 0 AS place, a AS ref FROM r WHERE a IS NOT NULL UNION SELECT DISTINCT row_id, 1, b FROM r WHERE b IS NOT NULL),
m AS (SELECT u.*, CASE WHEN f.n IS NULL THEN 'REFERENCE_NOT_FOUND' WHEN f.n > 1 THEN 'AMBIGUOUS_REFERENCE' END AS why, f.one FROM u LEFT JOIN f USING (ref)),
g AS (SELECT row_id, arg_min(why, place) FILTER (WHERE why IS NOT NULL) AS why, min(one) AS lo, max(one) AS hi FROM m GROUP BY 1)
SELECT r.row_id, CASE WHEN g.why IS NULL AND lo = hi THEN lo END AS target, CASE WHEN g.row_id IS NULL THEN 'NO_EXPLICIT_REFERENCE' WHEN g.why IS NOT NULL THEN g.why WHEN lo <> hi THEN 'CONFLICTING_REFERENCES' ELSE 'EXPLICIT_UNIQUE_LINK' END AS status
FROM (SELECT DISTINCT row_id FROM r) r LEFT JOIN g USING (row_id)""")
def evidence_resolution(spark, sf_dir):
    orders, customer = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "customer")
    refs = orders.select(F.col("o_orderkey").cast("string").alias("ref"), F.col("o_custkey").cast("string").alias("target"))
    refs = refs.unionByName(customer.select(F.concat(F.lit("c"), "c_mktsegment").alias("ref"), F.col("c_custkey").cast("string").alias("target")))
    n, order = F.col("l_linenumber"), F.col("l_orderkey")
    rows = _read(spark, sf_dir, "lineitem").select(
        (order * 10 + n).alias("row_id"),
        F.when(n % 3 != 0, (order + F.when(n % 5 == 0, 100_000_000).otherwise(0)).cast("string")).alias("a"),
        F.when(n % 2 == 0, (order + F.when(n % 4 == 0, 1).otherwise(0)).cast("string")).when(n == 7, "cBUILDING").alias("b"),
    ).distinct()
    return selection.resolve(rows, "row_id", ["a", "b"], refs, "ref", "target").distinct()


@_query("""SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)""")
def label_semi(spark, sf_dir):
    labels = _read(spark, sf_dir, "labels").filter("quality = 1")
    return _read(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id", "left_semi")


@_query("""SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def label_anti(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", "source").join(_read(spark, sf_dir, "labels"), "doc_id", "left_anti")


@_query("""WITH p AS (SELECT p_partkey, p_brand, p_size % 3 AS phase, substr(p_type, 1, strpos(p_type || ' ', ' ') - 1) AS lane FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY phase, lane ORDER BY CAST(p_partkey AS VARCHAR)) AS turn, list_position(['PROMO', 'ECONOMY', 'STANDARD', 'SMALL'], lane) AS k FROM p)
SELECT p_partkey, lane, row_number() OVER (ORDER BY phase, turn, k) AS position FROM r WHERE k > 0 QUALIFY position <= 20""")
def round_robin_topk(spark, sf_dir):
    rows = _read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 3).alias("phase"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("lane"))
    return selection.round_robin(rows, "phase", "lane", ["PROMO", "ECONOMY", "STANDARD", "SMALL"], [F.col("p_partkey").cast("string")], 20).select("p_partkey", "lane", "position")


@_query("""SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, value DESC, event_id DESC) AS n FROM events) WHERE n = 1 ORDER BY ts DESC, value DESC, event_id DESC LIMIT 5""")
def brief_top5(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return selection.one_per_group(rows, "user_id", [F.desc("ts"), F.desc("value"), F.desc("event_id")], 5).select("event_id", "user_id")


@_query("""SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100""")
def feed_order_topn(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)


# Canonical events: same user, type and day within six hours, first fit in id order

@_query("""WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS day, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY event_id) AS n FROM events),
f AS (SELECT user_id, event_type, day, n, event_id, 0 AS g, [{'lo': us, 'hi': us}] AS gs FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.event_type, e.day, e.n, e.event_id, coalesce(list_position(fit, true), len(gs) + 1)::INTEGER - 1,
CASE WHEN list_position(fit, true) IS NULL THEN list_append(gs, {'lo': e.us, 'hi': e.us}) ELSE list_transform(gs, lambda x, i: CASE WHEN i = list_position(fit, true) THEN {'lo': least(x.lo, e.us), 'hi': greatest(x.hi, e.us)} ELSE x END) END
FROM (SELECT f.*, x.us, x.event_id AS eid, list_transform(f.gs, lambda q: greatest(q.hi, x.us) - least(q.lo, x.us) <= 21600000000) AS fit FROM f JOIN e x ON x.user_id = f.user_id AND x.event_type = f.event_type AND x.day = f.day AND x.n = f.n + 1) z
JOIN e ON e.event_id = z.eid)
SELECT event_id, min(event_id) OVER (PARTITION BY user_id, event_type, day, g) AS group_id FROM f""")
def cluster_first_fit_6h(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"), canonical.micros(F.col("ts")).alias("us"))
    return canonical.first_fit(rows, ["user_id", "event_type", "day"], "event_id", "us", 21_600_000_000)


@_query("""SELECT a.event_id AS a, b.event_id AS b, abs(date_diff('microsecond', a.ts, b.ts)) <= 21600000000 AS merges FROM events a JOIN events b
ON a.user_id = b.user_id AND a.event_type = b.event_type AND CAST(a.ts AS DATE) = CAST(b.ts AS DATE) AND a.event_id < b.event_id""")
def merge_evidence_pairs(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"), canonical.micros(F.col("ts")).alias("us"))
    return canonical.pair_evidence(rows, ["user_id", "event_type", "day"], "event_id", "us", 21_600_000_000)


@_query("""SELECT p_brand, count(*) AS members, arg_min(p_name, (length(p_name), lower(p_name), p_name)) AS title, count(DISTINCT p_type) AS kinds, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part GROUP BY p_brand""")
def cluster_summary(spark, sf_dir):
    rows = _read(spark, sf_dir, "part")
    return rows.groupBy("p_brand").agg(
        F.count("*").alias("members"), canonical.shortest("p_name").alias("title"), F.count_distinct("p_type").alias("kinds"),
        F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"),
    )


@_query("""SELECT doc_id, 'canonical-event-v0-' || sha256('["CANONICAL_EVENT_V0",["doc/' || doc_id || '"]]') AS event_id FROM documents""")
def content_identity(spark, sf_dir):
    ref = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    return _read(spark, sf_dir, "documents").select("doc_id", S.event_id(F.array(ref)).alias("event_id"))


# Links

@_query("""SELECT a.s_suppkey AS a, b.s_suppkey AS b, a.s_nationkey AS nation FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey""")
def pair_comparable(spark, sf_dir):
    cases = _read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    return reaction.comparable_pairs(cases, "s_suppkey", ["nation"])


@_query("""SELECT r_regionkey AS region, n_nationkey AS nation, CASE WHEN r_regionkey <> n_regionkey THEN 'NO_MATCH' WHEN substr(n_name, 1, 1) = substr(r_name, 1, 1) THEN 'LINKED' WHEN length(n_name) > 8 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'AMBIGUOUS' END AS link_status FROM region, nation""")
def theta_link_decision(spark, sf_dir):
    region, nation = (_bounded(_read(spark, sf_dir, name), name, 100) for name in ("region", "nation"))
    pairs = region.crossJoin(F.broadcast(nation))  # two bounded registries, a hundred rows each at most
    first = lambda c: F.substring(c, 1, 1)
    status = (
        F.when(F.col("r_regionkey") != F.col("n_regionkey"), "NO_MATCH").when(first("n_name") == first("r_name"), "LINKED")
        .when(F.length("n_name") > 8, "INSUFFICIENT_EVIDENCE").otherwise("AMBIGUOUS")
    )
    return pairs.select(F.col("r_regionkey").alias("region"), F.col("n_nationkey").alias("nation"), status.alias("link_status"))


@_query("""WITH l AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) SELECT l_orderkey, l_partkey, CASE WHEN count(*) OVER (PARTITION BY l_partkey) > 1 THEN 'AMBIGUOUS' ELSE 'LINKED' END AS link_status FROM l""")
def link_ambiguity(spark, sf_dir):
    return selection.ambiguous_links(_read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct(), "l_orderkey", "l_partkey")


@_query("""WITH cur AS (SELECT c_custkey AS event, c_nationkey AS market FROM customer WHERE c_custkey % 7 = 0), auto AS (SELECT DISTINCT o_custkey AS event, CAST(o_orderkey % 25 AS INTEGER) AS market FROM orders)
SELECT event, market, 'CURATED' AS link_source FROM cur UNION ALL SELECT event, market, 'AUTOMATIC' FROM auto WHERE event NOT IN (SELECT event FROM cur) AND event IN (SELECT c_custkey FROM customer)""")
def curated_mapping_override(spark, sf_dir):
    customer = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("event"), F.col("c_nationkey").alias("market"))
    curated = customer.filter("event % 7 = 0").withColumn("valid", F.lit(True))
    auto = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("event"), (F.col("o_orderkey") % 25).cast("int").alias("market"))
    return selection.curated_override(customer, auto, curated, "event", "market")


# Urls and text

_KEY = r"""lower(regexp_extract(url, '^(?i)(https?://[^/?#]+)', 1)) || regexp_extract(url, '^(?i)https?://[^/?#]+([^#]*)', 1)"""


@_query(f"SELECT page_id, {_KEY} AS url_key FROM pages WHERE regexp_matches(url, '^(?i)https?://[^/?#]+')")
def url_key(spark, sf_dir):
    return _read(spark, sf_dir, "pages").filter(S.valid_url(F.col("url"))).select("page_id", S.url_key(F.col("url")).alias("url_key"))


@_query("""WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^(https://[^/?#]+)', 1)) AS head, regexp_extract(url, '^https://[^/?#]+([^?#]*)', 1) AS path,
list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND split_part(lower(x), '=', 1) NOT IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid')) AS kept FROM pages)
SELECT page_id, CASE WHEN head <> '' THEN head || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS clean_url FROM p""".replace("\\\\", "\\"))
def url_strip_tracking(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", S.without_tracking(F.col("url")).alias("clean_url"))


@_query("""SELECT regexp_matches(url, '^(?i)https?://[^/?#]+') AS valid, regexp_matches(url, '^(?i)https://(?:spam-farm\\.example\\.org|therha\\.example\\.com)(?::443)?(?:[/?#]|$)') AS allowed, count(*) AS pages FROM pages GROUP BY 1, 2""")
def url_valid_and_allowed(spark, sf_dir):
    url = F.col("url")
    hosts = S.allowed_url(url, ["spam-farm.example.org", "therha.example.com"])
    return _read(spark, sf_dir, "pages").groupBy(S.valid_url(url).alias("valid"), hosts.alias("allowed")).agg(F.count("*").alias("pages"))


_REJECT = """CASE WHEN title IS NULL OR title = '' THEN 'MISSING_TITLE' WHEN NOT regexp_matches(url, '^(?i)https://') THEN 'UNSAFE_SOURCE_URL' WHEN NOT regexp_matches(title, '(?i)\\b(the|of|and)\\b') THEN 'NOT_MACRO_RELEVANT' END"""


@_query(f"""WITH t AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages), r AS (SELECT *, {_REJECT} AS why FROM t),
d AS (SELECT *, CASE WHEN why IS NULL AND row_number() OVER (PARTITION BY why IS NULL, {_KEY} ORDER BY page_id) > 1 THEN 'DUPLICATE_URL' ELSE why END AS reason FROM r)
SELECT coalesce(reason, 'ACCEPTED') AS reason, count(*) AS pages FROM d GROUP BY 1""")
def reject_reason_counts(spark, sf_dir):
    from ..sources.rss import reject_reasons

    rows = _read(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    relevant = F.col("title").rlike(r"(?i)\b(the|of|and)\b")
    return reject_reasons(rows, "title", "url", "page_id", relevant).groupBy("reason").agg(F.count("*").alias("pages"))


_TERMS = [("FUNCTION", r"\b(the|of|and|in)\b"), ("ROMANCE", r"\b(de|la|les|el|que)\b"), ("GERMAN", r"\b(der|die|und|das)\b")]


_WORDS = r"regexp_extract_all(lower(text), '[\pL\pN_]+')"


@_query(f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents) SELECT doc_id, CASE WHEN list_has_any(ws, ['the', 'of', 'and', 'in']) THEN 'FUNCTION'
WHEN list_has_any(ws, ['de', 'la', 'les', 'el', 'que']) THEN 'ROMANCE' WHEN list_has_any(ws, ['der', 'die', 'und', 'das']) THEN 'GERMAN' END AS topic FROM w""")
def topic_first_match(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", S.first_topic(F.col("text"), _TERMS).alias("topic"))


@_query(f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents)
SELECT doc_id, array_to_string(list_sort(list_intersect(list_distinct(ws), ['the', 'of', 'and', 'in', 'der', 'die', 'und', 'das'])), ',') AS terms FROM w""")
def matched_terms(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(S.matched_terms(F.col("text"), [_TERMS[0][1], _TERMS[2][1]])), ",").alias("terms"))


def _macro_sql() -> str:
    from ..functions.lexicons import CONTEXT_PAIRS, MACRO_TITLE, RATE_MARKET

    hit = lambda p: f"regexp_matches(text, '(?i){p}')"
    rules = [hit(MACRO_TITLE), hit(RATE_MARKET), *(f"({hit(a)} AND {hit(b)})" for a, b in CONTEXT_PAIRS)]
    return f"SELECT doc_id, {' OR '.join(rules)} AS relevant FROM documents"


@_query(_macro_sql())
def lexicon_relevance(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", S.macro_relevant(F.col("text")).alias("relevant"))


@_query("""SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '\\bthe\\b')) AS BIGINT) AS the_count, CAST(len(regexp_extract_all(lower(text), '\\bder\\b')) AS BIGINT) AS der_count FROM documents""")
def mention_scoring(spark, sf_dir):
    n = lambda w: F.regexp_count(F.lower("text"), F.lit(rf"\b{w}\b")).cast("long")
    return _read(spark, sf_dir, "documents").select("doc_id", n("the").alias("the_count"), n("der").alias("der_count"))


@_query("""SELECT p_partkey, CASE WHEN regexp_matches(lower(p_type), '\\b(steel)\\b') THEN NULL WHEN regexp_matches(lower(p_type), '\\b(brass|copper)\\b') THEN 'WARM' WHEN regexp_matches(lower(p_type), '\\b(tin|nickel)\\b') THEN 'COLD' END AS kind FROM part""")
def category_label(spark, sf_dir):
    kind = S.category(F.col("p_type"), F.lit(None).cast("string"), [r"\b(steel)\b"], [("WARM", r"\b(brass|copper)\b"), ("COLD", r"\b(tin|nickel)\b")])
    return _read(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"))


@_query("""WITH m AS (SELECT p_partkey, list_filter([CASE WHEN regexp_matches(p_type, '(?i)\\bbrass\\b') THEN 'A' END, CASE WHEN regexp_matches(p_type, '(?i)\\bpromo\\b') AND NOT regexp_matches(p_type, '(?i)\\btin\\b') THEN 'B' END, CASE WHEN regexp_matches(p_type, '(?i)\\bplated\\b') THEN 'C' END], lambda x: x IS NOT NULL)[1:2] AS ms FROM part)
SELECT p_partkey, array_to_string(ms, ',') AS mechanisms FROM m""")
def mechanism_rules(spark, sf_dir):
    rules = [("A", r"\bbrass\b", None, None), ("B", r"\bpromo\b", None, r"\btin\b"), ("C", r"\bplated\b", None, None)]
    return _read(spark, sf_dir, "part").select("p_partkey", F.array_join(S.mechanisms(F.col("p_type"), rules), ",").alias("mechanisms"))


@_query(f"""SELECT event_id, CASE WHEN event_type = 'error' THEN 'REVIEW_FIRST' WHEN TIMESTAMP '{NOW}' - ts <= INTERVAL 172800 SECOND AND value >= 100 THEN 'HIGH' WHEN value >= 100 THEN 'BACKGROUND' ELSE 'LOW' END AS priority FROM events""")
def triage_priority(spark, sf_dir):
    fresh = recency.age_seconds(_ntz(NOW), F.col("ts")) <= recency.TWO_DAYS
    priority = F.when(F.col("event_type") == "error", "REVIEW_FIRST").when(fresh & (F.col("value") >= 100), "HIGH").when(F.col("value") >= 100, "BACKGROUND").otherwise("LOW")
    return _read(spark, sf_dir, "events").select("event_id", priority.alias("priority"))


@_query("""WITH t AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_id % 3 = 0 THEN 'Z' WHEN event_id % 3 = 1 THEN '+00:00' ELSE '' END AS raw, ts FROM events)
SELECT event_id, raw, CASE WHEN event_id % 3 <> 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS parsed FROM t""")
def iso_parse_guarded(spark, sf_dir):
    zone = F.when(F.col("event_id") % 3 == 0, "Z").when(F.col("event_id") % 3 == 1, "+00:00").otherwise("")
    raw = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone)
    rows = _read(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    shown = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), S.instant(F.col("raw")).cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return rows.select("event_id", "raw", shown.alias("parsed"))


@_query("""WITH f AS (SELECT user_id, count(*) AS failures FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT user_id, failures, CASE WHEN user_id % 10 = 3 THEN greatest(least(3600, CAST(60 * power(2, least(failures, 5)) AS BIGINT)), 86400) ELSE least(3600, CAST(60 * power(2, least(failures, 5)) AS BIGINT)) END AS wait, failures >= 5 OR user_id % 10 = 3 AS circuit_open FROM f""")
def backoff_schedule(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").filter("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("failures"))
    status = F.when(F.col("user_id") % 10 == 3, 403).otherwise(500)
    return rows.select("user_id", "failures", S.backoff(F.lit(60), F.col("failures"), 3600, status).alias("wait"), S.circuit_open(F.col("failures"), status).alias("circuit_open"))


@_query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_props(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# Sets and structures

@_query("SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders")
def set_union(spark, sf_dir):
    return _keys(spark, sf_dir, "customer", "c_custkey").union(_keys(spark, sf_dir, "orders", "o_custkey")).distinct()


@_query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def set_intersect(spark, sf_dir):
    return _keys(spark, sf_dir, "customer", "c_custkey").intersect(_keys(spark, sf_dir, "orders", "o_custkey"))


@_query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def set_except(spark, sf_dir):
    urgent = _read(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"))
    return _keys(spark, sf_dir, "customer", "c_custkey").subtract(urgent)


def _keys(spark, sf_dir, table, column):
    return _read(spark, sf_dir, table).select(F.col(column).alias("k"))


@_query("""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_totalprice < 50000 THEN 'PRICE_UNKNOWN' END, CASE WHEN o_orderstatus = 'P' THEN 'STATUS_UNKNOWN' END, CASE WHEN o_orderpriority LIKE '1%' THEN 'PRIORITY_UNKNOWN' END], lambda x: x IS NOT NULL), '|') AS unknown_codes FROM orders""")
def unknown_codes(spark, sf_dir):
    codes = F.array(F.when(F.col("o_totalprice") < 50000, "PRICE_UNKNOWN"), F.when(F.col("o_orderstatus") == "P", "STATUS_UNKNOWN"), F.when(F.col("o_orderpriority").startswith("1"), "PRIORITY_UNKNOWN"))
    return _read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.filter(codes, lambda x: x.isNotNull()), "|").alias("unknown_codes"))


@_query("""SELECT n_nationkey, n_name, count(s_suppkey) AS members, coalesce(array_to_string(list_sort(list(s_suppkey) FILTER (WHERE s_suppkey IS NOT NULL))[1:3], ','), '') AS first_three, greatest(0, count(s_suppkey) - 3) AS more
FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2""")
def marker_groups(spark, sf_dir):
    members = _read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    shown = selection.first_members(members, "n_nationkey", "s_suppkey", 3)
    rows = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name").join(shown, "n_nationkey", "left")
    n = F.coalesce("members", F.lit(0)).cast("long")
    first = F.coalesce(F.array_join(F.col("first").cast("array<string>"), ","), F.lit(""))
    return rows.select("n_nationkey", "n_name", n.alias("members"), first.alias("first_three"), F.greatest(F.lit(0), n - 3).cast("long").alias("more"))


@_query("""WITH o AS (SELECT p_partkey, string_split(p_type, ' ') AS labels FROM part) SELECT p_partkey, CASE WHEN len(labels) = 2 THEN 'BINARY' WHEN len(labels) > 2 THEN 'MULTI_OUTCOME' ELSE 'UNKNOWN' END AS outcome_type FROM o""")
def outcome_type(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", market.outcome_type(F.split("p_type", " ")).alias("outcome_type"))


@_query("""WITH e AS (SELECT conv_id AS thread, 'NEWS' AS kind, turn AS t, role || ':' || turn AS id FROM conversations UNION ALL SELECT user_id, 'OFFICIAL', event_id, event_type || ':' || event_id FROM events WHERE event_type = 'signup')
SELECT thread, kind, id, row_number() OVER (PARTITION BY thread ORDER BY t NULLS LAST, kind, id) AS position FROM e""")
def timeline_entries(spark, sf_dir):
    news = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("thread"), F.lit("NEWS").alias("kind"), F.col("turn").alias("at"), F.concat_ws(":", "role", F.col("turn").cast("string")).alias("id"))
    official = _read(spark, sf_dir, "events").filter("event_type = 'signup'").select(F.col("user_id").alias("thread"), F.lit("OFFICIAL").alias("kind"), F.col("event_id").alias("at"), F.concat_ws(":", "event_type", F.col("event_id").cast("string")).alias("id"))
    return canonical.timeline(news.unionByName(official), "thread", "at", "kind", "id").select("thread", "kind", "id", "position")


@_query(None)
def two_key_dedupe(spark, sf_dir):
    rows = _read(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    rows = rows.select(F.col("page_id").alias("ord"), "page_id", S.url_key(F.col("url")).alias("url_key"), F.sha2("title", 256).alias("article_key"))
    return canonical.two_key_dedupe(rows, "url_key", "article_key", "ord").select("page_id")


@_query(None)
def html_text(spark, sf_dir):
    from ..functions.arrow import html_to_text

    return _read(spark, sf_dir, "pages").select("page_id", html_to_text("html").alias("text"))


@_query(None)
def nfkc_title(spark, sf_dir):
    from ..functions.arrow import normal_title

    return _read(spark, sf_dir, "documents").select("doc_id", normal_title("text").alias("title"))


@_query("""SELECT user_id, arg_min(event_id, event_id) AS event_id FROM events GROUP BY user_id""")
def stream_first_seen(spark, sf_dir):
    from ..streaming.polls import first_seen_batch

    return first_seen_batch(_read(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id")


def _with_views() -> None:
    from . import guarded, known, views  # noqa: F401  (these register their queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _with_views()
    return {name: function for name, (function, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    _with_views()
    return {name: sql for name, (_, sql) in _found.items() if sql}
