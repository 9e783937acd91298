"""Golden values, boundaries and brute-force comparisons of the reference operators."""

import datetime as dt
import json
import os
import random
import re

import pytest
from pyspark.sql import Window, functions as F

from tidemark.functions import scalars as S
from tidemark.functions.arrow import BLOCK, normal, plain_text
from tidemark.operators import asof, canonical, components, context, evidence, linker, reaction, recency, selection
from tidemark.sources import news, rss

HEADER = "headline_or_text,source_name,source_url,source_published_at,observed_time,event_time,discovery_record_id"
ARTICLES = [
    "ECB cuts interest rates by 25 basis points,Wire,https://wire.example/a,2025-03-06T13:15:00Z,2025-03-06T13:20:00Z,,r1",
    "ECB lowers rates by 25 bps,Desk,https://desk.example/b,2025-03-06T15:00:00Z,2025-03-06T15:05:00Z,,r2",
    "ECB lowers rates by 25 bps,Desk,https://desk.example/b#again,2025-03-06T15:00:00Z,2025-03-06T16:05:00Z,,r3",
    "Storm hits coast,Wire,https://wire.example/c,,2025-03-07T08:00:00Z,,r4",
    "Storm hits coast,Wire,https://wire.example/d,2025-03-07T08:00:00Z,2025-03-07T08:00:00Z,,r4",
]


def test_inbox_rows_become_canonical_events(spark, tmp_path):
    """Copies go by url and by record; two reports of one decision within six hours are one event; ids are hashes of canonical JSON."""
    import hashlib

    folder = tmp_path / "news"
    folder.mkdir()
    (folder / "rss_headlines_1.csv").write_text("\ufeff" + "\n".join([HEADER, *ARTICLES]) + "\n", encoding="utf-8")
    (folder / "other.csv").write_text(HEADER + "\n" + ARTICLES[0].replace("r1", "r9").replace("/a", "/z") + "\n")
    rows = news.keyed(news.inbox(spark, str(folder)))
    kept = canonical.two_key_dedupe(rows.withColumn("place", F.row_number().over(Window.orderBy("place"))), "url_key", "article_key", "place")
    assert sorted(r.discovery_record_id for r in kept.collect()) == ["r1", "r2", "r4"]
    events = {tuple(r.article_references): r for r in canonical.canonical_events(news.items(kept)).collect()}
    want = [["r1", "r2"], ["r4"]]  # a record's id names the article before its url does
    assert sorted(map(list, events)) == want
    for refs, event in events.items():
        body = json.dumps(["CANONICAL_EVENT_V0", list(refs)], separators=(",", ":"))
        assert event.event_id == "canonical-event-v0-" + hashlib.sha256(body.encode()).hexdigest()
    assert events[tuple(want[0])].event_title == "ECB lowers rates by 25 bps" and events[tuple(want[0])].article_count == 2
    assert canonical.unassigned(news.items(kept)).first().status == "AVAILABLE"


@pytest.mark.parametrize(
    "event,before,after,change,percent,days",
    [
        ("2025-03-06", ("2025-03-05", "1.0694"), ("2025-03-07", "1.0857"), "0.0163", "1.524219", 2),
        ("2025-04-17", ("2025-04-16", "1.1355"), ("2025-04-22", "1.1476"), "0.0121", "1.065610", 6),
        ("2025-06-05", ("2025-06-04", "1.1384"), ("2025-06-06", "1.1411"), "0.0027", "0.237175", 2),
    ],
)
def test_published_reactions(spark, tmp_path, event, before, after, change, percent, days):
    constant = ",".join(reaction.SERIES.values())
    lines = [",".join(reaction.SERIES) + ",TIME_PERIOD,OBS_VALUE"]
    lines += [f"{constant},{d},{v}" for d, v in [("2025-01-02", "1.0300"), before, (event, "1.2000"), after, ("2025-12-01", "1.3")]]
    path = tmp_path / "rates.csv"
    path.write_text("\n".join(lines) + "\n")
    row = reaction.reaction(reaction.read_rates(spark, str(path)), event).first()
    assert (row.change, row.percent, row.span_days) == (change, percent, days)
    path.write_text("\n".join(lines[:2] + lines[:1:-1]) + "\n")
    with pytest.raises(ValueError, match="REFERENCE_RATES_REJECTED"):
        reaction.read_rates(spark, str(path))


def test_official_packets_confirm_one_proposition(spark):
    columns = ["official_confirmation", "authority_role", "authority_name", "official_source", "official_document_reference", "official_fact_proposition", "official_project_first_seen_at", "official_retrieved_at", "article_reference", "document_title"]
    good = ("OFFICIAL_CONFIRMED", "FACT_AUTHORITY", "Office", "https://office.example/d", "d", "Oil rose", "2026-10-06T03:15:25Z", "2026-10-06T03:15:26Z")
    rows = [(*good, "a1", "t"), (*good, "a1", "t"), (*good[:5], "Gas rose", *good[6:], "a2", "x"), (*good[:5], "Gas rose", *good[6:], "a2", "y"), (*good[:5], "Coal rose", *good[6:], "none", "t"), (*good[:5], "Late", good[7], good[6], "a1", "t")]
    events = spark.createDataFrame([("e1", ["a1"]), ("e2", ["a2"])], "event_id string, article_references array<string>")
    out = {r.proposition: (r.evidence_status, r.link_status, r.event_id) for r in evidence.project(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns)), events).collect()}
    assert out == {
        "Oil rose": ("OFFICIAL_CONFIRMED", "EXPLICIT_UNIQUE_LINK", "e1"), "Gas rose": ("AMBIGUOUS_EVIDENCE", "CONFLICTING_EVIDENCE_COPIES", None),
        "Coal rose": ("UNLINKED", "REFERENCE_NOT_FOUND", None), "Late": ("INCOMPLETE", "PACKET_VALIDATION_FAILED", None),
    }


def test_two_key_dedupe_equals_the_ordered_scan(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, *"abcdefgh"]), rng.choice([None, *"klmnopqr"])) for i in range(120)]
    urls, keys, want = set(), set(), []
    for i, u, k in rows:
        if (u and u in urls) or (k and k in keys):
            continue
        urls.add(u)
        keys.add(k)
        want.append(i)
    got = canonical.two_key_dedupe(spark.createDataFrame(rows, "i int, u string, k string"), "u", "k", "i")
    assert sorted(r.i for r in got.collect()) == want


def test_first_fit_equals_the_ordered_scan(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), rng.randint(0, 100)) for i in range(200)]
    groups, want = {}, {}
    for i, k, t in rows:
        for g in groups.setdefault(k, []):
            if all(abs(t - x) <= 25 for _, x in g):
                break
        else:
            g = []
            groups[k].append(g)
        g.append((i, t))
        want[i] = g[0][0]
    got = canonical.first_fit(spark.createDataFrame(rows, "i int, k string, t int").repartition(3), ["k"], "i", "t", 25)
    assert {r.i: r.group_id for r in got.collect()} == want


def _scan(rows):
    urls, keys, kept = set(), set(), []
    for i, u, k in rows:
        if (u is None or u not in urls) and (k is None or k not in keys):
            urls |= {u} - {None}
            keys |= {k} - {None}
            kept.append(i)
    return kept


def test_dedupe_of_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """10,000 rows, each sharing its url with the one before and its key with the one after: the rounds grow with the logarithm."""
    cuts = []
    for module in (canonical, components):
        monkeypatch.setattr(module, "cut", lambda df, cut=module.cut: cuts.append(1) or cut(df))
    rows = [(i, f"u{i // 2}", f"k{(i + 1) // 2}") for i in range(10_000)]
    got = canonical.two_key_dedupe(spark.createDataFrame(rows, "i int, u string, k string"), "u", "k", "i")
    assert sorted(r.i for r in got.collect()) == _scan(rows)
    assert len(cuts) < 40


def test_dedupe_of_groups_beyond_one_task(spark):
    """A chain above the bound of a task goes on in rounds; a hot url with a third of the rows never meets a task whole."""
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 == 0 else f"u{i // 2}", rng.choice([None, f"k{(i + 1) // 2}"])) for i in range(150)]
    got = canonical.two_key_dedupe(spark.createDataFrame(rows, "i int, u string, k string").repartition(5), "u", "k", "i", first_rounds=1, at_once=4)
    assert sorted(r.i for r in got.collect()) == _scan(rows)


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(70)] + [(200, 200), (None, 1)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges[:-1]:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    got = components.components(spark.createDataFrame(edges, "a int, b int")).collect()
    assert {r.node: r.component for r in got} == {x: root(x) for x in list(parent)} and len(got) == len(parent)


def test_first_fit_divides_a_hot_key_at_gaps(spark):
    """One key with all rows: 40 sessions of 500 rows in shuffled id order, many tasks, the ordered scan's groups; also before time zero and for a null key."""
    rng = random.Random(5)
    times = [s * 1000 + rng.randint(0, 300) for s in range(-20, 20) for _ in range(500)]
    rng.shuffle(times)
    rows = [(i, None, t) for i, t in enumerate(times)]
    groups, want = [], {}
    for i, _, t in rows:
        for g in groups:
            if max(g[1], t) - min(g[0], t) <= 100:
                g[0], g[1] = min(g[0], t), max(g[1], t)
                break
        else:
            g = [t, t, i]
            groups.append(g)
        want[i] = g[2]
    frame = spark.createDataFrame(rows, "i int, k string, t long").repartition(3)
    assert canonical.sessions(frame, ["k"], "t", 100).select("_session").distinct().count() == 40
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = canonical.first_fit(frame, ["k"], "i", "t", 100).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.i: r.group_id for r in got} == want and len({r.task for r in got}) == 4


def test_asof_join_on_boundaries(spark):
    t = lambda h, m=0: dt.datetime(2024, 1, 1 + h // 24, h % 24, m)
    quotes = [("a", t(9), t(9), 1, 1.0), ("a", t(10), t(12), 2, 2.0), ("a", t(10), t(10), 3, 3.0), ("b", t(1), t(60), 4, 4.0), ("a", None, t(1), 5, 5.0)]
    anchors = [("a", 1, t(8)), ("a", 2, t(9)), ("a", 3, t(11)), ("a", 4, t(12)), ("a", 5, t(80)), ("b", 6, t(59)), ("b", 7, t(60)), ("c", 8, t(1)), ("a", 9, None)]
    out = asof.asof_join(
        spark.createDataFrame(anchors, "k string, n int, at timestamp_ntz"), spark.createDataFrame(quotes, "k string, made timestamp_ntz, known timestamp_ntz, id int, v double"), "k", "at", "made", "known", "id", "v"
    )
    assert {r.n: r.quote and r.quote.id for r in out.collect()} == {1: None, 2: 1, 3: 3, 4: 2, 5: 2, 6: None, 7: 4, 8: None, 9: None}


def test_recency_limits(spark):
    now = dt.datetime(2024, 1, 10)
    ages = {0: "LAST_24H", 86_400: "LAST_24H", 86_401: "LAST_48H", 172_800: "LAST_48H", 172_801: "OLDER", -1: "INVALID_FUTURE"}
    rows = spark.createDataFrame([(a, now - dt.timedelta(seconds=a)) for a in ages] + [(999, None)], "age int, ts timestamp_ntz")
    out = rows.select("age", recency.bucket(F.lit(now).cast("timestamp_ntz"), F.col("ts")).alias("b")).collect()
    assert {r.age: r.b for r in out} == ages | {999: "UNKNOWN"}
    cache = rows.filter("age in (86400, 86401, 0)").select("age", recency.cache_status(F.lit(now).cast("timestamp_ntz"), F.col("ts"), 86_401).alias("c"))
    assert {r.age: r.c for r in cache.collect()} == {0: "FRESH_CACHE", 86_400: "FRESH_CACHE", 86_401: "STALE_CACHE"}


def test_times_and_urls(spark):
    values = ["2024-01-01T10:00:00Z", "2024-01-01T10:00:00+02:00", "2024-01-01T10:00:00+0200", "2024-01-01T10:00:00", "2024-01-01", "x", None, "2024-13-01T10:00:00Z", "2024-01-01T10:00:00.5Z"]
    out = spark.createDataFrame([(v,) for v in values], "v string").select(S.iso(S.instant(F.col("v"))).alias("t")).collect()
    assert [r.t for r in out] == ["2024-01-01T10:00:00Z", "2024-01-01T08:00:00Z", "2024-01-01T08:00:00Z", None, None, None, None, None, "2024-01-01T10:00:00.500000Z"]
    rfc = spark.createDataFrame([("Tue, 02 Jan 2024 10:00:00 GMT",), ("02 Jan 2024 10:00:00 -0500",), ("Tue, 02 Jan 2024",)], "v string").select(S.iso(S.rfc_instant(F.col("v"))).alias("t")).collect()
    assert [r.t for r in rfc] == ["2024-01-02T10:00:00Z", "2024-01-02T15:00:00Z", None]
    urls = spark.createDataFrame([("HTTPS://A.com/X?utm_a=1&b=2&FBCLID=3&b=1#f",), ("https://a.com",), ("ftp://a.com",), (None,)], "u string")
    got = urls.select(S.without_tracking(F.col("u")).alias("c"), S.url_key(F.col("u")).alias("k"), S.valid_url(F.col("u")).alias("v")).collect()
    assert [tuple(r) for r in got] == [
        ("https://a.com/X?b=2&b=1", "https://a.com/X?utm_a=1&b=2&FBCLID=3&b=1", True), ("https://a.com/", "https://a.com", True), (None, None, False), (None, None, False)
    ]


def test_text_functions():
    assert plain_text("<p>A &amp; B</p><script>x</script>c <![CDATA[<b>d</b>]]>") == "A & B xc d"
    assert plain_text("&lt;b&gt;x&lt;/b&gt;") == "x" and plain_text("a<hr>b") == "a b" and plain_text("<p> </p>") is None and plain_text("AT&T now") == "AT&T; now"
    assert normal("Ｆｅｄ — Straße, 25%") == "fed strasse 25%"


def _plain_brute(value):
    """The rule by the standard parser: unescape, block tags and their ends separate, CDATA recurses, references stay literal."""
    import html
    from html.parser import HTMLParser

    parts = []

    class Reader(HTMLParser):
        def block(self, tag, _=None):
            parts.append(" " if tag in BLOCK else "")

        handle_starttag = handle_endtag = block
        handle_data = lambda self, data: parts.append(data)
        handle_entityref = lambda self, name: parts.append(f"&{name};")
        handle_charref = lambda self, name: parts.append(f"&#{name};")

    reader = Reader(convert_charrefs=False)
    reader.feed(html.unescape(value))
    reader.close()
    return " ".join("".join(parts).split()) or None


def test_plain_text_equals_the_standard_parser():
    rng = random.Random(4)
    pieces = ["<p>", "</p>", "<br/>", "<b>", "</b>", "<td class='a>b'>", "word ", "two words", " ", "&amp; ", "&lt;i&gt;", "&nbsp;", "<!-- x > y -->", "\n", "A&B ", "é", "<hr>", "<a href=\"x\">", "</a>"]
    for _ in range(400):
        value = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert plain_text(value) == _plain_brute(value), value


def test_spans_take_the_longest_phrase_first():
    from tidemark.functions.lexicons import REGIONS, UPPER_CASE_ALIASES

    def brute(text):
        hits = []
        for ident, _, _, aliases in REGIONS:
            for alias in aliases:
                if alias == "America" and re.search("(?:South|North|Latin|Central) America", text, re.I):
                    continue
                for m in re.finditer(rf"(?<!\\w){re.escape(alias)}(?!\\w)".replace("\\\\", "\\"), text, 0 if alias in UPPER_CASE_ALIASES else re.I):
                    hits.append((-(m.end() - m.start()), m.start(), ident, m.group()))
        taken, out = set(), []
        for size, start, ident, hit in sorted(hits):
            span = set(range(start, start - size))
            if not span & taken:
                taken |= span
                out.append((ident, hit))
        return sorted(out)

    rng = random.Random(8)
    words = ["South", "China", "Sea", "Taiwan", "Strait", "US", "us", "U.S.", "European", "Union", "EU", "America", "Latin", "Red", "world", "臺灣", "海峽", "x", ",", "Iran"]
    for _ in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", ""]) for _ in range(rng.randint(1, 9)))
        assert sorted(context.spans(text)) == brute(text), text


def test_dates_of_propositions(spark):
    texts = {"on 15 october 2026 or 2026-11-01 and november 2026": ["2026-10-15", "2026-11", "2026-11-01"], "31 february 2026": ["INVALID_DATE"], "Sept. 5 2026": [], "Sep. 5, 2026 in May 2027": ["2026-09-05", "2027-05"], "": []}
    rows = linker.with_proposition(spark.createDataFrame([(t,) for t in [*texts, None]], "t string"), "t", "p")
    got = {r.t: list(r.p.date_scope) for r in rows.collect()}
    assert got == texts | {None: []}


def test_a_lost_append_leaves_nothing_behind(spark, tmp_path):
    from tidemark.operators import ledger

    path, made = str(tmp_path / "ledger"), spark.createDataFrame([("NEWS", e, "x", None, "{}", "{}") for e in "abc"], "observation_kind string, entity_id string, canonical_event_id string, source_timestamp string, payload string, provenance string")
    rows = ledger.observations(made, F.lit(1000).cast("long"))
    rows.write.parquet(f"{path}/rows/batch=b1")  # the rows of an attempt that died before it was listed
    assert ledger.append(spark, path, rows, "b1") == 3
    assert ledger.read(spark, path).count() == 3


def test_rate_decisions_and_rules(spark):
    titles = ["ECB cuts interest rates by 25 basis points", "Fed raises rates by 0.50 bp.", "Fed raises rates by 0 bp", "ECB cuts rates", "Fed up with oil supply after war on shipping", "Fed sanctions and interest rates"]
    rows = spark.createDataFrame([(t,) for t in titles], "t string")
    got = rows.select(canonical.rate_signature(F.col("t")).alias("s"), S.mechanisms(F.col("t")).alias("m")).collect()
    assert [r.s and tuple(r.s) for r in got] == [("ECB", "CUT", "25"), ("FED", "RAISE", "0.5"), None, None, None, None]
    assert [r.m for r in got[4:]] == [["OIL_SUPPLY", "GEOPOLITICAL_SUPPLY"], ["MONETARY_POLICY", "TRADE_POLICY"]]


def _market(i, question, **more):
    base = {"description": None, "resolution_criteria": None, "closed": False, "active": True, "incomplete": False, "observed_at": dt.datetime(2026, 10, 1), "market_close_time": dt.datetime(2026, 11, 1), "trusted": True}
    return {"market_id": i, "question": question} | base | more


def test_link_decisions(spark):
    events = [("e1", "Fed rate decision on 28 October 2026", None, dt.datetime(2026, 10, 2)), ("e2", "Storm hits coast", None, dt.datetime(2026, 10, 2)), ("e3", "ECB to cut rates by 25 bps on 29 October 2026", None, dt.datetime(2026, 10, 2))]
    markets = [
        _market("m1", "Will the Fed cut rates on 28 October 2026?"), _market("m2", "Will the ECB cut rates by 50 bps on 29 October 2026?"), _market("m3", "Will the Fed cut rates on 28 October 2026?", closed=True),
        _market("m4", "Will the Fed cut rates on 28 October 2026?", description="The ECB decides"), _market("m5", "Will the ECB cut rates by 25 bps on 29 October 2026?"), _market("m6", "Will the Fed cut rates before 28 October 2026?"),
    ]
    e = spark.createDataFrame(events, "event_id string, event_title string, event_occurred_at timestamp, first_detected_at timestamp")
    schema = "market_id string, question string, description string, resolution_criteria string, closed boolean, active boolean, incomplete boolean, observed_at timestamp, market_close_time timestamp, trusted boolean"
    m = spark.createDataFrame([tuple(x[f.split()[0]] for f in schema.split(", ")) for x in markets], schema)
    got = {(r.event_id, r.market_id): (r.link_status, r.reason) for r in linker.link_events(e, m).collect()}
    assert len(got) == 18
    assert got["e1", "m1"] == ("LINKED", "SAME_INSTITUTION_POLICY_RATE_AND_EXPLICIT_MEETING_SCOPE")
    assert got["e2", "m1"] == ("NO_MATCH", "UNSUPPORTED_OR_DIFFERENT_PROPOSITION")
    assert got["e1", "m2"] == ("NO_MATCH", "DIFFERENT_INSTITUTION")
    assert got["e3", "m2"] == ("NO_MATCH", "DIFFERENT_NUMERIC_THRESHOLD")
    assert got["e1", "m3"] == ("NO_MATCH", "PROVIDER_MARKET_NOT_ACTIVE")
    assert got["e1", "m4"] == ("NO_MATCH", "RESOLUTION_TEXT_CONTRADICTS_QUESTION")
    assert got["e3", "m5"][0] == "LINKED"
    assert got["e1", "m6"] == ("INSUFFICIENT_EVIDENCE", "NEGATION_DEADLINE_OR_CONDITION_NOT_SUPPORTED")
    again = e.unionByName(e.filter("event_id = 'e3'").withColumn("event_id", F.lit("e4")))
    for rows in (e, again, again.unionByName(e.filter("event_id = 'e1'"))):
        whole = linker.link_events(rows, m).collect()
        kept = [r for r in whole if r.link_status == "LINKED" or r.reason == "MULTIPLE_CANONICAL_EVENT_TARGETS"]
        indexed = linker.links(rows, m).collect()
        assert all(r in whole for r in indexed) and sorted(kept) == sorted(r for r in indexed if r in kept)
    with pytest.raises(ValueError, match="more than 2 events"):
        linker.link_events(e, m, most_events=2)


def test_rss_rejections_in_order(spark):
    rows = [(1, None, "https://a.com/1"), (2, "t", "http://a.com/1"), (3, "none", "https://a.com/2"), (4, "t", "https://a.com/3"), (5, "t", "https://A.com/3#x")]
    out = rss.reject_reasons(spark.createDataFrame(rows, "n int, title string, link string"), "title", "link", "n", F.col("title") == "t")
    assert [r.reason for r in out.orderBy("n").collect()] == ["MISSING_TITLE", "UNSAFE_SOURCE_URL", "NOT_MACRO_RELEVANT", "ACCEPTED", "DUPLICATE_URL"]


def test_round_robin_and_retention(spark):
    rows = spark.createDataFrame([(i, 0 if i < 6 else 1, "abc"[i % 3]) for i in range(10)], "i int, p int, lane string")
    out = selection.round_robin(rows, "p", "lane", ["c", "a"], [F.col("i")], 5).orderBy("position").collect()
    assert [r.i for r in out] == [2, 0, 5, 3, 8]
    kept = selection.retain(rows, "p", F.col("i") == 1, [F.desc("i")], 3)
    assert sorted(r.i for r in kept.collect()) == [1, 4, 5, 7, 8, 9]


def test_entry_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_ledger_append_and_replay(spark, tmp_path):
    from tidemark.operators import ledger

    path = str(tmp_path / "ledger")

    def rows(*items):
        made = spark.createDataFrame([(k, e, ev, None, json.dumps(p), "{}") for k, e, ev, p in items], "observation_kind string, entity_id string, canonical_event_id string, source_timestamp string, payload string, provenance string")
        return lambda us: ledger.observations(made, F.lit(us).cast("long"))

    first = rows(("EVENT", "x", "x", {"t": 1}), ("NEWS", "a", "x", {"v": 1}), ("NEWS", "b", "y", {"v": 1}))
    assert ledger.append(spark, path, first(1000), "b1") == 3
    assert ledger.append(spark, path, first(1000), "b1") == 0
    assert ledger.append(spark, path, first(2000), "b2") == 0
    assert ledger.append(spark, path, rows(("NEWS", "a", "y", {"v": 2}), ("SOURCE_STATE", "s", None, {}))(3000), "b3") == 2
    with pytest.raises(ValueError, match="REFUSED"):
        ledger.append(spark, path, rows(("NEWS", "a", "x", {"v": 9}))(2500), "b4")
    stored = ledger.read(spark, path)
    assert stored.count() == 5 and ledger.violations(stored).isEmpty()
    seen = lambda us: {(r.observation_kind, r.entity_id) for r in ledger.replay(stored, "x", F.lit(us)).filter("visible").collect()}
    assert seen(999) == set() and seen(1000) == {("EVENT", "x"), ("NEWS", "a")} and seen(3000) == {("EVENT", "x"), ("SOURCE_STATE", "s")}
    assert [r.status for t in (1, 1000, 3000) for r in ledger.replay_counts(stored, "x", F.lit(t)).collect()] == ["NO_OBSERVATIONS", "AVAILABLE", "AVAILABLE"]
    snap = ledger.freeze(stored, "x", F.lit(1000), "k")
    assert ledger.add_freezes(snap, snap).isEmpty() and len(snap.first().snapshot_sha256) == 64
    late = rows(("NEWS", "z", "x", {"observed_at": "2030-01-01T00:00:00Z"}))(5000)
    assert ledger.violations(late).count() == 1


def test_context_cases(spark):
    texts = [("a", "HEADLINE", "South China Sea tension as US and China talk"), ("b", "HEADLINE", "ECB holds"), ("c", "HEADLINE", "us and them"), ("d", "HEADLINE", "Taiwan and Japan sign"), ("e", "HEADLINE", "News from South America"), ("f", "HEADLINE", "Rates"), ("f", "BODY", "臺灣US outlook in Iran")]
    out = {r.k: (r.region_id, r.status) for r in context.infer(spark.createDataFrame(texts, "k string, tier string, text string"), "k", "text").collect()}
    assert out["a"] == ("south-china-sea", "INFERRED") and out["b"] == ("euro-area", "INFERRED") and out["c"] == (None, "UNKNOWN")
    assert out["d"] == (None, "MULTI_REGION") and out["e"] == (None, "UNKNOWN") and out["f"] == ("iran", "INFERRED")


def test_market_parse_watch_and_snapshot(spark):
    from tidemark.operators import market

    rows = [("1", "Will the Fed cut rates?", '["Yes","No"]', '["0.6200","0.38"]', "2026-11-01T00:00:00Z", "false", "true", "false"), ("2", "Oil above 90?", '["Yes"]', '["0.1","0.2"]', None, "false", "true", None), ("3", "NBA winner?", None, None, None, None, None, None), ("4", "a", None, None, None, None, None, None), ("4", "b", None, None, None, None, None, None)]
    parsed = market.parse_markets(spark.createDataFrame(rows, "id string, question string, outcomes string, outcomePrices string, endDate string, closed string, active string, archived string"))
    got = {r.market_id: r.prices for r in parsed.collect()}
    assert got == {"1": ["0.6200", "0.38"], "2": None, "3": None}
    assert [(r.market_id, r.category, r.reason) for r in market.watch(parsed).orderBy("position").collect()] == [("1", "MONETARY_POLICY", "QUESTION:fed"), ("2", "ENERGY", "QUESTION:oil")]
    assert [(r.category, r.markets) for r in market.category_counts(market.watch(parsed)).orderBy("place").collect()] == [("MONETARY_POLICY", 1), ("ENERGY", 1)]
    assert {r.market_id: r.outcome_type for r in market.watch(parsed).collect()} == {"1": "BINARY", "2": "UNKNOWN"}
    cases = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", None), ("e", None)], "case string, kind string")
    assert [tuple(r) for r in reaction.comparable_pairs(cases, "case", ["kind"]).collect()] == [("a", "b", "x")]
    at = lambda s: dt.datetime(2026, 10, 1, 14, 0) + dt.timedelta(seconds=s)
    quotes = [("e", "SPY", at(m * 60 - 30), at(m * 60 - 10), f"o{m}", 490.0 + m) for m in (0, 5, 7, 30, 60)] + [("e", "SPY", at(29 * 60), at(31 * 60), "late", 1.0)]
    obs = spark.createDataFrame(quotes, "event_id string, symbol string, market_ts timestamp_ntz, observed_at timestamp_ntz, id string, value double")
    anchors = spark.createDataFrame([("e", "SPY", at(0), "USD")], "event_id string, symbol string, anchor timestamp_ntz, unit string")
    spy = {r.window: r.value for r in market.snapshot(anchors, obs).collect()}
    assert spy == {"T0": 490.0, "PLUS_5M": 495.0, "PLUS_30M": 520.0, "PLUS_1H": 550.0}


def test_stream_equals_batch(spark, tmp_path):
    from tidemark.streaming import polls

    rows = spark.createDataFrame([(i, i % 7, str(i // 20)) for i in range(60)], "n long, k long, c string")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    query = polls.first_seen(stream, "k", "n").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.k, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.k, r.n) for r in polls.first_seen_batch(rows, "k", "n").collect()}


def test_product_fails_beyond_its_bound_and_cuts_nothing(spark, tmp_path):
    from tidemark.plans import catalog

    query = catalog.queries()["theta_link_decision"]
    nations = lambda n, to: spark.range(n).selectExpr("id AS n_nationkey", "concat('N', id) AS n_name", "id % 5 AS n_regionkey").write.parquet(f"{to}/nation.parquet")
    for name, n in (("full", 100), ("over", 101)):
        spark.range(5).selectExpr("id AS r_regionkey", "concat('R', id) AS r_name").write.parquet(f"{tmp_path / name}/region.parquet")
        nations(n, tmp_path / name)
    assert query(spark, str(tmp_path / "full")).count() == 500
    with pytest.raises(ValueError, match="nation has 101 rows"):
        query(spark, str(tmp_path / "over"))


def test_links_are_counted_before_pairs_are_written_out(spark):
    days = [f"2026-10-{10 + i}" for i in range(4)]
    events = [(i % 48, f"ECB to cut rates on {days[i % 4]}", None, dt.datetime(2026, 10, 2, 0, 0, 0, i % 2)) for i in range(60)]
    e = spark.createDataFrame(events, "event_id long, event_title string, event_occurred_at timestamp, first_detected_at timestamp")
    m = spark.createDataFrame(
        [(*_market(None if i == 7 else i % 16, f"Will the ECB {'hold' if i % 3 else 'cut'} rates on {days[i % 4]}?").values(),) for i in range(18)],
        "market_id long, question string, description string, resolution_criteria string, closed boolean, active boolean, incomplete boolean, observed_at timestamp, market_close_time timestamp, trusted boolean",
    )
    for rows, others in ((e, m), (e.limit(48), m.limit(16))):
        want = [r for r in linker.link_events(rows, others).collect() if r.reason != "DIFFERENT_DATE_SCOPE"]
        assert sorted(linker.links(rows, others).collect(), key=repr) == sorted(want, key=repr)
    plan = linker.links(e.limit(48), m.limit(16))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_seals_are_worked_out_once(spark):
    from tidemark.functions import canonical_json as C

    rows = spark.createDataFrame([('{"b":1,"a":{"d":[1,{"z":"x","y":null}]}}',), ("[1]",), ("no",), (None,)], "doc string")
    rows = rows.select("doc", C.fingerprint("doc").alias("seal"))
    carried = F.concat(F.lit('{"artifact_fingerprint":"'), C.fingerprint("doc"), F.lit('",'), F.substring("doc", F.lit(2), F.length("doc")))
    out = rows.select(C.sealed(carried).alias("sealed"))
    assert [r.sealed for r in out.collect()] == [True, False, False, False]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("parse_json") <= 4


def test_resolution_takes_more_tasks_for_more_rows(spark, monkeypatch):
    from tidemark.operators import selection

    rows = spark.range(70).select("id", F.col("id").cast("string").alias("a"), F.when(F.col("id") % 2 == 0, "two").alias("b"))
    refs = spark.createDataFrame([(str(i), "x" if i % 3 else None) for i in range(60)] + [("two", "x"), ("two", "x"), ("5", "y")], "ref string, target string")
    resolve = lambda: selection.resolve(rows, "id", ["a", "b"], refs, "ref", "target")
    got = {r.id: (r.target, r.status) for r in resolve().collect()}
    assert got[5] == (None, "AMBIGUOUS_REFERENCE") and got[8] == ("x", "EXPLICIT_UNIQUE_LINK") and got[64] == (None, "REFERENCE_NOT_FOUND")
    monkeypatch.setattr(selection, "TASK_ROWS", 10)
    many = resolve()
    assert {r.id: (r.target, r.status) for r in many.collect()} == got
    assert ", 7)" in many._jdf.queryExecution().executedPlan().toString()
