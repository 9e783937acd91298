"""Files that count whole or not at all, and scopes that no join widens."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import visibility
from tidemark.sources import guarded, news

ITEM = "<item><title>{}</title><link>{}</link></item>"
GOOD = ITEM.format("Oil &amp; gas", "https://www.eia.gov/a#x")


def _rss(items, head="", root="rss", tail=""):
    return f"{head}<{root} xmlns:dc='http://purl.org/dc/elements/1.1/'><channel><title>c</title>{items}</channel></{root}>{tail}"


FEEDS = {
    "good.xml": (_rss(GOOD + ITEM.format("", "https://www.eia.gov/b") + ITEM.format("T", "http://www.eia.gov/c"), head='﻿<?xml version="1.0"?>\n<!-- a -->'), "AVAILABLE"),
    "doctype.xml": (_rss(GOOD, head="<!DocType x>"), "UNSAFE_XML_DECLARATION"),
    "entity.xml": (_rss(GOOD + "<!ENTITY x 'y'>"), "UNSAFE_XML_DECLARATION"),
    "cut.xml": (_rss(GOOD)[:-4], "MALFORMED_RSS"),
    "tail.xml": (_rss(GOOD, tail="<x"), "MALFORMED_RSS"),
    "aside.xml": (_rss(GOOD, tail="\n<!-- end -->\n"), "AVAILABLE"),
    "latin.xml": (_rss(GOOD.replace("Oil", "Öl")).encode("latin-1"), "MALFORMED_RSS"),
    "words.xml": ("no markup", "MALFORMED_RSS"),
    "atom.xml": (_rss(GOOD, root="feed"), "UNEXPECTED_RSS_ROOT"),
    "bare.xml": ("<rss><item><title>a</title></item></rss>", "UNEXPECTED_RSS_ROOT"),
    "none.xml": (_rss(""), "NO_USABLE_ARTICLES"),
    "foreign.xml": (_rss(ITEM.format("T", "https://eia.gov.example/a")), "NO_USABLE_ARTICLES"),
    "many.xml": (_rss(GOOD * 6), "RSS_ITEM_LIMIT"),
    "large.xml": (_rss(GOOD) + " " * 3000, "EMPTY_OR_OVERSIZED_RESPONSE"),
}


def test_a_feed_counts_whole_or_not_at_all(spark, tmp_path):
    for name, (body, _) in FEEDS.items():
        (tmp_path / name).write_bytes(body if isinstance(body, bytes) else body.encode())
    found = guarded.files(spark, str(tmp_path), 2500, "*.xml")
    profile = guarded.PROFILES["EIA Today in Energy"]
    items = guarded.judged(guarded.feeds(found, 2500, 5), profile).cache()
    cycles = {r.path.rsplit("/", 1)[-1]: r for r in guarded.cycles(items).collect()}
    assert {n: r.status for n, r in cycles.items()} == {n: want for n, (_, want) in FEEDS.items()}
    good = cycles["good.xml"]
    assert (good.input_item_count, good.accepted_item_count, good.rejected) == (3, 1, {"MISSING_TITLE": 1, "UNSAFE_SOURCE_URL": 1})
    rows = guarded.headlines(items, profile, F.lit("now")).collect()
    assert sorted(r.path.rsplit("/", 1)[-1] for r in rows) == ["aside.xml", "good.xml"]
    assert {(r.headline_or_text, r.key, r.source_url, r.event_time, r.source_name) for r in rows} == {("Oil & gas", "https://www.eia.gov/a", "https://www.eia.gov/a#x", "", "EIA Today in Energy")}


def test_no_bytes_are_a_fault(spark):
    frame = spark.createDataFrame([("f", 0, bytearray(b"")), ("g", 9, None)], "path string, length long, content binary")
    assert {r.fault for r in guarded.feeds(frame).collect()} == {"EMPTY_OR_OVERSIZED_RESPONSE"}


def _headlines(spark, profile, items):
    frame = spark.createDataFrame([("f", bytearray(_rss(items).encode()))], "path string, content binary")
    judged = guarded.judged(guarded.feeds(frame.withColumn("length", F.length("content").cast("long"))), guarded.PROFILES[profile])
    return judged, [(r.headline_or_text, r.source_name, r.source_url, r.event_time) for r in guarded.headlines(judged, guarded.PROFILES[profile], F.lit("now")).orderBy("key").collect()]


def test_summaries_join_the_title_unless_they_repeat_it(spark):
    item = "<item><title>{}</title><description>{}</description><link>https://www.ecb.europa.eu/{}</link><pubDate>Thu, 06 Mar 2025 14:15:00 +0100</pubDate></item>"
    _, got = _headlines(spark, "ECB Press", item.format("Rates", " Cut  by\n25 ", "b") + item.format("Rates", "RATES", "a") + item.format("Again", "", "a#2"))
    assert got == [("Rates", "ECB Press", "https://www.ecb.europa.eu/a", "2025-03-06T13:15:00Z"), ("Rates - Cut by 25", "ECB Press", "https://www.ecb.europa.eu/b", "2025-03-06T13:15:00Z")]


def test_authors_are_needed_and_named(spark):
    item = "<item><title>{}</title>{}<link>https://globalvoices.org/{}</link></item>"
    items = item.format("Inflation &amp;amp; war", "<dc:creator><![CDATA[Jo &amp; Al]]></dc:creator>", "1") + item.format("Sanctions", "", "2") + item.format("Sanctions", "<author>Ed</author>", "3") + item.format("Football", "<author>Ed</author>", "4")
    judged, got = _headlines(spark, "Global Voices", items)
    assert [r.reason for r in judged.orderBy("place").collect()] == ["ACCEPTED", "MISSING_ATTRIBUTION", "ACCEPTED", "NOT_MACRO_RELEVANT"]
    assert got == [("Inflation &amp; war", "Global Voices · Jo & Al", "https://globalvoices.org/1", ""), ("Sanctions", "Global Voices · Ed", "https://globalvoices.org/3", "")]


def test_a_feed_without_relevant_titles_is_no_fault(spark):
    judged, got = _headlines(spark, "Guardian World", ITEM.format("Football", "https://www.theguardian.com/a"))
    assert got == [] and guarded.cycles(judged).first().status == "AVAILABLE"


def test_a_guid_stands_for_the_link_of_the_same_story_only(spark):
    item = "<item><title>Famine</title><link>https://news.un.org/feed/view/en/{}</link><guid isPermaLink='false'>{}</guid></item>"
    _, got = _headlines(spark, "UN News", item.format("1", "https://news.un.org/en/1") + item.format("2", "https://news.un.org/en/9") + item.format("3", "https://evil.example/en/3"))
    assert [u for _, _, u, _ in got] == ["https://news.un.org/en/1", "https://news.un.org/feed/view/en/2", "https://news.un.org/feed/view/en/3"]


EVIDENCE = {
    "list.json": ('[{"title":"a"},{"title":"b","extra":1}]', None, ["a", "b"]),
    "items.json": ('{"items":[{"title":"a"}],"records":[{"title":"z"}]}', None, ["a"]),
    "records.json": ('{"items":{},"records":[{"title":"a"}]}', None, ["a"]),
    "one.json": ('{"title":"a","items":5}', None, ["a"]),
    "nothing.json": ("[]", None, []),
    "mixed.json": ('{"items":[{"title":"a"},3]}', "CONFIGURED_EVIDENCE_SCHEMA_INVALID", []),
    "word.json": ('"a"', "CONFIGURED_EVIDENCE_SCHEMA_INVALID", []),
    "cut.json": ('[{"title":"a"}', "CONFIGURED_EVIDENCE_READ_FAILED", []),
    "lines.jsonl": ('{"title":"a"}\r\n\n{"title":7}\n', None, ["a", "7"]),
    "bad.ndjson": ('{"title":"a"}\n{', "CONFIGURED_EVIDENCE_READ_FAILED", []),
    "mixed.ndjson": ('{"title":"a"}\n[1]', "CONFIGURED_EVIDENCE_SCHEMA_INVALID", []),
    "large.json": ('[{"title":"' + "a" * 500 + '"}]', "CONFIGURED_EVIDENCE_FILE_TOO_LARGE", []),
}


def test_an_evidence_file_counts_whole_or_not_at_all(spark, tmp_path):
    for name, (body, _, _) in EVIDENCE.items():
        (tmp_path / name).write_text(body)
    read = guarded.evidence(guarded.files(spark, str(tmp_path), 400), 400).cache()
    assert {r.path.rsplit("/", 1)[-1]: r.fault for r in read.collect()} == {n: fault for n, (_, fault, _) in EVIDENCE.items()}
    rows = guarded.evidence_rows(read).orderBy("path", "place").collect()
    got = {n: [r.title for r in rows if r.path.endswith("/" + n)] for n in EVIDENCE}
    assert got == {n: titles for n, (_, _, titles) in EVIDENCE.items()} and rows[0].summary is None


@pytest.mark.parametrize(
    "limits,faults",
    [
        ({}, {"rss_headlines_a.csv": None, "gdelt_headlines_b.CSV": None, "rss_headlines_c.csv": "CONFIGURED_EVIDENCE_READ_FAILED"}),
        ({"most_files": 2}, dict.fromkeys(["rss_headlines_a.csv", "gdelt_headlines_b.CSV", "rss_headlines_c.csv"], "NEWS_INBOX_FILE_LIMIT_EXCEEDED")),
        ({"most_total": 50}, dict.fromkeys(["rss_headlines_a.csv", "gdelt_headlines_b.CSV", "rss_headlines_c.csv"], "NEWS_INBOX_SIZE_LIMIT_EXCEEDED")),
        ({"most_bytes": 30}, {"rss_headlines_a.csv": None, "gdelt_headlines_b.CSV": "CONFIGURED_EVIDENCE_FILE_TOO_LARGE", "rss_headlines_c.csv": "CONFIGURED_EVIDENCE_READ_FAILED"}),
    ],
)
def test_an_inbox_has_limits(spark, tmp_path, limits, faults):
    (tmp_path / "rss_headlines_a.csv").write_text("title,url\na,https://x/1\n")
    (tmp_path / "gdelt_headlines_b.CSV").write_text("title,url\nb,https://x/2\n" + "c,\n" * 10)
    (tmp_path / "rss_headlines_c.csv").write_bytes("title\nÄ\n".encode("latin-1"))
    (tmp_path / "notes.csv").write_text("title\nz\n" * 99)
    rows, manifest = guarded.inbox(spark, str(tmp_path), **limits)
    assert {r.file_name: r.fault for r in manifest.collect()} == faults
    assert {r.file_name for r in rows.select("file_name").distinct().collect()} <= {n for n, fault in faults.items() if fault is None}
    if not limits:
        assert "a" in {r.title for r in rows.collect()}


def test_no_join_widens_a_scope(spark):
    """Whatever the inputs, a row that any private or unknown source took part in is never public."""
    rng = random.Random(6)
    scopes = [*visibility.SCOPES, None, "OTHER"]
    frame = lambda n, c: spark.createDataFrame([(rng.randrange(40), i, rng.choice(scopes)) for i in range(n)], f"k int, {c} int, data_usage_scope string")
    left, right = frame(60, "a"), frame(30, "b")
    rank = lambda s: {"PUBLIC_REDISTRIBUTABLE": 0, "PRIVATE_RESEARCH_ONLY": 2}.get(s, 1)
    sides = [{(r[1], rank(r[2])) for r in side.collect()} for side in (left, right)]
    of = [dict(side) for side in sides]
    out = visibility.joined(left, right, ["k"], "left").collect()
    assert out and all(rank(r.data_usage_scope) == max(of[0][r.a], of[1].get(r.b, 0)) for r in out)
    assert {r.a for r in out} == set(of[0])
    grouped = left.groupBy("k").agg(visibility.strictest_of(F.col("data_usage_scope")).alias("s"))
    for r in grouped.collect():
        assert rank(r.s) == max(rank(x.data_usage_scope) for x in left.filter(F.col("k") == r.k).collect())
    with pytest.raises(ValueError):
        visibility.joined(left, right, ["k"], "full")


def test_receipts_of_both_scopes_stand_together(spark):
    private, public = visibility.SCOPES[2], visibility.SCOPES[0]
    content = [(1, "a", 1, public), (2, "b", 1, private), (3, "c", 1, private), (4, "d", 9, public), (5, "e", 1, None), (6, "b", 2, private)]
    receipts = [(2, "b", 3, 1, private), (1, "a", 3, 2, private), (1, "a", 4, 3, public), (1, "a", 9, 4, private), (4, "d", 5, 5, public), (6, "b", 3, 6, public)]
    out = visibility.with_receipts(
        spark.createDataFrame(content, "id int, entity string, at int, data_usage_scope string"), spark.createDataFrame(receipts, "id int, entity string, at int, n int, data_usage_scope string"),
        "id", "entity", "at", ["at", "n"], F.lit(5),
    )
    got = {(r.id, r.receipt_at, r.basis, r.data_usage_scope) for r in out.collect()}
    assert got == {(1, None, "REGISTRATION", public), (1, 4, "RECEIPT", public), (3, None, "REGISTRATION", private), (5, None, "REGISTRATION", "UNKNOWN"), (6, 3, "RECEIPT", private)}
    assert {r.id for r in visibility.public(out).collect()} == {1}


T, U = "2025-03-06T13:15:00Z", "2025-03-06T14:00:00+01:00"
PROJECTED = [
    ({"observed_time": T, "event_time": U}, {"reported_time_kind": "REPORTED_TIME"}),
    ({"observed_time": T, "event_time": "2025-03-06T14:15:00+01:00"}, {"reported_time_kind": "UNKNOWN", "reported_at": None}),
    ({"observed_time": T, "event_time": T, "published_at": U}, {"reported_time_kind": "REPORTED_TIME", "source_published_at": None}),
    ({"observed_time": "soon", "observed_at": T}, {"observed_at": None}),
    ({"source_published_at": "2025-03-06", "published_at": U}, {"reported_time_kind": "UNKNOWN"}),
    ({"event_time": U, "event_time_is_proxy": " True"}, {"reported_time_kind": "SOURCE_DATE_PROXY"}),
    ({"event_time": U, "source_name": "GDELT", "source_publisher": "P"}, {"reported_time_kind": "SOURCE_DATE_PROXY", "source_name": "P"}),
    ({"published_at": U, "source_name": "gdelt"}, {"reported_time_kind": "REPORTED_TIME", "source_name": "gdelt"}),
    ({"published_at": U, "collector": "federal_register"}, {"reported_time_kind": "SOURCE_DATE_PROXY"}),
    ({"title": " <b>Oil</b> &amp;  gas", "headline_or_text": "x"}, {"title": "Oil & gas", "raw_title": " <b>Oil</b> &amp;  gas", "news_summary": "x"}),
    ({"title": " ", "headline": "a \t b"}, {"title": "a b", "news_summary": None, "article_reference": None}),
    ({"item_reference": "i", "discovery_record_id": "d", "url": "https://x/1"}, {"article_reference": "i", "source_url": "https://x/1"}),
    ({"url": "ftp://x/1"}, {"article_reference": None, "source_url": None}),
    ({"source_url": "https://x/1", "url": "https://x/2"}, {"article_reference": "https://x/1"}),
    ({"canonical_event_id": "e", "identity_evidence_ref": "r", "identity_status": "CANONICAL"}, {"event_id": "e", "identity_status": "VERIFIED_BY_SOURCE", "identity_evidence_ref": "r"}),
    ({"canonical_event_id": "e", "identity_evidence_ref": "r", "identity_status": "GUESS"}, {"event_id": None, "identity_status": "UNKNOWN", "identity_evidence_ref": None}),
    ({"event_family": "f"}, {"event_family": "f", "event_family_status": "PROVISIONAL", "geography_status": "UNKNOWN", "verification_status": "UNVERIFIED_NEWS"}),
]


def test_items_take_the_first_alias_and_prove_nothing(spark):
    names = [*news.COLUMNS, "collector"]
    rows = [(i, *[given.get(n) for n in names]) for i, (given, _) in enumerate(PROJECTED)]
    frame = spark.createDataFrame(rows, "_row int, " + ", ".join(f"{n} string" for n in names))
    for i, (given, want) in enumerate(PROJECTED):
        (got,) = news.items(frame.filter(F.col("_row") == i)).collect()
        assert {n: got[n] for n in want} == want, given


def test_states_join_by_record_and_the_last_row_stands(spark):
    found = spark.createDataFrame([("d1",), ("d2",), ("d3",), (None,)], "discovery_record_id string")
    official = spark.createDataFrame([("d1", "p1"), ("d2", "p2"), ("d2", "p2"), ("d3", "")], "discovery_record_id string, artifact_fingerprint string")
    states = [("d1", None, "OLD", None, 1), (" ", "d1", " ", "NEW", 2), ("d3", "d1", "HELD", None, 3), (None, None, "X", None, 4)]
    macros = [("d9", "d1", True, "p0", 1), ("d9", "d1", True, "p1", 2), ("d9", "d1", False, "p7", 3), ("d2", None, True, "p2", 4), ("d3", None, True, "", 5)]
    out = news.with_states(
        found, official, spark.createDataFrame(states, "discovery_record_id string, event_reference string, expectation_state string, linkage_state string, arrival int"),
        spark.createDataFrame(macros, "discovery_record_id string, event_reference string, sealed boolean, event_reality_reference string, arrival int"), "EMPTY",
    )
    got = {r.discovery_record_id: (r.expectation_status, r.macroview_status) for r in out.collect()}
    assert got == {"d1": ("NEW", "AVAILABLE"), "d2": (None, "EMPTY"), "d3": ("HELD", "EMPTY"), None: (None, "EMPTY")}
