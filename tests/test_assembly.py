"""The view of events and the triage of articles."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import assembly


def test_view_of_a_hot_event_is_bounded_and_counted(spark):
    events = spark.createDataFrame([("e", "E"), ("f", "F"), ("g", "G"), ("h", "H")], "event_id string, event_title string")
    articles = spark.range(5000).select(F.col("id").alias("article_reference"), F.lit("e").alias("event_id"), F.lit("t").alias("title"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("2024-01-01T00:00:"), F.lpad((F.col("id") % 60).cast("string"), 2, "0"))).alias("published"))
    articles = articles.unionByName(spark.createDataFrame([(-1, "f", None, None), (-2, None, "x", None), (-3, "nowhere", "x", None)], "article_reference long, event_id string, title string, published string"))
    official = spark.createDataFrame([("o1", "e", "OFFICIAL_CONFIRMED", "LINKED", "p"), ("o2", "f", "OFFICIAL_CONFIRMED", "CONFLICTING_EVIDENCE_COPIES", "p"), ("o3", "g", "DRAFT", "LINKED", "p"), ("o4", "g", "OFFICIAL_CONFIRMED", "LINKED", " ")], "official_evidence_id string, event_id string, evidence_status string, link_status string, proposition string")
    linked = spark.createDataFrame([("m1", "e", "LINKED", "q"), ("m2", "e", "UNLINKED", "q")], "expectation_id string, event_id string, link_status string, question string")
    points = spark.createDataFrame([("p", "g", "Oslo")], "geography_id string, event_id string, place_name string")
    market = spark.createDataFrame([("A", "e", "t0", "OK"), ("B", "e", "t0", "OK"), ("A", "f", "t0", "OK"), ("B", "f", "t1", "OK")], "symbol string, event_id string, anchor string, status string")
    got = {r.event_id: r for r in assembly.events_view(events, articles, official, linked, points, market, most=4).collect()}
    assert {k: (r.articles_count, len(r.articles), r.verification_status, r.geography_status, r.market_status) for k, r in got.items()} == {
        "e": (5000, 4, "OFFICIAL_PARTIAL", "UNKNOWN", "AVAILABLE"), "f": (1, 1, "CONFLICTING_EVIDENCE", "UNKNOWN", "UNAVAILABLE"), "g": (0, 0, "NOT_VERIFIED", "KNOWN", "NO_OBSERVATIONS"), "h": (0, 0, "NOT_VERIFIED", "UNKNOWN", "NO_OBSERVATIONS"),
    }
    assert [json.loads(a)["published"][-2:] for a in got["e"].articles] == ["58"] * 4 and json.loads(got["f"].articles[0]) == {"article_reference": -1, "title": None, "published": None}
    assert [json.loads(m)["expectation_id"] for m in got["e"].market_expectations] == ["m1"]


@pytest.mark.parametrize("title,hours,proven,want", [
    ("ECB cuts interest rates", 1, True, "HIGH_PRIORITY_RESEARCH"), ("ECB cuts rates", 48, True, "HIGH_PRIORITY_RESEARCH"), ("ECB cuts rates", 49, True, "STALE_SOURCE_ARTICLE"), ("ECB cuts rates", 1, False, "NORMAL_RESEARCH"),
    ("Quiet day", 1, True, "NORMAL_RESEARCH"), ("ECB cuts rates", -1, True, "INSUFFICIENT_EVIDENCE"), ("ECB cuts rates", None, True, "INSUFFICIENT_EVIDENCE"), (None, 1, None, "NORMAL_RESEARCH"),
])
def test_priority(spark, title, hours, proven, want):
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    published = F.lit(None).cast("timestamp") if hours is None else F.timestamp_micros(F.unix_micros(now) - F.lit(hours * 3_600_000_000))
    assert spark.range(1).select(assembly.priority(F.lit(title).cast("string"), published, now, F.lit(proven).cast("boolean"))["priority"]).first()[0] == want


def test_nearest_and_merging_pairs_equal_brute_force(spark):
    import random

    from tidemark.operators import asof, canonical

    rng = random.Random(6)
    day = lambda n: (dt.date(2024, 1, 1) + dt.timedelta(days=n)) if n is not None else None
    seen = [(rng.choice("aaab"), rng.choice([None, *range(0, 200, 3)]), float(rng.randrange(9))) for _ in range(120)]
    asked = [(i, k, n) for i, (k, n) in enumerate([(k, n) for k in "abc" for n in (-5, 0, 30, 31, 59, 60, 99, 150, 198, 199, 300, 60)])]
    out = asof.nearest(
        spark.createDataFrame([(i, k, day(n)) for i, k, n in asked], "i int, k string, e date"), spark.createDataFrame([(k, day(n), v) for k, n, v in seen], "k string, d date, v double"), "k", "e", "d", "v"
    )
    for r in out.collect():
        own = [(day(n), v) for k, n, v in seen if k == r.k and n is not None]
        before, after = max([x for x in own if x[0] < r.e], default=(None, None)), min([x for x in own if x[0] > r.e], default=(None, None))
        assert (r.pre_date, r.pre_value, r.post_date, r.post_value) == before + after
    assert out.count() == len(asked)
    rows = [(i, rng.choice("xxy"), rng.randrange(-50, 400)) for i in range(150)]
    df = spark.createDataFrame(rows, "i int, k string, at long")
    pairs = canonical.merging_pairs(df, ["k"], "i", "at", 6)
    want = {(a, b) for a, k, s in rows for b, j, t in rows if k == j and a < b and abs(s - t) <= 6}
    assert sorted((r.a, r.b) for r in pairs.collect()) == sorted(want)
    sizes = {k: sum(1 for r in rows if r[1] == k) for k in "xy"}
    assert {r.k: r.merging + r.apart for r in canonical.pair_counts(df, pairs, ["k"]).collect()} == {k: n * (n - 1) // 2 for k, n in sizes.items()}
