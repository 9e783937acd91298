"""Inputs that are taken whole or not at all, redaction, previews and enrichment."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ledger, reaction, views
from tidemark.operators.redact import redacted
from tidemark.sources import packets

EVENT = "canonical-event-v0-" + "a" * 64
GOOD = {
    "symbol": "SPY", "event_id": EVENT, "time_basis": "SYSTEM_RECORDED_TIME", "event_observed_at": "2024-01-02T00:00:00Z", "market_timestamp": "2024-01-02T10:00:00Z",
    "observed_at": "2024-01-02T10:01:00Z", "source": {"name": "Desk", "url": "https://desk.example/q"}, "source_observation_id": "o1", "price_or_level": 5.0, "value_unit": "PRICE",
}


@pytest.mark.parametrize(
    "change, fault",
    [
        ({}, None), ({"symbol": None}, "INVALID_MARKET_SYMBOL"), ({"event_id": EVENT + "a"}, "INVALID_MARKET_EVENT"), ({"time_basis": "X"}, "NO_POINT_IN_TIME_SOURCE"),
        ({"observed_at": "2024-01-02T10:01:00"}, "INVALID_MARKET_TIME"), ({"market_timestamp": "2024-01-02T12:01:00+01:00"}, "MARKET_TIME_AFTER_KNOWLEDGE"),
        ({"source": {"name": " "}}, "MARKET_PROVENANCE_REQUIRED"), ({"source": {"name": "D", "url": "https://u@d.example/"}}, "INVALID_MARKET_SOURCE_URL"),
        ({"price_or_level": 0}, "INVALID_MARKET_VALUE"), ({"symbol": "US10Y", "price_or_level": -0.5, "value_unit": "YIELD_PERCENT"}, None), ({"value_unit": "INDEX_LEVEL"}, "MARKET_UNIT_MISMATCH"),
        ({"previous_close": {"price_or_level": 4, "market_timestamp": "2024-01-01T10:00:00Z", "observed_at": "2024-01-01T10:00:00Z", "source_observation_id": "p"}}, None),
        ({"previous_close": {"price_or_level": 4, "market_timestamp": "2024-01-01T10:00:00Z", "observed_at": "2024-01-03T10:00:00Z", "source_observation_id": "p"}}, "INVALID_PREVIOUS_CLOSE"),
        ({"synthetic": True}, "INVALID_MARKET_VISIBILITY"),
    ],
)
def test_record_faults(spark, change, fault):
    row = spark.createDataFrame([(json.dumps({**GOOD, **change}),)], "r string").select(F.from_json("r", packets.RECORD).alias("r")).select("r.*")
    assert row.select(packets.record_fault()).first()[0] == fault


def test_market_packets_are_taken_whole(spark, tmp_path):
    def read(rows, **more):
        (tmp_path / "p.json").write_text(json.dumps({"schema": packets.MARKET_SCHEMA, "observations": rows, **more}))
        found, status = packets.read_market(spark, str(tmp_path / "p.json"))
        return found.count(), status

    other = {**GOOD, "source_observation_id": "o2"}
    assert read([GOOD, GOOD, other]) == (2, "AVAILABLE") and read([]) == (0, "EMPTY")
    assert read([GOOD, {**other, "symbol": "?"}]) == read([GOOD], synthetic=True) == read([GOOD], schema="x") == (0, "UNAVAILABLE")
    assert read([GOOD, {**GOOD, "price_or_level": 6.0}]) == read([GOOD, {**other, "event_observed_at": "2024-01-01T00:00:00Z"}]) == (0, "UNAVAILABLE")
    assert packets.read_market(spark, None)[1] == "NOT_CONFIGURED" and packets.read_market(spark, str(tmp_path / "none"))[1] == "UNAVAILABLE"
    assert packets.read_market(spark, str(tmp_path / "p.json"), most_bytes=10)[1] == "UNAVAILABLE"


def test_sealed_cases_and_snapshots(spark, tmp_path):
    data, case = tmp_path / "rates.csv", tmp_path / "case.json"
    constant = ",".join(reaction.SERIES.values())
    data.write_text(",".join(reaction.SERIES) + ",TIME_PERIOD,OBS_VALUE\n" + "".join(f"{constant},2025-06-0{d},1.1{d}\n" for d in (4, 6)))
    held = {
        "schema": packets.CASE_SCHEMA, "synthetic": False, "event_date": "2025-06-05", "event_timestamp_precision": "DATE_ONLY", "fact_proposition": "Rates fell",
        "license": {"status": "OPEN", "conditions": "name"}, "market_data_sha256": hashlib.sha256(data.read_bytes()).hexdigest(),
        "market_data_retrieved_at": "2025-06-07T00:00:00Z", "system_observed_at": "2025-06-07T00:00:00Z",
    }

    def read(**change):
        case.write_text(json.dumps({**held, **change}))
        return packets.read_case(spark, str(case), str(data), {"event_date": "2025-06-05"}, {"status": "OPEN"})

    assert read()[1].count() == 2
    for fault in ({"event_date": "2025-06-06"}, {"source_published_at": "x"}, {"license": {"status": "OPEN"}}, {"market_data_sha256": "0"}, {"system_observed_at": None}, {"market_data_retrieved_at": "2025-06-05T00:00:00Z"}):
        assert read(**fault) is None
    table = tmp_path / "t.csv"
    for text, good in (("a,b\n1,x\n2,y\n", True), ("b,a\n1,x\n", False), ("a,b\n", False), ("a,b\n1,x\n1,y\n", False), ("a,b\n1,\n", False)):
        table.write_text(text)
        if good:
            assert packets.read_snapshot(spark, str(table), ["a", "b"], F.col("b").isNotNull(), F.col("a")).count() == 2
        else:
            with pytest.raises(ValueError, match="SNAPSHOT"):
                packets.read_snapshot(spark, str(table), ["a", "b"], F.col("b").isNotNull(), F.col("a"))


def test_curated_links_fail_closed(spark, tmp_path):
    path = tmp_path / "links.json"
    path.write_text(json.dumps({"schema": packets.LINKS_SCHEMA, "event_to_market": {"e": "m", "f": ["n", "o"]}}))
    found, status = packets.curated_links(spark, str(path))
    assert status == "CURATED" and {tuple(r) for r in found.collect()} == {("e", "m"), ("f", "n"), ("f", "o")}
    path.write_text("{")
    found, status = packets.curated_links(spark, str(path))
    assert status == "UNAVAILABLE" and found.isEmpty() and packets.curated_links(spark, None) == (None, "AUTOMATIC")


def test_feed_copies(spark):
    rows = [("https://A.example/x?utm_source=1", "It's", "2024-01-01"), ("https://a.example/x#f", "It’s", "2024-01-01"), ("https://a.example/y", "T", None), ("https://a.example/y", "T", "2024-01-01"), ("nothing", "T", None), (None, None, None)]
    out = {r.url: r for r in packets.feed_articles(spark.createDataFrame(rows, "link string, title string, pubDate string")).collect()}
    assert set(out) == {"https://a.example/x", "https://a.example/y"}
    assert not out["https://a.example/x"].conflicting and len(out["https://a.example/x"].aliases) == 2 and out["https://a.example/x"].precision == "DATE_ONLY"
    assert out["https://a.example/y"].conflicting


def test_redaction_of_nested_documents(spark):
    public = {"data_usage_scope": "PUBLIC_REDISTRIBUTABLE", "provider": "desk", "source": {"name": "Desk", "url": "https://desk.example/q"}}
    value = {
        "a": [1, {"data_usage_scope": "UNKNOWN"}, {"provider": "TIINGO"}, [{"x": {"data_usage_scope": "PUBLIC_REDISTRIBUTABLE"}}]], "private_market_observations": [1], "market_observations": [public],
        "market_reality_observations": [public, {**public, "synthetic": True}, {**public, "source": {"url": "https://api.tiingo.com/x"}}],
        "kept": {"contract_version": "MARKET_REALITY_SNAPSHOT_V0", "instruments": [{"price_or_level": None}, {"price_or_level": 1, **public}]},
        "gone": {"contract_version": "MARKET_REALITY_SNAPSHOT_V0", "instruments": [{"price_or_level": 1}]}, "bar": {"contract_version": "MARKET_OBSERVATION_V0"},
    }
    deep = "x"
    for i in range(11):
        deep = [deep] if i % 3 else {"k": deep, "gone": {"provider": "tiingo", "deep": [[[1]]]}}
    rows = spark.createDataFrame([(0, json.dumps(value)), (1, "{"), (2, None), (3, '{"provider": "Tiingo"}'), (4, json.dumps(deep)), (5, "[]"), (5, "[]"), (6, "null"), (7, ' "s"')], "n int, v string")
    found = redacted(rows, "v")
    assert found.columns == ["n", "v"]
    kept = sorted(tuple(r) for r in found.collect())
    out = [v for _, v in kept]
    assert out[1:4] == [None] * 3 and out[5:] == ["[]", "[]", None, '"s"']
    for i in reversed(range(11)):
        deep = deep[0] if i % 3 else deep["k"]
    shown = json.loads(out[4])
    for i in reversed(range(11)):
        assert i % 3 or shown["gone"] is None
        shown = shown[0] if i % 3 else shown["k"]
    assert shown == deep == "x"
    assert json.loads(out[0]) == {
        "a": [1, [{"x": {"data_usage_scope": "PUBLIC_REDISTRIBUTABLE"}}]], "market_observations": [], "market_reality_observations": [public], "kept": value["kept"], "gone": None, "bar": None,
    }


def test_redaction_opens_each_document_in_its_row(spark):
    wide = {f"k{i:03}": [{"provider": "tiingo"} if i % 3 == 0 else None if i % 3 == 1 else {"market_observations": i, "é\"": i}] for i in range(300)}
    texts = [json.dumps(wide), '{"": {"": []}, "market_observations": null, "market_reality_observations": {"a": 1}}', '{"a": "null", "b": null, "c": [null, "x"], "c2": 1.50}', '{"a": 1, "a": 2}', '"{["', "[[],{}]"] * 2
    before = spark._jsc.sc().dagScheduler().numTotalJobs()
    found = redacted(spark.createDataFrame(list(enumerate(texts)), "n int, v string"), "v")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert spark._jsc.sc().dagScheduler().numTotalJobs() == before and "Exchange" not in plan and "Join" not in plan
    out = [v for _, v in sorted(map(tuple, found.collect()))]
    assert out[:6] == out[6:]
    assert json.loads(out[0]) == {k: [None, None, {"market_observations": [], 'é"': i}][i % 3 :][:1] if i % 3 == 2 else [] for i, k in enumerate(wide)}
    assert out[1:6] == ['{"":{"":[]},"market_observations":[],"market_reality_observations":[]}', '{"a":"null","b":null,"c":["x"],"c2":1.5}', None, '"{["', "[[],{}]"]


def test_research_as_of_and_bindings(spark):
    made = spark.createDataFrame([("EVENT", "x", "x"), ("NEWS", "a", "x"), ("NEWS", "b", "y"), ("SOURCE_STATE", "s", "x")], "observation_kind string, entity_id string, canonical_event_id string")
    made = made.withColumns({"source_timestamp": F.lit(None), "payload": F.lit("{}"), "provenance": F.lit("{}")})
    rows = ledger.observations(made, F.lit(1000).cast("long")).unionByName(ledger.observations(made.filter("entity_id = 'a'"), F.lit(2000).cast("long")))
    assert ledger.rebound(rows).isEmpty() and ledger.rebound(rows.withColumn("entity_id", F.concat("entity_id", F.lit("!")))).count() == 5
    found = ledger.research_as_of(rows, "x", F.lit(2000))
    assert {(r.entity_id, r.first_us, r.last_us, r.versions) for r in found["detection"].collect()} == {("x", 1000, 1000, 1), ("a", 1000, 2000, 2), ("s", 1000, 1000, 1)}
    assert [(r.canonical_event_id, r.parts) for r in found["preview"].collect()] == [("x", 2)]
    assert [r.canonical_event_id for r in ledger.previews(rows, F.lit(2000)).collect()] == ["x"]
    assert ledger.capture_history(rows, "x", F.lit(2000)).count() == 3
    with pytest.raises(ValueError, match="TOO_LARGE"):
        ledger.capture_history(rows, "x", F.lit(2000), most=2)


def test_enrichment_is_no_place(spark):
    events = spark.createDataFrame([("e",), ("f",)], "event_id string")
    texts = spark.createDataFrame([("e", "HEADLINE", "ECB holds"), ("f", "HEADLINE", "Rates")], "event_id string, tier string, text string")
    sources = spark.createDataFrame([("e", "Desk"), ("f", "Desk")], "event_id string, source_name string")
    points = spark.createDataFrame([("e", "CURATED_PRESENTATION", "r"), ("f", "EXPLICIT_SOURCE", "r")], "event_id string, evidence_type string, evidence_reference string")
    out = {r.event_id: r for r in views.enriched(events, texts, sources, points, "event_id").collect()}
    assert (out["e"].context_region, out["e"].event_geography) == ("euro-area", "UNKNOWN") and len(out["e"].institutions) == 1
    assert (out["f"].context_status, out["f"].event_geography, out["f"].institutions) == ("UNKNOWN", "KNOWN", [])
