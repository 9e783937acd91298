"""Events rebuilt from stored payloads at an instant, and canonical JSON."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import canonical_json as C
from tidemark.operators import freezes, ledger, replay

EID = "canonical-event-v0-" + "a" * 64
DAY = 1791331200000000  # 2026-10-07


def at(clock):
    hours, minutes = map(int, clock.split(":"))
    return DAY + (hours * 60 + minutes) * 60_000_000


def state(*refs, **more):
    return "CANONICAL_EVENT_STATE", EID, EID, {"event_id": EID, "event_title": "Oil", "verification_status": "UNVERIFIED_NEWS", "article_references": list(refs), **more}


def news(ref, title="t", event=EID, **more):
    return "NEWS_ARTICLE", ref, event, {"article_reference": ref, "title": title, "verification_status": "UNVERIFIED_NEWS", "reported_at": None, **more}


def fact(event=EID, **more):
    return "OFFICIAL_EVIDENCE", "o1", event, {"official_evidence_id": "o1", "canonical_event_id": event, "authority_role": "FACT_AUTHORITY", "evidence_status": "OFFICIAL_CONFIRMED", **more}


def market(price, event=EID, status="LINKED", **more):
    return "MARKET_EXPECTATION", "m1", event, {"expectation_id": "m1", "canonical_event_id": event, "authority_role": "EXPECTATION_SENSOR", "link_status": status, "probabilities": [price, None], **more}


def reality(clock, price, scope="PUBLIC_REDISTRIBUTABLE", symbol="OIL", entity=None, **more):
    stamp = f"2026-10-07T{clock}:00Z"
    return "MARKET_REALITY", entity or symbol + clock, EID, {"symbol": symbol, "price_or_level": price, "market_timestamp": stamp, "data_usage_scope": scope, "source": {"name": "x"}, **more}


HISTORY = [
    ("09:00", state("n1")), ("09:00", news("n1")), ("09:00", ("SOURCE_STATE", "s", None, {"status": "OK"})), ("09:10", market("0.55", market_close_time="2026-10-07T08:30:00Z")),
    ("09:30", fact(published_at="2026-10-07T08:00:00Z")), ("10:00", market("0.70")), ("10:15", state("n1", "n2", geography_status="KNOWN")), ("10:15", news("n2", "later update")),
    ("10:20", ("CONTEXT_GEOGRAPHY", EID, EID, {"context_geography": {"b": [1, {"z": 1, "y": None}], "a": "é"}, "institution_context": [], "headline_explanation": None, "contract_version": "C1"})),
    ("11:00", market("0.70", None, "UNLINKED")),
]


@pytest.fixture(scope="module")
def stored(spark):
    def build(history):
        rows = [(kind, entity, event, None, json.dumps(payload), "{}", at(clock)) for clock, (kind, entity, event, payload) in history]
        df = spark.createDataFrame(rows, "observation_kind string, entity_id string, canonical_event_id string, source_timestamp string, payload string, provenance string, at long")
        return ledger.observations(df, F.col("at")).checkpoint()

    return build


@pytest.fixture(scope="module")
def seeded(stored):
    return stored(HISTORY)


@pytest.mark.parametrize("clock,articles,versions,facts,price,unknown", [
    ("08:59", None, 0, 0, None, ["EVENT_NOT_OBSERVED_AT_AS_OF"]),
    ("09:05", ["n1"], 0, 0, None, ["EVENT_OCCURRENCE_TIME_UNKNOWN", "GEOGRAPHY_UNKNOWN", "NO_OFFICIAL_EVIDENCE", "NO_LINKED_MARKET_EXPECTATION", "NEWS_REPORTED_TIME_UNKNOWN"]),
    ("09:20", ["n1"], 1, 0, "0.55", ["EVENT_OCCURRENCE_TIME_UNKNOWN", "GEOGRAPHY_UNKNOWN", "NO_OFFICIAL_EVIDENCE", "NEWS_REPORTED_TIME_UNKNOWN", "MARKET_PROBABILITIES_UNKNOWN"]),
    ("09:30", ["n1"], 1, 1, "0.55", ["EVENT_OCCURRENCE_TIME_UNKNOWN", "GEOGRAPHY_UNKNOWN", "NEWS_REPORTED_TIME_UNKNOWN", "MARKET_PROBABILITIES_UNKNOWN"]),
    ("10:05", ["n1"], 2, 1, "0.70", ["EVENT_OCCURRENCE_TIME_UNKNOWN", "GEOGRAPHY_UNKNOWN", "NEWS_REPORTED_TIME_UNKNOWN", "MARKET_CLOSE_TIME_UNKNOWN", "MARKET_PROBABILITIES_UNKNOWN"]),
    ("10:30", ["n1", "n2"], 2, 1, "0.70", ["EVENT_OCCURRENCE_TIME_UNKNOWN", "NEWS_REPORTED_TIME_UNKNOWN", "MARKET_CLOSE_TIME_UNKNOWN", "MARKET_PROBABILITIES_UNKNOWN"]),
    ("11:00", ["n1", "n2"], 2, 1, None, ["EVENT_OCCURRENCE_TIME_UNKNOWN", "NO_LINKED_MARKET_EXPECTATION", "NEWS_REPORTED_TIME_UNKNOWN"]),
])
def test_nothing_later_is_known(spark, seeded, clock, articles, versions, facts, price, unknown):
    asked = spark.createDataFrame([(EID,)], "canonical_event_id string")
    (got,) = replay.rebuild(seeded, at(clock), asked).collect()
    assert got.unknowns == unknown and got.news_article_references == articles
    assert got.replay_status == ("AVAILABLE" if articles else "NO_OBSERVATIONS")
    if articles:
        assert len(got.official_evidence) == facts and [json.loads(m)["probabilities"][0] for m in got.market_expectations] == ([price] if price else [])
        assert got.fact_state == ("PARTIAL_OFFICIAL_EVIDENCE" if facts else "NEWS_ONLY") and got.expectation_state == ("EXPECTATION_PRESENT" if price else "NONE")
        assert ("later update" in "".join(got.news)) == (clock >= "10:15")
        past = replay.history(seeded, at(clock)).filter("observation_kind = 'MARKET_EXPECTATION'").collect()
        assert len(past) == versions and sum(r.active_at_as_of for r in past) == bool(price)


def test_digests_are_those_of_the_canonical_text(seeded):
    (got,) = replay.rebuild(seeded, at("10:30")).collect()
    event = {n: None for n in [*replay.EVENT, *replay.CONTEXT]} | {"event_id": EID, "event_title": "Oil", "verification_status": "UNVERIFIED_NEWS", "geography_status": "KNOWN"}
    event |= {"context_geography": {"b": [1, {"z": 1, "y": None}], "a": "é"}, "institution_context": [], "context_contract": "C1"}
    parts = {p: [json.loads(r) for r in got[p]] for p in replay.PARTS}
    assert [set(r) for r in parts["news"]] == [set(replay.NEWS)] * 2 and set(parts["official_evidence"][0]) == set(replay.OFFICIAL) and set(parts["market_expectations"][0]) == set(replay.MARKET)
    text = lambda v: json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    sha = lambda v: hashlib.sha256(text(v).encode()).hexdigest()
    snapshot = {"event": event, **parts}
    assert json.loads(got.event) == event and got.snapshot_sha256 == sha(snapshot)
    result = {
        "contract_version": "MACROVIEW_FREEZE_V0", "canonical_event_id": EID, "freeze_key": "REPLAY_AS_OF/2026-10-07T10:30:00.000000Z", "frozen_at": "2026-10-07T10:30:00Z",
        "news_article_references": ["n1", "n2"], "official_evidence_ids": ["o1"], "market_expectation_ids": ["m1"], "fact_state": got.fact_state, "expectation_state": got.expectation_state,
        "unknowns": got.unknowns, "snapshot": snapshot,
        "provenance": {"snapshot_sha256": sha(snapshot), "news_sha256": sha(parts["news"]), "official_sha256": sha(parts["official_evidence"]), "expectation_sha256": sha(parts["market_expectations"])},
    }
    assert got.macroview_id == "macroview-freeze-v0-" + sha(result)


def test_freezes_are_stored_once_and_proven_again(spark, seeded):
    made = freezes.frozen(seeded, at("10:30"), at("10:31"), "K").checkpoint()
    (row,) = made.collect()
    body = json.loads(row.payload)
    text = json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert text == row.payload and hashlib.sha256(text.encode()).hexdigest() == row.payload_sha256
    assert body.pop("macroview_id") == row.macroview_id == "macroview-freeze-v0-" + hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert body["provenance"]["snapshot_sha256"] == row.snapshot_sha256
    again = made.withColumn("created_us", F.col("created_us") + 5)
    assert freezes.added(made, again).isEmpty()
    assert freezes.added(made.limit(0), made.unionByName(again)).first().created_us == at("10:31")
    assert freezes.added(made.withColumn("payload", F.lit("{}")), again).first().fault == "FREEZE_INTEGRITY_FAILED"
    later = freezes.frozen(seeded, at("11:00"), at("11:00"), "K")
    listed = freezes.listed(made.unionByName(later)).orderBy("place").collect()
    assert [(r.place, r.fault, r.created_us, r.expectation_state) for r in listed] == [(1, None, at("10:31"), "EXPECTATION_PRESENT"), (2, None, at("11:00"), "NONE")] and listed[0].unknowns == body["unknowns"]
    damages = {"payload": "{}", "payload_sha256": "x", "contract_version": "V9", "macroview_id": "m", "canonical_event_id": "e", "snapshot_sha256": "s"}
    broken = [made.withColumn(c, F.lit(v)) for c, v in damages.items()] + [made.withColumn("payload", F.lit(None).cast("string"))]
    for one in broken[1:]:
        broken[0] = broken[0].unionByName(one)
    assert {(r.fault, r.fact_state, r.unknowns) for r in freezes.listed(broken[0]).collect()} == {("FREEZE_INTEGRITY_FAILED", None, None)}
    for wrong in [(at("10:30"), at("10:29"), "K"), (0, 0, " "), (0, 0, "k" * 1001)]:
        with pytest.raises(ValueError):
            freezes.frozen(seeded, *wrong)


CASES = [
    ([state("n1", "n9"), news("n1")], "PARTIAL_OBSERVATIONS"), ([state(), news("n1")], "PARTIAL_OBSERVATIONS"), ([state("n1"), news("n1", verification_status="FALSE")], "PARTIAL_OBSERVATIONS"),
    ([state("n1", verification_status="X"), news("n1")], "PARTIAL_OBSERVATIONS"), ([state("n1"), news("n1", event="other")], "PARTIAL_OBSERVATIONS"),
    ([state(*[f"n{i}" for i in range(513)])] + [news(f"n{i}") for i in range(513)], "PARTIAL_OBSERVATIONS"), ([state("n1", "n1"), news("n1"), news("n7")], "AVAILABLE"),
    ([state(*[f"n{i}" for i in range(512)])] + [news(f"n{i}") for i in range(512)], "AVAILABLE"), ([news("n1")], "NO_OBSERVATIONS"), ([state("n1"), news("n1"), ("NEWS_ARTICLE", "x", EID, {"article_reference": "n1", "verification_status": "UNVERIFIED_NEWS", "title": "other"})], "AVAILABLE"),
    ([state("n1", "x"), news("n1"), ("NEWS_ARTICLE", "x", EID, {"article_reference": "n1", "verification_status": "UNVERIFIED_NEWS", "title": "other"})], "PARTIAL_OBSERVATIONS"),
]


def test_status(stored):
    rows = []
    for i, (history, _) in enumerate(CASES):  # each case is an event of its own, with entities of its own
        for kind, entity, event, payload in history:
            text = json.dumps(payload).replace(EID, f"e{i}").replace('"n', f'"{i}n').replace(f'"{i}news', '"news')
            name = f"{i}{entity}" if entity != EID else f"e{i}"
            rows.append(("09:00", (kind, name, f"e{i}" if event == EID else event, json.loads(text.replace('"x"', f'"{i}x"')))))
    got = {r.canonical_event_id: r for r in replay.rebuild(stored(rows), at("09:00")).collect()}
    for i, (_, status) in enumerate(CASES):
        r = got[f"e{i}"]
        assert r.replay_status == status and (r.event is None) == (status != "AVAILABLE") == (r.macroview_id is None), i


def test_prices_are_public_fresh_and_known(stored):
    rows = stored([
        ("09:00", state("n1")), ("09:00", news("n1")), ("08:55", reality("08:50", 50.0, entity="r0")), ("09:20", reality("09:20", 55.0, entity="r1", previous_close={"price_or_level": 44.0, "market_timestamp": "2026-10-06T20:00:00Z", "observed_at": "2026-10-06T20:00:00Z"})),
        ("09:21", reality("09:21", 99.0, "PRIVATE_RESEARCH_ONLY")), ("09:21", reality("09:21", 98.0, provider="Tiingo", entity="p")), ("09:21", reality("09:21", 97.0, source={"name": "n", "url": "https://u@api.tiingo.com:1/x"}, entity="q")),
        ("09:25", reality("09:40", 60.0, entity="r3")), ("09:10", reality("09:01", 4.5, symbol="US10Y", entity="y")), ("08:58", reality("08:58", 4.25, symbol="US10Y", entity="y0")), ("09:22", ("MARKET_OBSERVATION", "z", EID, {"symbol": "OIL"})),
    ])
    (got,) = replay.market_state(rows, at("09:30")).collect()
    shown = {m.symbol: (m.price_or_level, m.availability_status, m.change_since_event and round(m.change_since_event, 6), m.change_from_previous_close and round(m.change_from_previous_close, 6)) for m in got.market_reality}
    assert shown == {"OIL": (55.0, "AVAILABLE", 10.0, 25.0), "US10Y": (None, "STALE", None, None)}
    (early,) = replay.market_state(rows, at("09:12")).collect()
    assert {m.symbol: m.change_since_event for m in early.market_reality}["US10Y"] == 25.0


def test_research_adds_clocks(seeded):
    (got,) = replay.research(seeded, at("10:30")).collect()
    assert [(d.entity_id, d.first_us, d.versions) for d in got.detection] == [("n1", at("09:00"), 1), ("n2", at("10:15"), 1)]
    assert (got.evidence_versions, got.evidence_in_force, got.official_propositions, got.market_reality) == (2, 2, 1, None)


DOCS = [
    '{"b":1.5,"a":[{"d":1,"c":null,"é":"\\u00e9\\n/\\"x\\\\"}],"Z":true,"e":{},"l":[],"artifact_fingerprint":"xx","n":{"artifact_fingerprint":1,"k":[1,[2,{}]]}}', '{"a":"{,}:[]", "\\"":{"}":[""]}}', "[1, [2, {\"b\":0,\"a\":\"\"}]]",
    "{}", "[]", '"s"', '{"a":null}', "12", "null",
]


def test_canonical_json_equals_the_library(spark):
    df = spark.createDataFrame([(d,) for d in [*DOCS, "{bad", None, '{"a":1,"a":2}']], "d string")
    got = df.select("d", C.canonical("d").alias("c"), C.indented(C.canonical("d")).alias("i"), C.without("d", "artifact_fingerprint").alias("w"), C.fingerprint("d").alias("f"), C.quoted("d").alias("q"), C.allow_listed(C.parsed("d"), ["b", "zz"], ["e"]).alias("l")).collect()
    for r in got[: len(DOCS)]:
        held = json.loads(r.d)
        assert r.c == json.dumps(held, sort_keys=True, separators=(",", ":"), ensure_ascii=False) and r.i == json.dumps(held, sort_keys=True, indent=2, ensure_ascii=False) and r.q == json.dumps(r.d, ensure_ascii=False)
        if isinstance(held, dict):
            assert json.loads(r.l) == {"b": held.get("b"), "zz": None} | ({"e": held["e"]} if "e" in held else {})
            held.pop("artifact_fingerprint", None)
            assert json.loads(r.w) == held and r.f == hashlib.sha256((json.dumps(held, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode()).hexdigest()
        else:
            assert r.w is None and r.f is None
    assert [(r.c, r.i, r.f) for r in got[len(DOCS) :]] == [(None, None, None)] * 3
    own = got[0].f
    sealed = spark.createDataFrame([(DOCS[0].replace('"xx"', f'"{own}"'),), (DOCS[0],), ("[]",), (None,)], "d string")
    assert [r[0] for r in sealed.select(C.sealed("d")).collect()] == [True, False, False, False]
