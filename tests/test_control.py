"""Publishing, backups and the control of captures."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ledger
from tidemark.sinks import publish
from tidemark.streaming import control


def _rows(spark, *items, us=1000):
    made = spark.createDataFrame([("NEWS", e, "x", None, json.dumps({"v": v}), "{}") for e, v in items], "observation_kind string, entity_id string, canonical_event_id string, source_timestamp string, payload string, provenance string")
    return ledger.observations(made, F.lit(us).cast("long"))


def test_published_tables_and_documents(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    assert publish.current(spark, root) is None and publish.read_json(spark, f"{root}/x.json") is None
    publish.publish(spark.range(5), root, ["id"])
    old = publish.current(spark, root)
    publish.publish(spark.range(9), root, ["id"])
    assert old.count() == 5 and publish.current(spark, root).count() == 9
    publish.write_json(spark, f"{root}/x.json", {"b": "é", "a": 1})
    publish.write_json(spark, f"{root}/x.json", {"b": 2})
    assert publish.read_json(spark, f"{root}/x.json") == {"b": 2}
    assert not [n for n in os.listdir(tmp_path / "t") if n.endswith(".tmp")]


def test_capture_receipts_checkpoint_backup_and_restore(spark, tmp_path):
    path = f"file://{tmp_path}/capture"
    first = publish.capture_snapshot(spark, path, _rows(spark, ("a", 1), ("b", 1)), "b1", "x", F.lit(1000))
    assert first.filter("visible").count() == 2
    again = publish.capture_snapshot(spark, path, _rows(spark, ("a", 2), us=2000), "b2", "x", F.lit(2000))
    assert again.count() == 3 and again.filter("visible").count() == 2
    stored = ledger.read(spark, f"{path}/ledger")
    assert publish.checkpoint(stored, f"{path}/now").count() == 2
    assert spark.read.parquet(f"{path}/receipts").count() == 2 and publish.receipt_faults(spark, f"{path}/receipts").isEmpty()
    copied = publish.copy(spark, f"{path}/ledger", f"file://{tmp_path}/backup")
    assert copied.count() > 2 and publish.differences(spark, f"file://{tmp_path}/backup").isEmpty()
    with pytest.raises(ValueError, match="TARGET_EXISTS"):
        publish.copy(spark, f"{path}/ledger", f"file://{tmp_path}/backup")
    fence = publish.restore(spark, f"file://{tmp_path}/backup", f"file://{tmp_path}/back", "2026-10-06 12:00:00").first()
    assert fence.not_before_utc == "2026-10-07T00:00:00Z" and ledger.read(spark, f"file://{tmp_path}/back").count() == 3
    some = next(p for p in (tmp_path / "backup").rglob("*.json"))
    some.write_text(some.read_text() + " ")
    (some.parent / f".{some.name}.crc").unlink(missing_ok=True)  # the local file system's own check
    with pytest.raises(ValueError, match="VERIFICATION_FAILED"):
        publish.restore(spark, f"file://{tmp_path}/backup", f"file://{tmp_path}/other", "2026-10-06 12:00:00")


def test_settings_are_checked_in_order(tmp_path):
    base = {
        "scope": control.LOCAL, "root": str(tmp_path / "v/r"), "volume": str(tmp_path / "v"), "volume_id": "volume-01", "ledger_id": "ledger-01", "sources": ["A", "B"], "daily_quota": 10,
        "per_source_quota": 5, "interval": 1800, "max_backoff": 3600, "max_storage_bytes": 1 << 20, "warning_bytes": 1 << 10, "min_free_bytes": 4 << 20,
    }
    (tmp_path / "v/r").mkdir(parents=True)
    (tmp_path / "v/VOLUME.json").write_text(json.dumps({"volume_id": "volume-01", "scope": control.LOCAL}))
    good = control.CaptureSettings.of(base).checked({"A", "B"})
    moved = control.CaptureSettings.of({**base, "root": str(tmp_path / "v/s")})
    assert good.fingerprint() == moved.fingerprint() != control.CaptureSettings.of({**base, "interval": 2000}).fingerprint()
    wrong = [
        ({"root": base["volume"]}, "SCOPE"), ({"ledger_id": "x"}, "NAMESPACE"), ({"sources": ["A", "A"]}, "UNAPPROVED"), ({"sources": ["C"]}, "UNAPPROVED"), ({"daily_quota": 0}, "QUOTA"),
        ({"interval": 4000}, "QUOTA"), ({"warning_bytes": 1 << 20}, "CAPACITY"), ({"scope": control.PRODUCTION}, "ACTIVATION"), ({"volume_id": "volume-02"}, "VOLUME"), ({"root": "r"}, "ABSOLUTE"),
    ]
    for change, code in wrong:
        with pytest.raises(ValueError, match=code):
            control.CaptureSettings.of({**base, **change}).checked({"A", "B"})
    with pytest.raises(ValueError, match="SETTINGS"):
        control.CaptureSettings.of({**base, "more": 1})
    (tmp_path / "link").symlink_to(tmp_path / "v")
    with pytest.raises(ValueError, match="LINK"):
        control.plain_path(str(tmp_path / "link/r"))
    with pytest.raises(ValueError, match="IDENTITY"):
        control.same_runner(good, tmp_path / "marker")
    control.same_runner(control.CaptureSettings.of({**base, "initialize": True}), tmp_path / "marker")
    control.same_runner(good, tmp_path / "marker")
    assert control.capacity(good)["warning"] is False
    (tmp_path / "v/r/x").write_bytes(b"0" * (1 << 20))
    with pytest.raises(ValueError, match="EXHAUSTED"):
        control.capacity(good)


def test_one_writer_and_a_stop(tmp_path):
    with control.single_writer(tmp_path / "lock"):
        with pytest.raises(ValueError, match="ALREADY"), control.single_writer(tmp_path / "lock"):
            pass
    with control.single_writer(tmp_path / "lock"):
        pass
    stop = tmp_path / "stop"
    stop.write_text(json.dumps({"pid": 1}))
    assert not control.stop_requested(stop, 2) and control.stop_requested(stop, 1) and not stop.exists()


def test_admission_by_state(spark):
    at = lambda h, d=6: dt.datetime(2026, 10, d, h)
    rows = [
        ("1", "ATTEMPT", "t1", "A", at(1), None, None, None), ("2", "ATTEMPT", "t2", "A", at(2), None, None, None), ("3", "ATTEMPT", "t3", "A", at(3, 5), None, None, None),
        ("4", "PROVIDER", "B", "B", at(1), at(2), True, 5), ("5", "PROVIDER", "C", "C", at(1), at(9), False, 1), ("6", "PROVIDER", "D", "D", at(1), at(2), False, 0),
    ]
    states = control.states_of(spark, rows)
    sources = spark.createDataFrame([(s,) for s in "ABCDEF"], "source string")
    ask = lambda s, hour, daily=4, each=2: {r.source: r.decision for r in control.admitted(s, sources, F.lit(at(hour)), daily, each).collect()}
    assert ask(states, 5) == {"A": "SOURCE_QUOTA_USED", "B": "SOURCE_PAUSED", "C": "BACKOFF_OR_NOT_DUE", "D": "RESERVED", "E": "RESERVED", "F": "DAILY_QUOTA_USED"}
    assert set(ask(states, 1).values()) == {"CLOCK_REGRESSION"}
    fenced = states.unionByName(control.states_of(spark, [("7", "FENCE", "f", None, at(3), at(0, 7), None, None)]))
    assert set(ask(fenced, 5).values()) == {"RESTORE_FENCED"}
    freed = states.unionByName(control.acknowledged(states, "B", F.lit(at(4))))
    assert ask(freed, 5, 10)["B"] == "RESERVED"
    status = control.capture_status(fenced, True, True, F.lit(at(5)), 2).first()
    assert (status.status, status.daily_quota_used, status.budget_status) == ("RUNNING", 2, "RESTORE_FENCED")
    assert control.capture_status(states, True, False, F.lit(at(5)), 2).first().budget_status == "EXHAUSTED"
    assert control.capture_status(states, False, False, F.lit(at(5)), 3).first().status == "OFF"
    assert {r.source: r.used for r in control.reservations(states, "2026-10-06").collect()} == {"A": 2}


def test_polled_source_keeps_its_last_rows(spark):
    now, answers = [0.0], [spark.range(3), ValueError(), spark.range(0)]

    def fetch():
        got = answers.pop(0)
        if isinstance(got, Exception):
            raise got
        return got

    source = control.Polled(fetch, lambda: now[0], 60)
    assert source.read()[1] == "LIVE" and source.read()[1] == "CACHED"
    now[0] = 60.0
    rows, status = source.read()
    assert status == "LAST_VALID_FALLBACK" and rows.count() == 3 and source.read()[1] == "LAST_VALID_FALLBACK"
    now[0] = 120.0
    assert source.read()[1] == "EMPTY"
    assert control.Polled(fetch, lambda: 0.0, 1).read() == (None, "UNAVAILABLE")


def test_paths_flags_cycles_and_pages(spark):
    assert control.ledger_path({}, "/h") is None and control.ledger_path({"TIDEMARK_RECORD": "1"}, "/h") == "/h/.tidemark/ledger"
    assert control.ledger_path({"TIDEMARK_ROOT": "/r", "TIDEMARK_RECORD": "1"}, "/h") == "/r/ledger" and control.ledger_path({"TIDEMARK_LEDGER": "/l", "TIDEMARK_ROOT": "/r"}, "/h") == "/l"
    paths = control.evidence_paths({"TIDEMARK_NEWS": "n", "TIDEMARK_MARKETS": "/m"}, "/d")
    assert paths["news"] == "/d/n" and paths["markets"] == "/m" and paths["official"] is None and len(paths) == 8
    assert control.opted_in({"TIDEMARK_A": "1", "TIDEMARK_B": "1"}, {"a": False, "b": True, "c": False}) == ["a"]
    assert [control.request_fault(m, p, {"/x"}) for m, p in (("GET", "/x"), ("POST", "/x"), ("GET", "/y"))] == [None, 405, 404]
    stops = iter([False, False, False, True])
    assert control.run_cycles(lambda s: s.lower(), ["A", "B"], 2, lambda: next(stops)) == [(1, "A", "a"), (1, "B", "b"), (2, "A", "a")]
    with pytest.raises(ValueError, match="CYCLES"):
        control.run_cycles(str, [], 5, bool)
    pages = {"a": [{"id": 1}, {"id": 2}], "b": [{"id": 1}, {"id": "x"}, {"id": 3}]}
    assert [e["id"] for e in control.paged(lambda s, _: pages[s], ["a", "b"])] == [1, 2, 3]
    assert control.schema_faults(spark.range(1), "id long, x string") == ["x"] and control.schema_faults(spark.range(1), "id long") == []
