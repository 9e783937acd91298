"""Streams that stop and go on: versions of content, their expiry, and idempotent recording."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import ledger
from tidemark.streaming import polls

DAY = dt.datetime(2024, 1, 1)


def test_versions_go_on_from_the_checkpoint_and_old_keys_leave(spark, tmp_path):
    schema = "n long, k string, at timestamp, c string"
    polled = [
        [(0, "a", 0, "x"), (1, "a", 1, "x"), (2, "b", 1, "y"), (3, "old", 2, "z")],
        [(4, "a", 30, "w"), (5, "a", 40, "x"), (6, "c", 50, "q")],
        [(7, "a", 60, "x"), (8, "b", 200, "y"), (9, "d", 260, "v")],
        [(10, "d", 261, None)],
    ]
    shaped = lambda part: spark.createDataFrame([(n, k, DAY + dt.timedelta(minutes=m), c) for n, k, m, c in part], schema)
    build = lambda stream: polls.content_versions(stream, "k", "at", ["n"], "c", keep="60 minutes", delay="1 minute")
    folder, held = str(tmp_path), []
    for part in polled:
        shaped(part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        polls.advance(build, spark.readStream.schema(schema).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/state")
        state = spark.read.format("statestore").option("stateVarName", "last").load(f"{folder}/state")
        held.append({r[0] for r in state.select("key.k").collect()})
    rows = shaped([r for part in polled for r in part])
    got = {r.n: (r.change, r.first_observed_us) for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == {r.n: (r.change, r.first_observed_us) for r in polls.content_versions_batch(rows, "k", "at", ["n"], "c", keep="60 minutes").collect()}
    assert [got[n][0] for n in range(11)] == ["NEW", "DUPLICATE", "NEW", "NEW", "UPDATED", "UPDATED", "NEW", "DUPLICATE", "NEW", "NEW", "UPDATED"]
    assert {"a", "b", "old"} <= held[0] and held[-1] == {"d"} | ({"b"} & held[-1]) and "old" not in held[-1] and "a" not in held[-1]


def test_versions_without_content_or_in_frames(spark, tmp_path):
    schema, folder = "k string, n long, at timestamp, c string", str(tmp_path)
    rows = spark.createDataFrame([(k, n, DAY + dt.timedelta(minutes=n // 2), c) for k in ("a", None) for n, c in enumerate([None, "None", None, None, "x"])], schema)
    build = lambda stream: polls.content_versions(stream, "k", "at", ["n"], "c")
    for part in ("n < 2", "n >= 2"):
        rows.filter(part).write.mode("append").parquet(f"{folder}/in")
        polls.advance(build, spark.readStream.schema(schema).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/state")
    out = spark.read.parquet(f"{folder}/out")
    assert out.columns == ["k", "n", "at", "c", "change", "first_observed_us"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, polls.content_versions_batch(rows, "k", "at", ["n"], "c").collect()), key=str)
    assert "Pandas" not in build(spark.readStream.schema(schema).parquet(f"{folder}/in"))._jdf.queryExecution().analyzed().toString()  # frames of a few rows cost milliseconds a key


def test_a_batch_recorded_twice_counts_once(spark, tmp_path):
    made = spark.createDataFrame([(f"e{i}", f'{{"v":{i}}}') for i in range(6)], "entity_id string, payload string")
    made.coalesce(1).write.parquet(str(tmp_path / "in"))
    path = str(tmp_path / "ledger")

    def append(batch, batch_id):
        rows = batch.withColumns({"observation_kind": F.lit("NEWS_ARTICLE"), "canonical_event_id": F.lit("x"), "source_timestamp": F.lit(None), "provenance": F.lit("{}")})
        for _ in range(2):  # a batch that is handed over again after a failure
            ledger.append(spark, path, ledger.observations(rows, F.lit(1_000_000).cast("long")), f"poll-{batch_id}")

    stream = spark.readStream.schema(made.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        polls.record(stream, append, str(tmp_path / "ck")).awaitTermination()
    assert ledger.read(spark, path).count() == 6
