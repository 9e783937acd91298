"""The append-only ledger as write-once Parquet batches, its replay and its frozen snapshots.

A batch is one folder; it counts once its row stands in the batch list, which is written last. A rerun of the same batch id
finds its row and does nothing, so recording is idempotent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import versions

SCHEMA = (
    "observation_id string, observation_kind string, entity_id string, canonical_event_id string, observed_at string, observed_us long, source_timestamp string, "
    "payload string, payload_sha256 string, provenance string, contract_version string"
)
KINDS = ["observation_kind", "entity_id"]
ORDER = ["observed_us", "observation_id"]
#: Knowledge clocks inside a payload that must not lie after its recording.
CLOCKS = ["$.observed_at", "$.first_detected_at", "$.retrieved_at", "$.first_seen_at"]


def observations(rows: DataFrame, observed_us: Column) -> DataFrame:
    """Ledger rows of (observation_kind, entity_id, canonical_event_id, source_timestamp, payload, provenance): ids are content hashes."""
    at = F.timestamp_micros(observed_us)
    named = rows.select(
        *[F.col(c).cast("string").alias(c) for c in ("observation_kind", "entity_id", "canonical_event_id", "source_timestamp", "payload", "provenance")],
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("observed_at"), observed_us.alias("observed_us"), F.sha2("payload", 256).alias("payload_sha256"),
        F.lit("INTELLIGENCE_OBSERVATION_V1").alias("contract_version"),
    )
    identity = F.to_json(F.array("contract_version", "observation_kind", "entity_id", "canonical_event_id", "observed_at", "source_timestamp", "payload_sha256", "provenance"))
    return named.withColumn("observation_id", F.concat(F.lit("observation-v1-"), F.sha2(identity, 256))).select(*[c.split()[0] for c in SCHEMA.split(", ")])


def read(spark: SparkSession, path: str) -> DataFrame:
    """All committed rows; batch folders without a row in the batch list are left out."""
    try:
        batches = spark.read.schema("batch string").json(f"{path}/batches")
        rows = spark.read.schema(SCHEMA + ", batch string").parquet(f"{path}/rows")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], SCHEMA)
    return rows.join(batches, "batch", "left_semi").drop("batch")


def violations(rows: DataFrame) -> DataFrame:
    """Rows whose hash does not fit, whose kind or entity is empty, or whose payload knows more than its recording."""
    late = F.lit(False)
    for clock in CLOCKS:
        late = late | F.coalesce(F.unix_micros(F.try_to_timestamp(F.get_json_object("payload", clock))) > F.col("observed_us"), F.lit(False))
    bad = F.sha2("payload", 256) != F.col("payload_sha256")
    return rows.filter(F.coalesce(bad, F.lit(True)) | F.col("observation_kind").isNull() | F.col("entity_id").isNull() | late)


def append(spark: SparkSession, path: str, incoming: DataFrame, batch: str) -> int:
    """Adds a batch: duplicates and unchanged content are skipped, back-dated or conflicting rows refuse the whole batch. Returns the rows added."""
    stored = read(spark, path)
    listed = 0
    if not stored.isEmpty():
        listed = spark.read.schema("batch string").json(f"{path}/batches").filter(F.col("batch") == batch).count()
    if listed:
        return 0
    if not violations(incoming).isEmpty():
        raise ValueError("LEDGER_ROWS_REJECTED")
    stored = stored.join(incoming.select(*KINDS).distinct(), KINDS, "left_semi")  # only the history of these entities decides
    content = F.sha2(F.to_json(F.array("canonical_event_id", "payload_sha256", "source_timestamp", "provenance")), 256)
    judged = versions.classify_append(stored.withColumn("content", content), incoming.withColumn("content", content), KINDS, "observed_us", "observation_id", "content")
    counts = {r["verdict"]: r["n"] for r in judged.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    if counts.get("BACKDATED") or counts.get("CONFLICT"):
        raise ValueError(f"LEDGER_BATCH_REFUSED {counts}")
    fresh = judged.filter("verdict = 'APPEND'").drop("content", "verdict")
    fresh.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")  # what a lost attempt left there goes
    spark.createDataFrame([(batch,)], "batch string").write.mode("append").json(f"{path}/batches")
    return counts.get("APPEND", 0)


def read_as_of(rows: DataFrame, event: str, as_of_us: Column) -> DataFrame:
    """Every version up to the instant of each entity that the event ever held by then, and all source states."""
    seen = rows.filter(F.col("observed_us") <= as_of_us)
    tied = seen.filter(F.col("canonical_event_id") == event).select(*KINDS).distinct()
    states = seen.filter("observation_kind = 'SOURCE_STATE'")
    return seen.filter("observation_kind <> 'SOURCE_STATE'").join(tied, KINDS, "left_semi").unionByName(states)


def replay(rows: DataFrame, event: str, as_of_us: Column) -> DataFrame:
    """The history of an event as of an instant, with ``visible``: the latest version of its entity, and still bound to the event (or a source state)."""
    history = read_as_of(rows, event, as_of_us)
    flagged = versions.active_flags(history, KINDS, ORDER, as_of_us)
    bound = F.coalesce(F.col("canonical_event_id") == event, F.lit(False)) | (F.col("observation_kind") == "SOURCE_STATE")
    return flagged.withColumn("visible", F.col("active_at_as_of") & bound)


def replay_counts(rows: DataFrame, event: str, as_of_us: Column) -> DataFrame:
    """One row: visible rows of each kind as a map, and the status."""
    per_kind = replay(rows, event, as_of_us).filter("visible").groupBy("observation_kind").agg(F.count("*").alias("n"))
    out = per_kind.agg(F.map_from_entries(F.collect_list(F.struct("observation_kind", "n"))).alias("kinds"))
    known = F.filter(F.map_keys("kinds"), lambda k: k != "SOURCE_STATE")
    status = F.when(F.size(known) == 0, "NO_OBSERVATIONS").when(F.array_contains(F.map_keys("kinds"), "EVENT"), "AVAILABLE").otherwise("PARTIAL_OBSERVATIONS")
    return out.withColumn("status", status)


def freeze(rows: DataFrame, event: str, as_of_us: Column, key: str) -> DataFrame:
    """One row that copies the visible payloads by value, with their digest: (macroview_id, canonical_event_id, freeze_key, payload, snapshot_sha256)."""
    seen = replay(rows, event, as_of_us).filter("visible")
    parts = seen.agg(F.array_sort(F.collect_list(F.struct("observation_kind", "entity_id", "payload_sha256", "payload"))).alias("parts"))
    digest = F.sha2(F.to_json(F.transform("parts", lambda p: p["payload_sha256"])), 256)
    body = parts.select(F.to_json("parts").alias("payload"), digest.alias("snapshot_sha256"))
    return body.select(
        F.concat(F.lit("macroview-v0-"), F.sha2(F.concat_ws("|", F.lit(event), F.lit(key), "snapshot_sha256"), 256)).alias("macroview_id"),
        F.lit(event).alias("canonical_event_id"), F.lit(key).alias("freeze_key"), "payload", "snapshot_sha256",
    )


def add_freezes(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Frozen rows that are not stored yet, by (event, key, snapshot)."""
    return new.join(stored, ["canonical_event_id", "freeze_key", "snapshot_sha256"], "left_anti")


def cache_differences(cache: DataFrame, derived: DataFrame) -> DataFrame:
    """Rows that only one of a derived cache and the ledger's state has; empty when they agree."""
    return cache.exceptAll(derived).unionByName(derived.exceptAll(cache))


def rebound(rows: DataFrame) -> DataFrame:
    """Rows whose id is not the hash of what they hold."""
    again = observations(rows, F.col("observed_us")).select("observation_id").distinct()
    return rows.join(again, "observation_id", "left_anti")


def capture_history(rows: DataFrame, event: str, as_of_us: Column, most: int = 20_000) -> DataFrame:
    """The versions of an event's entities as of an instant, without source states; fails beyond ``most`` rows instead of cutting them."""
    found = read_as_of(rows, event, as_of_us).filter("observation_kind <> 'SOURCE_STATE'")
    if found.limit(most + 1).count() > most:
        raise ValueError("CAPTURE_HISTORY_TOO_LARGE")
    return found


def previews(rows: DataFrame, as_of_us: Column) -> DataFrame:
    """(canonical_event_id, macroview_id, snapshot_sha256, parts): what a freeze of each event would hold, never stored; events without their own row are skipped."""
    last = versions.latest(rows, KINDS, ORDER, as_of_us).filter("canonical_event_id is not null and observation_kind <> 'SOURCE_STATE'")
    held = last.groupBy("canonical_event_id").agg(
        F.array_sort(F.collect_list(F.struct("observation_kind", "entity_id", "payload_sha256"))).alias("parts"), F.count_if(F.col("observation_kind") == "EVENT").alias("own")
    ).filter("own > 0")
    digest = F.sha2(F.to_json(F.transform("parts", lambda p: p["payload_sha256"])), 256)
    ident = F.concat(F.lit("macroview-preview-v0-"), F.sha2(F.concat_ws("|", "canonical_event_id", digest), 256))
    return held.select("canonical_event_id", ident.alias("macroview_id"), digest.alias("snapshot_sha256"), F.size("parts").alias("parts"))


def research_as_of(rows: DataFrame, event: str, as_of_us: Column) -> dict[str, DataFrame]:
    """What was known of an event at an instant: its replay, the clocks of its visible entities and its preview."""
    seen = replay(rows, event, as_of_us)
    clocks = seen.groupBy(*KINDS).agg(
        F.min("observed_us").alias("first_us"), F.max("observed_us").alias("last_us"), F.count("*").alias("versions"), F.bool_or("visible").alias("visible")
    ).filter("visible").drop("visible")
    return {"replay": seen, "detection": clocks, "preview": previews(rows, as_of_us).filter(F.col("canonical_event_id") == event)}
