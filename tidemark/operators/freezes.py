"""Views of events frozen by value: made from what an instant knew, stored once, and proven again whenever they are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import canonical_json as C
from . import replay

CONTRACT = "MACROVIEW_FREEZE_V0"
ONE = ["canonical_event_id", "freeze_key", "snapshot_sha256"]


def frozen(rows: DataFrame, as_of_us: int, created_us: int, freeze_key: str, asked: DataFrame | None = None) -> DataFrame:
    """(macroview_id, canonical_event_id, freeze_key, contract_version, payload, payload_sha256, created_us, snapshot_sha256) of each event that was AVAILABLE at an instant.

    Events whose references were not all observed freeze nothing. A blank key or one of more than 1000 characters, and a creation before the instant, are errors.
    """
    if not freeze_key.strip() or len(freeze_key) > 1000:
        raise ValueError("EXPLICIT_FREEZE_KEY_REQUIRED")
    if created_us < as_of_us:
        raise ValueError("FREEZE_CREATION_BEFORE_AS_OF")
    known = replay.rebuild(rows, as_of_us, asked, freeze_key, payload=True).filter("replay_status = 'AVAILABLE'")
    return known.select(
        "macroview_id", "canonical_event_id", F.lit(freeze_key).alias("freeze_key"), F.lit(CONTRACT).alias("contract_version"), "payload", F.sha2("payload", 256).alias("payload_sha256"),
        F.lit(created_us).alias("created_us"), "snapshot_sha256",
    )


def added(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of ``new`` that store a view for the first time, by event, key and snapshot; of equal ones the earliest, then least id.

    A stored row that stands in the way of one must still be whole: ``new`` holds ``fault`` for those whose stored view is damaged, and these are not added either.
    """
    rest = [c for c in new.columns if c not in ONE]
    once = new.groupBy(*ONE).agg(F.min_by(F.struct(*rest), F.struct("created_us", "macroview_id")).alias("_row")).select(*ONE, "_row.*").select(*new.columns)
    damaged = F.max(F.when(F.sha2("payload", 256) != F.col("payload_sha256"), "FREEZE_INTEGRITY_FAILED")).alias("fault")
    prior = stored.groupBy(*ONE).agg(damaged, F.lit(True).alias("_held"))
    return once.join(prior, ONE, "left").filter("_held is null or fault is not null").drop("_held")


def fault() -> Column:
    """FREEZE_INTEGRITY_FAILED unless contract, digest of the payload, identity, event and snapshot of a stored row all agree with what the payload says."""
    document = C.parsed("payload")
    identity = F.concat(F.lit("macroview-freeze-v0-"), F.sha2(C.without("payload", "macroview_id"), 256))
    snapshot = F.try_variant_get(document, "$.provenance.snapshot_sha256", "string")
    sound = (
        (F.col("contract_version") == CONTRACT) & (F.sha2("payload", 256) == F.col("payload_sha256")) & (identity == F.col("macroview_id"))
        & (C.member(document, "macroview_id") == F.col("macroview_id")) & (C.member(document, "canonical_event_id") == F.col("canonical_event_id")) & (snapshot == F.col("snapshot_sha256"))
    )
    return F.when(~F.coalesce(sound, F.lit(False)), "FREEZE_INTEGRITY_FAILED")


def listed(stored: DataFrame) -> DataFrame:
    """``stored`` with ``fault``, ``place`` of each row among its event's (by creation, then id), and what the payload of a whole row says: fact_state, expectation_state, unknowns.

    A damaged row stays, so that a list shows it, but nothing of its payload is passed on.
    """
    place = Window.partitionBy("canonical_event_id").orderBy("created_us", "macroview_id")
    judged = stored.withColumn("fault", fault()).withColumn("place", F.row_number().over(place))
    of = lambda name, kind="string": F.when(F.col("fault").isNull(), C.member(C.parsed("payload"), name, kind)).alias(name)
    return judged.select("*", of("fact_state"), of("expectation_state"), of("unknowns", "array<string>"))
