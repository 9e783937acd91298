"""Versions of entities in an append-only history: latest, first, changes, replay as of an instant.

"Latest" is always a ``max_by`` aggregate over (clock, id): it combines on the map side, so an entity that holds a third
of the history costs one partial row a task. Windows are used only where every row needs its neighbour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest(history: DataFrame, keys: list[str], order: list[str], as_of: Column | None = None) -> DataFrame:
    """The last row of each key in ``order`` among those at or before ``as_of`` (on the first order column)."""
    seen = history if as_of is None else history.filter(F.col(order[0]) <= as_of)
    rest = [c for c in history.columns if c not in keys]
    return seen.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def first_and_last(history: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """First and last value of each key, and how many versions there are."""
    at = F.struct(*order)
    return history.groupBy(*keys).agg(
        F.min_by(value, at).alias("first_value"), F.max_by(value, at).alias("last_value"), F.count("*").alias("versions"),
        F.min(order[0]).alias("first_at"), F.max(order[0]).alias("last_at"),
    )


def changes(history: DataFrame, keys: list[str], order: list[str], content: str) -> DataFrame:
    """Rows whose content differs from the row before of the same key; A, B, A are three versions."""
    before = F.lag(F.struct(content)).over(Window.partitionBy(*keys).orderBy(*order))
    return history.withColumn("_before", before).filter(F.col("_before").isNull() | ~F.col(f"_before.{content}").eqNullSafe(F.col(content))).drop("_before")


def related_history(history: DataFrame, entity: str, binding: str, bound_to: Column, as_of: Column, clock: str) -> DataFrame:
    """All versions up to ``as_of`` of every entity that was ever bound to ``bound_to`` by then."""
    seen = history.filter(F.col(clock) <= as_of)
    related = seen.filter(F.col(binding) == bound_to).select(entity).distinct()
    return seen.join(related, entity, "left_semi")


def visible(history: DataFrame, keys: list[str], order: list[str], as_of: Column, binding: str, bound_to: Column) -> DataFrame:
    """Latest rows as of an instant whose latest binding is the one asked for."""
    return latest(history, keys, order, as_of).filter(F.col(binding) == bound_to)


def active_flags(history: DataFrame, keys: list[str], order: list[str], as_of: Column) -> DataFrame:
    """Every row up to ``as_of`` with whether it is the version in force then."""
    current = latest(history, keys, order, as_of).select(*keys, *[F.col(c).alias(f"_{c}") for c in order])
    seen = history.filter(F.col(order[0]) <= as_of).join(current, keys)
    same = F.struct(*order) == F.struct(*[F.col(f"_{c}") for c in order])
    return seen.withColumn("active_at_as_of", same).drop(*[f"_{c}" for c in order])


def classify_append(existing: DataFrame, incoming: DataFrame, keys: list[str], clock: str, row_id: str, content: str) -> DataFrame:
    """``incoming`` with ``verdict``, each row against the row before it in (clock, id) order and the stored latest.

    SKIP_DUPLICATE_ID: the id is stored; BACKDATED: before the stored latest; CONFLICT: same instant as the row before, other
    content; SKIP_UNCHANGED: the content of the row before; else APPEND.
    """
    stored = existing.groupBy(*keys).agg(F.max(clock).alias("_latest"), F.max_by(content, F.struct(clock, row_id)).alias("_content"))
    known = existing.select(F.col(row_id).alias("_id")).distinct()
    rows = incoming.join(stored, keys, "left").join(known, F.col(row_id) == F.col("_id"), "left")
    order = Window.partitionBy(*keys).orderBy(clock, row_id)
    at = F.coalesce(F.lag(clock).over(order), F.col("_latest"))
    what = F.when(F.lag(clock).over(order).isNotNull(), F.lag(content).over(order)).otherwise(F.col("_content"))
    verdict = (
        F.when(F.col("_id").isNotNull(), "SKIP_DUPLICATE_ID")
        .when(F.col(clock) < F.col("_latest"), "BACKDATED")
        .when((F.col(clock) == at) & ~what.eqNullSafe(F.col(content)), "CONFLICT")
        .when(at.isNotNull() & what.eqNullSafe(F.col(content)), "SKIP_UNCHANGED")
        .otherwise("APPEND")
    )
    return rows.withColumn("verdict", verdict).drop("_latest", "_content", "_id")
