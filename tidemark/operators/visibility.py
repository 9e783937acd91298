"""Scopes of use carried through joins and unions: a row is as restricted as the strictest of its sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import versions

#: Fixed values, the widest first; anything else, null too, counts as UNKNOWN.
SCOPES = ["PUBLIC_REDISTRIBUTABLE", "UNKNOWN", "PRIVATE_RESEARCH_ONLY"]
SCOPE = "data_usage_scope"


def rank(scope: Column) -> Column:
    """0 to 2, the stricter the higher."""
    return F.when(scope == SCOPES[0], 0).when(scope == SCOPES[2], 2).otherwise(1)


def _named(place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SCOPES]), place + 1)


def strictest(first: Column, *others: Column) -> Column:
    """The strictest of scopes that belong to one row."""
    return _named(F.greatest(rank(first), *[rank(o) for o in others]) if others else rank(first))


def strictest_of(scope: Column) -> Column:
    """The strictest scope of a group, as an aggregate; it combines before the shuffle."""
    return _named(F.max(rank(scope)))


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """The inner or left join of two scoped frames; a matched row takes the stricter scope, an unmatched one keeps its own."""
    if how not in ("inner", "left"):
        raise ValueError("SCOPED_JOIN_IS_INNER_OR_LEFT")
    other = right.withColumn("_scope", F.coalesce(SCOPE, F.lit(SCOPES[1]))).drop(SCOPE)
    scope = F.when(F.col("_scope").isNull(), strictest(F.col(SCOPE))).otherwise(strictest(F.col(SCOPE), F.col("_scope")))
    return left.join(other, on, how).withColumn(SCOPE, scope).drop("_scope")


def with_receipts(content: DataFrame, receipts: DataFrame, key: str, entity: str, at: str, order: list[str], as_of: Column) -> DataFrame:
    """(key, entity, at, receipt_at, basis, scope): public and restricted registrations and receipts together, as known at an instant.

    ``content`` has key, entity, ``at`` and a scope, ``receipts`` the same (key names the content) and ``order``, whose first column is ``at``. A private row with a receipt of its entity is
    known by the latest such receipt only; every other row by its own registration. The latest receipt of each entity stands beside them with the content it names, in the stricter of both
    scopes. A receipt whose content is not known by then gives no row.
    """
    known = content.filter(F.col(at) <= as_of).select(key, entity, at, SCOPE)
    last = versions.latest(receipts, [entity], order, as_of).select(F.col(key), entity, F.col(at).alias("receipt_at"), SCOPE)
    private = rank(F.col(SCOPE)) == 2
    superseded = known.filter(private).join(last.select(entity), entity, "left_semi").select(key)
    own = known.join(superseded, key, "left_anti").select(key, entity, at, F.lit(None).cast(last.schema["receipt_at"].dataType).alias("receipt_at"), F.lit("REGISTRATION").alias("basis"), strictest(F.col(SCOPE)).alias(SCOPE))
    read = joined(last, known.select(key, at, SCOPE), [key]).select(key, entity, at, "receipt_at", F.lit("RECEIPT").alias("basis"), SCOPE)
    return own.unionByName(read)


def public(rows: DataFrame) -> DataFrame:
    """The rows that may be passed on."""
    return rows.filter(F.col(SCOPE) == SCOPES[0])
