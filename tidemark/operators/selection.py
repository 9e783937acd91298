"""Keyed merges, conflict handling, rankings and round robins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows with references for one task.
TASK_ROWS = 100_000


def first_wins(rows: DataFrame, key: str, arrival: list[str]) -> DataFrame:
    """The first row of each key by arrival."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*arrival)).alias("_row")).select(key, "_row.*")


def last_wins(rows: DataFrame, key: str, arrival: list[str]) -> DataFrame:
    """The last row of each key by arrival."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*arrival)).alias("_row")).select(key, "_row.*")


def retain(rows: DataFrame, group: str, pinned: Column, order: list[Column], most: int) -> DataFrame:
    """Pinned rows, and of the others the first of each group by ``order`` up to ``most`` less its pinned rows."""
    held = rows.filter(pinned).groupBy(group).agg(F.count("*").alias("_held"))
    ranked = rows.filter(~pinned | pinned.isNull()).withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    ranked = ranked.filter(F.col("_rank") <= most).join(held, group, "left").filter(F.col("_rank") <= most - F.coalesce("_held", F.lit(0)))
    return rows.filter(pinned).unionByName(ranked.select(*rows.columns))


def consistent_copies(rows: DataFrame, key: str, signature: list[str], clock: str) -> DataFrame:
    """One row per key: copies, whether their signature is single-valued, earliest clock. Nulls in a signature count as values."""
    sign = F.struct(*signature)
    return rows.groupBy(key).agg(
        F.count("*").alias("copies"), (F.min(sign).eqNullSafe(F.max(sign))).alias("consistent"), F.min(clock).alias("first_at")
    )


def unambiguous(rows: DataFrame, key: str) -> DataFrame:
    """Rows of keys that occur exactly once; for joins where a second match must attach nothing."""
    rest = [c for c in rows.columns if c != key]
    one = rows.groupBy(key).agg(F.count("*").alias("_n"), F.any_value(F.struct(*rest)).alias("_row"))
    return one.filter("_n = 1").select(key, "_row.*")


def round_robin(rows: DataFrame, phase: str, lane: str, lane_order: list[str], order: list[Column], most: int) -> DataFrame:
    """By phase, one row of each lane in turn until ``most`` are chosen; ``position`` counts them from 1."""
    places = F.array_position(F.array(*[F.lit(x) for x in lane_order]), F.col(lane))
    turn = F.row_number().over(Window.partitionBy(phase, lane).orderBy(*order))
    ranked = rows.filter(places > 0).withColumn("_turn", turn).withColumn("_lane", places).filter(F.col("_turn") <= most)
    chosen = ranked.orderBy(phase, "_turn", "_lane").limit(most)
    return chosen.withColumn("position", F.row_number().over(Window.orderBy(phase, "_turn", "_lane")).cast("long")).drop("_turn", "_lane")


def one_per_group(rows: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """The first row of each group, and of those the first ``most``, by ``order``."""
    top = rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter("_n = 1")
    return top.orderBy(*order).limit(most).drop("_n")


def resolve(rows: DataFrame, row_id: str, columns: list[str], references: DataFrame, reference: str, target: str) -> DataFrame:
    """(row_id, target, status): every supplied reference column must resolve to exactly one target, and all agree.

    The first failing column gives the status: REFERENCE_NOT_FOUND or AMBIGUOUS_REFERENCE; none supplied:
    NO_EXPLICIT_REFERENCE; disagreement: CONFLICTING_REFERENCES; else EXPLICIT_UNIQUE_LINK.
    """
    pieces = F.array(*[F.struct(F.lit(i).alias("place"), F.trim(F.col(c).cast("string")).alias("ref")) for i, c in enumerate(columns)])
    asked = rows.select(row_id, F.explode(F.filter(pieces, lambda p: p["ref"].isNotNull() & (p["ref"] != ""))).alias("p")).select(row_id, "p.*")
    least, most = F.min(target).alias("one"), F.max(target).alias("other")
    found = references.groupBy(F.col(reference).alias("ref")).agg(least, most, F.lit(True).alias("known"))
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))  # so a task's share does not grow with the input
    met = asked.repartition(tasks, "ref").join(found.repartition(tasks, "ref"), "ref", "left").repartition(tasks, row_id)
    failed = F.when(F.col("known").isNull(), "REFERENCE_NOT_FOUND").when(F.col("one") < F.col("other"), "AMBIGUOUS_REFERENCE")
    per_row = met.groupBy(row_id).agg(
        F.min(F.when(failed.isNotNull(), F.struct("place", failed.alias("why")))).alias("bad"), F.min("one").alias("lo"), F.max("one").alias("hi")
    )
    status = F.when(F.col("bad").isNotNull(), F.col("bad.why")).when(F.col("lo") != F.col("hi"), "CONFLICTING_REFERENCES").otherwise("EXPLICIT_UNIQUE_LINK")
    out = rows.select(row_id).repartition(tasks, row_id).join(per_row, row_id, "left")
    linked = F.col("bad").isNull() & (F.col("lo") == F.col("hi"))
    return out.select(
        row_id, F.when(linked, F.col("lo")).alias(target), F.when(F.col("lo").isNull() & F.col("bad").isNull(), "NO_EXPLICIT_REFERENCE").otherwise(status).alias("status")
    )


def evidence_status(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Copies of one identity collapse; differing copies are AMBIGUOUS_EVIDENCE with their fields nulled."""
    value = F.struct(*fields)
    grouped = rows.groupBy(key).agg(F.count("*").alias("copies"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    same = F.col("lo").eqNullSafe(F.col("hi"))
    return grouped.select(
        key, "copies", F.when(same, "CONFIRMED").otherwise("AMBIGUOUS_EVIDENCE").alias("evidence_status"),
        *[F.when(same, F.col(f"lo.{f}")).alias(f) for f in fields],
    )


def curated_override(events: DataFrame, auto: DataFrame, curated: DataFrame, event: str, market: str) -> DataFrame:
    """Links of each event: the curated ones where it has any, else the automatic ones; one invalid entry voids the curated list.

    ``curated`` has (event, market, valid boolean).
    """
    bad = curated.filter(~F.col("valid") | F.col("valid").isNull()).limit(1)
    usable = curated.join(bad.select(F.lit(1).alias("_bad")), F.lit(True), "left_anti")
    mapped = usable.select(event, market).distinct().withColumn("link_source", F.lit("CURATED"))
    fallback = auto.select(event, market).distinct().join(mapped.select(event).distinct(), event, "left_anti").withColumn("link_source", F.lit("AUTOMATIC"))
    return mapped.unionByName(fallback).join(events.select(event).distinct(), event, "left_semi")


def ambiguous_links(links: DataFrame, event: str, market: str) -> DataFrame:
    """``links`` with link_status AMBIGUOUS where the market is linked to more than one event."""
    several = links.groupBy(market).agg(F.count_distinct(event).alias("_events"))
    out = links.join(several, market)
    return out.withColumn("link_status", F.when(F.col("_events") > 1, "AMBIGUOUS").otherwise("LINKED")).drop("_events")


def first_members(rows: DataFrame, group: str, member: str, most: int) -> DataFrame:
    """(group, members, first): the number of members of each group and the least ``most`` of them; a group is never gathered whole."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(member))).filter(F.col("_n") <= most)
    shown = ranked.groupBy(group).agg(F.array_sort(F.collect_list(member)).alias("first"))
    return rows.groupBy(group).agg(F.count(member).alias("members")).join(shown, group)
