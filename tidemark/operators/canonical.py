"""News deduplication, canonical events and their summaries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.lexicons import RATE_DECISION
from ..functions.scalars import event_id
from ..lineage import cut
from .components import components

SIX_HOURS = 21_600_000_000


def micros(at: Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP or TIMESTAMP_NTZ."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), at)


def _round(rows: DataFrame, url: str, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(kept, undecided): the first undecided row of its url and of its key stays, what shares one with it goes."""
    by_url = rows.filter(F.col(url).isNotNull()).groupBy(url).agg(F.min(order).alias("_u"))
    by_key = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_k"))
    firsts = rows.join(by_url, url, "left").join(by_key, key, "left")
    stay = firsts.filter(F.coalesce(F.col("_u") == F.col(order), F.lit(True)) & F.coalesce(F.col("_k") == F.col(order), F.lit(True)))
    stay = cut(stay.select(*rows.columns))
    rest = rows.join(stay.select(order), order, "left_anti")
    rest = rest.join(stay.filter(F.col(url).isNotNull()).select(url).distinct(), url, "left_anti")
    return stay, cut(rest.join(stay.filter(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti").select(*rows.columns))


def _grouped(rows: DataFrame, url: str, key: str, order: str) -> DataFrame:
    """``rows`` with ``_group``: rows linked by any chain of shared urls and keys carry the same one, the first row's order."""
    to_first = lambda name: rows.filter(F.col(name).isNotNull()).groupBy(name).agg(F.min(order).alias("b"))
    ends = [rows.filter(F.col(name).isNotNull()).join(to_first(name), name).select(F.col(order).alias("a"), "b") for name in (url, key)]
    found = components(ends[0].unionByName(ends[1]))
    return cut(rows.join(found.withColumnRenamed("node", order).withColumnRenamed("component", "_group"), order))


def _scanned(rows: DataFrame, url: str, key: str, order: str) -> DataFrame:
    """The rows that the ordered scan keeps, one group after the other; only one group's keys are held at a time."""
    columns = [c for c in rows.columns if c != "_group"]
    sorted_rows = rows.select("_group", order, url, key).repartition("_group").sortWithinPartitions("_group", order)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, urls, keys = None, set(), set()
        for pdf in frames:
            keep = []
            for group, u, k in zip(pdf["_group"], pdf[url], pdf[key]):
                if group != current:
                    current, urls, keys = group, set(), set()
                stays = not (pd.notna(u) and u in urls) and not (pd.notna(k) and k in keys)
                if stays:
                    urls.add(u)
                    keys.add(k)
                keep.append(stays)
            yield pdf.loc[keep, [order]]

    kept = sorted_rows.mapInPandas(scan, T.StructType([rows.schema[order]]))
    return rows.select(*columns).join(kept, order, "left_semi")


def two_key_dedupe(rows: DataFrame, url: str, key: str, order: str, first_rounds: int = 2, at_once: int = 500_000) -> DataFrame:
    """Rows that no earlier kept row shares a url or key with; a skipped row registers neither, rows without either stay.

    A few rounds of minima and joins settle large groups of copies without gathering any. What is left open hangs together in chains of shared urls
    and keys: contraction finds these in logarithmically many rounds, and each of at most ``at_once`` rows is scanned in order by one task. Larger ones
    take more rounds of minima, which also break them, and are contracted again. ``order`` must be unique and of a plain type.
    """
    open_rows, kept, rounds = cut(rows), [], max(1, first_rounds)
    while True:
        for _ in range(rounds):
            stay, open_rows = _round(open_rows, url, key, order)
            kept.append(stay)
            if open_rows.isEmpty():
                return reduce(DataFrame.unionByName, kept)
        grouped = _grouped(open_rows, url, key, order)
        large = grouped.groupBy("_group").count().filter(F.col("count") > at_once).select("_group")
        kept.append(cut(_scanned(grouped.join(large, "_group", "left_anti"), url, key, order).select(*rows.columns)))
        open_rows = cut(grouped.join(large, "_group", "left_semi").select(*rows.columns))
        if open_rows.isEmpty():
            return reduce(DataFrame.unionByName, kept)
        rounds = 2 * rounds


def rate_signature(title: Column) -> Column:
    """struct(actor, action, basis_points) of a headline that states a rate decision, else null."""
    part = lambda i: F.regexp_extract(title, "(?i)" + RATE_DECISION, i)
    amount = part(3).try_cast("decimal(5,2)")
    points = F.regexp_replace(F.regexp_replace(amount.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(
        (part(1) != "") & (amount > 0) & (amount <= 100),
        F.struct(
            F.when(F.lower(part(1)).isin("ecb", "european central bank"), "ECB").otherwise("FED").alias("actor"),
            F.when(F.lower(part(2)).isin("cuts", "lowers", "reduces"), "CUT").otherwise("RAISE").alias("action"),
            points.alias("basis_points"),
        ),
    )


def sessions(rows: DataFrame, keys: list[str], at: str, span: int) -> DataFrame:
    """``rows`` with ``_session``, numbered within a key: a gap of more than ``span`` between neighbours in time begins the next.

    Times meet as first and last of buckets of the span (no bucket holds a gap), so the window runs over a key's buckets, not its rows.
    """
    bucket = F.col(at) - F.pmod(F.col(at), F.lit(span + 1))
    held = rows.groupBy(*keys, bucket.alias("_bucket")).agg(F.min(at).alias("_from"), F.max(at).alias("_to"))
    order = Window.partitionBy(*keys).orderBy("_bucket")
    begins = F.coalesce(F.col("_from") - F.lag("_to").over(order) > span, F.lit(True)).cast("long")
    numbered = held.withColumn("_begins", begins).withColumn("_session", F.sum("_begins").over(order))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys] + [F.col("l._bucket").eqNullSafe(F.col("r._bucket"))]
    joined = rows.withColumn("_bucket", bucket).alias("l").join(numbered.alias("r"), reduce(Column.__and__, same), "left")
    return joined.select(*[F.col(f"l.{c}") for c in rows.columns], F.col("r._session").alias("_session"))


def first_fit(rows: DataFrame, keys: list[str], row_id: str, at: str, span: int) -> DataFrame:
    """(row_id, group_id): rows of one key in id order join the first group that stays within ``span``, else open one.

    A gap in time of more than ``span`` divides a key into sessions that share no group, and each is folded by itself, so a hot key spreads over its
    sessions. The fold is order-dependent; it streams over sorted partitions and holds the groups of one session, each found by its place in time: a row
    looks only at groups that begin within a span of it. ``group_id`` is the group's first row id; times must not be null.
    """
    parts = [*keys, "_session"]
    ordered = sessions(rows.select(*keys, row_id, at), keys, at, span).repartition(*parts).sortWithinPartitions(*parts, row_id)
    width = span + 1

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, places, opened = None, {}, 0
        for pdf in frames:
            out = []
            for *key, ident, t in pdf[[*parts, row_id, at]].itertuples(index=False, name=None):
                key = [None if pd.isna(k) else k for k in key]
                if key != current:
                    current, places, opened = key, {}, 0
                near = [g for p in (t // width - 1, t // width, t // width + 1) for g in places.get(p, ())]
                fits = [g for g in near if max(g[1], t) - min(g[0], t) <= span]
                if fits:
                    g = min(fits, key=lambda g: g[2])
                    if t < g[0] and t // width != g[0] // width:
                        places[g[0] // width].remove(g)
                        places.setdefault(t // width, []).append(g)
                    g[0], g[1] = min(g[0], t), max(g[1], t)
                else:
                    g = [t, t, opened, ident]
                    opened += 1
                    places.setdefault(t // width, []).append(g)
                out.append((ident, g[3]))
            yield pd.DataFrame(out, columns=[row_id, "group_id"])

    kind = rows.schema[row_id].dataType
    return ordered.mapInPandas(fold, T.StructType([T.StructField(row_id, kind), T.StructField("group_id", kind)]))


def pair_evidence(rows: DataFrame, keys: list[str], row_id: str, at: str, span: int) -> DataFrame:
    """(a, b, merges) of every pair of one key, a before b; for the bounded groups of canonical events."""
    side = lambda x: rows.select(*keys, F.col(row_id).alias(x), F.col(at).alias(f"_{x}"))
    return side("a").join(side("b"), keys).filter("a < b").select("a", "b", (F.abs(F.col("_a") - F.col("_b")) <= span).alias("merges"))


def merging_pairs(rows: DataFrame, keys: list[str], row_id: str, at: str, span: int) -> DataFrame:
    """(keys, a, b) of the pairs of one key within ``span``, a before b; rows meet in buckets of the span and its neighbours only, so a group spread over time costs what it has of pairs."""
    bucket = F.floor(F.col(at) / span)
    left = rows.select(*keys, F.col(row_id).alias("a"), F.col(at).alias("_a"), bucket.alias("_bucket"))
    right = rows.select(*keys, F.col(row_id).alias("b"), F.col(at).alias("_b"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_bucket"))
    return left.join(right, [*keys, "_bucket"]).filter((F.col("a") < F.col("b")) & (F.abs(F.col("_a") - F.col("_b")) <= span)).select(*keys, "a", "b")


def pair_counts(rows: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, merging, apart): how many pairs of each key merge, and how many do not, which are only counted."""
    size = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    held = pairs.groupBy(*keys).agg(F.count("*").alias("_m"))
    merging, n = F.coalesce("_m", F.lit(0)), F.col("_n")
    return size.join(held, keys, "left").select(*keys, merging.alias("merging"), (F.expr("_n * (_n - 1) div 2") - merging).alias("apart"))


def shortest(title: str) -> Column:
    """The shortest title, ties by folded and then plain text."""
    return F.min_by(title, F.struct(F.length(title), F.lower(title), F.col(title)))


def canonical_events(items: DataFrame) -> DataFrame:
    """Events of ``items`` (article_reference, title, source_name, reported_at, reported_time_kind, observed_at; times as TIMESTAMP).

    Copies of a reference must agree in title, reported time, its kind and source, or all are left out. Rate decisions of one actor, action, size
    and day within six hours join first-fit in reference order; any other article is an event of its own. Items without reference or title
    are left out. See ``unassigned`` for their number.
    """
    usable = items.filter("article_reference is not null and title is not null and title <> ''")
    sign = F.struct("title", "reported_at", "reported_time_kind", "source_name")
    chronology = F.coalesce(F.when(F.col("reported_time_kind") == "REPORTED_TIME", F.col("reported_at")), F.col("observed_at"))
    refs = usable.groupBy("article_reference").agg(
        F.min(sign).alias("one"), F.max(sign).alias("two"), F.min("observed_at").alias("observed_at"), F.max(chronology).alias("latest_at")
    )
    refs = refs.filter(F.col("one").eqNullSafe(F.col("two"))).select("article_reference", "one.*", "observed_at", "latest_at")
    refs = refs.withColumn("sig", rate_signature(F.col("title")))
    timed = F.col("sig").isNotNull() & (F.col("reported_time_kind") == "REPORTED_TIME") & F.col("reported_at").isNotNull()
    merging = refs.filter(timed).select("article_reference", "sig.*", F.to_date("reported_at").alias("day"), F.unix_micros("reported_at").alias("us"))
    placed = first_fit(merging, ["actor", "action", "basis_points", "day"], "article_reference", "us", SIX_HOURS)
    members = refs.join(placed, "article_reference", "left").withColumn("group_id", F.coalesce("group_id", "article_reference"))
    grouped = members.groupBy("group_id").agg(
        F.array_sort(F.collect_set("article_reference")).alias("article_references"),
        shortest("title").alias("event_title"),
        F.count("*").alias("article_count"),
        F.array_sort(F.collect_set("source_name")).alias("source_names"),
        F.min("observed_at").alias("first_detected_at"),
        F.max("latest_at").alias("latest_article_at"),
    )
    return grouped.select(event_id(F.col("article_references")).alias("event_id"), *[c for c in grouped.columns if c != "group_id"])


def unassigned(items: DataFrame) -> DataFrame:
    """One row: how many items no event holds, and the projection status (PARTIAL when there are any)."""
    bad = F.col("article_reference").isNull() | F.col("title").isNull() | (F.col("title") == "")
    sign = F.struct("title", "reported_at", "reported_time_kind", "source_name")
    per_ref = items.withColumn("_bad", bad).groupBy(F.when(~bad, F.col("article_reference")).alias("ref")).agg(
        F.count("*").alias("n"), F.min(sign).eqNullSafe(F.max(sign)).alias("same")
    )
    total = per_ref.agg(F.coalesce(F.sum(F.when(F.col("ref").isNull() | ~F.col("same"), F.col("n"))), F.lit(0)).alias("unassigned"))
    return total.select("unassigned", F.when(F.col("unassigned") > 0, "PARTIAL").otherwise("AVAILABLE").alias("status"))


def timeline(entries: DataFrame, thread: str, at: str, kind: str, ident: str) -> DataFrame:
    """``entries`` with ``position`` in their thread: by time (nulls last), kind, id."""
    order = Window.partitionBy(thread).orderBy(F.asc_nulls_last(at), kind, ident)
    return entries.withColumn("position", F.row_number().over(order).cast("long"))


def timeline_counts(entries: DataFrame, thread: str, kind: str) -> DataFrame:
    """(thread, news_count, official_count)."""
    return entries.groupBy(thread).agg(F.count_if(F.col(kind) == "NEWS").alias("news_count"), F.count_if(F.col(kind) == "OFFICIAL").alias("official_count"))
