"""As-of, offset-window and nearest joins over two clocks.

An observation counts at an instant when it was both made and known by then; the newest made wins, ties by known time
and id. The join is a running maximum over (key, day) partitions: each day begins with what the days before left, which is a
window over one pre-aggregated row a key and day. So a hot key spreads over its days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def asof_join(anchors: DataFrame, quotes: DataFrame, key: str, at: str, made: str, known: str, quote_id: str, value: str) -> DataFrame:
    """``anchors`` with struct ``quote`` (made, known, id, value) in force at column ``at``; null where none is."""
    best = F.struct(F.col(made).alias("made"), F.col(known).alias("known"), F.col(quote_id).alias("id"), F.col(value).alias("value"))
    side = quotes.filter(F.col(made).isNotNull() & F.col(known).isNotNull()).select(F.col(key), F.greatest(made, known).alias("_t"), best.alias("_q"))
    side = side.withColumn("_day", F.to_date("_t"))
    ends = side.groupBy(key, "_day").agg(F.max("_q").alias("_end"))
    wanted = anchors.withColumn("_t", F.col(at)).withColumn("_day", F.to_date("_t"))
    marks = wanted.select(key, "_day").distinct().unionByName(ends.select(key, "_day")).distinct().join(ends, [key, "_day"], "left")
    before = Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select(key, "_day", F.max("_end").over(before).alias("_carry"))
    both = side.select(key, "_t", "_day", F.lit(0).alias("_side"), "_q", F.lit(None).cast(wanted.select(F.struct(*anchors.columns)).schema[0].dataType).alias("_row"))
    both = both.unionByName(wanted.select(key, "_t", "_day", F.lit(1).alias("_side"), F.lit(None).cast(side.schema["_q"].dataType).alias("_q"), F.struct(*anchors.columns).alias("_row")))
    so_far = Window.partitionBy(key, "_day").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    joined = both.withColumn("_seen", F.max("_q").over(so_far)).filter("_side = 1").join(carried, [key, "_day"], "left")
    return joined.select("_row.*", _later("_seen", "_carry").alias("quote"))


def _later(a: str, b: str) -> Column:
    """The greater of two nullable structs."""
    return F.when(F.col(b).isNull() | (F.col(a) > F.col(b)), F.col(a)).otherwise(F.col(b))


def offset_windows(anchors: DataFrame, at: str, offsets: list[int]) -> DataFrame:
    """One row per anchor and offset (seconds): ``offset`` and ``target`` = at + offset."""
    rows = anchors.withColumn("offset", F.explode(F.array(*[F.lit(o) for o in offsets])))
    return rows.withColumn("target", F.col(at) + F.make_dt_interval(secs=F.col("offset").cast("decimal(18,6)")))


def stale(target: Column, made: Column, limit: int) -> Column:
    """Whether an observation is older than ``limit`` seconds at the target (exactly that old is fresh)."""
    return target - made > F.make_dt_interval(secs=F.lit(limit).cast("decimal(18,6)"))


def nearest(anchors: DataFrame, observations: DataFrame, key: str, anchor_date: str, date: str, value: str) -> DataFrame:
    """``anchors`` with the last observation strictly before and the first strictly after ``anchor_date``; of one date's values the greatest before, the least after.

    A key's observations stand in months. Each month knows the nearest of the months before and after it (a window over one row a key and month), so a key that holds
    a third of all rows spreads over its months, and an anchor meets only its own.
    """
    month = lambda d: F.trunc(d, "MONTH")
    days = observations.filter(F.col(date).isNotNull()).groupBy(F.col(key).alias("_k"), F.col(date).alias("_d")).agg(F.max(value).alias("_hi"), F.min(value).alias("_lo"))
    days = days.withColumn("_m", month("_d")).withColumn("_pre", F.struct("_d", F.col("_hi").alias("_v"))).withColumn("_post", F.struct("_d", F.col("_lo").alias("_v")))
    wanted = anchors.withColumn("_k", F.col(key)).withColumn("_d", F.col(anchor_date)).withColumn("_m", month("_d"))
    ends = days.groupBy("_k", "_m").agg(F.max("_pre").alias("_last"), F.min("_post").alias("_first"))
    marks = wanted.select("_k", "_m").distinct().unionByName(ends.select("_k", "_m")).distinct().join(ends, ["_k", "_m"], "left")
    months = Window.partitionBy("_k").orderBy("_m")
    carried = marks.select(
        "_k", "_m", F.max("_last").over(months.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.min("_first").over(months.rowsBetween(1, Window.unboundedFollowing)).alias("_after")
    )
    row = F.struct(*anchors.columns)
    none = lambda frame, c: F.lit(None).cast(frame.schema[c].dataType).alias(c)
    shaped = wanted.select("_k", "_d", "_m", row.alias("_row"))
    both = days.select("_k", "_d", "_m", F.lit(1).alias("_side"), "_pre", "_post", none(shaped, "_row")).unionByName(
        shaped.select("_k", "_d", "_m", F.lit(0).alias("_side"), none(days, "_pre"), none(days, "_post"), "_row")
    )
    up = Window.partitionBy("_k", "_m").orderBy("_d", "_side").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("_k", "_m").orderBy(F.desc("_d"), "_side").rowsBetween(Window.unboundedPreceding, -1)
    met = both.withColumn("_p", F.max("_pre").over(up)).withColumn("_n", F.min("_post").over(down)).filter("_side = 0").join(carried, ["_k", "_m"], "left")
    met = met.select("_row.*", F.coalesce("_p", "_before").alias("_p"), F.coalesce("_n", "_after").alias("_n"))
    return met.select(*anchors.columns, F.col("_p._d").alias("pre_date"), F.col("_p._v").alias("pre_value"), F.col("_n._d").alias("post_date"), F.col("_n._v").alias("post_value"))


def missing_dates(observations: DataFrame, key: str, date: str) -> DataFrame:
    """Dates strictly between a key's first and last observation that have none."""
    span = observations.groupBy(key).agg(F.min(date).alias("lo"), F.max(date).alias("hi"), F.collect_set(date).alias("seen"))
    inner = F.when(F.datediff("hi", "lo") > 1, F.sequence(F.date_add("lo", 1), F.date_sub("hi", 1))).otherwise(F.array().cast("array<date>"))
    return span.select(key, F.explode(F.array_except(inner, "seen")).alias("missing_date"))
