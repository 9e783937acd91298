"""Prediction-market records and price observations: parsing, validation, snapshots, watch list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import category, instant, price, relevance_reason
from . import asof, selection

#: Window name and seconds after the event.
WINDOWS = [("T0", 0), ("PLUS_5M", 300), ("PLUS_30M", 1800), ("PLUS_1H", 3600)]
STALE_AFTER = 900
CATEGORIES = ["MONETARY_POLICY", "ECONOMY_TRADE", "ENERGY", "GEOPOLITICS"]


def decoded(value: Column) -> Column:
    """An array of strings from JSON text of a list; null for anything else, and for more than 32 entries."""
    out = F.from_json(value.cast("string"), "array<string>")
    return F.when((F.size(out) <= 32) & value.cast("string").rlike(r"^\s*\["), out)


def parse_markets(rows: DataFrame, most: int = 20) -> DataFrame:
    """(market_id, question, outcomes, prices, closed, active, archived, market_close_time) of provider rows with id, question, outcomes, outcomePrices, endDate, closed, active, archived.

    Blank ids go; labels and prices must align or both are null; prices keep the provider's text and must be 0 to 1; ids with differing copies go
    altogether; the first ``most`` by id stay.
    """
    labels, prices = decoded(F.col("outcomes")), decoded(F.col("outcomePrices"))
    fine = (F.size(labels) == F.size(prices)) & F.forall(prices, lambda p: price(p).isNotNull())
    made = rows.select(
        F.trim(F.col("id").cast("string")).alias("market_id"), "question", F.when(fine, labels).alias("outcomes"), F.when(fine, prices).alias("prices"),
        *[F.col(c).cast("boolean").alias(c) for c in ("closed", "active", "archived")], instant(F.col("endDate")).alias("market_close_time"),
    ).filter("market_id <> ''")
    rest = [c for c in made.columns if c != "market_id"]
    value = F.struct(*rest)
    one = made.groupBy("market_id").agg(F.min(value).alias("lo"), F.max(value).alias("hi")).filter(F.col("lo").eqNullSafe(F.col("hi")))
    return one.select("market_id", "lo.*").orderBy("market_id").limit(most)


def outcome_type(labels: Column) -> Column:
    """BINARY for two labels, MULTI_OUTCOME for more, else UNKNOWN."""
    return F.when(F.size(labels) == 2, "BINARY").when(F.size(labels) > 2, "MULTI_OUTCOME").otherwise("UNKNOWN")


def category_counts(watched: DataFrame) -> DataFrame:
    """(category, markets, place) of a watch list: how many markets each category has, in the order of the categories; none of what has none."""
    place = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category")).cast("int")
    return watched.groupBy("category").agg(F.count("*").alias("markets")).withColumn("place", place)


def watch(markets: DataFrame, titles: str | None = None, most: int = 20) -> DataFrame:
    """The watch list: category, reason, outcome type and phase of the markets that a round robin over phases and categories chooses."""
    context = F.col(titles) if titles else F.array().cast("array<string>")
    kind = category(F.col("question"), F.array_join(context, " "))
    phase = F.when(F.coalesce("closed", F.lit(False)) | F.coalesce("archived", F.lit(False)), 2).when(F.col("active") & ~F.col("closed"), 0).otherwise(1)
    rows = markets.withColumn("category", kind).withColumn("phase", phase).withColumn("reason", relevance_reason(F.col("question"), context, F.col("category")))
    rows = rows.withColumn("outcome_type", outcome_type(F.col("outcomes")))
    return selection.round_robin(rows.filter("category is not null"), "phase", "category", CATEGORIES, [F.col("market_id").cast("string")], most)


def bar_problem(open_: str = "open", high: str = "high", low: str = "low", close: str = "close", volume: str = "volume") -> Column:
    """The first fault of a bar: NOT_FINITE, NOT_POSITIVE, RANGE, VOLUME; null for a good one."""
    values = [F.col(c) for c in (open_, high, low, close)]
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    all_finite = finite(values[0]) & finite(values[1]) & finite(values[2]) & finite(values[3])
    return (
        F.when(~all_finite, "NOT_FINITE").when(F.least(*values) <= 0, "NOT_POSITIVE")
        .when((F.greatest(*values) > F.col(high)) | (F.least(*values) < F.col(low)), "RANGE").when(F.col(volume) < 0, "VOLUME")
    )


def public(scope: str = "data_usage_scope", synthetic: str = "synthetic") -> Column:
    """Whether an observation may be shown: the public scope exactly, and not synthetic."""
    return F.coalesce((F.col(scope) == "PUBLIC_REDISTRIBUTABLE") & ~F.coalesce(F.col(synthetic), F.lit(True)), F.lit(False))


def snapshot(anchors: DataFrame, observations: DataFrame) -> DataFrame:
    """(event_id, symbol, window, value, status, change) of each anchor (event_id, symbol, anchor) and window.

    ``observations``: event_id, symbol, market_ts, observed_at, id, value, unit; times as TIMESTAMP_NTZ. A value older than 900 s at its target is STALE
    and null; the change is against the value in force at the anchor, which must be as fresh, in percent or, for yields, basis points.
    """
    keyed = lambda df: df.withColumn("k", F.concat_ws("|", "event_id", "symbol"))
    quotes = keyed(observations)
    rows = keyed(anchors)
    base = asof.asof_join(rows, quotes, "k", "anchor", "market_ts", "observed_at", "id", "value").withColumnRenamed("quote", "base")
    targets = asof.offset_windows(base, "anchor", [s for _, s in WINDOWS])
    out = asof.asof_join(targets, quotes, "k", "target", "market_ts", "observed_at", "id", "value")
    old = asof.stale(F.col("target"), F.col("quote.made"), STALE_AFTER)
    status = F.when(F.col("quote").isNull(), "UNAVAILABLE").when(old, "STALE").otherwise("AVAILABLE")
    value = F.when(~old, F.col("quote.value"))
    start = F.when(~asof.stale(F.col("anchor"), F.col("base.made"), STALE_AFTER), F.col("base.value"))
    change = F.when(F.col("unit") == "PERCENT_YIELD", (value - start) * 100).when(start != 0, (value / start - 1) * 100)
    name = F.coalesce(*[F.when(F.col("offset") == s, n) for n, s in WINDOWS])
    return out.select("event_id", "symbol", name.alias("window"), value.alias("value"), status.alias("status"), F.when(F.col("offset") > 0, change).alias("change"))
