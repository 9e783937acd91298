"""Mixing sources to target weights by weighted fair queueing.

Each source queues its shuffled documents ``passes`` times over. A queued document's virtual finish time is the words
of its source up to and with it, divided by the source's target; the queue of all sources is range-sorted by finish time and cut
where the words reach the total budget. Every source then stands within one document of its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ._cut import cut
from ._names import unused
from ._prefix import running_total

WORD = r"[^\x20\x09-\x0D]+"
SEED = 20_240_501


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=(5, 2, 1), share_pct: int = 150, passes: int = 2) -> DataFrame:
    """(source_key, source_size, rank, target double): water-filled targets of the sources in ``sizes``.

    Sources by ``source_key`` take the weights in turn and share ``share_pct`` percent of all words; a target stops at
    ``passes`` times its source and the excess is shared out again by weight until no target is above.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = cut(running_total(sizes, [F.col("source_key")], None, "rank").withColumn("weight", w), "sources")
    cap = F.col("source_size") * passes
    level, full = 0.0, -1
    budget = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share_pct / 100
    while True:
        above = cap <= F.lit(level) * F.col("weight")
        row = ranked.agg(
            F.sum(F.when(above, cap)).alias("capped"), F.sum(F.when(~above, F.col("weight"))).alias("open"), F.count_if(above).alias("n")
        ).first()
        if row["open"] is None or row["n"] == full:
            break
        full = row["n"]
        level = (budget - (row["capped"] or 0)) / row["open"]
    filled = F.when(cap <= F.lit(level) * F.col("weight"), cap.cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return ranked.select("source_key", "source_size", "rank", filled.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=(5, 2, 1), share_pct: int = 150, passes: int = 2) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken (``size`` times the passes that the mix takes).

    Null text has size 0; a null source is a source of its own, after all others; sources without words have target 0;
    repeated rows queue one after another; an empty table gives no rows. The shuffle is a fixed hash of the id and
    the text, so reruns agree.
    """
    source = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col)))
    queue = docs.select(
        F.col(id_col).alias("id"), source.alias("source_key"), word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(SEED), id_col, text_col).alias("shuffled"),
    )
    queue = cut(queue, "mix-queue")
    sizes = queue.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    wanted = cut(targets(sizes, weights, share_pct, passes), "mix-targets")
    order = [F.col(c) for c in ("source_key", "shuffled", "id", "size")]
    before = running_total(queue, order, "size", "before", "source_key")
    before = cut(before.join(wanted, "source_key"), "mix-before")
    turns = before.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    finish = (F.col("before") + F.col("size") + F.col("turn") * F.col("source_size")) / F.col("target")
    turns = turns.filter("size > 0 and target > 0").select(finish.alias("finish"), "rank", "turn", "size")
    line = running_total(turns, [F.col("finish"), F.col("rank"), F.col("turn")], "size", "sent")
    budget = (wanted.agg(F.sum("source_size")).first()[0] or 0) * min(share_pct, 100 * passes) / 100  # the sum of all targets, exactly
    last = line.filter(F.col("sent") + F.col("size") / 2 <= budget).agg(F.max(F.struct("finish", "rank", "turn")).alias("k")).first()["k"]
    taken = F.lit(0).cast("long")
    if last is not None:
        for turn in range(passes):
            at = (F.col("before") + F.col("size") + F.lit(turn) * F.col("source_size")) / F.col("target")
            within = F.struct(at.alias("finish"), F.col("rank"), F.lit(turn).alias("turn")) <= F.struct(
                F.lit(last["finish"]).alias("finish"), F.lit(last["rank"]).cast("long").alias("rank"), F.lit(last["turn"]).alias("turn")
            )
            taken = taken + F.when(within & (F.col("size") > 0) & (F.col("target") > 0), F.col("size")).otherwise(0)
    return before.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, in no order; a row that repeats counts as often as it stands there.

    All other cases are as in ``mix``; every column passes through, whatever its name. Rows of one id with equal texts
    are copies of one row: as many of them as the mix takes come out, alike.
    """
    names, text = docs.columns, options.get("text_col", "text")
    key, turn, passes, copies = unused(names, "mix_key", "mix_turn", "mix_passes", "mix_copies")
    rows = docs.withColumn(key, F.struct(F.col(id_col), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("version")))
    often = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    wanted = mix(rows.withColumn(id_col, F.col(key)), id_col=id_col, **options)
    wanted = wanted.groupBy(F.col(id_col).alias(key)).agg(F.sum(often).alias(passes), F.count("*").alias(copies)).filter(F.col(passes) > 0)
    wanted = cut(wanted, "mix-passes")
    repeated = wanted.filter(F.col(copies) > 1)
    once = rows.join(wanted.filter(F.col(copies) == 1), key)
    if not repeated.isEmpty():
        once = once.unionByName(rows.join(repeated, key).dropDuplicates([key]))
    return once.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(passes)))).select(*names)
