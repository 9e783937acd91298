"""Line deduplication by winnowing over line hashes (DataFrame operations only).

A document is a sequence of lines with words. For every line, the shortest run of lines from it on that has ``min_words`` words
is a window, and so is the shortest such run that ends with it: whatever run of ``min_words`` words or more repeats, its windows repeat, and they cover
it to both ends. Each window selects its least line hash as fingerprint, so equal windows select equal fingerprints at equal places.

1. Fingerprint positions join by fingerprint, its place in the window and the window's content; the first in (id, line) order
   stays, later ones are matches. A line that stands in very many documents does not gather them, as its surroundings differ.
2. A match reaches from its fingerprint to both ends of its window, and windows of the next lines carry it on: matches of a document that touch
   or overlap become one run, which is deleted.

Nothing is paired within a group: each window meets only the first of its content, found by a pre-aggregated minimum.
Runs and texts meet by a shuffle of the documents that may have runs, as told by a hashed bitmap of bounded size; all other texts stay where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ._cut import cut

WORD = r"[^\x20\x09-\x0D]+"
LAST = (1 << 63) - 1
MOST_BITS = 26  # of the bitmap: a million rows of 64 bits


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    number = F.col(id_col).cast("long")
    return docs.select(
        F.coalesce(number, F.lit(LAST)).alias("id"), F.xxhash64(number.isNull(), text).alias("version"), number.alias("named"), text.alias("text")
    )


def _may_have(keyed: DataFrame, runs: DataFrame) -> DataFrame:
    """``keyed`` with a boolean ``asked``: false only where ``runs`` has no such (id, version)."""
    width = min(MOST_BITS, max(10, (8 * runs.count()).bit_length()))
    place = F.pmod(F.xxhash64("id", "version"), F.lit(1 << width))
    words = runs.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, cast(pmod(xxhash64(id, version), 64) as int))").alias("bit"))
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bits"))  # 2 ** (MOST_BITS - 6) rows at most
    placed = keyed.withColumn("word", F.shiftright(place, 6))
    hit = F.expr("shiftright(coalesce(bits, 0L), cast(pmod(xxhash64(id, version), 64) as int)) & 1L = 1L")
    return placed.join(F.broadcast(words), "word", "left").withColumn("asked", hit).drop("word", "bits")


def repeated_runs(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, version, runs): of each document with later repeats, the sorted disjoint line ranges [first, last] to delete.

    Lines are numbered from 0. ``version`` is a hash of the text: rows of one id with different texts are different
    documents, equal rows are the same one. Null ids come last in the order.
    """
    keyed = _keyed(docs, id_col, text_col)
    words = F.regexp_count("line", F.lit(WORD))
    lines = (
        keyed.select("id", "version", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select("id", "version", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), words.alias("words"))
        .filter("words > 0")
        .repartition("id", "version")
        .dropDuplicates(["id", "version", "pos"])
    )
    per_doc = Window.partitionBy("id", "version")
    lines = lines.withColumn("stop", F.sum("words").over(per_doc.orderBy("pos")))
    lines = lines.withColumn("start", F.col("stop") - F.col("words"))
    onward = per_doc.orderBy("start").rangeBetween(0, min_words - 1)
    back = per_doc.orderBy("stop").rangeBetween(1 - min_words, 0)

    def window(frame, backward: bool):
        return F.struct(
            F.lit(backward).alias("backward"), F.min("pos").over(frame).alias("first"), F.max("pos").over(frame).alias("last"),
            F.min(F.struct("h", (-F.col("pos")).alias("at"))).over(frame).alias("mark"), F.sum("words").over(frame).alias("total"),
            F.xxhash64(F.collect_list("h").over(frame)).alias("x"), F.xxhash64(F.collect_list("g").over(frame)).alias("y"),
        )

    windows = lines.select("id", "version", window(onward, False).alias("on"), window(back, True).alias("back"))
    windows = windows.select("id", "version", F.explode(F.array("on", "back")).alias("w"))
    windows = windows.select("id", "version", "w.*").filter(F.col("total") >= min_words).drop("total")
    windows = windows.withColumn("fingerprint", F.col("mark.h")).withColumn("at", -F.col("mark.at") - F.col("first")).drop("mark")
    windows = cut(windows, "line-windows")
    content = ["fingerprint", "at", "backward", "x", "y"]
    place = F.struct("id", "version", "first")
    first = windows.groupBy(*content).agg(F.min(place).alias("origin"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = windows.join(first.hint("merge"), content).filter(place != F.col("origin")).select("id", "version", "first", "last")
    order = per_doc.orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = later.withColumn("fresh", F.when(F.col("first") <= reach + 1, 0).otherwise(1)).withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("id", "version", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.groupBy("id", "version").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))


def dedup_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_lines, removed_lines, removed_runs, clean_text.

    Null text is the empty text (one empty line); texts below ``min_words`` words and empty tables lose nothing; a
    repeated row gets the same text as its first copy; blank lines go with the run around them.
    """
    keyed = _keyed(docs, id_col, text_col)
    runs = cut(repeated_runs(docs, min_words, id_col, text_col), "line-runs")
    asked = _may_have(keyed, runs)
    met = asked.filter("asked").select("id", "version", "named", "text").join(runs.hint("merge"), ["id", "version"], "left")
    rest = asked.filter("not asked").select("named", "text", F.lit(None).cast(runs.schema["runs"].dataType).alias("runs"))
    full = met.select("named", "text", "runs").unionByName(rest)
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda _, i: ~F.exists("runs", lambda r: (i >= r["first"]) & (i <= r["last"])))
    gone = F.coalesce(F.aggregate("runs", F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1), F.lit(0))
    return full.select(
        F.col("named").alias(id_col),
        F.size(lines).cast("long").alias("n_lines"),
        gone.cast("long").alias("removed_lines"),
        F.coalesce(F.size("runs"), F.lit(0)).cast("long").alias("removed_runs"),
        F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("clean_text"),
    )
