"""Daily reference rates around an event date, with the provider's exact decimals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Fixed values of the accepted series.
SERIES = {
    "KEY": "EXR.D.USD.EUR.SP00.A", "FREQ": "D", "CURRENCY": "USD", "CURRENCY_DENOM": "EUR", "EXR_TYPE": "SP00", "EXR_SUFFIX": "A", "OBS_STATUS": "A",
}


def read_rates(spark: SparkSession, path: str, series: dict[str, str] | None = None, most: int = 32) -> DataFrame:
    """(day DATE, rate DECIMAL(18,6), text) of one series file; raises unless its constant columns agree and days ascend uniquely."""
    rows = spark.read.option("header", True).csv(path).withColumn("_row", F.monotonically_increasing_id())
    wanted = {k: v for k, v in (SERIES if series is None else series).items() if k in rows.columns}
    wrong = F.lit(False)
    for name, value in wanted.items():
        wrong = wrong | ~F.col(name).eqNullSafe(F.lit(value))
    out = rows.select("_row", F.to_date("TIME_PERIOD").alias("day"), F.col("OBS_VALUE").cast("decimal(18,6)").alias("rate"), F.col("OBS_VALUE").alias("text"), wrong.alias("wrong"))
    before = F.lag("day").over(Window.orderBy("_row"))  # at most ``most`` rows
    facts = out.limit(most + 1).withColumn("late", F.coalesce(before >= F.col("day"), F.lit(False))).agg(
        F.count("*").alias("n"), F.count_if("wrong").alias("wrong"), F.count_if(F.col("late") | F.col("rate").isNull() | (F.col("rate") <= 0)).alias("bad")
    ).first()
    if not 2 <= facts["n"] <= most or facts["wrong"] or facts["bad"]:
        raise ValueError("REFERENCE_RATES_REJECTED")
    return out.select("day", "rate", "text")


def reaction(rates: DataFrame, event_date: str) -> DataFrame:
    """One row: the last rate before and the first after the event date, change, percent (half-even, six places), span in days, missing days."""
    event = F.lit(event_date).cast("date")
    around = rates.agg(
        F.max(F.when(F.col("day") < event, F.struct("day", "rate", "text"))).alias("pre"), F.min(F.when(F.col("day") > event, F.struct("day", "rate", "text"))).alias("post"), F.collect_set("day").alias("days")
    )
    pre, post = F.col("pre.rate"), F.col("post.rate")
    scale = F.greatest(*[F.length(F.split_part(F.col(f"{s}.text"), F.lit("."), F.lit(2))) for s in ("pre", "post")])
    change = (post - pre).cast("string")
    inner = F.when(F.datediff("post.day", "pre.day") > 1, F.sequence(F.date_add("pre.day", 1), F.date_sub("post.day", 1))).otherwise(F.array().cast("array<date>"))
    return around.select(
        F.col("pre.day").alias("pre_date"), F.col("post.day").alias("post_date"), F.col("pre.text").alias("pre_value"), F.col("post.text").alias("post_value"),
        F.substring(change, F.lit(1), F.instr(change, ".") + scale).alias("change"),
        F.bround(((post - pre) / pre * 100).cast("decimal(38,12)"), 6).cast("decimal(18,6)").cast("string").alias("percent"),
        F.datediff("post.day", "pre.day").alias("span_days"), F.array_sort(F.array_except(inner, "days")).alias("missing"),
    )


def comparable_pairs(cases: DataFrame, case_id: str, attributes: list[str]) -> DataFrame:
    """(a, b, attributes) of the pairs of cases with equal attributes, each once; a null attribute compares with nothing."""
    side = lambda x: cases.select(*attributes, F.col(case_id).alias(x))
    return side("a").join(side("b"), attributes).filter("a < b").select("a", "b", *attributes)
