"""Regions and institutions that texts mention, longest phrase first, and the context they support."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lexicons import INSTITUTIONS, REGIONS, UPPER_CASE_ALIASES

#: How specific a kind of region is, most specific first; kinds of one rank tie.
RANKS = {"SEA": 0, "COUNTRY": 1, "COUNTRY_CONTEXT": 1, "JURISDICTION": 2, "MACRO_REGION": 3, "CONTINENT": 4, "GLOBAL": 5}
#: Fixed value: with such a name in a text, the bare alias America names no country.
OTHER_AMERICA = re.compile(r"(?:South|North|Latin|Central) America", re.I)


@cache
def _phrases(registry: str) -> list[tuple[re.Pattern, dict[str, str]]]:
    """One alternation for each length of alias, longest first, and the id of each alias by its lower case."""
    named = {"REGION": [(i, a) for i, _, _, a in REGIONS], "INSTITUTION": [(i, a) for i, _, a in INSTITUTIONS]}[registry]
    lengths: dict[int, list[tuple[str, str]]] = {}
    for ident, alias in sorted((ident, alias) for ident, aliases in named for alias in aliases):
        lengths.setdefault(len(alias), []).append((alias, ident))
    out = []
    for _, some in sorted(lengths.items(), reverse=True):
        words = [re.escape(a) if a in UPPER_CASE_ALIASES else f"(?i:{re.escape(a)})" for a, _ in some]
        out.append((re.compile(rf"(?<!\w)(?:{'|'.join(words)})(?!\w)"), {a.lower(): i for a, i in reversed(some)}))
    return out


def spans(text: str, registry: str = "REGION") -> list[tuple[str, str]]:
    """(id, matched text) of the registry's phrases in ``text``: a phrase takes its place, and no shorter one may overlap it.

    Lengths are tried from the longest on; what a length has found is blanked for the shorter ones, word characters
    by word characters, so that boundaries stay where they were.
    """
    found, left = [], text
    for pattern, owner in _phrases(registry):
        hits = [m for m in pattern.finditer(left) if m[0].lower() != "america" or not OTHER_AMERICA.search(text)]
        for hit in hits:
            found.append((owner[hit[0].lower()], hit[0]))
            left = left[: hit.start()] + re.sub(r"\w", "_", re.sub(r"[^\w]", " ", hit[0])) + left[hit.end() :]
    return found


def mentions(texts: DataFrame, key: str, text: str, registry: str = "REGION") -> DataFrame:
    """(key, tier, ident, mention) of the rows of ``texts`` (key, tier, text): each id once a row, with its first mention by length."""
    schema = f"`{key}` {texts.schema[key].dataType.simpleString()}, tier string, ident string, mention string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids, words = [], [], []
            for i, value in enumerate(batch.column(2).to_pylist()):
                seen: dict[str, str] = {}
                for ident, hit in spans(value or "", registry):
                    seen.setdefault(ident, hit)
                rows += [i] * len(seen)
                ids += seen.keys()
                words += seen.values()
            at = pa.array(rows, pa.int64())
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(ids, pa.string()), pa.array(words, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "tier", "ident", "mention"])

    return texts.select(key, "tier", text).mapInArrow(run, schema)


def _of(table: dict, value: Column) -> Column:
    return F.coalesce(*[F.when(value == k, v) for k, v in table.items()])


def institutions(texts: DataFrame, key: str, text: str, sources: DataFrame | None = None, source: str = "source_name") -> DataFrame:
    """(key, institution_id, region_id, recognition): each institution once, by a mention in any text or else by a source's name."""
    found = mentions(texts, key, text, "INSTITUTION").select(key, F.col("ident").alias("institution_id"), F.lit("INSTITUTION_MENTION").alias("recognition"))
    if sources is not None:
        named = sources.select(key, F.lit("SOURCE").alias("tier"), F.col(source).alias(text))
        named = mentions(named, key, text, "INSTITUTION").select(key, F.col("ident").alias("institution_id"), F.lit("SOURCE_INSTITUTION_REFERENCE").alias("recognition"))
        found = found.unionByName(named)
    found = found.groupBy(key, "institution_id").agg(F.min("recognition").alias("recognition"))
    return found.select(key, "institution_id", _of({i: r for i, r, _ in INSTITUTIONS}, F.col("institution_id")).alias("region_id"), "recognition")


def infer(texts: DataFrame, key: str, text: str, sources: DataFrame | None = None) -> DataFrame:
    """(key, region_id, method, confidence, status, candidates): the region that most distinct texts of the best tier name.

    ``texts`` has key, ``tier`` (HEADLINE or BODY) and text; ``sources`` has key and source_name. Headlines decide before bodies, bodies before
    institutions; a lower tier never breaks a tie. Of equally supported regions that texts name, the most specific kind stays; a
    tie that is left is MULTI_REGION without a region. An institution counts once for its jurisdiction, and its kind breaks no tie.
    """
    named = mentions(texts.distinct(), key, text).groupBy(key, F.col("ident").alias("region_id"), "tier").agg(F.count("*").alias("n"))
    houses = institutions(texts, key, text, sources)
    by_house = houses.groupBy(key, "region_id").agg(F.lit("INSTITUTION").alias("tier"), F.count("*").alias("n"), F.min("recognition").alias("recognition"))
    scores = named.withColumn("recognition", F.lit(None).cast("string")).unionByName(by_house)
    tier = _of({"HEADLINE": 0, "BODY": 1, "INSTITUTION": 2}, F.col("tier"))
    kind = F.when(F.col("tier") == "INSTITUTION", 0).otherwise(_of({i: RANKS[k] for i, _, k, _ in REGIONS}, F.col("region_id")))
    scores = scores.withColumn("place", F.struct(tier.alias("t"), (-F.col("n")).alias("n"), kind.alias("k")))
    best = scores.groupBy(key).agg(F.min("place").alias("best"))
    top = scores.join(best, key).filter(F.col("place") == F.col("best")).groupBy(key)
    top = top.agg(F.array_sort(F.collect_set("region_id")).alias("winners"), F.min("tier").alias("tier"), F.min("recognition").alias("recognition"))
    out = texts.select(key).distinct()
    if sources is not None:
        out = out.unionByName(sources.select(key)).distinct()
    out = out.join(top, key, "left")
    one, none = F.size("winners") == 1, F.col("winners").isNull()
    method = F.when(none, "UNKNOWN").when(~one, "MULTI_REGION").when(F.col("tier") == "INSTITUTION", "INSTITUTION_JURISDICTION").otherwise("EXPLICIT_CONTEXT_MENTION")
    sure = F.when(none, None).when(~one, "LOW").when(F.col("tier") == "HEADLINE", "HIGH")
    sure = sure.when((F.col("tier") == "BODY") | (F.col("recognition") == "INSTITUTION_MENTION"), "MEDIUM").otherwise("LOW")
    return out.select(
        key, F.when(one, F.col("winners")[0]).alias("region_id"), method.alias("method"), sure.alias("confidence"),
        F.when(none, "UNKNOWN").when(one, "INFERRED").otherwise("MULTI_REGION").alias("status"),
        F.when(~none & ~one, F.col("winners")).otherwise(F.array().cast("array<string>")).alias("candidates"),
    )
