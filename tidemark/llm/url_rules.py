"""Url filter: longest matching host/path rule, and link-graph propagation for the rest (DataFrame operations only).

Hosts with pages that an allow rule covers are trusted seeds, hosts with pages that a block rule covers are distrusted
seeds, each by its share of covered pages. Personalised PageRank carries trust along host links; distrust runs along the reversed links, to the hosts
that link to blocked ones. Both run until no host can gain more than a tolerance. A host whose distrust reaches
``threshold`` and exceeds its trust is blocked, the rest are allowed. All mass is integer (``UNIT`` parts), so results do not depend on the order of additions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ._cut import cut, discard

UNIT = 1_000_000_000
TOLERANCE = UNIT // 1_000_000
#: (verdict, host, path)
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _matched(host: Column, path: Column, rules) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. Rules are a parameter list, a literal each."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_links(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(src, dst, n): links between different hosts, from absolute and scheme-relative href values, added up per pair."""
    href = F.regexp_extract_all(F.col(html_col), F.lit(r"(?i)\bhref\s*=\s*[\"']?((?:[a-z][a-z0-9+.\-]*:)?//[^\s\"'<>]+)"), F.lit(1))
    target = F.col("link")
    target = F.when(target.startswith("//"), F.concat(F.lit("http:"), target)).otherwise(target)
    return (
        pages.select(url_parts(F.col(url_col))[0].alias("src"), F.explode(href).alias("link"))
        .select("src", url_parts(target)[0].alias("dst"))
        .filter("src <> '' and dst <> '' and src <> dst")
        .groupBy("src", "dst")
        .agg(F.count("*").alias("n"))
    )


def propagate(seeds: DataFrame, links: DataFrame, rounds: int | None = None, damping_pct: int = 85, tolerance: int = TOLERANCE) -> DataFrame:
    """(host, mass): integer (no step of it beyond a long or decimal(38)) personalised PageRank of ``seeds`` (host, seed) over ``links`` (src, dst, n).

    The mass starts as the restart share of the seeds and only grows. What all later rounds can still add is at most
    damping / (1 - damping) times what the last one added to all hosts; the rounds end when that is ``tolerance`` or less, so no
    host lacks more (besides less than one unit that rounding takes per link and round). With ``rounds``, so many rounds are made from the
    whole seeds instead, fewer at a fixed point, settled or not. Each round is one join on the source and one pre-aggregated sum per target.
    """
    out = links.groupBy("src").agg(F.sum("n").alias("total"))
    links = cut(links.join(out, "src"), "links")
    base = cut(seeds.select("host", F.expr(f"seed * {100 - damping_pct} div 100").alias("mass")), "mass")
    mass = base if rounds is None else seeds.select("host", F.col("seed").alias("mass"))
    if links.isEmpty():
        return mass if rounds == 0 else base
    done = 0
    while rounds is None or done < rounds:
        sent = (
            links.join(mass, links.src == mass.host)
            .select(F.col("dst").alias("host"), F.expr(f"(mass div 100) * {damping_pct} + (mass % 100) * {damping_pct} div 100").alias("mass"), "n", "total")
            .select("host", (F.expr("(mass div total) * n") + F.expr("cast(mass % total as decimal(19)) * cast(n as decimal(19)) div total")).alias("mass"))
            .unionByName(base)
        )
        new = cut(sent.groupBy("host").agg(F.sum("mass").alias("mass")), "mass")
        change = F.abs(F.coalesce("a.mass", F.lit(0)) - F.coalesce("b.mass", F.lit(0)))
        moved = new.alias("a").join(mass.alias("b"), "host", "full").agg(F.coalesce(F.sum(change), F.lit(0))).first()[0]
        if done:
            discard(mass)
        mass, done = new, done + 1
        if moved == 0 or (rounds is None and moved * damping_pct <= tolerance * (100 - damping_pct)):
            break
    return mass


def judge(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES,
    rounds: int | None = None, threshold: int = UNIT // 20, tolerance: int = TOLERANCE,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict.

    A page under a rule takes that rule's verdict; any other takes its host's, from settled masses (``rounds`` None). Null or malformed urls have an empty
    host, no rule and verdict allow; null html has no links; repeated pages each count; an empty table gives no rows.
    Very long pages are searched whole; of rules of equal length that fit, the last in (verdict, host, path) order wins; other columns are ignored.
    """
    host, path = url_parts(F.col(url_col))
    base = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    base = base.withColumn("hit", _matched(F.col("host"), F.col("path"), rules))
    per_host = cut(
        base.filter("host <> ''")
        .groupBy("host")
        .agg(F.count("*").alias("n"), F.count_if(F.expr("hit.verdict = 'allow'")).alias("good"), F.count_if(F.expr("hit.verdict = 'block'")).alias("bad")),
        "hosts",
    )
    links = cut(host_links(pages, url_col, html_col), "host-links")
    trust = propagate(per_host.filter("good > 0").select("host", F.expr(f"good * {UNIT} div n").alias("seed")), links, rounds, tolerance=tolerance)
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = propagate(per_host.filter("bad > 0").select("host", F.expr(f"bad * {UNIT} div n").alias("seed")), back, rounds, tolerance=tolerance)
    scored = (
        per_host.select("host")
        .join(trust.withColumnRenamed("mass", "trust"), "host", "left")
        .join(distrust.withColumnRenamed("mass", "distrust"), "host", "left")
        .filter(f"coalesce(distrust, 0) >= {threshold} and coalesce(distrust, 0) > coalesce(trust, 0)")
        .select("host", F.lit("block").alias("by_graph"))
    )
    return base.join(scored, "host", "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce(F.col("hit.verdict"), F.col("by_graph"), F.lit("allow")).alias("verdict"),
    )
