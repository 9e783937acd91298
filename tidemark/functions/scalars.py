"""Scalar rules as column expressions: time, url, text, identity and backoff."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .lexicons import CATEGORIES, CATEGORY_EXCLUDED, CONTEXT_PAIRS, CUE_GEOPOLITICS, MACRO_TITLE, MECHANISMS, RATE_MARKET, TRACKING

ANY_CASE = "(?i)"


# Time

def instant(value: Column) -> Column:
    """A TIMESTAMP where the text has a zone, else null; naive and date-only texts are null."""
    zoned = value.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})$")
    return F.when(zoned, F.try_to_timestamp(F.regexp_replace(value, r"([+-]\d{2})(\d{2})$", "$1:$2")))


def rfc_instant(value: Column) -> Column:
    """An RFC 2822 date with a zone, or an ISO instant; else null."""
    bare = F.regexp_replace(F.trim(value), r"^[A-Za-z]{3},\s*", "")
    named = F.try_to_timestamp(F.regexp_replace(bare, r"\s(GMT|UT|UTC|Z)$", " +0000"), F.lit("d MMM yyyy HH:mm:ss xx"))
    return F.when(bare.rlike(r"^\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2} ([+-]\d{4}|GMT|UT|UTC|Z)$"), named).otherwise(instant(value))


def iso(at: Column) -> Column:
    """ISO text ending in Z, microseconds only where there are any (session time zone UTC)."""
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.when(F.date_format(at, "SSSSSS") == "000000", whole).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))


def ledger_time(at: Column) -> Column:
    """ISO text with six digits of a second."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def precision(value: Column) -> Column:
    """DATE_ONLY, MINUTE, SECOND or UNKNOWN, by the text's form."""
    return (
        F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), "DATE_ONLY")
        .when(value.rlike(r"\d{2}:\d{2}:\d{2}"), "SECOND")
        .when(value.rlike(r"\d{2}:\d{2}"), "MINUTE")
        .otherwise("UNKNOWN")
    )


# Text

def text(*values: Column) -> Column:
    """The first value that is not blank, trimmed of any white space."""
    trimmed = [F.regexp_replace(v, r"(?U)^\s+|\s+$", "") for v in values]
    return F.coalesce(*[F.when(t != "", t) for t in trimmed])


def collapsed(value: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))


# Urls

def url_key(url: Column) -> Column:
    """Scheme and authority in lower case, path and query as they are, no fragment; null unless http(s) with an authority."""
    head = F.regexp_extract(F.trim(url), r"^(?i)(https?://[^/?#]+)", 1)
    rest = F.regexp_extract(F.trim(url), r"^(?i)https?://[^/?#]+([^#]*)", 1)
    return F.when(head != "", F.concat(F.lower(head), rest))


def valid_url(url: Column) -> Column:
    """http or https in any case, and an authority."""
    return F.coalesce(url.rlike(r"^(?i)https?://[^/?#]+"), F.lit(False))


def host(url: Column) -> Column:
    """The host in lower case, without userinfo and port; empty where there is none."""
    return F.lower(F.regexp_extract(url, r"^(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def allowed_url(url: Column, hosts: list[str]) -> Column:
    """https, one of the hosts, no userinfo, no port but 443."""
    names = "|".join(h.replace(".", r"\.") for h in hosts)
    return F.coalesce(url.rlike(rf"^(?i)https://(?:{names})(?::443)?(?:[/?#]|$)"), F.lit(False))


def without_tracking(url: Column) -> Column:
    """https urls with a lower-case host, a path, no fragment and no tracking parameters (the others in their order)."""
    head = F.lower(F.regexp_extract(url, r"^(?i)(https://[^/?#]+)", 1))
    path = F.regexp_extract(url, r"^(?i)https://[^/?#]+([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    name = lambda p: F.lower(F.split_part(p, F.lit("="), F.lit(1)))
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~name(p).startswith("utm_") & ~name(p).isin(TRACKING))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(head != "", F.concat(head, F.when(path == "", "/").otherwise(path), tail))


# Lexical rules

def macro_relevant(title: Column) -> Column:
    """Any macro phrase, a rate-market phrase, or both halves of a context pair."""
    found = title.rlike(ANY_CASE + MACRO_TITLE) | title.rlike(ANY_CASE + RATE_MARKET)
    for context, development in CONTEXT_PAIRS:
        found = found | (title.rlike(ANY_CASE + context) & title.rlike(ANY_CASE + development))
    return F.coalesce(found, F.lit(False))


def first_topic(title: Column, topics: list[tuple[str, str]]) -> Column:
    """The first topic whose pattern is found; null without any."""
    return F.coalesce(*[F.when(title.rlike(ANY_CASE + pattern), name) for name, pattern in topics])


def matched_terms(title: Column, patterns: list[str]) -> Column:
    """All matches of the patterns in their order, in lower case, each once."""
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(F.lower(title), F.lit(p.lower()), F.lit(0)) for p in patterns])))


def category(question: Column, context: Column, excluded=CATEGORY_EXCLUDED, categories=CATEGORIES) -> Column:
    """Discovery category of a question with its events' titles; null when excluded or unmatched."""
    both = F.lower(F.concat_ws(" ", F.coalesce(question, F.lit("")), F.coalesce(context, F.lit(""))))
    hit = F.coalesce(*[F.when(both.rlike(p), name) for name, p in categories])
    for pattern in excluded:
        hit = F.when(~both.rlike(pattern), hit)
    return hit


def relevance_reason(question: Column, titles: Column, kind: Column) -> Column:
    """Where and what the category's cue is: QUESTION:cue, PROVIDER_EVENT_TITLE:cue, or the general reason."""
    cue = F.coalesce(*[F.when(kind == name, CUE_GEOPOLITICS if name == "GEOPOLITICS" else p) for name, p in CATEGORIES])
    found = lambda v: F.call_function("regexp_extract", F.lower(v), cue, F.lit(0))
    in_titles = F.filter(F.transform(F.coalesce(titles, F.array().cast("array<string>")), found), lambda x: x != "")
    return F.when(kind.isNotNull(), F.coalesce(
        F.when(found(question) != "", F.concat(F.lit("QUESTION:"), found(question))),
        F.when(F.size(in_titles) > 0, F.concat(F.lit("PROVIDER_EVENT_TITLE:"), in_titles[0])),
        F.lit("CONSERVATIVE_MACRO_TOPIC_MATCH"),
    ))


def mechanisms(title: Column, rules=MECHANISMS, most: int = 2) -> Column:
    """Names of the first ``most`` mechanism rules: a term, the second cue where the rule has one, and no counter-cue."""
    parts = []
    for name, term, also, unless in rules:
        hit = title.rlike(ANY_CASE + term)
        hit = hit & title.rlike(ANY_CASE + also) if also else hit
        hit = hit & ~title.rlike(ANY_CASE + unless) if unless else hit
        parts.append(F.when(hit, name))
    return F.slice(F.filter(F.array(*parts), lambda x: x.isNotNull()), 1, most)


# Identity

def content_id(prefix: str, *values: Column) -> Column:
    """Prefix and SHA-256 of the canonical JSON array of strings (nulls stay null)."""
    return F.concat(F.lit(prefix), F.sha2(F.to_json(F.array(*values)), 256))


def event_id(references: Column) -> Column:
    """Identity of an article set."""
    return F.concat(F.lit("canonical-event-v0-"), F.sha2(F.concat(F.lit('["CANONICAL_EVENT_V0",'), F.to_json(F.array_sort(references)), F.lit("]")), 256))


def evidence_id(authority: Column, url: Column, document: Column, proposition: Column, published: Column) -> Column:
    return content_id("official-evidence-v0-", F.lit("OFFICIAL_EVIDENCE_V0"), authority, url, document, proposition, published)


# Control

def backoff(interval: Column, failures: Column, most: int, status: Column) -> Column:
    """Seconds to wait: the interval doubled per failure up to five times, at most ``most``; a day or more after 403 and 406."""
    wait = F.least(F.lit(most), interval * F.pow(F.lit(2), F.least(failures, F.lit(5)))).cast("long")
    return F.when(status.isin(403, 406), F.greatest(wait, F.lit(86_400))).otherwise(wait)


def circuit_open(failures: Column, status: Column) -> Column:
    return (failures >= 5) | status.isin(403, 406)


def price(value: Column) -> Column:
    """A finite number of 0 to 1, else null."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & number.between(0.0, 1.0), number)
