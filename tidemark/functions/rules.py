"""Rules over titles, sources, clocks and provider fields, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .arrow import title_key
from .lexicons import ANALYSIS_CUE
from .scalars import host, instant, iso, without_tracking

#: What keeps a title from being a decision, and the actions and actors of one.
NO_DECISION = (
    r"(?i)\b(?:meeting|minutes|accounts|interview|speech|outlook|forecast|expect\w*|preview|guidelines?|implementation|diagnostic|review|scheduled|will|may|could|should)\b"
)
NO_DECISION_PATH = r"/press/(?:key|inter|accounts|govcdec)/"
DECISION = r"(?i)\b(?:cuts?|lowers?|reduces?|raises?|hikes?|holds?|keeps?|maintains?|announces?)\b.{0,48}\b(?:rates?|rate decision)\b"
DECISION_ACTOR = r"(?i)\b(?:ECB|European Central Bank)\b"
#: Host, source name and licence of attributed sources; the first always names an author.
ATTRIBUTED = [
    ("globalvoices.org", "Global Voices", "https://creativecommons.org/licenses/by/3.0/"),
    ("news.un.org", "UN News", None),
    ("www.theguardian.com", "Guardian World", None),
]
#: Failure codes by what a fetch met.
FAILURES = [("timeout", "TIMEOUT"), ("redirect", "REDIRECT_REFUSED"), ("size", "RESPONSE_TOO_LARGE"), ("type", "CONTENT_TYPE_REFUSED"), ("parse", "INVALID_RESPONSE")]
METADATA = ["article_reference", "title", "news_source", "reported_at", "reported_time_kind", "observed_at", "discovered_at", "verification_status"]


def _filled(value: Column) -> Column:
    return value.isNotNull() & (value != "")


def provenance_valid(title: Column, source: Column, url: Column) -> Column:
    """A title, a source's name and an http(s) url with a host and without user information."""
    plain = F.rlike(url, F.lit(r"^(?i)https?://[^/?#@]*[^/?#@:][^/?#@]*(?:[/?#]|$)"))
    return F.coalesce(_filled(title) & _filled(source) & plain, F.lit(False))


def ecb_decision(title: Column, url: Column, institution: Column | None = None) -> Column:
    """An explicit reported rate action of the bank, or its decision document; never a meeting, forecast or review."""
    title, url = F.coalesce(title, F.lit("")), F.coalesce(url, F.lit(""))
    actor = F.rlike(title, F.lit(DECISION_ACTOR))
    actor = actor | F.coalesce(institution == "ECB", F.lit(False)) if institution is not None else actor
    document = (F.lower(F.trim(title)) == "monetary policy decisions") & (F.coalesce(host(url), F.lit("")) == "www.ecb.europa.eu") & F.contains(url, F.lit("/press/pr/"))
    vetoed = F.rlike(title, F.lit(NO_DECISION)) | F.rlike(url, F.lit(NO_DECISION_PATH))
    return ~vetoed & ((actor & F.rlike(title, F.lit(DECISION))) | document)


def article_kind(title: Column, decision: Column) -> Column:
    """REPORTED_RATE_DECISION where the title states one with its size and time, else by cue words."""
    cue = F.rlike(F.coalesce(title, F.lit("")), F.lit("(?i)" + ANALYSIS_CUE))
    return F.when(F.coalesce(decision, F.lit(False)), "REPORTED_RATE_DECISION").when(cue, "ANALYSIS_OR_CONTEXT").otherwise("ARTICLE_TYPE_UNKNOWN")


def attribution(name: Column, url: Column) -> Column:
    """struct(source, author, license_url) of a source that names its author behind a middle dot, by its host; else null."""
    at = F.instr(name, " \u00b7 ")
    author = F.when(at > 0, F.substring(name, at + 3, F.length(name)))
    out = None
    for where, source, licence in ATTRIBUTED:
        starts = F.startswith(name, F.lit(source + " \u00b7 " if licence else source))
        value = F.struct(F.lit(source).alias("source"), author.alias("author"), F.lit(licence).cast("string").alias("license_url"))
        held = F.coalesce((host(url) == where) & starts, F.lit(False))
        out = F.when(held, value) if out is None else out.when(held, value)
    return out


def research_clocks(reported: Column, kind: Column, observed: Column, discovered: Column, basis: Column) -> Column:
    """struct of independent clocks: a latency only where the observation is proven to be the first and is not before the publication."""
    published = F.when(kind.isin("REPORTED_TIME", "SOURCE_REPORTED_TIME"), reported)
    seen = F.coalesce(observed, discovered)
    proven = F.coalesce(basis == "FIRST_RECORDED_SOURCE_OBSERVATION", F.lit(False))
    latency = F.when(proven & (instant(seen) >= instant(published)), (F.unix_micros(instant(seen)) - F.unix_micros(instant(published))) / 1_000_000.0)
    return F.struct(
        published.alias("source_published_at"), seen.alias("upstream_observed_at"), F.when(proven, seen).alias("first_observed_at"),
        F.coalesce(basis, F.lit("UPSTREAM_OBSERVATION;FIRST_OBSERVATION_NOT_PROVEN")).alias("first_observed_basis"),
        latency.alias("discovery_latency_seconds"), F.when(latency.isNotNull(), "MEASURED").otherwise("UNKNOWN").alias("discovery_latency_status"),
    )


def headline_explanation(title: Column, institution: Column, templates: list[tuple[str, str]]) -> Column:
    """The text of the first (institution id, template) that fits, with {} for the title; null without one."""
    return F.coalesce(*[F.when(institution == i, F.concat(F.lit(t.split("{}")[0]), title, F.lit(t.split("{}")[1]))) for i, t in templates])


def article_identity(url: Column) -> Column:
    """Identity of an article by its url without tracking keys."""
    return F.concat(F.lit("article-url-v47-"), F.sha2(without_tracking(url), 256))


def content_version(title: str, url: Column, publisher: Column, published: Column, precision: Column) -> Column:
    """Identity of an article's content: title key, clean url, publisher, publication time and its precision, keys in order."""
    body = F.struct(precision.alias("precision"), published.alias("published"), publisher.alias("publisher"), title_key(title).alias("title"), without_tracking(url).alias("url"))
    return F.concat(F.lit("news-content-v47-"), F.sha2(F.to_json(body, {"ignoreNullFields": "false"}), 256))


def metadata_hash(fields: dict[str, Column]) -> Column:
    """Hash of an article's eight metadata fields, in key order; fields that are not given are null."""
    body = F.struct(*[fields.get(k, F.lit(None).cast("string")).alias(k) for k in sorted(METADATA)])
    return F.sha2(F.to_json(body, {"ignoreNullFields": "false"}), 256)


def slug_url(slugs: Column, base: str) -> Column:
    """The url of the only valid slug; null where there is none or more than one, or over a hundred are given."""
    valid = F.array_distinct(F.filter(slugs, lambda s: F.rlike(s, F.lit("^[a-zA-Z0-9-]+$"))))
    return F.when((F.size(valid) == 1) & (F.size(slugs) <= 100), F.concat(F.lit(base), valid[0]))


def aligned_identifiers(labels: Column, *lists: tuple[str, Column]) -> Column:
    """struct(kind, ids) of the first list that has one well-formed id for each label."""
    fits = lambda ids: (F.size(ids) == F.size(labels)) & (F.size(labels) > 0) & F.forall(ids, lambda x: F.rlike(x, F.lit("^(?:[0-9]{1,128}|0x[0-9a-fA-F]{64})$")))
    return F.coalesce(*[F.when(F.coalesce(fits(ids), F.lit(False)), F.struct(F.lit(kind).alias("kind"), ids.alias("ids"))) for kind, ids in lists])


def limited(value: Column, most: int) -> Column:
    """Text without outer white space, cut to ``most`` characters; null where nothing is left."""
    held = F.regexp_replace(value, r"^\s+|\s+$", "")
    return F.nullif(F.substring(held, 1, most), F.lit(""))


def retry_after(value: Column, status: Column, ttl: int, otherwise: int = 21_600, most: int = 86_400) -> Column:
    """Seconds to wait after status 429: the header's digits between ``ttl`` and ``most``, else ``otherwise``; null after any other status."""
    seconds = F.least(F.lit(most), F.greatest(F.lit(ttl), F.when(F.rlike(value, F.lit("^[0-9]{1,9}$")), value.cast("int"))))
    return F.when(status == 429, F.when(F.rlike(value, F.lit("^[0-9]{1,9}$")), seconds).otherwise(otherwise))


def failure_reason(error: Column, status: Column) -> Column:
    """A stable code of a failed fetch: the http status, else by the error's kind, else PROVIDER_UNAVAILABLE."""
    out = F.when(status.isNotNull() & (status != 200), F.concat(F.lit("HTTP_"), status.cast("string")))
    for part, code in FAILURES:
        out = out.when(F.contains(F.lower(error), F.lit(part)), code)
    return out.when(error.isNotNull(), "PROVIDER_UNAVAILABLE")


def bounded_int(value: Column, least: int, most: int, default: int) -> Column:
    """An integer setting: its value where it is one within bounds, ``default`` where it is not given, else null."""
    number = F.when(F.rlike(value, F.lit("^[0-9]{1,9}$")), value.cast("int"))
    return F.when(value.isNull() | (value == ""), default).when(number.between(least, most), number)


def shown(at: Column) -> Column:
    return iso(at)
