"""What of an object in a nested JSON document may be shown: rules on VARIANT as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import canonical_json as C

#: Members that never leave, members that leave empty, and members whose rows must each be public.
HIDDEN, EMPTIED, ROWS = ["private_market_observations", "market_reality_windows"], "market_observations", "market_reality_observations"
#: Contracts whose objects must be public as a whole.
OBSERVATION, SNAPSHOT, PUBLIC = "MARKET_OBSERVATION_V0", "MARKET_REALITY_SNAPSHOT_V0", "PUBLIC_REDISTRIBUTABLE"


def public(document: Column, private: str) -> Column:
    """Whether a VARIANT is an object of the public scope, not synthetic, and from neither the private provider's name nor its host."""
    lower = lambda path: F.lower(F.coalesce(F.try_variant_get(document, path, "string"), F.lit("")))
    link = F.when(lower("$.source.url") != "", lower("$.source.url")).otherwise(lower("$.source_reference"))
    host = F.regexp_extract(link, r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)", 1)
    named = (lower("$.provider") == private) | F.contains(lower("$.source.name"), F.lit(private))
    source = C.member_text(document, "source")
    real = F.coalesce(F.to_json(C.member(document, "synthetic", "variant")), F.lit("false")) == "false"
    scoped = C.member(document, "data_usage_scope").eqNullSafe(F.lit(PUBLIC))
    return scoped & real & (F.startswith(source, F.lit("{")) | (source == "null")) & ~named & (host != f"{private}.com") & ~F.endswith(host, F.lit(f".{private}.com"))


def forbidden(document: Column, private: str) -> Column:
    """Whether an object may not leave at all."""
    scope = C.member(document, "data_usage_scope", "variant")
    contract = F.coalesce(C.member(document, "contract_version"), F.lit(""))
    used = lambda i: (C.member_text(i, "price_or_level") != "null") | (C.member_text(i, "source") != "null")
    instruments = F.coalesce(C.member(document, "instruments", "array<variant>"), F.array().cast("array<variant>"))
    return (
        (scope.isNotNull() & ~C.member(document, "data_usage_scope").eqNullSafe(F.lit(PUBLIC))) | (F.lower(F.coalesce(C.member(document, "provider"), F.lit(""))) == private)
        | ((contract == OBSERVATION) & ~public(document, private)) | ((contract == SNAPSHOT) & F.exists(instruments, lambda i: used(i) & ~public(i, private)))
    )
