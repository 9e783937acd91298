"""Canonical JSON text as column expressions on VARIANT: keys sorted at every depth, no spaces, raw non-ASCII.

A VARIANT keeps its keys sorted, so writing one out is canonical. Numbers take one form: 1.50 and 1.5 are one text, so are 1.0 and 1; exponents are
written as 1.0E-5. Text that is no JSON, or names a key twice, is null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def canonical(text: Column | str) -> Column:
    """The canonical text of a JSON document; null for null or no JSON."""
    return F.to_json(F.try_parse_json(_col(text)))


def quoted(text: Column | str) -> Column:
    """A string as JSON text; null stays null."""
    one = F.to_json(F.array(_col(text)))
    return F.when(_col(text).isNotNull(), F.substring(one, F.lit(2), F.length(one) - 2))


def parsed(text: Column | str) -> Column:
    """A JSON text as VARIANT; null for null or no JSON."""
    return F.try_parse_json(_col(text))


def using(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def member(document: Column, name: str, kind: str = "string") -> Column:
    """A top-level member of a VARIANT as ``kind``; null where it is absent or of another kind."""
    return F.try_variant_get(document, f"$['{name}']", kind)


def member_text(document: Column, name: str) -> Column:
    """A top-level member of a VARIANT as canonical text; "null" where it is null or absent."""
    return F.coalesce(F.to_json(member(document, name, "variant")), F.lit("null"))


def object_text(members: dict[str, Column]) -> Column:
    """A JSON object of members that are canonical texts themselves."""
    parts = [F.concat(F.lit(f'"{n}":'), members[n]) for n in sorted(members)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def array_text(items: Column) -> Column:
    """A JSON array of canonical texts."""
    return F.concat(F.lit("["), F.concat_ws(",", items), F.lit("]"))


def allow_listed(document: Column, names: list[str], where_present: list[str] = ()) -> Column:
    """The canonical text of the listed members of a VARIANT only, null for those absent; members of ``where_present`` are left out where absent."""
    parts = []
    for n in sorted([*names, *where_present]):
        text = F.concat(F.lit(f'"{n}":'), member_text(document, n))
        parts.append(text if n in names else F.when(member(document, n, "variant").isNotNull(), text))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))  # concat_ws passes over nulls


#: The tokens of canonical JSON: strings, brackets, commas, colons, and everything between.
TOKEN = r'"(?:[^"\\]|\\.)*"|[\[\]{},:]|[^\[\]{},:"]+'


def indented(text: Column | str) -> Column:
    """Canonical text with two spaces a level, one member a line, empty objects and arrays closed at once."""
    token_list = F.regexp_extract_all(_col(text), F.lit(TOKEN), F.lit(0))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("depth"), F.lit("").alias("last"))

    def put(held: Column, token: Column) -> Column:
        opens, closes = held["last"].isin("{", "["), token.isin("}", "]")
        depth = held["depth"] + F.when(token.isin("{", "["), 1).when(closes, -1).otherwise(0)
        line = F.concat(F.lit("\n"), F.repeat(F.lit("  "), F.when(closes, depth).otherwise(held["depth"])))
        before = F.when(opens & ~closes, line).when(held["last"] == ",", line).when(closes & ~opens, line).otherwise("")
        shown = F.when(token == ":", ": ").otherwise(token)
        return F.struct(F.concat(held["out"], before, shown).alias("out"), depth.alias("depth"), token.alias("last"))

    return F.when(_col(text).isNotNull(), F.aggregate(token_list, start, put)["out"])


def _without(text: Column, name: str) -> Column:
    """``without`` of a text that is canonical already."""

    def shown(held: Column) -> Column:
        keys = F.array_sort(F.filter(F.map_keys(held), lambda k: k != name))
        return F.concat_ws(",", F.transform(keys, lambda k: F.concat(quoted(k), F.lit(":"), F.coalesce(F.to_json(held[k]), F.lit("null")))))

    return F.when(F.startswith(text, F.lit("{")), F.concat(F.lit("{"), using(F.from_json(text, "map<string, variant>"), shown), F.lit("}")))


def without(document: Column | str, name: str) -> Column:
    """The canonical text of a JSON object without one top-level member; null for what is no object."""
    return using(canonical(document), lambda text: _without(text, name))


def fingerprint(document: Column | str) -> Column:
    """SHA-256 of a JSON object without its own ``artifact_fingerprint``, indented by two, with a newline at the end; null for anything else."""
    return using(without(document, "artifact_fingerprint"), lambda text: F.sha2(F.concat(indented(text), F.lit("\n")), 256))


def sealed(document: Column | str) -> Column:
    """Whether a JSON object carries its own fingerprint."""
    def own(text: Column) -> Column:
        carried = lambda seal: F.when(F.length(seal) == 64, seal == fingerprint(text))  # noqa: E731 (no other length can be one)
        return F.coalesce(using(member(parsed(text), "artifact_fingerprint"), carried), F.lit(False))

    return using(_col(document), own)
