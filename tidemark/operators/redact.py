"""Nested JSON documents without what may not be shown, at any depth.

A document is a list of pieces in its row: text that stands, and objects and arrays still to open. Each round opens all of them one level further, in place, until none is left;
the rules take members and whole objects out before they are opened, so nothing below them is read. Whether a member is left is known when it is reached, so no round goes back up,
and no row leaves its task: there is no shuffle. No document is walked in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import canonical_json as C
from ..functions.redaction import EMPTIED, HIDDEN, ROWS, forbidden, public

OBJECT, ITEMS = "map<string,variant>", "array<variant>"
PIECE = f"struct<text:string,object:{OBJECT},items:{ITEMS},of_rows:boolean>"


def _piece(text: Column, of: Column | None = None) -> Column:
    """Text that stands or, with ``of``, text before an object or array that is still to open."""
    held = [F.lit(None).cast(OBJECT), F.lit(None).cast(ITEMS), F.lit(False)] if of is None else [of["object"], of["items"], of["of_rows"]]
    return F.struct(text.alias("text"), *(c.alias(n) for c, n in zip(held, ("object", "items", "of_rows"), strict=True)))


def _closed(piece: Column) -> Column:
    return piece["object"].isNull() & piece["items"].isNull()


def _value(document: Column, private: str, of_rows: Column) -> Column:
    """A VARIANT as a piece; neither text nor anything to open for null and for an object that may not leave."""
    found = F.struct(
        F.lit("").alias("text"), F.try_variant_get(document, "$", OBJECT).alias("object"), F.try_variant_get(document, "$", ITEMS).alias("items"), of_rows.alias("of_rows"),
    )
    leaf = F.to_json(document)
    return C.using(found, lambda p: (
        F.when(p["items"].isNotNull(), p).when(p["of_rows"], _piece(F.lit("[]")))  # where only public rows may stand, anything but a list is an empty list
        .when(p["object"].isNull(), _piece(F.nullif(leaf, F.lit("null")))).when(forbidden(document, private), _piece(F.lit(None).cast("string"))).otherwise(p)
    ))


def _members(piece: Column, private: str) -> Column:
    """The pieces of an object, those before each member's value with its key."""

    def member(key: Column, place: Column) -> Column:
        value = F.when(key == EMPTIED, _piece(F.lit("[]"))).otherwise(_value(piece["object"][key], private, key == ROWS))
        before = F.concat(F.when(place > 0, ",").otherwise(""), C.quoted(key), F.lit(":"))
        return C.using(value, lambda v: _piece(F.concat(before, F.coalesce(v["text"], F.lit("null"))), v))

    keys = F.filter(F.array_sort(F.map_keys(piece["object"])), lambda k: ~k.isin(HIDDEN))
    return F.concat(F.array(_piece(F.concat(piece["text"], F.lit("{")))), F.transform(keys, member), F.array(_piece(F.lit("}"))))


def _listed(piece: Column, private: str) -> Column:
    """The pieces of an array; nulls go, but where rows stand."""
    shown = F.filter(piece["items"], lambda v: ~piece["of_rows"] | public(v, private))
    values = F.filter(F.transform(shown, lambda v: _value(v, private, F.lit(False))), lambda v: piece["of_rows"] | v["text"].isNotNull())
    items = F.transform(values, lambda v, place: _piece(F.concat(F.when(place > 0, ",").otherwise(""), F.coalesce(v["text"], F.lit("null"))), v))
    return F.concat(F.array(_piece(F.concat(piece["text"], F.lit("[")))), items, F.array(_piece(F.lit("]"))))


def shown(text: Column | str, private: str = "tiingo") -> Column:
    """A JSON document as it may be shown, canonical; null for null, for no JSON, and for what is forbidden as a whole."""

    def state(pieces: Column) -> Column:
        return C.using(pieces, lambda ps: F.struct(ps.alias("pieces"), F.exists(ps, lambda p: ~_closed(p)).alias("more")))

    def further(held: Column, _: Column) -> Column:
        opened = F.transform(held["pieces"], lambda p: F.when(p["object"].isNotNull(), _members(p, private)).when(p["items"].isNotNull(), _listed(p, private)).otherwise(F.array(p)))
        return F.when(held["more"], state(F.flatten(opened))).otherwise(held)

    def whole(canonical: Column) -> Column:
        # no document is deeper than it has brackets; rounds after the last open piece change nothing
        rounds = F.length(canonical) - F.length(F.translate(canonical, "{[", ""))
        top = F.array(_value(C.parsed(canonical), private, F.lit(False)))
        pieces = F.aggregate(F.sequence(F.lit(0), rounds), state(top).cast(f"struct<pieces:array<{PIECE}>,more:boolean>"), further, lambda held: held["pieces"])
        return C.using(pieces, lambda ps: F.when(ps[0]["text"].isNotNull(), F.array_join(F.transform(ps, lambda p: p["text"]), "")))

    return C.using(C.canonical(text), lambda canonical: F.when(canonical.isNotNull(), whole(canonical)))


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` dealt evenly over four tasks a core, or as many as the session shuffles into: a document costs far more to open than what it is made from costs to move."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def redacted(rows: DataFrame, text_col: str, private: str = "tiingo") -> DataFrame:
    """``rows`` with ``text_col`` as it may be shown (``shown``).

    Forbidden objects are null as members and go from lists; nulls go from lists, too. Rows that are equal stay as many. A document is opened in its row, with all its pieces, once a level;
    rows stay in their tasks (``dealt`` spreads them before).
    """
    return rows.select(*[shown(text_col, private).alias(c) if c == text_col else F.col(c) for c in rows.columns])
