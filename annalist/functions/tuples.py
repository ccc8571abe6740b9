"""Tuples of a change message, read by position against the relation's columns.

A tuple is ARRAY<STRUCT<kind, value>>; the relation's columns are ARRAY<STRING>.
Surplus tuple entries are cut, missing ones leave their columns out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tuple entry kinds and the text for an unsent large value.
KIND_NULL, KIND_UNCHANGED, KIND_TEXT = "n", "u", "t"
UNCHANGED_TEXT = "<unchanged>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once. Inside a lambda that uses it, or where
    it is used twice, it is else worked out each time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _last_of_each_name(pairs: Column) -> Column:
    """Repeated column names: the last one wins."""
    names = F.transform(pairs, lambda p: p["name"])
    return F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), p["name"]))


def tuple_to_json(columns: Column, entries: Column, repeats: Column | None = None) -> Column:
    """Row image as JSON text. No tuple gives NULL, an empty tuple gives ``{}``.

    Null entries keep their key, unsent values become ``<unchanged>``, text stays
    text, and entries of any other kind are left out. ``repeats`` says whether a
    column name occurs twice; it is worked out per row when not given.
    """
    if repeats is None:
        repeats = F.size(F.array_distinct(columns)) < F.size(columns)

    def pair(name: Column, entry: Column) -> Column:
        value = F.when(entry["kind"] == KIND_UNCHANGED, F.lit(UNCHANGED_TEXT)).when(
            entry["kind"] == KIND_TEXT, F.coalesce(entry["value"], F.lit(""))
        )
        readable = name.isNotNull() & entry["kind"].isin(KIND_NULL, KIND_UNCHANGED, KIND_TEXT)
        return F.when(readable, F.struct(name.alias("name"), value.alias("value")))

    # The shorter side is padded with NULLs, which ``pair`` leaves out.
    pairs = F.filter(F.zip_with(columns, entries, pair), lambda p: p.isNotNull())
    image = F.when(repeats, F.to_json(F.map_from_entries(_last_of_each_name(pairs)))).otherwise(
        F.to_json(F.map_from_entries(pairs))
    )
    return F.when(entries.isNotNull() & columns.isNotNull(), image)


# Control characters with an escape of their own.
_NAMED = {7: "\\a", 8: "\\b", 9: "\\t", 10: "\\n", 11: "\\v", 12: "\\f", 13: "\\r"}


def quoted(text: Column) -> Column:
    """Double-quoted text with backslash escapes for quote, backslash and control characters."""
    for raw in ("\\", '"'):
        text = F.replace(text, F.lit(raw), F.lit("\\" + raw))

    def shown(c: Column) -> Column:
        code = F.ascii(c)
        out = F.when((code < 32) | (code == 127), F.concat(F.lit("\\x"), F.lower(F.lpad(F.hex(code), 2, "0")))).otherwise(c)
        for number, escape in _NAMED.items():
            out = F.when(code == number, F.lit(escape)).otherwise(out)
        return F.when(c == "", c).otherwise(out)

    # Few texts have any; the others are not taken apart.
    escaped = F.array_join(F.transform(F.split(text, ""), shown), "")
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x1f\x7f]"), escaped).otherwise(text), F.lit('"'))


def printable_tuple(prefix: str, columns: Column, entries: Column) -> Column:
    """Trace text of a tuple. Unlike the JSON image, entries of other kinds are shown."""
    def line(name: Column, entry: Column) -> Column:
        value = quoted(F.coalesce(entry["value"], F.lit("")))
        shown = (
            F.when(entry["kind"] == KIND_NULL, F.lit("NULL"))
            .when(entry["kind"] == KIND_UNCHANGED, F.lit(UNCHANGED_TEXT))
            .when(entry["kind"] == KIND_TEXT, value)
            .otherwise(F.concat(value, F.lit(" (type: "), entry["kind"], F.lit(")")))
        )
        return F.concat(F.lit("    "), name, F.lit(": "), shown)

    # Padding gives NULL lines, which ``array_join`` skips.
    lines = F.zip_with(columns, entries, line)
    body = F.array_join(F.concat(F.array(F.lit(prefix + ":")), lines), "\n")
    return F.when(entries.isNull(), F.lit(prefix + ": <nil>")).otherwise(body)
