"""Statements that repeat or undo a row change, and the key that finds its row.

An *image* here is ARRAY<STRUCT<name, kind, value>>: the readable entries of a tuple beside
the relation's column names, as the JSON images show them, so entries of unknown kinds are
left out and the last of a repeated name counts. A key is an image too.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from annalist.functions.tuples import KIND_NULL, KIND_TEXT, KIND_UNCHANGED, let

# A relation's replica identity, as letters in its message and as words.
DEFAULT, NOTHING, FULL, INDEX = "d", "n", "f", "i"
IDENTITY_WORDS = {DEFAULT: "default", NOTHING: "nothing", FULL: "full", INDEX: "index"}
BY_KEY = (DEFAULT, INDEX)


def identity_word(letter: Column) -> Column:
    out = F.lit(None).cast("string")
    for code, word in IDENTITY_WORDS.items():
        out = F.when(letter == code, F.lit(word)).otherwise(out)
    return out


def image_of(columns: Column, entries: Column, repeats: Column | None = None) -> Column:
    """The image of a tuple; NULL without a tuple or columns. ``repeats`` says whether a
    column name occurs twice; it is worked out per row when not given."""
    if repeats is None:
        repeats = F.size(F.array_distinct(columns)) < F.size(columns)
    pair = lambda name, e: F.struct(name.alias("name"), e["kind"].alias("kind"), e["value"].alias("value"))
    readable = lambda e: e["name"].isNotNull() & F.coalesce(e["kind"].isin(KIND_NULL, KIND_UNCHANGED, KIND_TEXT), F.lit(False))
    # The shorter side is padded with NULLs, which are not readable.
    known = F.filter(F.zip_with(columns, entries, pair), readable)
    last = lambda image: F.filter(image, lambda e, i: ~F.array_contains(F.slice(names(image), i + 2, F.size(image)), e["name"]))
    return F.when(repeats, let(known, last)).otherwise(known)


def names(image: Column) -> Column:
    return F.transform(image, lambda e: e["name"])


def _whole(image: Column) -> Column:
    """Whether an image says all its values."""
    return ~F.exists(image, lambda e: e["kind"] == KIND_UNCHANGED)


def key_names(columns: Column, flags: Column) -> Column:
    """The columns whose flag is set; a missing flag is not."""
    marked = F.zip_with(columns, flags, lambda name, flag: F.when(flag, name))
    return F.array_distinct(F.filter(marked, lambda n: n.isNotNull()))


def key_of(image: Column, identity: Column, keys: Column) -> Column:
    """What finds the image's row: its key columns, or all columns of a full identity.

    NULL when the relation has no such identity, the image lacks a key column, or a value
    of the key was not sent.
    """
    part = F.filter(image, lambda e: F.array_contains(keys, e["name"]))
    by_key = let(part, lambda p: F.when((F.size(keys) > 0) & (F.size(p) == F.size(keys)) & _whole(p), p))
    whole = F.when((F.size(image) > 0) & _whole(image), image)
    return F.when(identity.isin(*BY_KEY), by_key).when(identity == FULL, whole)


def key_before(kind: Column, old: Column, new: Column, identity: Column, keys: Column) -> Column:
    """Finds the row an update or delete met. An update of a keyed relation that sends no
    old image left the key as it was."""
    met = F.when(old.isNotNull(), key_of(old, identity, keys)).when(identity.isin(*BY_KEY), key_of(new, identity, keys))
    return F.when(kind == "U", met).when(kind == "D", key_of(old, identity, keys))


def key_after(kind: Column, new: Column, identity: Column, keys: Column) -> Column:
    """Finds the row an insert or update left."""
    return F.when(kind.isin("I", "U"), key_of(new, identity, keys))


def as_json(image: Column) -> Column:
    return F.to_json(F.map_from_entries(F.transform(image, lambda e: F.struct(e["name"], F.when(e["kind"] == KIND_TEXT, F.coalesce(e["value"], F.lit("")))))))


def identifier(name: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))


def literal(entry: Column) -> Column:
    text = F.replace(F.coalesce(entry["value"], F.lit("")), F.lit("'"), F.lit("''"))
    return F.when(entry["kind"] == KIND_NULL, F.lit("NULL")).otherwise(F.concat(F.lit("'"), text, F.lit("'")))


def where_clause(key: Column) -> Column:
    """A condition on all columns of a key; NULL without one."""
    holds = lambda e: F.concat(
        identifier(e["name"]), F.when(e["kind"] == KIND_NULL, F.lit(" IS NULL")).otherwise(F.concat(F.lit(" = "), literal(e)))
    )
    return F.array_join(F.transform(key, holds), " AND ")


def qualified(schema: Column, name: Column) -> Column:
    return F.concat(identifier(schema), F.lit("."), identifier(name))


def insert_statement(table: Column, image: Column) -> Column:
    """NULL without an image, or when it does not say all its values."""
    listed = lambda parts: F.array_join(parts, ", ")
    body = F.concat(
        F.lit(" ("), listed(F.transform(image, lambda e: identifier(e["name"]))),
        F.lit(") VALUES ("), listed(F.transform(image, literal)), F.lit(")"),
    )
    return F.when(_whole(image), F.concat(F.lit("INSERT INTO "), table, F.when(F.size(image) > 0, body).otherwise(F.lit(" DEFAULT VALUES"))))


def update_statement(table: Column, image: Column, where: Column) -> Column:
    """Sets what the image says; NULL when that is nothing, or without a condition."""
    said = F.filter(image, lambda e: e["kind"] != KIND_UNCHANGED)
    sets = F.array_join(F.transform(said, lambda e: F.concat(identifier(e["name"]), F.lit(" = "), literal(e))), ", ")
    # An entry makes some text, so no text is no entry.
    return F.when(sets != "", F.concat(F.lit("UPDATE "), table, F.lit(" SET "), sets, F.lit(" WHERE "), where))


def delete_statement(table: Column, where: Column) -> Column:
    return F.concat(F.lit("DELETE FROM "), table, F.lit(" WHERE "), where)


def forward_statement(kind: Column, table: Column, new: Column, where_before: Column) -> Column:
    return (
        F.when(kind == "I", insert_statement(table, new))
        .when(kind == "U", update_statement(table, new, where_before))
        .when(kind == "D", delete_statement(table, where_before))
    )


def reverse_statement(kind: Column, table: Column, old: Column, identity: Column, where_after: Column) -> Column:
    """The inverse; NULL where there is none. Only a full identity sends whole old images,
    any other one its key at most, and a value that was not sent can't be put back."""
    before = F.when((identity == FULL) & _whole(old), old)
    return (
        F.when(kind == "I", delete_statement(table, where_after))
        .when(kind == "U", update_statement(table, before, where_after))
        .when(kind == "D", insert_statement(table, before))
    )


def changed_columns(old: Column, new: Column, identity: Column, keys: Column) -> Column:
    """Names whose values differ between both images of an update, in the order of the new
    one; those that only the old one has come last.

    Unsent values count as unchanged. An old image that holds the key only is compared in
    the key only. Without both images the list is empty.
    """
    values = lambda image: F.map_from_entries(F.transform(image, lambda e: F.struct(e["name"], F.struct(e["kind"], F.coalesce(e["value"], F.lit(""))))))
    unsent = lambda v: F.coalesce(v["kind"] == KIND_UNCHANGED, F.lit(False))

    def differs(both: Column, name: Column) -> Column:
        x, y = F.try_element_at(both["before"], name), F.try_element_at(both["after"], name)
        return ~unsent(x) & ~unsent(y) & ~x.eqNullSafe(y)

    every = F.array_union(names(new), names(old))
    compared = F.when(identity.isin(*BY_KEY), F.filter(every, lambda n: F.array_contains(keys, n))).otherwise(every)
    both = F.struct(values(old).alias("before"), values(new).alias("after"))
    found = let(both, lambda b: F.filter(compared, lambda n: differs(b, n)))
    return F.coalesce(found, F.array().cast("array<string>"))
