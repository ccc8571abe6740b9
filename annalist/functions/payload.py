"""Payload codec: JSON objects as text at rest.

A payload is a JSON object or nothing. SQL NULL and the JSON text ``null`` both
mean "no payload"; any other JSON value and any malformed text is an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OBJECT, NOTHING, ERROR = "object", "null", "error"


def as_text(payload: Column, data_type: str) -> Column:
    """Payloads may arrive as text or as UTF-8 bytes."""
    return F.decode(payload, "UTF-8") if data_type == "binary" else payload


def parsed(text: Column) -> Column:
    """The JSON value of the whole text as a variant, NULL when any part of it is malformed.

    The parser stops at the end of the first value and overlooks what follows. So the
    text is parsed once, inside a list that ends with the text's own digest, which must
    be found right after it: no text can bring its own end along.
    """
    mark = F.md5(text)
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')))
    whole = F.try_variant_get(listed, "$[1]", "string") == mark
    return F.when(whole, F.try_variant_get(listed, "$[0]", "variant"))


def class_of(value: Column, text: Column) -> Column:
    """The class of a text whose parsed value is given."""
    kind = F.schema_of_variant(value)
    return (
        F.when(text.isNull(), NOTHING)
        .when(kind.startswith("OBJECT"), OBJECT)
        .when(kind == "VOID", NOTHING)
        .otherwise(ERROR)
    )


def object_of(value: Column) -> Column:
    """A parsed value if it is an object."""
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def payload_class(text: Column) -> Column:
    return class_of(parsed(text), text)


def is_object(text: Column) -> Column:
    """Whether the class of a text is OBJECT; false for NULL. Parses the text once, and builds
    no schema: a well-formed value is an object if it begins like one."""
    mark = F.md5(text)
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')))
    begins = F.ltrim(text, F.lit(" \t\r\n")).startswith("{")
    return F.coalesce(begins & (F.try_variant_get(listed, "$[1]", "string") == mark), F.lit(False))


def decode_payload(text: Column) -> Column:
    """The payload as a variant object; NULL when there is none or it is an error.

    Each use parses the text. To use several outcomes, select ``parsed(text)`` first and
    take :func:`class_of` and :func:`object_of` of that.

    Repeated keys are an error unless ``spark.sql.variant.allowDuplicateKeys`` is
    on, as it is in sessions of :func:`annalist.session.build_session`; then the
    last one wins.
    """
    return object_of(parsed(text))


def encode_payload(fields: Column) -> Column:
    """Map or struct to JSON text; NULL in gives NULL out, null values are kept."""
    return F.to_json(fields, {"ignoreNullFields": "false"})
