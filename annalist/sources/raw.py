"""Change messages as they arrive, as JSON text per position, some of it undecodable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalist import schemas
from annalist.functions.payload import is_object
from annalist.operators.segments import CHANGE_KINDS, COMMIT, CONTROL_KINDS, RELATION, TRUNCATE
from annalist.sources.messages import normalize

_CORRUPT = "_corrupt_record"
# What the frame around a message says; the rest is in its text.
_OUTER = ("slot", "pos", "received_at")
_INNER = T.StructType([f for f in schemas.MESSAGES.fields if f.name not in _OUTER] + [T.StructField(_CORRUPT, T.StringType())])
KINDS = (*CONTROL_KINDS, RELATION, *CHANGE_KINDS, TRUNCATE)

MALFORMED, NO_KIND, INCOMPLETE = "malformed", "no kind", "incomplete"


def _parsed(raw: DataFrame) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    # The JSON reader overlooks text behind the message, which ``is_object`` does not.
    whole = raw.withColumn("is_object", is_object(F.col("payload")))
    # As a list of one that is taken apart, so that the text is parsed once and not again
    # wherever a field is used.
    return whole.withColumn("message", F.explode(F.array(F.from_json("payload", _INNER, options))))


def _reason() -> Column:
    """Why a message can't be used; NULL when it can."""
    part = lambda name: F.col(f"message.{name}")
    kind = part("kind")
    lacks = (
        (kind.isin(*CHANGE_KINDS, RELATION) & part("relation_id").isNull())
        | ((kind == RELATION) & part("columns").isNull())
        | (kind.isin(*CONTROL_KINDS) & part("lsn").isNull())
        | ((kind == COMMIT) & part("commit_ts").isNull())
    )
    return (
        F.when(F.col("payload").isNull() | ~F.col("is_object") | F.col("message").isNull() | part(_CORRUPT).isNotNull(), MALFORMED)
        .when(kind.isNull(), NO_KIND)
        .when(~kind.isin(*KINDS), F.concat(F.lit("unknown kind "), kind))
        .when(lacks, INCOMPLETE)
    )


def decode_messages(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The messages of raw rows (slot, pos, received_at, payload), and the rejected rows with
    their text and reason.

    A rejected message stays in the log, so positions have no gaps: with its kind if that
    is unknown, without any if it can't be told. It has no effect there, as a message that
    a reader logs and skips.
    """
    read = _parsed(raw).withColumn("reason", _reason())
    kind = F.when(F.col("reason").isNull() | F.col("reason").startswith("unknown kind"), F.col("message.kind"))
    usable = lambda f: F.when(F.col("reason").isNull(), F.col(f"message.{f.name}")).alias(f.name)
    inner = [f for f in _INNER.fields if f.name not in ("kind", _CORRUPT)]
    log = normalize(read.select(*_OUTER, kind.alias("kind"), *[usable(f) for f in inner]))
    return log, read.where(F.col("reason").isNotNull()).select("slot", "pos", "reason", "payload")
