"""Column defaults of the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist import schemas
from annalist.functions.clock import stamp

# The database whose changes are captured.
SOURCE_DB = "traildb"

# Defaults by table; any other absent column is NULL.
_EMPTY = "array()"
DEFAULTS = {
    "trails": {"created_at": "now", "updated_at": "now"},
    "events": {"occured_at": "now"},
    "wal_transaction": {"change_count": 0, "safety_flags": _EMPTY, "ingested_at": "now"},
    "wal_change": {
        "changed_columns": _EMPTY,
        "forward_dml_sql": "",
        "reverse_dml_sql": "",
        "affected_row_count": 1,
        "undo_status": "not_applied",
        "safety_flags": _EMPTY,
        "created_at": "now",
    },
    "wal_checkpoint": {"updated_at": "now"},
}


SCHEMAS = {
    "trails": schemas.TRAILS,
    "events": schemas.EVENTS,
    "wal_transaction": schemas.WAL_TRANSACTION,
    "wal_change": schemas.WAL_CHANGE,
    "wal_checkpoint": schemas.WAL_CHECKPOINT,
}


def with_defaults(rows: DataFrame, table: str, clock: Column | None = None) -> DataFrame:
    """All columns of the table in order; absent or NULL ones take their default."""
    present = set(rows.columns)

    def default(name: str) -> Column | None:
        if name not in DEFAULTS[table]:
            return None
        value = DEFAULTS[table][name]
        if value == "now":
            return stamp(clock)
        return F.array().cast("array<string>") if value == _EMPTY else F.lit(value)

    def filled(field) -> Column:
        given = F.col(field.name) if field.name in present else None
        fallback = default(field.name)
        if given is None:
            value = F.lit(None) if fallback is None else fallback
        else:
            value = given if fallback is None else F.coalesce(given, fallback)
        return value.cast(field.dataType).alias(field.name)

    return rows.select(*[filled(f) for f in SCHEMAS[table].fields])
