"""Constraint audits: each returns the offending rows or keys with the rule's name."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Length bounds and stored operation codes.
TRAIL_LENGTHS = {"id": 255, "name": 255}
EVENT_LENGTHS = {"id": 255, "trail_id": 255, "type": 50}
OPERATIONS = ("I", "U", "D")

# Columns that may not be NULL.
REQUIRED = {
    "trails": ("id", "name", "created_at", "updated_at"),
    "events": ("id", "trail_id", "type", "occured_at", "sequence"),
    "wal_transaction": (
        "source_slot", "source_db", "xid", "commit_lsn", "commit_ts", "change_count", "safety_flags", "ingested_at",
    ),
    "wal_change": (
        "source_slot", "commit_lsn", "change_seq_in_txn", "schema_name", "table_name", "op", "changed_columns",
        "forward_dml_sql", "reverse_dml_sql", "affected_row_count", "undo_status", "safety_flags", "created_at",
    ),
    "wal_checkpoint": ("slot_name", "last_lsn", "updated_at"),
}


def duplicate_keys(rows: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    """Keys that occur more than once. Counts are reduced map-side, so copies do not gather."""
    return (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
        .withColumn("rule", F.lit(rule))
    )


def primary_key(rows: DataFrame, key: str, rule: str) -> DataFrame:
    """Keys that are repeated or NULL."""
    return (
        rows.groupBy(key)
        .agg(F.count(F.lit(1)).alias("copies"))
        .where((F.col("copies") > 1) | F.col(key).isNull())
        .withColumn("rule", F.lit(rule))
    )


def missing_parents(
    children: DataFrame, parents: DataFrame, child_keys: Sequence[str], parent_keys: Sequence[str], rule: str
) -> DataFrame:
    """Child rows whose parent does not exist."""
    known = parents.select(*[F.col(p).alias(c) for p, c in zip(parent_keys, child_keys)]).distinct()
    return children.join(known, list(child_keys), "left_anti").withColumn("rule", F.lit(rule))


def _broken(rows: DataFrame, tests: Mapping[str, Column], rule: str) -> DataFrame:
    """Rows once per column whose test holds; one narrow pass without a shuffle."""
    failed = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]), lambda c: c.isNotNull())
    return rows.withColumn("column", F.explode(failed)).withColumn("rule", F.lit(rule))


def nulls(rows: DataFrame, table: str) -> DataFrame:
    """Rows once per required column that is NULL; a column that is not there is NULL in every row."""
    absent = lambda c: F.col(c).isNull() if c in rows.columns else F.lit(True)
    return _broken(rows, {c: absent(c) for c in REQUIRED[table]}, f"{table}_not_null")


def too_long(rows: DataFrame, bounds: Mapping[str, int], rule: str) -> DataFrame:
    return _broken(rows, {c: F.char_length(F.col(c)) > n for c, n in bounds.items()}, rule)


def bad_operations(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("op").isNull() | ~F.col("op").isin(*OPERATIONS)).withColumn("rule", F.lit("op"))
