"""Committed transactions: roll-up, first-wins dedup, empty ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions.lsn import num_to_lsn
from annalist.operators.buckets import DEFAULT_BITS
from annalist.operators.changes import pieces


def by_segment(counted: DataFrame) -> DataFrame:
    """Every BEGIN with its COMMIT, if it has one, and the number of changes kept for it.

    ``counted``: from :func:`pieces`, one row per (segment, bucket), so a transaction of
    any size is one row per 2^bits positions. All aggregates are of numbers. ``carried``
    changes were stored by earlier micro-batches. Positions come out in their
    canonical text form; an empty or malformed one is NULL.
    """
    single = ("xid", "begin_lsn_num", "carried", "commit_pos", "commit_lsn_num", "commit_ts")
    return (
        counted.groupBy("slot", "begin_pos")
        .agg(*[F.max(c).alias(c) for c in single], F.sum("n").alias("n"))
        .withColumn("carried", F.coalesce("carried", F.lit(0)))
        .select(
            "slot",
            "begin_pos",
            "commit_pos",
            "xid",
            num_to_lsn(F.col("begin_lsn_num")).alias("begin_lsn"),
            num_to_lsn(F.col("commit_lsn_num")).alias("commit_lsn"),
            "begin_lsn_num",
            "commit_lsn_num",
            "commit_ts",
            (F.col("carried") + F.col("n")).alias("change_count"),
            "carried",
        )
    )


def committed(by_segment: DataFrame) -> DataFrame:
    """Committed, non-empty transactions. One whose position is no valid LSN is
    dropped, as nothing may be stored for it."""
    return by_segment.where((F.col("change_count") > 0) & F.col("commit_lsn_num").isNotNull())


def still_open(by_segment: DataFrame, begins: DataFrame) -> DataFrame:
    """Segments that may still be committed. ``begins``: from ``open_begins``, one row per slot."""
    ends = begins.select("slot", F.col("pos").alias("begin_pos"))
    return by_segment.where(F.col("commit_pos").isNull()).join(ends, ["slot", "begin_pos"], "left_semi")


def empty_transactions(log: DataFrame, bits: int = DEFAULT_BITS) -> DataFrame:
    """Committed transactions without a kept change: never stored, no checkpoint move."""
    empty = F.col("commit_pos").isNotNull() & (F.col("change_count") == 0)
    return by_segment(pieces(log, bits)).where(empty).select(
        "slot", "begin_pos", "xid", "begin_lsn", "commit_pos", "commit_lsn", "commit_ts"
    )


def transactions(log: DataFrame, bits: int = DEFAULT_BITS) -> DataFrame:
    """One row per committed, non-empty transaction, redeliveries included."""
    return committed(by_segment(pieces(log, bits)))


def first_deliveries(delivered: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Drop redeliveries: per (slot, commit position) the first to arrive wins.

    ``existing`` (source_slot, commit_lsn_num) holds what is stored already; it
    wins over everything delivered now. Copies are reduced by a partial
    aggregation, so any number of copies of one transaction is harmless.
    """
    # Numbers only, which aggregate without a sort; the texts are made of them again.
    texts = {"begin_lsn": num_to_lsn(F.col("begin_lsn_num")), "commit_lsn": num_to_lsn(F.col("commit_lsn_num"))}
    key = ("slot", "commit_lsn_num")
    numbers = [c for c in delivered.columns if c not in (*key, *texts)]
    first = (
        delivered.groupBy(*key)
        .agg(*[F.min_by(c, "commit_pos").alias(c) for c in numbers])
        .withColumns(texts)
        .select(*delivered.columns)
    )
    if existing is None:
        return first
    stored = existing.select(F.col("source_slot").alias("slot"), "commit_lsn_num")
    return first.join(stored, ["slot", "commit_lsn_num"], "left_anti")
