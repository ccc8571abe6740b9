"""Running transaction state over the message log.

BEGIN opens a segment and silently drops one that is still open; COMMIT closes
the open segment and is ignored when there is none; the last segment of a log
may stay open. A change belongs to the last control message before it, and only
if that is a BEGIN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions.lsn import lsn_to_num, num_to_lsn
from annalist.operators.buckets import (
    BUCKET,
    DEFAULT_BITS,
    SEED,
    bucket_of,
    carries,
    first_after,
    last_before,
    seeds,
)

# Message kinds.
BEGIN, COMMIT, RELATION, TRUNCATE = "B", "C", "R", "T"
CHANGE_KINDS = ("I", "U", "D")
CONTROL_KINDS = (BEGIN, COMMIT)

COMMITTED, DISCARDED, OPEN, STRAY_COMMIT = "committed", "discarded", "open", "stray_commit"


def control() -> Column:
    """A control message's values; NULL on other rows."""
    return F.when(
        F.col("kind").isin(*CONTROL_KINDS),
        F.struct("pos", "kind", "lsn", "commit_ts"),
    )


def segments(log: DataFrame, bits: int = DEFAULT_BITS) -> DataFrame:
    """One row per BEGIN with its outcome, and one per COMMIT that closed nothing.

    Reads control messages only.
    """
    controls = log.where(F.col("kind").isin(*CONTROL_KINDS)).select(
        "slot", "pos", "kind", "xid", "lsn", "commit_ts"
    )
    carried = carries(controls, ["slot"], "pos", control(), bits, closing=True)
    rows = (
        controls.withColumn(BUCKET, bucket_of(F.col("pos"), bits))
        .withColumn("control", control())
        .withColumn(SEED, F.lit(False))
        .unionByName(seeds(carried, ["slot"], "pos", "control", bits, closing=True), allowMissingColumns=True)
        .withColumn("before", last_before("control", "pos", "slot", BUCKET))
        .withColumn("after", first_after("control", "pos", "slot", BUCKET))
        .where(~F.col(SEED))
    )
    opened = F.col("kind") == BEGIN
    closed = opened & (F.col("after.kind") == COMMIT)
    stray = ~opened & (F.coalesce(F.col("before.kind"), F.lit(COMMIT)) == COMMIT)
    return rows.where(opened | stray).select(
        "slot",
        F.col("pos").alias("begin_pos"),
        F.when(opened, F.col("xid")).alias("xid"),
        F.when(opened, F.col("lsn")).alias("begin_lsn"),
        F.when(closed, F.col("after.pos")).alias("commit_pos"),
        F.when(closed, F.col("after.lsn")).when(~opened, F.col("lsn")).alias("commit_lsn"),
        F.when(closed, F.col("after.commit_ts")).when(~opened, F.col("commit_ts")).alias("commit_ts"),
        F.when(~opened, STRAY_COMMIT)
        .when(F.col("after").isNull(), OPEN)
        .when(closed, COMMITTED)
        .otherwise(DISCARDED)
        .alias("state"),
    )


def open_begins(log: DataFrame) -> DataFrame:
    """The BEGIN each slot ends with, if its last control message is one. Its position
    text comes in canonical form; a malformed one is NULL."""
    latest = lambda c: F.max_by(c, "pos")  # noqa: E731  numbers only, which aggregate without a sort
    return (
        log.where(F.col("kind").isin(*CONTROL_KINDS))
        .groupBy("slot")
        .agg(
            F.max("pos").alias("pos"),
            latest(F.col("kind") == BEGIN).alias("opened"),
            latest(F.col("xid")).alias("xid"),
            latest(lsn_to_num(F.col("lsn"))).alias("lsn_num"),
        )
        .where("opened")
        .select("slot", "pos", F.lit(BEGIN).alias("kind"), "xid", num_to_lsn(F.col("lsn_num")).alias("lsn"))
    )


def control_code() -> Column:
    """Position and kind of a control message as one growing number: odd for BEGIN.

    One number is cheaper to aggregate and to carry along every row than a struct.
    """
    code = F.shiftleft("pos", 1) + (F.col("kind") == BEGIN).cast("bigint")
    return F.when(F.col("kind").isin(*CONTROL_KINDS), code)


def in_segment() -> Column:
    """Whether the last control message before the row is a BEGIN."""
    return F.coalesce(F.col("before") % 2 == 1, F.lit(False))


def begin_position() -> Column:
    return F.shiftright("before", 1)


# What the state of a message is found from.
STATE_COLUMNS = ("slot", "pos", "kind", "relation_id", "xid", "lsn", "commit_ts", "carried")


def with_segment_state(log: DataFrame, bits: int = DEFAULT_BITS) -> DataFrame:
    """Add ``before``, the code of the last control message before each message, and
    ``known``, the position of the latest earlier message about its relation; NULL
    when there is none. Relations outlive transactions.

    The log is shuffled once, by (slot, bucket), and whatever groups by
    (slot, bucket, ...) downstream reuses that partitioning. Tuples and column lists
    stay behind.
    """
    log = log.select(*STATE_COLUMNS)
    announced = F.when(F.col("kind") == RELATION, F.col("pos"))
    of_relation = ["slot", "relation_id"]
    related = log.where(F.col("kind").isin(RELATION, *CHANGE_KINDS))
    controls = carries(log, ["slot"], "pos", control_code(), bits)
    versions = carries(related, of_relation, "pos", announced, bits)
    rows = (
        log.withColumn(BUCKET, bucket_of(F.col("pos"), bits))
        .withColumn("control", control_code())
        .withColumn("version", announced)
        .withColumn(SEED, F.lit(False))
        .unionByName(seeds(controls, ["slot"], "pos", "control", bits), allowMissingColumns=True)
        .unionByName(seeds(versions, of_relation, "pos", "version", bits), allowMissingColumns=True)
        .repartition("slot", BUCKET)
    )
    known = last_before("version", "pos", "slot", BUCKET, "relation_id")
    return (
        rows.withColumn("known", F.when(F.col("kind").isin(*CHANGE_KINDS), known))
        .withColumn("before", last_before("control", "pos", "slot", BUCKET))
        .where(~F.col(SEED))
        .drop("control", "version")
    )
