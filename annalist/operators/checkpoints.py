"""Checkpoints: the highest stored commit position per slot, never moving back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions.clock import stamp
from annalist.functions.lsn import LSN_NUM_TYPE, lsn_to_num, lsn_to_num_strict, num_to_lsn
from annalist.operators.buckets import BEFORE_ROW, BUCKET, DEFAULT_BITS, SEED, below, bucket_of, carries
from annalist.operators.segments import COMMITTED, segments


def stored_positions(stored: DataFrame) -> DataFrame:
    """slot, last_lsn_num of the stored checkpoints; malformed text fails the job."""
    return stored.select(F.col("slot_name").alias("slot"), lsn_to_num_strict(F.col("last_lsn")).alias("last_lsn_num"))


def load_checkpoints(slots: DataFrame, stored: DataFrame) -> DataFrame:
    """Position to resume from per slot: 0 without a checkpoint, malformed text fails the job."""
    known = stored_positions(stored).withColumnRenamed("last_lsn_num", "stored")
    return slots.select("slot").distinct().join(known, "slot", "left").select(
        "slot", F.coalesce(F.col("stored"), F.lit(0).cast(LSN_NUM_TYPE)).alias("last_lsn_num")
    )


def upsert_checkpoints(stored: DataFrame, saves: DataFrame, clock: Column | None = None) -> DataFrame:
    """New checkpoint table: the latest save per slot replaces what was stored.

    ``saves``: slot_name, last_lsn, arrival. There is no guard against moving
    back here; callers save only what :func:`checkpoint_history` lets through.
    """
    old = stored.select("slot_name", "last_lsn", "updated_at", F.lit(None).cast("bigint").alias("arrival"))
    new = saves.select("slot_name", "last_lsn", stamp(clock).alias("updated_at"), "arrival")
    newest = F.max(F.struct("arrival", "last_lsn", "updated_at")).alias("newest")
    return (
        old.unionByName(new)
        .groupBy("slot_name")
        .agg(newest)
        .select(
            "slot_name",
            "newest.last_lsn",
            lsn_to_num(F.col("newest.last_lsn")).alias("last_lsn_num"),
            "newest.updated_at",
        )
    )


def final_checkpoints(delivered: DataFrame, loaded: DataFrame) -> DataFrame:
    """Largest commit position of the non-empty transactions, at least the loaded one.

    Redeliveries count too: storing them succeeded without effect.
    """
    reached = delivered.groupBy("slot").agg(F.max("commit_lsn_num").alias("reached"))
    number = F.greatest(F.col("reached"), F.col("last_lsn_num"), F.lit(0).cast(LSN_NUM_TYPE))
    return (
        loaded.join(reached, "slot", "full")
        .select("slot", number.cast(LSN_NUM_TYPE).alias("last_lsn_num"))
        .withColumn("last_lsn", num_to_lsn(F.col("last_lsn_num")))
    )


def checkpoint_history(delivered: DataFrame, loaded: DataFrame, bits: int = DEFAULT_BITS) -> DataFrame:
    """Every checkpoint save in arrival order: positions above all earlier ones and the loaded one.

    Running maximum by position buckets; the maximum of earlier buckets, carried in two
    levels, enters each bucket as a seed row.
    """
    rows = delivered.select("slot", F.col("commit_pos").alias("pos"), "commit_lsn_num")
    # A running maximum is no last value, but the running maxima are, and they grow.
    peaks = carries(rows, ["slot"], "pos", F.col("commit_lsn_num"), bits, peak=True)
    seeds = peaks.join(loaded.select("slot", "last_lsn_num"), "slot", "left").select(
        "slot",
        below(F.col(BUCKET), bits).alias("pos"),
        F.greatest("from_before", "last_lsn_num", F.lit(0).cast(LSN_NUM_TYPE)).alias("commit_lsn_num"),
        BUCKET,
        F.lit(True).alias(SEED),
    )
    rows = rows.withColumn(BUCKET, bucket_of(F.col("pos"), bits))
    seen = Window.partitionBy("slot", BUCKET).orderBy("pos").rowsBetween(*BEFORE_ROW)
    return (
        rows.withColumn(SEED, F.lit(False))
        .unionByName(seeds)
        .withColumn("highest", F.max("commit_lsn_num").over(seen))
        .where(~F.col(SEED) & (F.col("commit_lsn_num") > F.col("highest")))
        .select("slot", "pos", "commit_lsn_num", num_to_lsn(F.col("commit_lsn_num")).alias("last_lsn"))
    )


def resume(log: DataFrame, loaded: DataFrame, bits: int = DEFAULT_BITS) -> DataFrame:
    """Committed transactions a source sends again when started at the loaded position.

    The transaction at the checkpoint itself comes again; dedup absorbs it.
    ``loaded`` has one row per slot, from :func:`load_checkpoints`.
    """
    committed = segments(log, bits).where(F.col("state") == COMMITTED).drop("state")
    return (
        committed.withColumn("commit_lsn_num", lsn_to_num(F.col("commit_lsn")))
        .join(loaded, "slot")
        .where(F.col("commit_lsn_num") >= F.col("last_lsn_num"))
        .drop("last_lsn_num")
    )
