"""Row changes: what happens to each message, row images, numbering."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions.lsn import lsn_to_num
from annalist.functions.tuples import tuple_to_json
from annalist.operators.buckets import BEFORE_ROW, BUCKET, DEFAULT_BITS, below
from annalist.operators.relations import with_relations
from annalist.operators.segments import (
    BEGIN,
    CHANGE_KINDS,
    COMMIT,
    RELATION,
    TRUNCATE,
    begin_position,
    in_segment,
    with_segment_state,
)

KEPT, UNKNOWN_RELATION, NO_TRANSACTION = "change", "unknown_relation", "no_transaction"


def disposition() -> Column:
    """Outcome of a message, from the columns of ``with_segment_state``.

    An unknown relation is noticed before a missing transaction. Truncates and
    unknown kinds are reported but never stored and take no number.
    """
    kind = F.col("kind")
    return (
        F.when(kind.isNull(), "undecodable")
        .when(kind == BEGIN, "begin")
        .when((kind == COMMIT) & in_segment(), "commit")
        .when(kind == COMMIT, "commit_ignored")
        .when(kind == RELATION, "relation")
        .when(kind == TRUNCATE, "truncate")
        .when(~kind.isin(*CHANGE_KINDS), "unknown_kind")
        .when(F.col("known").isNull(), UNKNOWN_RELATION)
        .when(~in_segment(), NO_TRANSACTION)
        .otherwise(KEPT)
    )


def dispositions(log: DataFrame, bits: int = DEFAULT_BITS) -> DataFrame:
    return with_segment_state(log, bits).select(
        "slot", "pos", "kind", "relation_id", disposition().alias("disposition")
    )


def row_images(columns: Column, repeats: Column | None = None) -> tuple[Column, Column]:
    """Old and new image by kind: insert has new only, delete old only, update both.

    An update whose message carries no old tuple has a NULL old image.
    """
    kind = F.col("kind")
    old = F.when(kind.isin("U", "D"), tuple_to_json(columns, F.col("old_tuple"), repeats))
    new = F.when(kind.isin("I", "U"), tuple_to_json(columns, F.col("new_tuple"), repeats))
    return old, new


def pieces(log: DataFrame, bits: int = DEFAULT_BITS) -> DataFrame:
    """Per (segment, bucket): the kept changes counted, and what BEGIN and COMMIT say.

    A segment that lies inside one bucket is one row; one that crosses buckets is
    one row per bucket, whatever its size. Needs no shuffle beyond that of
    ``with_segment_state``; all values are numbers, so the counting is hashed.
    """
    kind = F.col("kind")
    kept, begins, ends = disposition() == KEPT, kind == BEGIN, (kind == COMMIT) & in_segment()
    lsn_num = lsn_to_num(F.col("lsn"))
    return (
        with_segment_state(log, bits)
        .where(kept | begins | ends)
        .groupBy("slot", BUCKET, F.when(begins, F.col("pos")).otherwise(begin_position()).alias("begin_pos"))
        .agg(
            F.count(F.when(kept, 1)).alias("n"),
            F.max(F.when(begins, F.col("xid"))).alias("xid"),
            F.max(F.when(begins, lsn_num)).alias("begin_lsn_num"),
            F.max(F.when(begins, F.col("carried"))).alias("carried"),
            F.max(F.when(ends, F.col("pos"))).alias("commit_pos"),
            F.max(F.when(ends, lsn_num)).alias("commit_lsn_num"),
            F.max(F.when(ends, F.col("commit_ts"))).alias("commit_ts"),
        )
    )


def markers(chosen: DataFrame, counted: DataFrame, bits: int) -> DataFrame:
    """One row per (chosen segment, bucket): at its BEGIN, or just before the bucket
    it continues in.

    ``chosen``: slot, begin_pos, commit_pos, commit_lsn, carried, change_count. ``counted``: from
    :func:`pieces`, the kept changes per bucket. ``first`` is how many changes come before.
    """
    earlier = Window.partitionBy("slot", "begin_pos").orderBy(BUCKET).rowsBetween(*BEFORE_ROW)
    return (
        counted.where(F.col("n") > 0)
        .select("slot", "begin_pos", BUCKET, "n")
        .join(chosen.select("slot", "begin_pos", "commit_pos", "commit_lsn", "carried", "change_count"), ["slot", "begin_pos"])
        .withColumn("first", F.col("carried") + F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .select(
            "slot",
            BUCKET,
            F.greatest("begin_pos", below(F.col(BUCKET), bits)).alias("pos"),
            F.struct("begin_pos", "commit_pos", "commit_lsn", "first", "change_count").alias("marker"),
        )
    )


def numbered_changes(
    log: DataFrame, chosen: DataFrame, counted: DataFrame, bits: int = DEFAULT_BITS, extra: Mapping[str, Column] | None = None
) -> DataFrame:
    """Row changes of the chosen segments with images and dense numbers from 1.

    ``extra``: more columns, over a change message and ``known``, its relation version; with
    them comes ``change_count``, the size of the change's transaction.

    The wide log is shuffled exactly once. Markers of the chosen segments travel in
    the same shuffle: a change belongs to the last marker before it if that segment
    is not over yet, and its number is the count of known changes since. So neither
    the choice of transactions nor the numbering joins anything with the changes.
    """
    rows = with_relations(
        log.where(F.col("kind").isin(RELATION, *CHANGE_KINDS)), bits, markers(chosen, counted, bits)
    ).where(F.col("marker").isNotNull() | F.col("known").isNotNull())
    # Images replace the tuples before the second window, whose rows stay small.
    old, new = row_images(F.col("known.columns"), F.col("known.repeats"))
    rows = rows.select(
        "slot",
        BUCKET,
        "pos",
        "marker",
        F.col("known.pos").alias("relation_pos"),
        F.col("known.namespace").alias("schema_name"),
        F.col("known.relation").alias("table_name"),
        F.col("relation_id").alias("table_oid"),
        F.col("kind").alias("op"),
        old.alias("old_row"),
        new.alias("new_row"),
        *[value.alias(name) for name, value in (extra or {}).items()],
    )
    more = [] if extra is None else [F.col("segment.change_count").alias("change_count"), *extra]
    so_far = (
        Window.partitionBy("slot", BUCKET).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    at_marker = F.when(F.col("marker").isNotNull(), F.struct("marker.*", "counted"))
    return (
        rows.withColumn("counted", F.count("relation_pos").over(so_far))
        .withColumn("segment", F.last(at_marker, ignorenulls=True).over(so_far))
        .where(F.col("relation_pos").isNotNull() & F.col("segment").isNotNull())
        .where(F.col("segment.commit_pos").isNull() | (F.col("pos") < F.col("segment.commit_pos")))
        .select(
            F.col("slot").alias("source_slot"),
            F.col("segment.commit_lsn").alias("commit_lsn"),
            F.col("segment.begin_pos").alias("begin_pos"),
            (F.col("segment.first") + F.col("counted") - F.col("segment.counted"))
            .cast("int")
            .alias("change_seq_in_txn"),
            "schema_name",
            "table_name",
            "table_oid",
            "op",
            "old_row",
            "new_row",
            "pos",
            *more,
        )
    )


def messages_with(outcome: str, log: DataFrame, bits: int = DEFAULT_BITS) -> DataFrame:
    return dispositions(log, bits).where(F.col("disposition") == outcome).drop("disposition")


def orphan_changes(log: DataFrame, bits: int = DEFAULT_BITS) -> DataFrame:
    """Changes of known relations that arrived with no transaction open."""
    return messages_with(NO_TRANSACTION, log, bits)


def unknown_relation_changes(log: DataFrame, bits: int = DEFAULT_BITS) -> DataFrame:
    """Changes that arrived before any message about their relation."""
    return messages_with(UNKNOWN_RELATION, log, bits)


def message_stats(log: DataFrame, bits: int = DEFAULT_BITS) -> DataFrame:
    return (
        dispositions(log, bits)
        .groupBy("slot", "kind", "disposition")
        .agg(F.count(F.lit(1)).alias("messages"))
    )
