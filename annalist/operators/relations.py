"""Which version of its relation a change was written against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.operators.buckets import BUCKET, DEFAULT_BITS, SEED, bucket_of, carries, last_before, seeds
from annalist.operators.segments import CHANGE_KINDS, RELATION


def relation_version() -> Column:
    """A relation message's values; NULL on other rows.

    Whether column names repeat is settled here, once per relation message.
    """
    repeats = F.size(F.array_distinct("columns")) < F.size("columns")
    return F.when(
        F.col("kind") == RELATION, F.struct("pos", "namespace", "relation", "columns", repeats.alias("repeats"), "identity", "key_flags")
    )


def with_relations(log: DataFrame, bits: int = DEFAULT_BITS, markers: DataFrame | None = None) -> DataFrame:
    """Add ``known``: the latest earlier message about the change's relation, or NULL.

    An as-of lookup without a join: relation messages of earlier buckets enter as
    seed rows, and a window per relation finds the last one. The log is shuffled
    once, by (slot, bucket). ``markers`` travel in the same shuffle and stay.
    """
    of_relation = ["slot", "relation_id"]
    related = log.where(F.col("kind").isin(RELATION, *CHANGE_KINDS))
    # Positions alone are carried; what the few relation messages say is joined to them.
    announced = F.when(F.col("kind") == RELATION, F.col("pos"))
    carried = carries(related, of_relation, "pos", announced, bits)
    said = log.where(F.col("kind") == RELATION).select(
        *of_relation, F.col("pos").alias("announced"), relation_version().alias("version")
    )
    entering = seeds(carried, of_relation, "pos", "announced", bits).join(said, [*of_relation, "announced"]).drop("announced")
    rows = (
        log.withColumn(BUCKET, bucket_of(F.col("pos"), bits))
        .withColumn("version", relation_version())
        .withColumn(SEED, F.lit(False))
        .unionByName(entering, allowMissingColumns=True)
    )
    if markers is not None:
        rows = rows.unionByName(markers.withColumn(SEED, F.lit(False)), allowMissingColumns=True)
    rows = rows.repartition("slot", BUCKET)
    known = last_before("version", "pos", "slot", BUCKET, "relation_id")
    return (
        rows.withColumn("known", F.when(F.col("kind").isin(*CHANGE_KINDS), known))
        .where(~F.col(SEED))
        .drop("version", SEED)
    )


def relation_asof(log: DataFrame, bits: int = DEFAULT_BITS) -> DataFrame:
    """Change messages with the relation version valid at their position; unknown ones dropped."""
    log = log.select("slot", "pos", "kind", "relation_id", "namespace", "relation", "columns", "identity", "key_flags")
    return (
        with_relations(log, bits)
        .where(F.col("known").isNotNull())
        .select(
            "slot",
            "pos",
            "kind",
            "relation_id",
            F.col("known.pos").alias("relation_pos"),
            F.col("known.namespace").alias("schema_name"),
            F.col("known.relation").alias("table_name"),
            F.col("known.columns").alias("columns"),
        )
    )
