"""Stored events, laid out so that replaying some trails reads little and shuffles nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.operators.trails import EVENT_COLUMNS

#: Up to so many requested trails are looked up by name, which leaves out other buckets.
FEW = 1000


def write_events(events: DataFrame, table: str, path: str, n_buckets: int) -> None:
    """Write events as a table bucketed by trail and sorted by (trail, sequence)."""
    writer = events.select(*EVENT_COLUMNS).write.bucketBy(n_buckets, "trail_id").sortBy("trail_id", "sequence")
    writer.mode("overwrite").option("path", path).saveAsTable(table)


def replay_stored(spark: SparkSession, table: str, requests: DataFrame) -> DataFrame:
    """Events of the requested trails (trail_id, from_sequence; one row each) from there on.

    The requests go to the buckets of the events; the events are not shuffled. When there
    are few, their trails become a filter, by which Spark opens only their buckets and,
    inside these, only the row groups that can hold them. The result is in no order.
    """
    events, wanted = spark.table(table), requests.select("trail_id", "from_sequence").where(F.col("trail_id").isNotNull())
    some = [r["trail_id"] for r in wanted.select("trail_id").limit(FEW + 1).collect()]
    if len(some) <= FEW:
        events = events.where(F.col("trail_id").isin(some))
    return events.join(wanted.hint("shuffle_merge"), "trail_id").where(F.col("sequence") >= F.col("from_sequence")).select(*EVENT_COLUMNS)
