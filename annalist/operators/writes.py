"""Changing trails in batches: create, append, update, replace, delete.

Each function returns new table contents; nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions.clock import stamp
from annalist.operators.numbering import PIECE_ROWS, number_within
from annalist.operators.trails import EVENT_COLUMNS

ALREADY_EXISTS, NOT_FOUND = "already exists", "not found"


def create_trails(
    trails: DataFrame, requests: DataFrame, clock: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """New trails and refused requests.

    ``requests``: id, name, arrival. An id that exists, or that an earlier request
    of the same batch took, is refused. Requests for one id are reduced map-side.
    """
    created_at = stamp(clock)
    first = (
        requests.withColumn("created_at", created_at)
        .groupBy("id")
        .agg(F.min(F.struct("arrival", "name", "created_at")).alias("first"))
        .select("id", "first.*")
    )
    accepted = first.join(trails.select("id"), "id", "left_anti")
    # (id, arrival) names one request, so a much repeated id does not gather here.
    refused = requests.join(accepted.select("id", "arrival"), ["id", "arrival"], "left_anti")
    created = accepted.select(
        "id", "name", "created_at", F.col("created_at").alias("updated_at"), "arrival"
    )
    return created, refused.withColumn("reason", F.lit(ALREADY_EXISTS))


def initial_events(created: DataFrame, events: DataFrame) -> DataFrame:
    """Events that came with the create requests, kept only for trails that were created."""
    accepted = created.select(F.col("id").alias("trail_id"))
    return events.join(accepted, "trail_id", "left_semi").select(*EVENT_COLUMNS)


def known_and_unknown(requests: DataFrame, trails: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Split requests by whether their trail exists."""
    ids = trails.select(F.col("id").alias(key))
    return requests.join(ids, key, "left_semi"), requests.join(ids, key, "left_anti").withColumn(
        "reason", F.lit(NOT_FOUND)
    )


def lengths_of(events: DataFrame) -> DataFrame:
    return events.groupBy("trail_id").agg(F.count(F.lit(1)).alias("n"))


def appended_events(
    trails: DataFrame, lengths: DataFrame, pending: DataFrame, piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """Pending events of known trails, numbered after the events each trail already has.

    ``lengths``: trail_id, n. ``pending``: id, trail_id, type, payload, occured_at,
    arrival. The next number is count + 1, also where the stored sequences have gaps.
    """
    counts = lengths.withColumnRenamed("trail_id", "id")
    base = trails.select("id").join(counts, "id", "left").select(
        F.col("id").alias("trail_id"), F.coalesce(F.col("n"), F.lit(0)).alias("base")
    )
    placed = number_within(pending, ["trail_id"], [F.col("arrival"), F.col("id")], "place", piece_rows)
    return placed.join(base, "trail_id").select(
        *[c for c in EVENT_COLUMNS if c != "sequence"], (F.col("base") + F.col("place")).alias("sequence")
    )


def rejected_appends(trails: DataFrame, pending: DataFrame) -> DataFrame:
    return known_and_unknown(pending, trails, "trail_id")[1]


def append_events(
    trails: DataFrame, events: DataFrame, pending: DataFrame, piece_rows: int = PIECE_ROWS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All events after the append, the touched trails table, and the rejects."""
    added = appended_events(trails, lengths_of(events), pending, piece_rows)
    return (
        events.select(*EVENT_COLUMNS).unionByName(added),
        touch_trails(trails, pending),
        rejected_appends(trails, pending),
    )


def touch_trails(trails: DataFrame, pending: DataFrame) -> DataFrame:
    """Move ``updated_at`` to the last append, never back.

    Reads the pending events themselves, reduced map-side; those of unknown trails
    touch nothing.
    """
    last = pending.groupBy(F.col("trail_id").alias("id")).agg(F.max("occured_at").alias("last"))
    return trails.join(last, "id", "left").select(
        "id", "name", "created_at", F.greatest("updated_at", "last").alias("updated_at")
    )


def update_trails(
    trails: DataFrame, updates: DataFrame, clock: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """The trails table after updates, and the updates whose trail does not exist.

    ``updates``: id, name, arrival and any columns ``clock`` reads. Only the name
    changes; ``updated_at`` becomes the moment of the update whatever the update
    itself asks for; ``created_at`` stays. The last update of an id wins.
    """
    last = (
        updates.withColumn("moment", stamp(clock))
        .groupBy("id")
        .agg(F.max(F.struct("arrival", "name", "moment")).alias("last"))
    )
    touched = F.col("last").isNotNull()
    updated = trails.join(last, "id", "left").select(
        "id",
        F.when(touched, F.col("last.name")).otherwise(F.col("name")).alias("name"),
        "created_at",
        F.when(touched, F.col("last.moment")).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    return updated, known_and_unknown(updates, trails, "id")[1]


def replace_events(trails: DataFrame, events: DataFrame, replaced: DataFrame, new_events: DataFrame) -> DataFrame:
    """Events after replacing all events of the given trails (column ``id``).

    Unknown trails are not touched and get no events.
    """
    targets = replaced.select("id").distinct().join(trails.select("id"), "id", "left_semi")
    targets = targets.select(F.col("id").alias("trail_id"))
    kept = events.join(targets, "trail_id", "left_anti").select(*EVENT_COLUMNS)
    return kept.unionByName(new_events.join(targets, "trail_id", "left_semi").select(*EVENT_COLUMNS))


def cascade_delete(
    parents: DataFrame, children: DataFrame, deleted: DataFrame, parent_keys: list[str], child_keys: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Parents and children left after deleting parents; children go with their parent.

    ``deleted`` holds the parent keys to delete.
    """
    gone = deleted.select(*parent_keys).distinct()
    as_child = gone.toDF(*child_keys)
    return parents.join(gone, parent_keys, "left_anti"), children.join(as_child, child_keys, "left_anti")
