"""The trail operations as batch functions over tables of requests.

Each takes the current tables and one table of requests and returns what was done
and what was refused, with the reason.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.operators import trails as reading
from annalist.operators import writes


@dataclass(frozen=True)
class Outcome:
    done: DataFrame
    refused: DataFrame


def create_trails(trails: DataFrame, requests: DataFrame, clock: Column | None = None) -> Outcome:
    """``requests``: id, name, arrival. Any name will do, also an empty one."""
    return Outcome(*writes.create_trails(trails, requests, clock))


def list_trails(trails: DataFrame, events: DataFrame) -> Outcome:
    """The documents of all trails, newest first, in fragments with created_at beside them,
    and the trails refused for an unreadable payload."""
    fragments, refused = reading.export_trails(trails, events)
    dated = fragments.join(trails.select("id", "created_at"), "id")
    return Outcome(dated.orderBy(F.desc("created_at"), "id", "section", "sequence", "event_id"), refused)


def get_trails(trails: DataFrame, events: DataFrame, requests: DataFrame) -> Outcome:
    """``requests``: id. The documents of the requested trails in fragments. Only their
    events are read; unknown and unreadable trails are refused."""
    wanted = requests.select("id").distinct()
    found = trails.join(wanted, "id", "left_semi")
    theirs = events.join(found.select(F.col("id").alias("trail_id")), "trail_id", "left_semi")
    _, missing = writes.known_and_unknown(wanted, trails, "id")
    fragments, refused = reading.export_trails(found, theirs)
    return Outcome(fragments, missing.unionByName(refused))


@dataclass(frozen=True)
class Changed:
    """What a change did to the two tables, and what it refused."""

    trails: DataFrame
    events: DataFrame
    refused: DataFrame


def append_events(trails: DataFrame, events: DataFrame, requests: DataFrame) -> Changed:
    """``requests``: id, trail_id, type, payload, occured_at, arrival.

    ``events`` of the result are those that were added, with their numbers; what is
    stored already is counted and nothing else. ``trails`` is the table with the
    appended ones touched.
    """
    added = writes.appended_events(trails, writes.lengths_of(events), requests)
    return Changed(writes.touch_trails(trails, requests), added, writes.rejected_appends(trails, requests))


def update_trails(
    trails: DataFrame, events: DataFrame, updates: DataFrame, new_events: DataFrame, clock: Column | None = None
) -> Changed:
    """Set the name of each updated trail and put ``new_events`` in place of its events.

    ``updates``: id, name, arrival. A trail without new events has none afterwards. An
    update of an unknown trail changes nothing, and neither do events given for it or
    for a trail that is not updated.
    """
    updated, refused = writes.update_trails(trails, updates, clock)
    return Changed(updated, writes.replace_events(trails, events, updates, new_events), refused)


def replay_trails(trails: DataFrame, events: DataFrame, requests: DataFrame) -> Outcome:
    """``requests``: trail_id, from_text, one per trail. An unreadable start is noticed
    before an unknown trail."""
    args = reading.parse_replay_args(requests)
    valid = args.where(F.col("status") == reading.ACCEPTED)
    known, unknown = writes.known_and_unknown(valid, trails, "trail_id")
    refused = (
        args.where(F.col("status") != reading.ACCEPTED)
        .select("trail_id", "from_text", F.col("status").alias("reason"))
        .unionByName(unknown.select("trail_id", "from_text", "reason"))
    )
    return Outcome(reading.replay(events, known), refused)
