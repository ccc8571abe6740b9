"""Appending events to trails from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from annalist import schemas
from annalist.operators.trails import EVENT_COLUMNS
from annalist.operators.writes import appended_events, lengths_of, rejected_appends
from annalist.sources.store import MAIN, Store
from annalist.streaming.capture_stream import run_of

# Lengths are kept as additions per batch and summed up after this many batches.
FULL_EVERY = 64

BASE = "base"  # the run that stands for the events stored before any stream
LENGTHS = schemas.table(trail_id=schemas.TEXT, n=schemas.LONG)
TOUCHED = schemas.table(trail_id=schemas.TEXT, last=schemas.TIME)


def _lengths(store: Store, entries: list[Row], only: DataFrame | None = None) -> DataFrame:
    """Length per trail after the given batches: the last full table and the additions
    since. ``only`` (trail_id) limits them to some trails, before they are summed up."""
    full = max((i for i, e in enumerate(entries) if e["place"] % FULL_EVERY == 0), default=-1)
    rows = store.read("lengths", LENGTHS, entries[full + 1 :])
    if full >= 0:
        rows = rows.unionByName(store.read("lengths_full", LENGTHS, [entries[full]]))
    if only is not None:
        rows = rows.join(only, "trail_id", "left_semi")
    return rows.groupBy("trail_id").agg(F.sum("n").alias("n"))


def _publish(store: Store, run: str, batch: int, attempt: str, entries: list[Row]) -> None:
    if store.next_place() % FULL_EVERY == 0:
        added = store.attempt("lengths", attempt)
        full = _lengths(store, entries).unionByName(added).groupBy("trail_id").agg(F.sum("n").alias("n"))
        store.write(full, "lengths_full", attempt)
    store.publish(run, batch, attempt)


def prepare(store: Store, events: DataFrame) -> None:
    """Start from the events stored so far; without effect on a store that has been prepared."""
    entries = store.published()
    if entries:
        return
    attempt = store.begin(BASE, 0)
    store.write(lengths_of(events).select("trail_id", "n"), "lengths", attempt)
    _publish(store, BASE, 0, attempt, entries)


def append_batch(store: Store, trails: DataFrame, pending: DataFrame, batch: int, run: str = MAIN) -> None:
    """Number one batch of pending events after everything appended before it.

    A published batch is not done again. In a run that begins on a store of another run,
    events that are stored already, known by their id, are not appended again.
    """
    entries = store.published()
    if any((e["run"], e["batch"]) == (run, batch) for e in entries):
        return
    attempt = store.begin(run, batch)
    others = [e for e in entries if e["run"] not in (run, BASE)]
    if others:
        pending = pending.join(store.read("events", schemas.EVENTS, others).select("id"), "id", "left_anti")
    touched = pending.select("trail_id").distinct()
    known = trails.join(touched.withColumnRenamed("trail_id", "id"), "id", "left_semi")
    added = appended_events(known, _lengths(store, entries, touched), pending)
    written = store.write(added.select(*schemas.EVENTS.fieldNames()), "events", attempt)
    store.write(rejected_appends(trails, pending), "rejects", attempt)
    store.write(lengths_of(written).select("trail_id", "n"), "lengths", attempt)
    store.write(written.groupBy("trail_id").agg(F.max("occured_at").alias("last")), "touched", attempt)
    _publish(store, run, batch, attempt, entries)


def appended(store: Store) -> DataFrame:
    return store.read("events", schemas.EVENTS).select(*EVENT_COLUMNS)


def touched_trails(store: Store, trails: DataFrame) -> DataFrame:
    """The trails as the appends left them: ``updated_at`` moved on, never back.

    The stored events are not read; each batch keeps the last moment per trail.
    """
    last = store.read("touched", TOUCHED).groupBy(F.col("trail_id").alias("id")).agg(F.max("last").alias("last"))
    return trails.join(last, "id", "left").select(
        "id", "name", "created_at", F.greatest("updated_at", "last").alias("updated_at")
    )


def start_append(
    pending: DataFrame, trails: DataFrame, store: Store, progress: str, once: bool = False
) -> StreamingQuery:
    """Run :func:`append_batch` on every micro-batch; a failing batch stops the query."""

    def run(batch: DataFrame, batch_id: int) -> None:
        append_batch(store, trails, batch, batch_id, run_of(batch))

    writer = pending.writeStream.foreachBatch(run).option("checkpointLocation", progress)
    return (writer.trigger(availableNow=True) if once else writer).start()
