"""Change capture over a message stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from annalist.operators.buckets import DEFAULT_BITS
from annalist.operators.defaults import SOURCE_DB
from annalist.plans.capture import capture_batch
from annalist.sources.store import Store


def run_of(batch: DataFrame) -> str:
    """The id of the stream that hands over a batch. It is kept with the stream's progress,
    so a resumed stream goes on with its run, and one with new progress begins another."""
    found = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not found:
        raise ValueError("the batch does not come from a stream")
    return found


def start_capture(
    messages: DataFrame,
    store: Store,
    progress: str,
    bits: int = DEFAULT_BITS,
    once: bool = False,
    clock: Column | None = None,
    source_db: str = SOURCE_DB,
) -> StreamingQuery:
    """Run :func:`capture_batch` on every micro-batch.

    ``progress`` is Spark's checkpoint folder; it decides which messages a batch
    holds, so a batch that failed is repeated with the same messages. A failing batch
    stops the query instead of being skipped. With a new ``progress`` on an old store
    the source is read from its start; what is stored already is recognized by its
    commit position and stored no second time. ``once`` processes what is there and ends.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        capture_batch(store, batch, batch_id, bits, clock, run_of(batch), source_db)

    writer = messages.writeStream.foreachBatch(run).option("checkpointLocation", progress)
    return (writer.trigger(availableNow=True) if once else writer).start()
