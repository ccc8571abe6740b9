"""From a change log to stored transactions, changes and checkpoints."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from annalist.functions.ids import batch_id
from annalist.operators.buckets import DEFAULT_BITS
from annalist.operators.changes import numbered_changes, pieces
from annalist.operators.checkpoints import final_checkpoints, stored_positions
from annalist.operators.defaults import SOURCE_DB, with_defaults
from annalist.operators.described import described_changes
from annalist.operators.position_filters import POSITIONS, attempts_holding, position_filter
from annalist.operators.segments import RELATION, STATE_COLUMNS, open_begins
from annalist.operators.transactions import by_segment, committed, first_deliveries, still_open
from annalist.session import kept, lean_writes
from annalist.sources.messages import normalize
from annalist.sources.store import CHANGES, MAIN, Store


def together(spark: SparkSession, *jobs: Callable[[], object]) -> None:
    """Run independent Spark jobs side by side, so that small ones fill the gaps of large
    ones. All have ended when this returns; the first failure is raised then."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
    for job in running:
        job.result()


def transaction_rows(
    chosen: DataFrame, clock: Column | None = None, source_db: str = SOURCE_DB, batch: Column | None = None
) -> DataFrame:
    """``batch``: the id of the batch that stores them, which else stays NULL."""
    rows = chosen.select(
        F.lit(None).cast("string").alias("ingest_batch_id") if batch is None else batch.alias("ingest_batch_id"),
        F.col("slot").alias("source_slot"),
        F.lit(source_db).alias("source_db"),
        "xid",
        "begin_lsn",
        "commit_lsn",
        "commit_lsn_num",
        "commit_ts",
        F.col("change_count").cast("int").alias("change_count"),
        "begin_pos",
    )
    return with_defaults(rows, "wal_transaction", clock)


def counted_pieces(log: DataFrame, bits: int = DEFAULT_BITS) -> DataFrame:
    """The log's changes counted in one pass over narrow columns, one row per segment and
    bucket, kept in the scratch folder for all that is made of them."""
    return kept(pieces(log, bits), "counted")


def decoded_once(log: DataFrame) -> DataFrame:
    """What the state of messages is found from, kept in the scratch folder: the steps read it
    several times, and would decode the messages each time."""
    return kept(log.select(*STATE_COLUMNS), "decoded")


def delivered_transactions(log: DataFrame, bits: int = DEFAULT_BITS) -> DataFrame:
    """All committed, non-empty transactions of a log, redeliveries included, for callers
    that use them more than once."""
    return committed(by_segment(counted_pieces(log, bits)))


def capture(log: DataFrame, bits: int = DEFAULT_BITS) -> tuple[DataFrame, DataFrame]:
    """Transactions and numbered changes of a whole log, nothing stored before."""
    counted = counted_pieces(log, bits)
    chosen = first_deliveries(committed(by_segment(counted)))
    return transaction_rows(chosen), numbered_changes(log, chosen, counted, bits)


def describe(log: DataFrame, bits: int = DEFAULT_BITS) -> DataFrame:
    """The changes of a whole log with keys, statements, hashes and flags."""
    counted = counted_pieces(log, bits)
    return described_changes(log, first_deliveries(committed(by_segment(counted))), counted, bits)


def suspected_batches(store: Store, delivered: DataFrame, loaded: DataFrame, entries: Sequence[Row]) -> list[Row]:
    """The batches that may hold a transaction which is delivered again.

    Only positions up to a slot's checkpoint can be stored already. They are held against
    the ranges and filters of the batches; the transactions are not read.
    """
    suspects = delivered.join(loaded, "slot").where(F.col("commit_lsn_num") <= F.col("last_lsn_num"))
    found = attempts_holding(suspects, store.read("positions", POSITIONS, entries))
    names = {r["attempt"] for r in found.collect()}  # of batches, not of rows
    return [e for e in entries if e["attempt"] in names]


def _stored_before(store: Store, delivered: DataFrame, loaded: DataFrame, entries: Sequence[Row]) -> DataFrame | None:
    """What the store holds, as far as a delivery of this batch could repeat it."""
    held = suspected_batches(store, delivered, loaded, entries) if entries else []
    return store.transactions(held) if held else None


def _state(log: DataFrame, begins: DataFrame, opened: DataFrame) -> DataFrame:
    """What the next batch must know: open BEGINs with their stored changes, and the
    latest message per relation. One row per slot and one per known relation."""
    fields = [c for c in log.columns if c not in ("slot", "relation_id", "pos")]
    stored = opened.select("slot", F.col("begin_pos").alias("pos"), F.col("change_count").alias("carried"))
    relations = (
        log.where(F.col("kind") == RELATION)
        .groupBy("slot", "relation_id")
        .agg(F.max(F.struct("pos", *fields)).alias("last"))
        .select("slot", "relation_id", "last.*")
    )
    return relations.unionByName(begins.join(stored, ["slot", "pos"], "left"), allowMissingColumns=True).select(
        *log.columns
    )


def _saved(final: DataFrame, stored: DataFrame, clock: Column | None) -> DataFrame:
    """The checkpoint table after a batch. A slot is saved, and stamped, only when its
    position grew; any other keeps its row."""
    old = stored.select("slot_name", F.col("last_lsn_num").alias("old"), F.col("updated_at").alias("since"))
    rows = final.withColumnRenamed("slot", "slot_name").join(old, "slot_name", "left")
    kept = F.when(F.col("last_lsn_num") <= F.col("old"), F.col("since"))
    return with_defaults(rows.withColumn("updated_at", kept), "wal_checkpoint", clock)


def capture_batch(
    store: Store,
    messages: DataFrame,
    batch: int,
    bits: int = DEFAULT_BITS,
    clock: Column | None = None,
    run: str = MAIN,
    source_db: str = SOURCE_DB,
    described: bool = False,
) -> None:
    """Store one batch of messages, continuing from the batch before it in the same run.

    ``described`` fills keys, statements, hashes and flags of the changes, and the batch id
    of the transactions, which stay at their defaults otherwise.

    A transaction left open is stored as far as it has come and finished by a
    later batch, so the work of a batch depends on its own messages only. Its
    changes stay invisible until its transaction row exists.

    The first batch of a run starts as a new connection does: nothing is open and no
    relation is known, as the source sends both again, but the stored checkpoints and
    transactions count, so what is stored is not stored twice. A batch that
    is published already is left as it is.
    """
    with lean_writes(store.spark):
        _capture_batch(store, messages, batch, bits, clock, run, source_db, described)


def _capture_batch(
    store: Store, messages: DataFrame, batch: int, bits: int, clock: Column | None, run: str, source_db: str, described: bool
) -> None:
    published = store.published()
    entries = {(e["run"], e["batch"]): e["attempt"] for e in published}
    if (run, batch) in entries:
        return
    # The state leads the union, so the batch runs with the settings of the store's
    # session; a stream's own session may have adaptive execution switched off.
    if batch > 0:
        state = store.attempt("state", entries[run, batch - 1]).select(*messages.columns)
    else:
        state = normalize(store.spark.range(0).drop("id"))
    attempt = store.begin(run, batch)
    log = state.unionByName(messages)
    # Kept for the steps below, which would otherwise each read the log again.
    counted = store.write(pieces(log, bits), "segments", attempt)
    segments = by_segment(counted)
    begins = open_begins(log)
    opened = still_open(segments, begins)
    delivered = committed(segments)
    stored = store.checkpoints()
    loaded = stored_positions(stored)
    fresh = first_deliveries(delivered, _stored_before(store, delivered, loaded, published))

    # A change whose commit is known by now is stored finished, any other open.
    numbered = (described_changes if described else numbered_changes)(log, fresh.unionByName(opened), counted, bits)
    changes = with_defaults(numbered, "wal_change", clock).select(
        "*", F.lit(run).alias("run"), F.col("commit_lsn").isNotNull().alias("finished")
    )
    closing = fresh.where("carried > 0").select(
        F.lit(run).alias("run"), F.col("slot").alias("source_slot"), "begin_pos", "commit_lsn"
    )

    def transactions_and_positions() -> None:
        written = store.write(transaction_rows(fresh, clock, source_db, batch_id(run, batch) if described else None), "wal_transaction", attempt)
        positions = written.select(F.col("source_slot").alias("slot"), "commit_lsn_num")
        store.write(position_filter(positions, attempt), "positions", attempt)

    together(
        store.spark,
        lambda: store.write(changes, CHANGES, attempt, "finished"),
        transactions_and_positions,
        lambda: store.write(closing, "closing", attempt),
        lambda: store.write(_saved(final_checkpoints(delivered, loaded), stored, clock), "wal_checkpoint", attempt),
        lambda: store.write(_state(log, begins, opened), "state", attempt),
    )
    store.publish(run, batch, attempt)
    if batch > 1:
        store.forget_carried(run, batch - 2)
