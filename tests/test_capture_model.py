"""The capture against a sequential model, on random logs and with tiny buckets."""

import random

import pytest
from pyspark.sql import functions as F

from annalist.operators import buckets, changes, checkpoints, segments, transactions
from annalist.plans.capture import capture, capture_batch
from annalist.sources.store import Store
from logs import frame, message, model_changes, random_log, run_model, spark_changes, spark_transactions

SLOTS = 40


@pytest.fixture(scope="module")
def logs():
    return {f"slot_{i}": random_log(f"slot_{i}", seed=i) for i in range(SLOTS)}


@pytest.fixture(scope="module")
def expected(logs):
    results = [run_model(rows) for rows in logs.values()]
    return (
        sorted(repr(t) for r in results for t in r[0]),
        model_changes([c for r in results for c in r[1]]),
        sorted(s for r in results for s in r[2]),
        {slot: r[3] for slot, r in zip(logs, results)},
    )


@pytest.fixture(scope="module")
def log(spark, logs):
    rows = [m for rows in logs.values() for m in rows]
    random.Random(1).shuffle(rows)
    return frame(spark, rows).cache()


@pytest.mark.parametrize("bits", [2, 17])
def test_transactions_and_changes(log, expected, bits):
    stored, changed = capture(log, bits)
    assert expected[1], "the logs must exercise something"
    assert spark_transactions(stored) == expected[0]
    assert spark_changes(changed) == expected[1]


@pytest.mark.parametrize("bits", [3])
def test_checkpoints(spark, log, expected, bits):
    slots = log.select("slot").distinct()
    nothing = spark.createDataFrame([], "slot_name string, last_lsn string")
    loaded = checkpoints.load_checkpoints(slots, nothing)
    delivered = transactions.transactions(log, bits)
    saves = checkpoints.checkpoint_history(delivered, loaded, bits).collect()
    assert sorted((r.slot, r.pos, int(r.commit_lsn_num)) for r in saves) == expected[2]
    final = checkpoints.final_checkpoints(delivered, loaded).collect()
    assert {r.slot: int(r.last_lsn_num) for r in final} == expected[3]


def test_every_message_has_one_disposition(log, logs):
    rows = changes.dispositions(log, 3)
    assert rows.count() == sum(map(len, logs.values()))
    kinds = {r.kind: r.n for r in rows.groupBy("kind").agg(F.countDistinct("disposition").alias("n")).collect()}
    assert kinds["I"] == 3 and kinds["C"] == 2 and kinds["B"] == 1
    stats = changes.message_stats(log, 3).agg(F.sum("messages")).first()[0]
    assert stats == sum(map(len, logs.values()))


def test_segments_do_not_depend_on_buckets(log):
    small, large = segments.segments(log, 2), segments.segments(log, 30)
    assert sorted(map(repr, small.collect())) == sorted(map(repr, large.collect()))


def test_batches_equal_one_run(spark, tmp_path, logs, expected):
    """Logs cut anywhere, also inside transactions; one batch is repeated as a retry."""
    rng = random.Random(0)
    batches = [[], [], []]
    for rows in logs.values():
        cuts = sorted(rng.randrange(len(rows) + 1) for _ in range(2))
        for batch, (low, high) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
            batches[batch] += rows[low:high]
    store = Store(spark, str(tmp_path))
    for number, rows in enumerate(batches):
        capture_batch(store, frame(spark, rows), number, bits=3)
        if number == 1:
            capture_batch(store, frame(spark, rows), number, bits=3)
    assert spark_transactions(store.transactions()) == expected[0]
    assert spark_changes(store.changes()) == expected[1]
    marks = {r.slot_name: int(r.last_lsn_num) for r in store.checkpoints(2).collect()}
    assert marks == {slot: mark for slot, mark in expected[3].items() if mark}


def test_state_is_carried_over_runs_of_buckets(log, expected, monkeypatch):
    """Buckets of four positions in runs of two: what is carried crosses many runs."""
    monkeypatch.setattr(buckets, "RUN_BITS", 1)
    stored, changed = capture(log, bits=2)
    assert spark_transactions(stored) == expected[0]
    assert spark_changes(changed) == expected[1]
    small = segments.segments(log, 2)
    monkeypatch.undo()
    assert sorted(map(repr, small.collect())) == sorted(map(repr, segments.segments(log, 30).collect()))


def test_one_transaction_over_many_buckets(spark):
    """A transaction that fills most of the log is numbered without a gap."""
    rows = [message("s", 0, "R", relation_id=1, namespace="n", relation="t", columns=["a"])]
    rows += [message("s", 1, "B", xid=1, lsn="0/1")]
    rows += [message("s", 2 + i, "I", relation_id=1, new_tuple=[("t", str(i))]) for i in range(5000)]
    rows += [message("s", 6000, "C", lsn="0/9")]
    rows += [message("s", 6001, "I", relation_id=1, new_tuple=[("t", "orphan")])]
    stored, changed = capture(frame(spark, rows), bits=4)
    assert [r.change_count for r in stored.collect()] == [5000]
    got = changed.agg(F.min("change_seq_in_txn"), F.max("change_seq_in_txn"), F.countDistinct("change_seq_in_txn")).first()
    assert tuple(got) == (1, 5000, 5000)
    assert changed.where(F.col("new_row") != F.format_string('{"a":"%d"}', F.col("change_seq_in_txn") - 1)).count() == 0


def test_many_copies_of_one_transaction(spark):
    """A redelivered transaction is stored once, from its first delivery."""
    rows = [message("s", 0, "R", relation_id=1, namespace="n", relation="t", columns=["a"])]
    for copy in range(300):
        base = 10 + copy * 10
        rows.append(message("s", base, "B", xid=5, lsn="0/1"))
        rows.append(message("s", base + 1, "I", relation_id=1, new_tuple=[("t", str(copy))]))
        rows.append(message("s", base + 2, "C", lsn="0/9" if copy % 2 else "0/09"))
    stored, changed = capture(frame(spark, rows), bits=4)
    assert [(r.commit_lsn, r.begin_pos) for r in stored.collect()] == [("0/9", 10)]
    assert [r.new_row for r in changed.collect()] == ['{"a":"0"}']


def test_bad_commit_position_stores_nothing(spark):
    rows = [
        message("s", 0, "R", relation_id=1, namespace="n", relation="t", columns=["a"]),
        message("s", 1, "B", xid=5, lsn=""),
        message("s", 2, "I", relation_id=1, new_tuple=[("t", "x")]),
        message("s", 3, "C", lsn="nonsense"),
        message("s", 4, "B", xid=6, lsn=""),
        message("s", 5, "I", relation_id=1, new_tuple=[("t", "y")]),
        message("s", 6, "C", lsn="0/7"),
    ]
    stored, changed = capture(frame(spark, rows), bits=3)
    assert [(r.xid, r.begin_lsn) for r in stored.collect()] == [(6, None)]
    assert [r.new_row for r in changed.collect()] == ['{"a":"y"}']
