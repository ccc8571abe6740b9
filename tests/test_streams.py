"""Streams give what one batch run gives, also when stopped and resumed."""

import random

from annalist import schemas
from annalist.plans.capture import capture
from annalist.sources.messages import read_message_stream
from annalist.sources.store import Store
from annalist.streaming import append_stream
from annalist.streaming.capture_stream import start_capture
from logs import frame, random_log, spark_changes, spark_transactions
from test_trails import make_events, make_pending, make_trails


def test_capture_stream(spark, tmp_path):
    rng = random.Random(5)
    logs = [random_log(f"s{i}", seed=100 + i, size=60) for i in range(8)]
    cuts = [rng.randrange(60) for _ in logs]
    steps = [[m for log, c in zip(logs, cuts) for m in log[:c]], [m for log, c in zip(logs, cuts) for m in log[c:]]]
    store = Store(spark, str(tmp_path / "store"))
    arriving, progress = str(tmp_path / "in"), str(tmp_path / "progress")
    for step in steps:
        frame(spark, step).write.mode("append").parquet(arriving)
        start_capture(read_message_stream(spark, arriving), store, progress, bits=4, once=True).awaitTermination()
    stored, changed = capture(frame(spark, [m for log in logs for m in log]))
    assert spark_transactions(store.transactions()) == spark_transactions(stored)
    assert spark_changes(store.changes()) == spark_changes(changed)


def test_append_stream(spark, tmp_path, monkeypatch):
    """Numbers go on over batches, also past the point where lengths are summed up."""
    monkeypatch.setattr(append_stream, "FULL_EVERY", 2)
    store = Store(spark, str(tmp_path / "store"))
    append_stream.prepare(store, make_events(spark, ("a", 1), ("a", 2)))
    arriving, progress = str(tmp_path / "in"), str(tmp_path / "progress")
    known = make_trails(spark, "a", "b")
    for step in range(4):
        rows = [(f"{t}{step}{i}", t, "x", None, step * 10 + i) for t in ("a", "b", "missing") for i in range(2)]
        make_pending(spark, *rows).write.mode("append").parquet(arriving)
        pending = spark.readStream.schema(schemas.PENDING).parquet(arriving)
        append_stream.start_append(pending, known, store, progress, once=True).awaitTermination()
    got = {(r.trail_id, r.sequence): r.id for r in append_stream.appended(store).collect()}
    assert [got["a", s] for s in range(3, 11)] == [f"a{step}{i}" for step in range(4) for i in range(2)]
    assert [got["b", s] for s in range(1, 9)] == [f"b{step}{i}" for step in range(4) for i in range(2)]
    assert len(got) == 16
