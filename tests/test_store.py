"""The store over many batches, restarts at the stored position, and what is read for them."""

import random

import pytest
from pyspark.sql import functions as F

from annalist import schemas
from annalist.operators import position_filters
from annalist.operators.checkpoints import stored_positions
from annalist.operators.position_filters import POSITIONS, attempts_holding, position_filter
from annalist.operators.transactions import transactions
from annalist.plans.capture import capture, capture_batch, suspected_batches
from annalist.plans.resume import resume_capture
from annalist.sources import raw, store
from annalist.sources.event_table import replay_stored, write_events
from annalist.sources.log_index import LogIndex
from annalist.sources.store import Store
from annalist.streaming import append_stream
from logs import frame, lsn_text, message, random_log, spark_changes, spark_transactions
from test_plans import plan
from test_trails import make_events, make_pending, make_trails


def test_a_long_manifest_stays_small_and_loses_nothing(spark, tmp_path, monkeypatch):
    """An append store of two runs, over many summaries of the manifest."""
    monkeypatch.setattr(store, "SUMMARY_EVERY", 4)
    monkeypatch.setattr(append_stream, "FULL_EVERY", 5)
    kept = Store(spark, str(tmp_path / "store"))
    append_stream.prepare(kept, make_events(spark, ("a", 1)))
    known, sent = make_trails(spark, "a"), 0
    for run, batches in (("first", 9), ("second", 8)):
        for batch in range(batches):
            append_stream.append_batch(kept, known, make_pending(spark, (f"{run}{batch}", "a", "x", None, sent)), batch, run)
            sent += 1
            # A repeated batch changes nothing.
            append_stream.append_batch(kept, known, make_pending(spark, ("other", "a", "x", None, sent)), batch, run)
    got = {r.sequence: r.id for r in append_stream.appended(kept).collect()}
    assert [got[s] for s in sorted(got)] == [f"first{b}" for b in range(9)] + [f"second{b}" for b in range(8)]
    assert sorted(got) == list(range(2, 19))
    assert [e["place"] for e in kept.published()] == list(range(1, 19))
    assert len(kept._names("summary-")) == 2 and len(kept._names("entry-")) <= 2 * 4


def test_an_unfinished_entry_does_not_block_the_next(spark, tmp_path):
    kept = Store(spark, str(tmp_path / "store"))
    kept.publish("r", 0, "a0")
    (tmp_path / "store/manifest/entry-000000002/_temporary").mkdir(parents=True)
    kept.publish("r", 1, "a1")
    assert [e["attempt"] for e in kept.published()] == ["a0", "a1"]


def test_filters_name_every_batch_that_holds_a_position(spark, monkeypatch):
    monkeypatch.setattr(position_filters, "BITS_PER_POSITION", 12)
    rng = random.Random(3)
    held = {f"a{i}": {(f"s{rng.randrange(3)}", rng.randrange(10**6)) for _ in range(4000)} for i in range(4)}
    ddl = "slot string, commit_lsn_num decimal(20,0)"
    rows = lambda pairs: spark.createDataFrame([(s, n) for s, n in pairs], "slot string, n bigint").select("slot", F.col("n").cast("decimal(20,0)").alias("commit_lsn_num"))
    filters = spark.createDataFrame([], POSITIONS)
    for name, pairs in held.items():
        filters = filters.unionByName(position_filter(rows(pairs), name))
    filters = filters.unionByName(position_filter(spark.createDataFrame([], ddl), "nothing")).cache()
    every = set().union(*held.values())
    for pairs in ([next(iter(held["a2"]))], rng.sample(sorted(held["a1"]), 50), [("s0", 10**7)], [("elsewhere", 5)]):
        found = {r.attempt for r in attempts_holding(rows(pairs), filters).collect()}
        assert {a for a, p in held.items() if p & set(pairs)} <= found
    absent = [p for p in (("s1", rng.randrange(10**6)) for _ in range(4000)) if p not in every][:1000]
    one = filters.where("attempt = 'a0'")
    wrong = sum(attempts_holding(rows(absent[i : i + 20]), one).count() for i in range(0, 200, 20))
    assert wrong <= 6, "about 2 in 1000 positions pass for one that is there"


def batch_rows(slot, numbers, pos):
    rows = [message(slot, pos, "R", relation_id=1, namespace="s", relation="t", columns=["a"])]
    for i, n in enumerate(numbers):
        at = pos + 1 + 3 * i
        rows += [
            message(slot, at, "B", xid=n, lsn=lsn_text(n)),
            message(slot, at + 1, "I", relation_id=1, new_tuple=[("t", str(n))]),
            message(slot, at + 2, "C", lsn=lsn_text(n)),
        ]
    return rows


def test_one_old_redelivery_reads_one_batch(spark, tmp_path, monkeypatch):
    kept = Store(spark, str(tmp_path / "store"))
    for b in range(4):
        rows = [m for slot in ("x", "y") for m in batch_rows(slot, range(100 * b + 1, 100 * b + 20), 1000 * b)]
        capture_batch(kept, frame(spark, rows), b)
    again = frame(spark, batch_rows("y", [105, 500], 9000) + batch_rows("x", [501], 9000))
    entries = kept.published()
    held = suspected_batches(kept, transactions(again), stored_positions(kept.checkpoints()), entries)
    assert [e["batch"] for e in held] == [1]
    read = []
    before = Store.transactions
    monkeypatch.setattr(Store, "transactions", lambda self, entries=None: read.append([e["batch"] for e in entries]) or before(self, entries))
    capture_batch(kept, again, 4)
    assert read == [[1]]
    monkeypatch.undo()
    assert kept.transactions().where("source_slot = 'y'").count() == 4 * 19 + 1


# Restarts.


def landed(spark, tmp_path, n=8):
    """A landed log in files of position ranges, and all its messages."""
    logs = [random_log(f"s{i}", seed=900 + i, size=90) for i in range(5)]
    rows = [m for log in logs for m in log]
    end = max(m["pos"] for m in rows) + 1
    for i in range(n):
        step = [m for m in rows if m["pos"] * n // end == i]
        frame(spark, step).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    return rows, LogIndex(spark, str(tmp_path / "log"), str(tmp_path / "index"))


@pytest.mark.parametrize("cut", [0, 3, 8])
def test_resumed_capture_equals_one_run(spark, tmp_path, cut):
    rows, index = landed(spark, tmp_path)
    end = max(m["pos"] for m in rows) + 1
    kept = Store(spark, str(tmp_path / "store"))
    first = frame(spark, [m for m in rows if m["pos"] * 8 // end < cut])
    capture_batch(kept, first, 0, bits=4, run="first")
    name = resume_capture(kept, index, bits=4)
    # Commit positions of the random logs go up and down, so only what lies beyond the
    # checkpoint or comes before it in the log is asked for again.
    stored, changed = capture(frame(spark, rows))
    reached = {r.slot: r.last_lsn_num for r in stored_positions(kept.checkpoints()).collect()}
    assert reached
    if cut in (0, 8):
        assert spark_transactions(kept.transactions()) == spark_transactions(stored)
        assert spark_changes(kept.changes()) == spark_changes(changed)
    n = kept.transactions().count()
    assert resume_capture(kept, index, bits=4, run=name) == name and kept.transactions().count() == n


def test_a_restart_opens_only_files_beyond_the_checkpoint(spark, tmp_path):
    for i in range(10):  # one file each, commits in order
        frame(spark, batch_rows("x", range(10 * i + 1, 10 * i + 6), 100 * i)).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    index = LogIndex(spark, str(tmp_path / "log"), str(tmp_path / "index"))
    assert index.refresh() == 10 and index.refresh() == 0 and index.files().count() == 10
    loaded = spark.createDataFrame([("x", 72)], "slot string, last_lsn_num int")
    assert index.chosen_files(index.resume_points(loaded)).count() == 3
    messages = index.resumed_messages(loaded)
    assert {f.rsplit("/", 1)[1] for f in messages.inputFiles() if "/log/" in f} == {
        r.file.rsplit("/", 1)[1] for r in index.files().where("top_commit >= 72").collect()
    }
    # The relation is known although its message lies in a file that is not opened.
    assert sorted(r.xid for r in transactions(messages).collect()) == [n for i in (7, 8, 9) for n in range(10 * i + 1, 10 * i + 6)]
    assert messages.where("kind = 'R' and pos < 700").count() == 1
    beyond = spark.createDataFrame([("x", 10**6)], "slot string, last_lsn_num int")
    assert index.chosen_files(index.resume_points(beyond)).count() == 0
    assert index.chosen_files(index.resume_points(loaded.limit(0))).count() == 10


def test_a_restart_goes_back_to_an_open_begin(spark, tmp_path):
    whole = batch_rows("x", range(1, 6), 0) + [message("x", 50, "B", xid=9, lsn="0/9"), message("x", 51, "I", relation_id=1, new_tuple=[("t", "9")])]
    rest = [message("x", 60, "I", relation_id=1, new_tuple=[("t", "10")]), message("x", 61, "C", lsn="0/9")]
    for step in (whole, rest):
        frame(spark, step).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    index = LogIndex(spark, str(tmp_path / "log"), str(tmp_path / "index"))
    index.refresh()
    loaded = spark.createDataFrame([("x", 6)], "slot string, last_lsn_num int")
    assert index.resume_points(loaded).first().resume_pos == 50
    found = transactions(index.resumed_messages(loaded)).collect()
    assert [(r.xid, r.change_count) for r in found] == [(9, 2)]


# Undecodable input.


def test_rejects(spark):
    texts = [
        '{"kind":"B","xid":1,"lsn":"0/1"}', '{"kind":"B","xid":', None, "", "[]", "null", '{"xid":1}', '{"kind":"Q"}',
        '{"kind":"I","new_tuple":[]}', '{"kind":"C","lsn":"0/1"}', '{"kind":"R","relation_id":1}', '{"kind":"B","xid":"x","lsn":"0/1"}',
        '{"kind":"I","relation_id":1,"new_tuple":[{"kind":"t","value":"v"}],"more":1}', "{\"kind\":\"B\"} trailing",
    ]
    frame_ = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "slot string, pos bigint, payload string")
    log, rejected = raw.decode_messages(frame_.withColumn("received_at", F.lit(None).cast("timestamp_ntz")))
    reasons = {r.pos: r.reason for r in rejected.collect()}
    assert reasons == {
        1: "malformed", 2: "malformed", 3: "malformed", 4: "malformed", 5: "malformed", 6: "no kind", 7: "unknown kind Q",
        8: "incomplete", 9: "incomplete", 10: "incomplete", 11: "malformed", 13: "malformed",
    }
    assert {r.pos: r.payload for r in rejected.collect()}[1] == texts[1]
    kinds = {r.pos: r.kind for r in log.collect()}
    assert len(kinds) == len(texts) and kinds[0] == "B" and kinds[7] == "Q" and kinds[1] is None and kinds[8] is None
    assert log.schema == schemas.MESSAGES and log.where("pos = 12").first().new_tuple[0].value == "v"


# Stored events.


def test_replaying_few_trails_shuffles_no_events_and_opens_their_buckets(spark, tmp_path):
    ids = [f"t{i}" for i in range(40)]
    events = make_events(spark, *[(t, n) for t in ids for n in range(1, 6)])
    write_events(events, "replayed_events", str(tmp_path / "events"), 8)
    requests = spark.createDataFrame([("t3", 2), ("t7", 5), ("nothing", 1), (None, 1)], "trail_id string, from_sequence bigint")
    found = replay_stored(spark, "replayed_events", requests)
    text = plan(found)
    assert sorted((r.trail_id, r.sequence) for r in found.collect()) == [("t3", n) for n in range(2, 6)] + [("t7", 5)]
    scan = next(line for line in text.splitlines() if "replayed_events" in line or "FileScan" in line and "sequence" in line)
    assert "SelectedBucketsCount" in scan and "8 out of 8" not in scan
    # One shuffle, that of the requests: the events' side has a scan, a filter and at most a sort.
    assert text.count("Exchange hashpartitioning") == 1
    assert "Exchange" not in text[text.rindex("Sort [", 0, text.index("SelectedBucketsCount")) : text.index("SelectedBucketsCount")]
    spark.sql("DROP TABLE replayed_events")
