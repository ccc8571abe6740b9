"""Checkpoint rules, case by case."""

import pytest
from pyspark.sql import functions as F

from annalist import schemas
from annalist.functions.lsn import lsn_to_num
from annalist.operators import checkpoints
from annalist.plans.capture import capture, capture_batch
from annalist.sources.store import Store
from logs import frame, message

STORED = "slot_name string, last_lsn string"
SLOTS = "slot string"


def delivered(spark, lsns, slot="test_slot"):
    rows = spark.createDataFrame([(slot, i, text) for i, text in enumerate(lsns)], "slot string, commit_pos bigint, text string")
    return rows.withColumn("commit_lsn_num", lsn_to_num(F.col("text")))


def loaded(spark, text=None, slot="test_slot"):
    stored = spark.createDataFrame([] if text is None else [(slot, text)], STORED)
    return checkpoints.load_checkpoints(spark.createDataFrame([(slot,)], SLOTS), stored)


def test_no_checkpoint_loads_zero(spark):
    assert [int(r.last_lsn_num) for r in loaded(spark).collect()] == [0]


def test_stored_checkpoint_loads(spark):
    assert [int(r.last_lsn_num) for r in loaded(spark, "0/16B3748").collect()] == [0x16B3748]


def test_malformed_checkpoint_fails(spark):
    with pytest.raises(Exception, match="malformed LSN"):
        loaded(spark, "bad").collect()


def test_saves_never_move_back(spark):
    """Lower and equal positions cause no save, higher ones do."""
    rows = delivered(spark, ["0/3000000", "0/2000000", "0/3000000", "0/4000000"])
    saves = checkpoints.checkpoint_history(rows, loaded(spark), bits=1).orderBy("pos").collect()
    assert [r.last_lsn for r in saves] == ["0/3000000", "0/4000000"]


def test_saves_start_above_the_loaded_position(spark):
    rows = delivered(spark, ["0/1", "0/5", "0/6"])
    assert [r.last_lsn for r in checkpoints.checkpoint_history(rows, loaded(spark, "0/5")).collect()] == ["0/6"]


def test_final_is_at_least_the_loaded_position(spark):
    rows = delivered(spark, ["0/3"])
    assert [r.last_lsn for r in checkpoints.final_checkpoints(rows, loaded(spark, "0/9")).collect()] == ["0/9"]
    assert [r.last_lsn for r in checkpoints.final_checkpoints(rows, loaded(spark)).collect()] == ["0/3"]
    assert [r.last_lsn for r in checkpoints.final_checkpoints(rows.where("false"), loaded(spark, "0/9")).collect()] == ["0/9"]


def test_upsert_takes_the_latest_save_without_a_guard(spark):
    stored = spark.createDataFrame([("a", "0/9"), ("b", "0/9")], STORED).withColumn("updated_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    saves = spark.createDataFrame([("a", "0/5", 1), ("a", "0/3", 2), ("c", "0/1", 1)], "slot_name string, last_lsn string, arrival bigint")
    rows = checkpoints.upsert_checkpoints(stored, saves, F.lit("2024-02-02")).orderBy("slot_name").collect()
    assert [(r.slot_name, r.last_lsn, r.updated_at.month) for r in rows] == [("a", "0/3", 2), ("b", "0/9", 1), ("c", "0/1", 2)]


def transaction(base, xid, begin, commit, changes=1, slot="test_slot"):
    rows = [message(slot, base, "B", xid=xid, lsn=begin)]
    rows += [message(slot, base + 1 + i, "I", relation_id=7, new_tuple=[("t", "1")]) for i in range(changes)]
    return [*rows, message(slot, base + 9, "C", lsn=commit)]


ITEMS = message("test_slot", 0, "R", relation_id=7, namespace="public", relation="items", columns=["id"])


def test_transaction_is_stored_and_moves_the_mark(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    capture_batch(store, frame(spark, [ITEMS, *transaction(10, 100, "0/4500", "0/5000")]), 0)
    assert [(r.xid, r.begin_lsn, r.change_count) for r in store.transactions().collect()] == [(100, "0/4500", 1)]
    assert [(r.table_name, r.op, r.change_seq_in_txn) for r in store.changes().collect()] == [("items", "I", 1)]
    assert [r.last_lsn for r in store.checkpoints(0).collect()] == ["0/5000"]


def test_empty_transaction_stores_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    capture_batch(store, frame(spark, [ITEMS, *transaction(10, 200, "0/5", "0/6000", changes=0)]), 0)
    assert store.transactions().count() == store.changes().count() == store.checkpoints(0).count() == 0


def test_failed_batch_moves_nothing_and_can_be_repeated(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    capture_batch(store, frame(spark, [ITEMS, *transaction(10, 1, "0/1", "0/10")]), 0)
    good = frame(spark, transaction(20, 300, "0/5", "0/7000"))
    broken = good.withColumn("xid", F.raise_error(F.lit("lost")).cast("bigint"))
    with pytest.raises(Exception, match="lost"):
        capture_batch(store, broken, 1)
    assert [r.xid for r in store.transactions().collect()] == [1]
    assert [r.last_lsn for r in store.checkpoints(0).collect()] == ["0/10"]
    capture_batch(store, good, 1)
    assert sorted(r.xid for r in store.transactions().collect()) == [1, 300]
    assert [r.last_lsn for r in store.checkpoints(1).collect()] == ["0/7000"]


def test_redelivery_in_a_later_batch_is_dropped(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    capture_batch(store, frame(spark, [ITEMS, *transaction(10, 1, "0/1", "0/10", 2)]), 0)
    capture_batch(store, frame(spark, [*transaction(30, 1, "0/1", "0/10", 2), *transaction(50, 2, "0/1", "0/8")]), 1)
    assert sorted((r.xid, r.begin_pos) for r in store.transactions().collect()) == [(1, 10), (2, 50)]
    assert store.changes().count() == 3
    # The lower position is stored, but the mark stays.
    assert [r.last_lsn for r in store.checkpoints(1).collect()] == ["0/10"]


def test_resume_repeats_the_checkpoint_itself(spark):
    log = frame(spark, [ITEMS, *transaction(10, 1, "0/1", "0/8"), *transaction(30, 2, "0/1", "0/9"), *transaction(50, 3, "0/1", "0/10")])
    rows = checkpoints.resume(log, loaded(spark, "0/9")).collect()
    assert sorted(r.xid for r in rows) == [2, 3]
    assert capture(log)[0].count() == 3


def test_store_tables_have_all_columns(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    capture_batch(store, frame(spark, [ITEMS, *transaction(10, 1, "0/1", "0/10")]), 0)
    assert store.transactions().columns == schemas.WAL_TRANSACTION.fieldNames()
    assert store.changes().columns == schemas.WAL_CHANGE.fieldNames()
    assert store.checkpoints(0).columns == schemas.WAL_CHECKPOINT.fieldNames()
