"""What grows with the tables: work that is done once, and what the shuffles move and leave."""

import datetime
import os
import time

import pytest
from pyspark.sql import functions as F

from annalist.catalog import inputs, queries
from annalist.functions import payload, statements
from annalist.operators import described, undo
from annalist.plans.capture import capture_batch
from annalist.session import WRITING, land, lean_writes
from annalist.sources.store import Store

DAY = datetime.datetime(1996, 1, 2)


def plan(frame):
    return frame._jdf.queryExecution().explainString(frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Some orders with lines, about relations that the first four of them announce."""
    folder = tmp_path_factory.mktemp("tables")
    orders = [(k, k % 5, "OFP"[k % 3], DAY, "1-URGENT" if k % 2 else "5-LOW") for k in range(210)]
    lines = [
        (k, k % 9, 3, n % 7 + 1, 2.0, 10.0, 0.05 * (n % 3), 0.02 * (n % 2), "NAR"[(k + n) % 3], "OF"[n % 2], DAY)
        for k in range(210)
        for n in range(k % 4)
    ]
    spark.createDataFrame(
        orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string"
    ).write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(
        lines,
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    ).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_raw_messages_are_decoded_once(spark, tables):
    found = queries.wal_disposition_raw(spark, tables)
    assert "from_json" not in plan(found) and "parse_json" not in plan(found)
    assert found.count() == inputs.change_log(spark, tables).count()
    assert {r.disposition for r in found.select("disposition").distinct().collect()} >= {"begin", "change", "undecodable"}


TEXTS = ['{}', ' {"a": 1} ', '\t\r\n{"a": [1]}', '{"a": 1} junk', '{"a": 1},{"b": 2}', '{"a": 1}]', '[{"a": 1}]', "null", " null", "1", '"{"', '"{}"']
TEXTS += ['{"a": 1', "{", "", " ", "{'a': 1}", "\x0b{}", "﻿{}", '{"a": 1, "a": 2}', '{"a": 1},"{}"', None]


def test_objects_are_told_as_by_their_class(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "p string")
    for r in rows.select("p", payload.is_object(F.col("p")).alias("is"), payload.payload_class(F.col("p")).alias("class")).collect():
        assert r["is"] == (r["class"] == payload.OBJECT), r


def test_lines_are_shuffled_as_plain_columns(spark, tables):
    below = plan(inputs._line_messages(spark, tables)).split("Exchange ", 1)[1]
    assert "struct(" not in below and "array(" not in below


def test_an_image_is_worked_out_once(spark):
    rows = spark.createDataFrame([(["a", "b", "a"], [("t", "1"), ("n", None), ("u", None)])], "c array<string>, t array<struct<kind:string,value:string>>")
    image = rows.select(statements.image_of(F.col("c"), F.col("t")).alias("image"))
    assert [(e.name, e.kind) for e in image.first().image] == [("b", "n"), ("a", "u")]
    assert image._jdf.queryExecution().analyzed().toString().count("zip_with") == 2  # one for each case


def shuffle_files(spark):
    top = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {name for folder in top for _, _, names in os.walk(folder) for name in names if name.startswith("shuffle_")}


def left_beyond(spark, before):
    """Shuffle files that stay; they are deleted in the background."""
    for _ in range(40):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.25)
    return left


def test_written_tables_leave_no_shuffle_files(spark, tables, tmp_path):
    rows = inputs.derived_log(spark, tables)
    before = shuffle_files(spark)
    land(rows, f"{tmp_path}/log")
    assert not left_beyond(spark, before)
    store = Store(spark, f"{tmp_path}/store")
    capture_batch(store, spark.read.parquet(f"{tmp_path}/log"), 0, clock=F.lit("2024-01-01"))
    assert not left_beyond(spark, before)
    assert store.changes().count() > 0
    files = [f for _, _, names in os.walk(f"{tmp_path}/store/attempts") for f in names if f.startswith("part-")]
    assert files and all(f.endswith(".zstd.parquet") for f in files)


def test_settings_return_after_a_failure(spark):
    before = {name: spark.conf.get(name) for name in WRITING}
    with pytest.raises(ZeroDivisionError), lean_writes(spark):
        assert {name: spark.conf.get(name) for name in WRITING} == WRITING != before
        raise ZeroDivisionError
    assert {name: spark.conf.get(name) for name in WRITING} == before


def test_hashes_move_twice(spark):
    rows = spark.createDataFrame(
        [("s", "0/1", 1, i + 1, 3000, f"x{i}", None if i == 7 else "y") for i in range(3000)],
        "source_slot string, commit_lsn string, begin_pos long, change_seq_in_txn int, change_count long, forward_dml_sql string, reverse_dml_sql string",
    )
    hashes = described.statement_hashes(described.statement_fragments(rows))
    assert plan(hashes).count("Exchange hashpartitioning") == 2
    found = {r.direction: (r.n, r.missing, r.sql_hash is None) for r in hashes.collect()}
    assert found == {"forward": (3000, 0, False), "reverse": (3000, 1, True)}


def test_requests_meet_the_changes_once(spark, tmp_path):
    spark.createDataFrame([("s", "0/1", 1, "DELETE")], "source_slot string, commit_lsn string, change_seq_in_txn int, reverse_dml_sql string").write.parquet(f"{tmp_path}/the-changes")
    requests = spark.createDataFrame(
        [("s", "0/1", 1, 1, "undo", "u"), ("s", "0/9", 1, 2, "undo", "v")], "source_slot string, commit_lsn string, change_seq_in_txn int, arrival bigint, action string, requested_by string"
    )
    judged = undo.judged_requests(spark.read.parquet(f"{tmp_path}/the-changes"), requests.withColumn("requested_at", F.lit(None).cast("timestamp_ntz")))
    assert "the-changes" not in plan(judged)
    assert {(r.requested_by, r.outcome) for r in judged.collect()} == {("u", "accepted"), ("v", "refused")}
