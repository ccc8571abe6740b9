"""Shapes of the physical plans that matter at scale."""

import re

from annalist.catalog import inputs
from annalist.catalog.queries import REGISTRY
from annalist.operators import changes, segments
from annalist.plans.capture import capture, capture_batch
from annalist.sources.messages import read_messages
from annalist.sources.store import CHANGES, Store

SMALL = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_the_wide_log_is_shuffled_once(spark, tmp_path):
    inputs.change_log(spark, SMALL).write.parquet(str(tmp_path / "log"))
    log = read_messages(spark, str(tmp_path / "log"))
    text = plan(capture(log)[1])
    wide = [line for line in text.splitlines() if "FileScan" in line and "new_tuple" in line]
    assert len(wide) == 1
    shuffles = [line for line in text.splitlines() if "REPARTITION_BY_COL" in line]
    assert len(shuffles) == 1, "the narrow pass is a table by now, and the wide log is shuffled once"
    assert "counted-" in text
    assert "Join" not in text[: text.index("REPARTITION_BY_COL")], "no join above the wide shuffle"


def test_a_batch_reads_the_wide_log_once(spark, tmp_path, monkeypatch):
    """The plans of everything that a batch writes: one wide scan, one wide shuffle."""
    inputs.change_log(spark, SMALL).write.parquet(str(tmp_path / "log"))
    plans, write = {}, Store.write

    def noted(self, rows, table, *rest):
        plans[table] = plan(rows)
        return write(self, rows, table, *rest)

    monkeypatch.setattr(Store, "write", noted)
    capture_batch(Store(spark, str(tmp_path / "store")), read_messages(spark, str(tmp_path / "log")), 0)
    wide = {t: sum("FileScan" in x and "new_tuple" in x for x in p.splitlines()) for t, p in plans.items()}
    assert wide[CHANGES] == 1 and all(n <= 1 for n in wide.values())
    assert plans[CHANGES].count("REPARTITION_BY_COL") == 1 and plans["segments"].count("REPARTITION_BY_COL") == 1
    for table, text in plans.items():
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, table
    assert not any("SortAggregate" in plans[t] for t in (CHANGES, "segments", "wal_transaction", "closing"))


def test_the_capture_sorts_for_no_aggregate_and_collects_no_list(spark, tmp_path):
    inputs.change_log(spark, SMALL).write.parquet(str(tmp_path / "log"))
    for frame in capture(read_messages(spark, str(tmp_path / "log"))):
        assert "SortAggregate" not in plan(frame) and "collect_list" not in plan(frame)


def test_trails_are_read_few_times(spark):
    text = plan(REGISTRY["trail_assemble"](spark, SMALL))
    assert text.count("FileScan") <= 4 and len(re.findall(r"\bExchange\b", text)) <= 8
    assert plan(REGISTRY["payload_decode"](spark, SMALL)).count("try_parse_json") <= 1


def test_segments_read_control_messages_only(spark, tmp_path):
    inputs.change_log(spark, SMALL).write.parquet(str(tmp_path / "log"))
    text = plan(segments.segments(read_messages(spark, str(tmp_path / "log"))))
    scans = [line for line in text.splitlines() if "FileScan" in line]
    assert scans and all("In(kind, [B,C])" in line for line in scans)
    assert all("tuple" not in line for line in scans)


def test_counting_reads_narrow_columns(spark, tmp_path):
    inputs.change_log(spark, SMALL).write.parquet(str(tmp_path / "log"))
    text = plan(changes.pieces(read_messages(spark, str(tmp_path / "log"))))
    assert not re.search(r"ReadSchema: \S*(tuple|columns)", text)


def test_no_query_needs_a_cross_join_or_python(spark):
    for name, query in REGISTRY.items():
        if name.startswith("stream"):
            continue
        text = plan(query(spark, SMALL))
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython"):
            assert bad not in text, (name, bad)
