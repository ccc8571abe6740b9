import json

import pytest
from pyspark.sql import functions as F

from annalist import schemas
from annalist.catalog import queries
from annalist.functions import clock, event_types, ids, lsn, payload, tuples
from annalist.operators import defaults, trails
from annalist.sources.frames import route_frames

LSNS = [
    ("0/0", 0),
    ("0/16B3748", 23803720),
    ("0/9000000", 150994944),
    ("0/10000000", 268435456),
    ("1/2A05F200", 5000000000),
    ("FFFFFFFF/FFFFFFFF", 18446744073709551615),
]


def test_lsn_both_ways(spark):
    rows = spark.createDataFrame([(t, str(n)) for t, n in LSNS], "text string, number string")
    rows = rows.withColumn("number", F.col("number").cast("decimal(20,0)"))
    for r in rows.select("*", lsn.lsn_to_num(F.col("text")).alias("n"), lsn.num_to_lsn(F.col("number")).alias("t")).collect():
        assert (r.n, r.t) == (r.number, r.text)


def test_lsn_of_large_numbers(spark):
    """Of whole numbers up to and beyond the last position, and of NULL."""
    numbers = [0, 2**32 - 1, 2**63 - 1, 2**63, 2**63 + 2**32, 2**64 - 1, 2**64, 2**64 + 2**63 + 5, 10**20 + 7]
    rows = spark.createDataFrame([(str(n),) for n in numbers] + [(None,)], "text string").withColumn("n", F.col("text").cast("decimal(22,0)"))
    found = {r.text: r.lsn for r in rows.select("text", lsn.num_to_lsn(F.col("n")).alias("lsn")).collect()}
    assert found == {str(n): f"{n >> 32:X}/{n & 0xFFFFFFFF:X}" for n in numbers} | {None: None}
    assert spark.range(1).select(lsn.is_lsn(lsn.num_to_lsn(F.lit(str(2**64)).cast("decimal(20,0)"))).alias("ok")).first().ok is False


def test_lsn_format_of_many_orders(spark, tmp_path):
    """Order keys from 2^23 on, whose positions no bigint holds."""
    keys = [0, 2**23 - 1, 2**23, 9_000_000, 2**24 - 1, 54_000_000]
    rows = spark.createDataFrame([(k, 7 + k) for k in keys] + [(None, 1), (1, None)], "o_orderkey long, o_custkey long")
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    found = {(r.o_orderkey, r.small_lsn): r.lsn for r in queries.lsn_format(spark, str(tmp_path)).collect()}
    text = lambda n: f"{n >> 32:X}/{n & 0xFFFFFFFF:X}"
    assert found == {(k, text(7 + k)): text((k << 40) + 7 + k) for k in keys} | {(None, "0/1"): None, (1, None): None}


def test_malformed_lsn(spark):
    rows = spark.createDataFrame([(t,) for t in ("bad", "", "0/", "/1", "0/123456789", "0/1 ", "g/1", None)], "text string")
    assert all(r.n is None for r in rows.select(lsn.lsn_to_num(F.col("text")).alias("n")).collect())
    with pytest.raises(Exception, match="malformed LSN"):
        rows.select(lsn.lsn_to_num_strict(F.col("text"))).collect()


def test_lsn_order_is_numeric(spark):
    rows = spark.createDataFrame([("0/10000000",), ("0/9000000",)], "text string")
    assert [r.text for r in rows.orderBy(lsn.lsn_to_num(F.col("text"))).collect()] == ["0/9000000", "0/10000000"]


def rendered(spark, columns, entries):
    rows = spark.createDataFrame([(columns, entries)], schemas.table(c=schemas.TEXTS, t=schemas.TUPLE))
    r = rows.select(
        tuples.tuple_to_json(F.col("c"), F.col("t")).alias("json"),
        tuples.printable_tuple("  Row", F.col("c"), F.col("t")).alias("text"),
    ).first()
    return r.json, r.text


def test_tuple_kinds(spark):
    entries = [("t", 'a"b\\c\n'), ("n", None), ("u", None), ("b", "raw"), ("t", "surplus")]
    image, text = rendered(spark, ["a", "b", "c", "d"], entries)
    assert json.loads(image) == {"a": 'a"b\\c\n', "b": None, "c": "<unchanged>"}
    assert text == '  Row:\n    a: "a\\"b\\\\c\\n"\n    b: NULL\n    c: <unchanged>\n    d: "raw" (type: b)'


def test_tuple_edges(spark):
    assert rendered(spark, ["a"], None) == (None, "  Row: <nil>")
    assert rendered(spark, ["a"], []) == ("{}", "  Row:")
    assert json.loads(rendered(spark, ["a", "b"], [("t", "1")])[0]) == {"a": "1"}
    assert json.loads(rendered(spark, ["a", "b", "a"], [("t", "1"), ("t", "2"), ("t", "3")])[0]) == {"a": "3", "b": "2"}
    # A later entry that is left out does not hide an earlier one of the same name.
    assert json.loads(rendered(spark, ["a", "a"], [("t", "1"), ("b", "2")])[0]) == {"a": "1"}


@pytest.mark.parametrize(
    "text, expected",
    [
        (None, "null"), ("null", "null"), ('{"k": 1}', "object"), ("{}", "object"), ("[1]", "error"), ("1", "error"),
        ('"x"', "error"), ("true", "error"), ("{", "error"), ("", "error"), ('{"a":1} x', "error"), ("{'a':1}", "error"),
        ('{"a":1},{"b":2}', "error"), ('{"a":1},"b":2', "error"), ('{"a":1}} {', "error"), (' {"a":1} ', "object"),
        ('{"a":1,"a":2}', "object"), ('{"a":1}] [', "error"), ('{"a":1},0]', "error"), ("null,null", "error"),
    ],
)
def test_payload_class(spark, text, expected):
    rows = spark.createDataFrame([(text,)], "p string")
    r = rows.select(
        payload.payload_class(F.col("p")).alias("c"),
        F.to_json(payload.decode_payload(F.col("p"))).alias("back"),
        payload.payload_class(payload.as_text(F.col("p").cast("binary"), "binary")).alias("bytes"),
    ).first()
    assert (r.c, r.bytes) == (expected, expected)
    assert (r.back is not None) == (expected == "object")


def test_payload_keeps_large_integers_and_nulls(spark):
    rows = spark.createDataFrame([('{"n": 9007199254740993, "z": null}',)], "p string")
    assert rows.select(F.to_json(payload.decode_payload(F.col("p")))).first()[0] == '{"n":9007199254740993,"z":null}'


def test_quoted(spark):
    text = 'a"b\\c\td\n\x07\x00\x7f\x1b é😀'
    rows = spark.createDataFrame([(text,), ("plain",), ("",)], "t string")
    want = r'"a\"b\\c\td\n\a\x00\x7f\x1b é😀"'
    assert [r[0] for r in rows.select(tuples.quoted(F.col("t"))).collect()] == [want, '"plain"', '""']


def test_frames(spark):
    header = bytes(range(24))
    frames = [b"", b"w12345", b"w" + b"x" * 20, b"w" + header, b"w" + header + b"Bxyz", b"k123", b"zq"]
    outcomes = ["empty_frame", "short_lt8", "short_lt24", "empty_payload", "payload", "keepalive", "unknown"]
    rows = spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate(frames)], "i int, frame binary")
    got = route_frames(rows).orderBy("i").collect()
    assert [r.outcome for r in got] == outcomes
    assert bytes(got[4].payload) == b"Bxyz" and got[3].payload is None
    assert int(got[4].wal_start) == int.from_bytes(header[:8], "big")
    assert int(got[4].sent_at) == int.from_bytes(header[16:], "big")
    assert got[1].wal_start is None


def test_frame_shortest_lengths(spark):
    sizes = [7, 8, 23, 24, 25]
    rows = spark.createDataFrame([(n, bytearray(b"w" + b"\x00" * n)) for n in sizes], "n int, frame binary")
    got = {r.n: r.outcome for r in route_frames(rows).collect()}
    assert got == {7: "short_lt8", 8: "short_lt24", 23: "short_lt24", 24: "empty_payload", 25: "payload"}


@pytest.mark.parametrize(
    "text, start",
    [
        (None, 1), ("", 1), ("0", 0), ("-3", -3), ("+7", 7), ("007", 7), ("9223372036854775807", 2**63 - 1),
        ("9223372036854775808", None), (" 1", None), ("1 ", None), ("x", None), ("1.0", None), ("0x1", None), ("1e3", None),
        ("5\n", None), ("\n5", None),
    ],
)
def test_replay_argument(spark, text, start):
    rows = spark.createDataFrame([("t", text)], "trail_id string, from_text string")
    r = trails.parse_replay_args(rows).first()
    assert r.from_sequence == start
    assert (r.status == trails.ACCEPTED) == (start is not None)


def test_times(spark):
    rows = spark.createDataFrame([("2024-01-01 00:00:07.1795",), ("2024-01-01 10:00:00",)], "t string").select(
        F.col("t").cast("timestamp_ntz").alias("t")
    )
    assert [r[0] for r in rows.select(clock.rfc3339(F.col("t"))).collect()] == ["2024-01-01T00:00:07.1795Z", "2024-01-01T10:00:00Z"]
    assert rows.select(clock.trace_stamp(F.col("t"))).first()[0] == "2024-01-01 00:00:07.179"
    assert rows.select(clock.utc_now().alias("n")).dtypes == [("n", "timestamp_ntz")]


def test_ids(spark):
    rows = spark.range(100)
    assert rows.select(ids.random_id().alias("i")).distinct().count() == 100
    first = rows.select(ids.stable_id(F.lit("t"), F.col("id"))).collect()
    assert first == rows.select(ids.stable_id(F.lit("t"), F.col("id"))).collect() and len(set(first)) == 100


def test_named_types(spark):
    rows = spark.createDataFrame([(t,) for t in (*event_types.NAMED_EVENT_TYPES, "other")], "type string")
    assert [r[0] for r in rows.select(event_types.is_named(F.col("type"))).collect()] == [True] * 4 + [False]


def test_defaults(spark):
    rows = spark.createDataFrame([("s", None)], "source_slot string, undo_status string")
    r = defaults.with_defaults(rows, "wal_change", F.lit("2024-01-01")).first()
    assert (r.undo_status, r.affected_row_count, r.changed_columns, r.safety_flags, r.forward_dml_sql) == ("not_applied", 1, [], [], "")
    assert r.created_at.year == 2024 and r.row_pk is None and r.change_lsn is None
    assert defaults.with_defaults(rows, "wal_transaction").columns == schemas.WAL_TRANSACTION.fieldNames()
    kept = defaults.with_defaults(spark.createDataFrame([("s", "done")], rows.schema), "wal_change").first()
    assert kept.undo_status == "done"
