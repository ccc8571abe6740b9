"""Inputs of the registered queries, derived by Spark from the given tables.

All rows of the source tables are used. Remainders of keys only decide which
messages are faulty, missing or delivered twice, so every rule has cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist import schemas
from annalist.functions.lsn import num_to_lsn
from annalist.operators.numbering import number_within
from annalist.plans.capture import capture_batch, describe
from annalist.session import land, scratch_folder
from annalist.sources.event_table import write_events
from annalist.sources.log_index import LogIndex
from annalist.sources.messages import normalize, read_messages
from annalist.sources.store import Store

RELATION_COLUMNS = ("orderkey", "partkey", "quantity", "tax_pct", "discount_pct", "status")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


# Trails and events.


def event_type(source: Column) -> Column:
    return (
        F.when(source == "signup", "created").when(source == "error", "deleted").otherwise("updated")
    )


def unnumbered_events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        text("event_id").alias("id"),
        text("user_id").alias("trail_id"),
        event_type(F.col("event_type")).alias("type"),
        F.col("props").alias("payload"),
        F.col("ts").cast("timestamp_ntz").alias("occured_at"),
        F.col("event_id").alias("arrival"),
    )


def numbered(events: DataFrame) -> DataFrame:
    return number_within(events, ["trail_id"], [F.col("occured_at"), F.col("arrival")], "sequence").select(*schemas.EVENTS.fieldNames())


def events(spark: SparkSession, folder: str) -> DataFrame:
    return numbered(unnumbered_events(spark, folder))


def trails(spark: SparkSession, folder: str) -> DataFrame:
    """One trail per user, and two without events."""
    users = (
        table(spark, folder, "events")
        .groupBy("user_id")
        .agg(F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))
        .select(
            text("user_id").alias("id"),
            F.concat(F.lit("user-"), text("user_id")).alias("name"),
            F.col("created_at").cast("timestamp_ntz").alias("created_at"),
            F.col("updated_at").cast("timestamp_ntz").alias("updated_at"),
        )
    )
    empty = spark.range(1, 3, 1, 1).select(
        F.concat(F.lit("empty-"), text("id")).alias("id"),
        F.concat(F.lit("nothing-"), text("id")).alias("name"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("updated_at"),
    )
    return users.unionByName(empty)


def trails_before_append(spark: SparkSession, folder: str) -> DataFrame:
    """The trails as they were when their stored events were the last, pending ones not counted."""
    stored = F.max(F.when(~is_pending(), F.col("ts"))).cast("timestamp_ntz").alias("since")
    last = table(spark, folder, "events").withColumnRenamed("event_id", "arrival").groupBy("user_id").agg(stored)
    since = last.select(text("user_id").alias("id"), "since")
    moment = F.when(F.col("since").isNotNull(), F.col("since")).otherwise(F.col("created_at"))
    return trails(spark, folder).join(since, "id", "left").withColumn("updated_at", moment).drop("since")


def is_pending() -> Column:
    return F.col("arrival") % 10 == 9


def stored_events(spark: SparkSession, folder: str) -> DataFrame:
    return numbered(unnumbered_events(spark, folder).where(~is_pending()))


def pending_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events to append; those of some users point at a trail that does not exist."""
    lost = F.col("trail_id").cast("bigint") % 13 == 0
    return (
        unnumbered_events(spark, folder)
        .where(is_pending())
        .withColumn("trail_id", F.when(lost, F.concat("trail_id", F.lit("-missing"))).otherwise(F.col("trail_id")))
    )


def events_with_faults(spark: SparkSession, folder: str) -> DataFrame:
    """All events; a few payloads have text behind their end, are lists, or stop short."""
    n, payload = F.col("id").cast("bigint"), F.col("payload")
    return events(spark, folder).withColumn(
        "payload",
        F.when(n % 1191 == 5, F.concat(payload, F.lit(" junk")))
        .when(n % 1191 == 402, F.concat(F.lit("["), payload, F.lit("]")))
        .when(n % 1191 == 799, '{"k":')
        .otherwise(payload),
    )


def trails_by_type(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """One long trail per kind of event, numbered in order of arrival."""
    arrived = unnumbered_events(spark, folder).withColumn("trail_id", F.concat(F.lit("all-"), F.col("type")))
    numbered_ = number_within(arrived, ["trail_id"], [F.col("arrival")], "sequence").select(*schemas.EVENTS.fieldNames())
    moment = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    ids = arrived.select(F.col("trail_id").alias("id")).distinct()
    return ids.select("id", F.lit("by \"type\"").alias("name"), moment.alias("created_at"), moment.alias("updated_at")), numbered_


def replay_requests(spark: SparkSession, folder: str) -> DataFrame:
    """One request per user, some without a start, some with an unreadable one."""
    user = F.col("user_id")
    return (
        table(spark, folder, "events")
        .select("user_id")
        .distinct()
        .select(
            text(user).alias("trail_id"),
            F.when(user % 17 == 0, "").when(user % 19 == 0, "x").otherwise(text(user % 30)).alias("from_text"),
        )
    )


def customer_requests(spark: SparkSession, folder: str) -> DataFrame:
    """One request per order, keyed by customer; customers repeat, some match a trail."""
    return table(spark, folder, "orders").select(
        text("o_custkey").alias("id"),
        F.concat(F.lit("customer-"), F.col("o_orderpriority")).alias("name"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("requested_at"),
        F.col("o_orderkey").alias("arrival"),
    )


def customer_events(spark: SparkSession, folder: str) -> DataFrame:
    """Each order as an event of its customer's trail, numbered by order key."""
    orders = table(spark, folder, "orders").select(
        text("o_orderkey").alias("id"),
        text("o_custkey").alias("trail_id"),
        F.col("o_orderstatus").alias("type"),
        F.to_json(F.struct(F.col("o_orderpriority").alias("priority"))).alias("payload"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("occured_at"),
        F.col("o_orderkey").alias("arrival"),
    )
    return number_within(orders, ["trail_id"], [F.col("arrival")], "sequence").drop("arrival")


def customer_replays(spark: SparkSession, folder: str) -> DataFrame:
    """One replay request per customer; some start nowhere readable, most trails are unknown."""
    segment = F.col("c_mktsegment")
    start = F.when(segment == "BUILDING", "").when(segment == "MACHINERY", "x").otherwise(text("c_nationkey"))
    return table(spark, folder, "customer").select(text("c_custkey").alias("trail_id"), start.alias("from_text"))


def conversation_events(spark: SparkSession, folder: str) -> DataFrame:
    """Already numbered events with the whole text of each turn as payload."""
    return table(spark, folder, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        text("conv_id").alias("trail_id"),
        F.col("role").alias("type"),
        F.to_json(F.create_map(F.lit("text"), F.col("text"))).alias("payload"),
        F.lit("2024-02-01 00:00:00").cast("timestamp_ntz").alias("occured_at"),
        (F.col("turn") + 1).alias("sequence"),
    )


# Change log.


def _message(kind: str, present: Column, **fields: Column) -> Column:
    shape = {
        "offset": "bigint",
        "xid": "bigint",
        "lsn": "string",
        "commit_ts": "timestamp_ntz",
        "relation_id": "bigint",
        "namespace": "string",
        "relation": "string",
        "columns": "array<string>",
        "column_types": "array<bigint>",
        "truncated": "array<bigint>",
    }
    values = [
        (fields[name] if name in fields else F.lit(None)).cast(data_type).alias(name)
        for name, data_type in shape.items()
    ]
    return F.when(present, F.struct(F.lit(kind).alias("kind"), *values))


def _order_messages(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    version = F.floor(key / 400).cast("bigint")
    columns = F.when(version % 2 == 0, F.array(*map(F.lit, RELATION_COLUMNS))).otherwise(
        F.array(*map(F.lit, RELATION_COLUMNS[:-1]))
    )
    messages = [
        _message("B", key % 77 != 0, offset=F.lit(0), xid=key, lsn=num_to_lsn(key * 65536 + 16)),
        _message("T", key % 91 == 0, offset=F.lit(100), truncated=F.array(F.lit(16385), 16385 + key % 7)),
        _message(
            "C", key % 50 != 0, offset=F.lit(126), lsn=num_to_lsn(key * 65536 + 32), commit_ts=F.col("o_orderdate")
        ),
    ]
    for n in range(1, 8):
        present = (key % 400 < 4) if n < 7 else (key % 400 < 4) & (key >= 400)
        messages.append(
            _message(
                "R",
                present,
                offset=F.lit(1 + n),
                relation_id=F.lit(16384 + n),
                namespace=F.lit("sales"),
                relation=F.concat(F.lit(f"lineitem_{n}_v"), text(version)),
                columns=columns,
                column_types=F.transform(columns, lambda c, i: i + 20),
            )
        )
    return (
        table(spark, folder, "orders")
        .select(
            key.alias("order_key"),
            F.col("o_orderdate").alias("received_at"),
            F.explode(F.filter(F.array(*messages), lambda m: m.isNotNull())).alias("m"),
        )
        .select("order_key", "received_at", "m.*")
    )


def _entry(kind: Column | str, value: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("kind"), value.cast("string").alias("value"))


def _line_messages(spark: SparkSession, folder: str) -> DataFrame:
    # An order has a handful of lines, so this window stays small per key.
    lines = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"
    )
    percent = lambda c: F.round(F.col(c) * 100).cast("bigint")
    flag = F.col("l_returnflag")
    row = F.array(
        _entry("t", F.col("l_orderkey")),
        _entry("t", F.col("l_partkey")),
        _entry("t", F.col("l_quantity").cast("bigint")),
        _entry(F.when(F.col("l_tax") == 0, "n").otherwise("t"), F.when(F.col("l_tax") != 0, percent("l_tax"))),
        _entry(
            F.when(F.col("l_discount") >= 0.08, "u").otherwise("t"),
            F.when(F.col("l_discount") < 0.08, percent("l_discount")),
        ),
        _entry(F.when(F.col("l_linestatus") == "F", "b").otherwise("t"), F.col("l_linestatus")),
    )
    has_old = (flag == "R") | ((flag == "A") & (F.col("l_linestatus") == "O"))
    # Numbered first, so that the shuffle moves the plain columns and not the tuples.
    numbered_ = table(spark, folder, "lineitem").withColumn("place", F.row_number().over(lines))
    return numbered_.select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_shipdate").alias("received_at"),
        F.when(flag == "N", "I").when(flag == "A", "U").otherwise("D").alias("kind"),
        (F.col("place") + 20).cast("bigint").alias("offset"),
        (F.col("l_linenumber") + 16384).cast("bigint").alias("relation_id"),
        F.when(has_old, row).alias("old_tuple"),
        F.when(flag != "R", row).alias("new_tuple"),
    )


def redelivery_shift(spark: SparkSession, folder: str) -> int:
    """How much later a message is delivered again: behind the position of any first delivery."""
    top = table(spark, folder, "orders").agg(F.max("o_orderkey").alias("top")).first()["top"] or 0
    return 128 * (top + 1)


def derived_log(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as transactions, line items as row changes, four slots.

    Some BEGINs and COMMITs are missing, relations change over time, and some
    transactions are delivered again much later.
    """
    messages = _order_messages(spark, folder).unionByName(
        _line_messages(spark, folder), allowMissingColumns=True
    )
    again = (F.col("order_key") % 101 == 0) & (F.col("kind") != "R")
    later = F.lit(redelivery_shift(spark, folder)).cast("bigint")
    first = F.lit(0).cast("bigint")
    shifts = F.when(again, F.array(first, later)).otherwise(F.array(first))
    return normalize(
        messages.withColumn("shift", F.explode(shifts))
        .withColumn("slot", F.concat(F.lit("slot_"), text(F.col("order_key") % 4)))
        .withColumn("pos", F.col("order_key") * 128 + F.col("offset") + F.col("shift"))
    )


# Derived tables written by this session, by (application, kind, source folder).
_WRITTEN: dict[tuple[str, str, str], str] = {}


def _written(spark: SparkSession, folder: str, kind: str) -> tuple[str, bool]:
    """Folder of a derived table, and whether it still has to be written."""
    key = (spark.sparkContext.applicationId, kind, folder)
    fresh = key not in _WRITTEN
    if fresh:
        _WRITTEN[key] = scratch_folder(spark, kind)
    return _WRITTEN[key], fresh


def change_log(spark: SparkSession, folder: str) -> DataFrame:
    """The derived log as a table, landed once per session like a captured log would be."""
    path, fresh = _written(spark, folder, "change-log")
    if fresh:
        land(derived_log(spark, folder), path)
    return read_messages(spark, path)


def keyed_log(spark: SparkSession, folder: str) -> DataFrame:
    """The log as of a source that tells replica identities and keys. Relations are keyed by
    one or two columns, by an index that moves from version to version, fully, or not at
    all; the old images of updates differ from the new ones, in keys and NULLs too."""
    number, at = F.col("relation_id") - 16384, F.size("columns")
    identity = F.when(number.isin(1, 2), "d").when(number.isin(3, 6), "f").when(number == 4, "n").when(number == 5, "i")
    in_key = lambda i: (
        F.when(number == 1, i == 0)
        .when(number == 2, i < 2)
        .when(number == 5, i == F.when(at == len(RELATION_COLUMNS), 0).otherwise(1))
        .otherwise(number.isin(3, 6))
    )
    order = F.col("old_tuple")[0]["value"].cast("bigint")
    more = lambda e: _entry("t", e["value"].cast("bigint") + 1)
    old = F.transform(
        "old_tuple",
        lambda e, i: F.when(i == 2, more(e))
        .when((i == 1) & (order % 3 == 0), more(e))
        .when((i == 3) & (order % 5 == 0), _entry("n", F.lit(None)))
        .otherwise(e),
    )
    announced = F.col("kind") == "R"
    return change_log(spark, folder).withColumns(
        {
            "identity": F.when(announced, identity),
            "key_flags": F.when(announced, F.transform("columns", lambda c, i: in_key(i))),
            "old_tuple": F.when(F.col("kind") == "U", old).otherwise(F.col("old_tuple")),
        }
    )


def described_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The described changes of the keyed log, worked out once per session."""
    path, fresh = _written(spark, folder, "described")
    if fresh:
        land(describe(keyed_log(spark, folder)), path)
    return spark.read.parquet(path)


def raw_log(spark: SparkSession, folder: str) -> DataFrame:
    """The log as text per position. Some texts are cut short or missing, some are of a kind
    nobody knows or lack their kind or their relation."""
    log, order, kind = change_log(spark, folder), F.shiftright("pos", 7), F.col("kind")
    inner = [c for c in log.columns if c not in ("slot", "pos", "received_at", "kind", "relation_id")]
    told = F.when(kind == "T", "Y").when(~((kind == "B") & (order % 97 == 0)), kind)
    relation = F.when(~((kind == "U") & (order % 59 == 0)), F.col("relation_id"))
    text_ = F.to_json(F.struct(told.alias("kind"), relation.alias("relation_id"), *inner))
    payload = (
        F.when((kind == "C") & (order % 83 == 0), F.substring(text_, F.lit(1), F.floor(F.length(text_) / 2).cast("int")))
        .when(~((kind == "I") & (order % 61 == 0)), text_)
    )
    return log.select("slot", "pos", "received_at", payload.alias("payload"))


PIECES = 16


def log_in_pieces(spark: SparkSession, folder: str) -> LogIndex:
    """The log landed as files of 16 ranges of positions, with an index of them."""
    path, fresh = _written(spark, folder, "log-pieces")
    index = LogIndex(spark, f"{path}/log", f"{path}/index")
    if fresh:
        log = change_log(spark, folder)
        end = (log.agg(F.max("pos").alias("top")).first()["top"] or 0) + 1
        pieces = log.withColumn("piece", F.floor(F.col("pos") * PIECES / end).cast("int"))
        land(pieces.repartition("piece"), f"{path}/log", "piece")
        index.refresh()
    return index


def stored_event_table(spark: SparkSession, folder: str) -> str:
    """Name of a table of all events, bucketed by trail."""
    path, fresh = _written(spark, folder, "event-table")
    name = "events_" + path.rsplit("-", 1)[1]
    if fresh:
        write_events(events(spark, folder), name, path, 16)
    return name


def undo_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a request about the first or second change of the order its user's
    number names: users come again and again, and some name an order that was never stored."""
    kind, user = F.col("event_type"), F.col("user_id")
    action = F.when(kind == "purchase", "undo").when(kind == "view", "undo").when(kind == "click", "redo").when(kind == "signup", "abandon").otherwise(kind)
    action = F.when((kind == "signup") & (F.col("event_id") % 3 != 0), "undo").otherwise(action)
    position = user * 65536 + 32
    return table(spark, folder, "events").select(
        F.concat(F.lit("slot_"), text(user % 4)).alias("source_slot"),
        num_to_lsn(position).alias("commit_lsn"),
        (F.col("event_id") % 2 + 1).cast("int").alias("change_seq_in_txn"),
        F.floor(F.col("event_id") / 2).cast("bigint").alias("arrival"),
        action.alias("action"),
        F.col("ts").cast("timestamp_ntz").alias("requested_at"),
        text("event_id").alias("requested_by"),
    )


def middle_of(rows: DataFrame, position: str) -> int:
    ends = rows.agg(F.min(position).alias("low"), F.max(position).alias("high")).first()
    return (ends["low"] + ends["high"]) // 2


def halves(rows: DataFrame, position: str) -> list[DataFrame]:
    """The rows in two steps of arrival, split at the middle of the position range."""
    middle = middle_of(rows, position)
    return [rows.where(F.col(position) <= middle), rows.where(F.col(position) > middle)]


def log_steps(spark: SparkSession, folder: str) -> list[DataFrame]:
    """The whole log in three steps of arrival: two halves, then the redeliveries."""
    log = change_log(spark, folder)
    first = F.col("pos") < redelivery_shift(spark, folder)
    return [*halves(log.where(first), "pos"), log.where(~first)]


def stored_batch(spark: SparkSession, folder: str) -> Store:
    """The whole log stored by the capture job as one batch, once per session."""
    path, fresh = _written(spark, folder, "store")
    store = Store(spark, path)
    if fresh:
        capture_batch(store, change_log(spark, folder), 0, clock=F.lit("2024-01-01 00:00:00"))
    return store


def stored_checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    """What an earlier run had reached by the start of 1996; the last slot never saved."""
    key = F.col("o_orderkey")
    return (
        table(spark, folder, "orders")
        .where((F.col("o_orderdate") < "1996-01-01") & (key % 4 != 3))
        .groupBy(F.concat(F.lit("slot_"), text(key % 4)).alias("slot_name"))
        .agg(F.max(key).alias("top"), F.max("o_orderdate").alias("updated_at"))
        .select(
            "slot_name",
            num_to_lsn(F.col("top") * 65536 + 32).alias("last_lsn"),
            (F.col("top") * 65536 + 32).cast("decimal(20,0)").alias("last_lsn_num"),
            F.col("updated_at").cast("timestamp_ntz").alias("updated_at"),
        )
    )


def slots(log: DataFrame) -> DataFrame:
    return log.select("slot").distinct()
