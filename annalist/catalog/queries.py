"""Registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist import schemas
from annalist.catalog import inputs
from annalist.functions import ids
from annalist.functions.clock import utc_now
from annalist.functions.lsn import lsn_to_num, num_to_lsn
from annalist.functions.payload import (
    as_text,
    class_of,
    decode_payload,
    encode_payload,
    object_of,
    parsed,
    payload_class,
)
from annalist.functions.tuples import tuple_to_json
from annalist.operators import (
    audits,
    changes,
    checkpoints,
    described,
    relations,
    safety,
    segments,
    trace,
    trails,
    transactions,
    undo,
    writes,
)
from annalist.operators.defaults import with_defaults
from annalist.operators.numbering import number_within
from annalist.plans import service
from annalist.plans.capture import capture, capture_batch, decoded_once, delivered_transactions
from annalist.plans.resume import resume_capture
from annalist.session import scratch_folder
from annalist.sources import event_table, raw
from annalist.sources.frames import route_frames
from annalist.sources.messages import read_message_stream
from annalist.sources.store import Store
from annalist.streaming import append_stream, capture_stream

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def big(column: str) -> Column:
    return F.col(column).cast("bigint").alias(column)


def shown(column: str) -> Column:
    """A number that may be NULL, as text."""
    return inputs.text(column).alias(column)


def tuple_text(column: str) -> Column:
    """A tuple as text, for comparison."""
    entry = lambda e: F.concat(e["kind"], F.lit("="), F.coalesce(e["value"], F.lit("")))
    return F.array_join(F.transform(column, entry), ",").alias(column)


# Trails: reading.


@query
def scan_trails(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.trails(spark, folder).select(*trails.TRAIL_COLUMNS)


@query
def scan_events(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.events(spark, folder).select(*trails.EVENT_COLUMNS)


@query
def trail_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return trails.lookup(inputs.customer_requests(spark, folder), inputs.trails(spark, folder))


@query
def trail_length(spark: SparkSession, folder: str) -> DataFrame:
    return trails.trail_lengths(inputs.trails(spark, folder), inputs.unnumbered_events(spark, folder))


def event_fields(*names: str) -> list[Column]:
    return [F.col(f"event.{n}").alias(f"event_{n}") for n in names]


@query
def trail_assemble(spark: SparkSession, folder: str) -> DataFrame:
    """Trails beside their events, one row each."""
    rows = trails.with_events(inputs.trails(spark, folder), inputs.events(spark, folder))
    return rows.select("id", "name", *event_fields("id", "type", "payload", "occured_at"), shown_sequence())


def shown_sequence() -> Column:
    return inputs.text(F.col("event.sequence")).alias("sequence")


@query
def trail_nested(spark: SparkSession, folder: str) -> DataFrame:
    """Events nested in rows of at most 40."""
    item = lambda e: F.concat_ws(":", e["sequence"].cast("string"), e["type"], e["id"])
    rows = trails.nested(inputs.trails(spark, folder), inputs.events(spark, folder), 40)
    events = F.array_join(F.transform("events", item), ",").alias("events")
    return rows.select("id", "name", "part", F.size("events").cast("bigint").alias("n_events"), events)


@query
def trail_list(spark: SparkSession, folder: str) -> DataFrame:
    rows = trails.list_trails(inputs.trails(spark, folder), inputs.events(spark, folder))
    return rows.select(*trails.TRAIL_COLUMNS, *event_fields("id", "type"), shown_sequence())


@query
def replay_args(spark: SparkSession, folder: str) -> DataFrame:
    args = trails.parse_replay_args(inputs.replay_requests(spark, folder))
    return args.withColumn("from_sequence", shown("from_sequence"))


def accepted_requests(spark: SparkSession, folder: str) -> DataFrame:
    args = trails.parse_replay_args(inputs.replay_requests(spark, folder))
    return args.where(F.col("status") == trails.ACCEPTED)


@query
def replay_from_sequence(spark: SparkSession, folder: str) -> DataFrame:
    return trails.replay(inputs.events(spark, folder), accepted_requests(spark, folder))


@query
def replay_stored(spark: SparkSession, folder: str) -> DataFrame:
    """Replay out of the stored, bucketed events."""
    return event_table.replay_stored(spark, inputs.stored_event_table(spark, folder), accepted_requests(spark, folder))


@query
def conversation_replay(spark: SparkSession, folder: str) -> DataFrame:
    """Replay of already numbered events, from the second on; payloads hold whole texts."""
    events = inputs.conversation_events(spark, folder)
    requests = events.select("trail_id").distinct().withColumn("from_sequence", F.lit(2).cast("bigint"))
    return trails.replay(events, requests).select(
        "id", "trail_id", "type", "sequence", F.md5(F.get_json_object("payload", "$.text")).alias("text_md5")
    )


def fragments(exported: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Fragments and refused trails in one table."""
    done, refused = exported
    return (
        done.select("id", "section", shown("sequence"), "event_id", "json")
        .unionByName(refused.select("id", F.col("reason").alias("json")), allowMissingColumns=True)
        .withColumn("section", F.coalesce("section", F.lit(-1)).cast("bigint"))
    )


@query
def trail_export_json(spark: SparkSession, folder: str) -> DataFrame:
    return fragments(trails.export_trails(inputs.trails(spark, folder), inputs.events_with_faults(spark, folder)))


@query
def trail_export_long(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of trails that each hold a large share of all events."""
    return fragments(trails.export_trails(*inputs.trails_by_type(spark, folder)))


@query
def replay_export_json(spark: SparkSession, folder: str) -> DataFrame:
    return fragments(trails.export_replay(inputs.events_with_faults(spark, folder), accepted_requests(spark, folder)))


@query
def event_type_counts(spark: SparkSession, folder: str) -> DataFrame:
    return trails.event_type_counts(inputs.unnumbered_events(spark, folder))


@query
def service_list(spark: SparkSession, folder: str) -> DataFrame:
    outcome = service.list_trails(inputs.trails(spark, folder), inputs.events_with_faults(spark, folder))
    return fragments((outcome.done, outcome.refused))


@query
def service_get(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the requested trails, and the refused ids with the reason."""
    outcome = service.get_trails(
        inputs.trails(spark, folder), inputs.events_with_faults(spark, folder), inputs.customer_requests(spark, folder)
    )
    return fragments((outcome.done, outcome.refused))


@query
def service_replay(spark: SparkSession, folder: str) -> DataFrame:
    """Replayed events of the customers' requests, and the refused requests with reasons."""
    outcome = service.replay_trails(
        inputs.trails(spark, folder), inputs.events(spark, folder), inputs.customer_replays(spark, folder)
    )
    done = outcome.done.select("trail_id", F.col("id").alias("event_id"), inputs.text("sequence").alias("result"))
    return done.unionByName(
        outcome.refused.select("trail_id", F.col("reason").alias("result")), allowMissingColumns=True
    )


# Trails: writing.


@query
def trail_create(spark: SparkSession, folder: str) -> DataFrame:
    created, _ = writes.create_trails(
        inputs.trails(spark, folder), inputs.customer_requests(spark, folder), F.col("requested_at")
    )
    return created


@query
def trail_create_rejects(spark: SparkSession, folder: str) -> DataFrame:
    _, refused = writes.create_trails(
        inputs.trails(spark, folder), inputs.customer_requests(spark, folder), F.col("requested_at")
    )
    return refused.select("id", "arrival", "reason")


@query
def trail_create_events(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as first events of the customers' trails that could be created."""
    events = inputs.customer_events(spark, folder)
    return writes.initial_events(trail_create(spark, folder), events)


def _append_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        inputs.trails_before_append(spark, folder),
        inputs.stored_events(spark, folder),
        inputs.pending_events(spark, folder),
    )


@query
def trail_append(spark: SparkSession, folder: str) -> DataFrame:
    return writes.append_events(*_append_inputs(spark, folder))[0]


@query
def trail_touch(spark: SparkSession, folder: str) -> DataFrame:
    return writes.append_events(*_append_inputs(spark, folder))[1]


@query
def append_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return writes.append_events(*_append_inputs(spark, folder))[2].select("id", "trail_id", "type", "reason")


UPDATED_AT = "2024-06-01 00:00:00"


def _updates(spark: SparkSession, folder: str) -> DataFrame:
    """Updates that ask for a moment of their own, which they do not get."""
    return inputs.customer_requests(spark, folder).withColumn("updated_at", F.col("requested_at"))


@query
def trail_update(spark: SparkSession, folder: str) -> DataFrame:
    return writes.update_trails(inputs.trails(spark, folder), _updates(spark, folder), F.lit(UPDATED_AT))[0]


@query
def trail_update_rejects(spark: SparkSession, folder: str) -> DataFrame:
    rejected = writes.update_trails(inputs.trails(spark, folder), _updates(spark, folder), F.lit(UPDATED_AT))[1]
    return rejected.select("id", "arrival", "reason")


@query
def trail_replace_events(spark: SparkSession, folder: str) -> DataFrame:
    """Trails that have a conversation get its turns in place of their events."""
    turns = inputs.conversation_events(spark, folder)
    rows = writes.replace_events(
        inputs.trails(spark, folder),
        inputs.events(spark, folder),
        turns.select(F.col("trail_id").alias("id")),
        turns,
    )
    content = F.coalesce(F.get_json_object("payload", "$.text"), F.get_json_object("payload", "$.k"))
    return rows.select("id", "trail_id", "type", "sequence", F.md5(content).alias("content_md5"))


@query
def service_append(spark: SparkSession, folder: str) -> DataFrame:
    """The events that were added, and the refused ones with the reason."""
    changed = service.append_events(*_append_inputs(spark, folder))
    added = changed.events.select("id", "trail_id", inputs.text("sequence").alias("result"))
    return added.unionByName(changed.refused.select("id", "trail_id", F.col("reason").alias("result")))


@query
def service_update(spark: SparkSession, folder: str) -> DataFrame:
    """Orders rename the trails of their customers and become these trails' only events."""
    changed = service.update_trails(
        inputs.trails(spark, folder),
        inputs.events(spark, folder),
        _updates(spark, folder),
        inputs.customer_events(spark, folder),
        F.lit(UPDATED_AT),
    )
    rows = lambda frame, level, *columns: frame.select(
        F.lit(level).alias("level"), "id", F.concat_ws("|", *columns).alias("content")
    )
    return (
        rows(changed.trails, "trail", "name", inputs.text("updated_at"))
        .unionByName(rows(changed.events, "event", "trail_id", "type", inputs.text("sequence")))
        .unionByName(rows(changed.refused, "refused", inputs.text("arrival"), "reason"))
    )


@query
def cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Delete the trails named by toxic labels; rows left per table."""
    deleted = inputs.table(spark, folder, "labels").where("toxic = 1").select(inputs.text("doc_id").alias("id"))
    parents, children = writes.cascade_delete(
        inputs.trails(spark, folder), inputs.events(spark, folder), deleted, ["id"], ["trail_id"]
    )
    return parents.select(F.lit("trail").alias("level"), "id", F.lit(None).cast("string").alias("trail_id")).unionByName(
        children.select(F.lit("event").alias("level"), "id", "trail_id")
    )


@query
def cascade_delete_wal(spark: SparkSession, folder: str) -> DataFrame:
    """Delete the transactions of urgent orders; changes left per transaction."""
    store = inputs.stored_batch(spark, folder)
    stored, changed = store.transactions(), store.changes()
    urgent = inputs.table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'")
    deleted = stored.join(urgent.select(F.col("o_orderkey").alias("xid")), "xid", "left_semi")
    keys = ["source_slot", "commit_lsn"]
    parents, children = writes.cascade_delete(stored, changed, deleted, keys, keys)
    return (
        parents.select(*keys, F.lit("transaction").alias("level"))
        .unionByName(children.select(*keys, F.lit("change").alias("level")))
        .groupBy(*keys, "level")
        .agg(F.count(F.lit(1)).alias("n"))
    )


# Scalars.


@query
def event_id_stable(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.events(spark, folder).select(
        "id", ids.stable_id(F.col("trail_id"), F.col("sequence")).alias("stable_id")
    )


@query
def new_trail_stamps(spark: SparkSession, folder: str) -> DataFrame:
    """Random ids and clock stamps for the created trails: per name, what must hold of them."""
    stamped = trail_create(spark, folder).select(
        ids.random_id().alias("id"), "name", utc_now().alias("created_at"), utc_now().alias("updated_at")
    )
    uuid = r"\A[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"
    holds = lambda c: F.coalesce(F.bool_and(c), F.lit(False))
    return stamped.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"),
        (F.count_distinct("id") == F.count(F.lit(1))).alias("ids_differ"),
        holds(F.col("id").rlike(uuid)).alias("ids_are_uuids"),
        holds(F.col("created_at").isNotNull() & (F.col("created_at") <= F.col("updated_at"))).alias("stamps_in_order"),
        (F.count_distinct("created_at") == 1).alias("one_moment"),
    )


@query
def payload_decode(spark: SparkSession, folder: str) -> DataFrame:
    """Payloads of every kind: objects, lists, JSON null, broken text, text behind the end, nothing."""
    props, kind, n = F.col("props"), F.col("event_type"), F.col("event_id")
    text = (
        F.when(kind == "click", F.concat(F.lit("["), props, F.lit("]")))
        .when((kind == "view") & (n % 2 == 0), "null")
        .when(kind == "view", F.concat(props, F.lit("] ["), props))
        .when(kind == "purchase", F.concat(F.lit("{"), props))
        .when(kind == "signup", props)
        .when(n % 2 == 0, F.concat(props, F.lit(" "), props))
    )
    # A payload may come as bytes as well as text.
    raw = as_text(text.cast("binary"), "binary")
    rows = inputs.table(spark, folder, "events").select("event_id", raw.alias("text"))
    rows = rows.select("event_id", "text", parsed(F.col("text")).alias("value"))
    fields = F.variant_get(object_of(F.col("value")), "$", "map<string,string>")
    return rows.select(
        "event_id",
        class_of(F.col("value"), F.col("text")).alias("class"),
        F.get(F.array(fields["k"]), F.lit(0)).alias("k"),
        encode_payload(fields).alias("encoded"),
    )


@query
def payload_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Whole document texts through encoding and decoding."""
    docs = inputs.table(spark, folder, "documents").select(
        "doc_id", encode_payload(F.create_map(F.lit("text"), F.col("text"))).alias("payload")
    )
    back = F.variant_get(decode_payload(F.col("payload")), "$.text", "string")
    return docs.select("doc_id", payload_class(F.col("payload")).alias("class"), F.md5(back).alias("text_md5"))


def lsn_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Positions of every order: ordinary, above 2^63, and malformed ones."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    high = F.concat(F.lit("F"), F.lpad(F.hex(key), 7, "0"), F.lit("/"), F.lower(F.hex(key)))
    return inputs.table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(status == "F", high)
        .when(status == "P", F.concat(F.lit("bad-"), inputs.text(key)))
        .otherwise(num_to_lsn(key * 65536 + 16))
        .alias("lsn"),
    )


@query
def lsn_parse(spark: SparkSession, folder: str) -> DataFrame:
    number = lsn_to_num(F.col("lsn"))
    return lsn_texts(spark, folder).select(
        "o_orderkey", "lsn", number.cast("string").alias("number"), number.isNotNull().alias("valid")
    )


@query
def lsn_format(spark: SparkSession, folder: str) -> DataFrame:
    # As a decimal: from key 2^23 on the product is beyond a bigint, though still a position.
    number = F.col("o_orderkey").cast("decimal(19,0)") * F.lit(1 << 40).cast("decimal(13,0)") + F.col("o_custkey")
    return inputs.table(spark, folder, "orders").select(
        "o_orderkey", num_to_lsn(number).alias("lsn"), num_to_lsn(F.col("o_custkey")).alias("small_lsn")
    )


@query
def lsn_order(spark: SparkSession, folder: str) -> DataFrame:
    """Place of each commit in its slot by position; text order would differ."""
    commits = (
        inputs.change_log(spark, folder)
        .where(F.col("kind") == "C")
        .select("slot", "pos", "lsn", lsn_to_num(F.col("lsn")).alias("lsn_num"))
    )
    numbered = number_within(commits, ["slot"], [F.col("lsn_num"), F.col("pos")], "place")
    return numbered.orderBy("slot", "lsn_num", "pos").withColumn("lsn_num", shown("lsn_num"))


# Change capture.


@query
def wal_message_scan(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.change_log(spark, folder).select(
        "slot", "pos", "kind", shown("xid"), "lsn", "commit_ts", shown("relation_id"), "namespace", "relation",
        F.array_join("columns", ",").alias("columns"), tuple_text("old_tuple"), tuple_text("new_tuple"),
    )


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """Captured frames of every outcome, one per order."""
    key, priority, status = F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus")
    number = lambda n: F.unhex(F.lpad(F.hex(n), 16, "0"))
    raw = lambda text: F.lit(text).cast("binary")
    header = F.concat(raw("w"), number(key * 65536 + 16), number(key * 65536 + 32), number(key * 1000))
    frame = (
        F.when(status == "P", F.concat(header, raw("B"), inputs.text(key).cast("binary")))
        .when(status == "O", F.concat(raw("k"), inputs.text(key).cast("binary")))
        .when(priority == "1-URGENT", raw(""))
        .when(priority == "2-HIGH", raw("wabcde"))
        .when(priority == "3-MEDIUM", raw("wabcdefghijklmnopqrst"))
        .when(priority == "5-LOW", raw("zq"))
        .otherwise(header)
    )
    return inputs.table(spark, folder, "orders").select("o_orderkey", frame.alias("frame"))


@query
def wal_frame_route(spark: SparkSession, folder: str) -> DataFrame:
    return route_frames(frames(spark, folder)).select(
        "o_orderkey", "outcome", shown("wal_start"), shown("wal_end"), shown("sent_at"),
        F.hex("payload").alias("payload_hex"), num_to_lsn(F.col("wal_start")).alias("change_lsn"),
    )


@query
def wal_disposition(spark: SparkSession, folder: str) -> DataFrame:
    rows = changes.dispositions(inputs.change_log(spark, folder))
    return rows.withColumn("relation_id", shown("relation_id"))


@query
def wal_message_stats(spark: SparkSession, folder: str) -> DataFrame:
    return changes.message_stats(inputs.change_log(spark, folder))


@query
def wal_segments(spark: SparkSession, folder: str) -> DataFrame:
    rows = segments.segments(inputs.change_log(spark, folder))
    return rows.withColumn("xid", shown("xid")).withColumn("commit_pos", shown("commit_pos"))


@query
def wal_relation_asof(spark: SparkSession, folder: str) -> DataFrame:
    return relations.relation_asof(inputs.change_log(spark, folder)).withColumn("columns", F.array_join("columns", ","))


@query
def wal_orphan_changes(spark: SparkSession, folder: str) -> DataFrame:
    return changes.orphan_changes(inputs.change_log(spark, folder))


@query
def wal_unknown_relation(spark: SparkSession, folder: str) -> DataFrame:
    return changes.unknown_relation_changes(inputs.change_log(spark, folder))


@query
def wal_empty_txn(spark: SparkSession, folder: str) -> DataFrame:
    return transactions.empty_transactions(inputs.change_log(spark, folder))


@query
def wal_tuple_to_row(spark: SparkSession, folder: str) -> DataFrame:
    """New tuples read against the full and against a too short column list."""
    columns = F.array(*map(F.lit, inputs.RELATION_COLUMNS))
    tuples = inputs.change_log(spark, folder).where(F.col("kind").isin(*segments.CHANGE_KINDS))
    return tuples.select(
        "slot",
        "pos",
        tuple_to_json(columns, F.col("new_tuple")).alias("row"),
        tuple_to_json(F.slice(columns, 1, 3), F.col("new_tuple")).alias("cut_row"),
    )


def delivered(spark: SparkSession, folder: str) -> DataFrame:
    return transactions.transactions(inputs.change_log(spark, folder))


@query
def wal_row_images(spark: SparkSession, folder: str) -> DataFrame:
    return capture(inputs.change_log(spark, folder))[1].select("source_slot", "pos", "op", "old_row", "new_row")


@query
def wal_change_seq(spark: SparkSession, folder: str) -> DataFrame:
    return capture(inputs.change_log(spark, folder))[1].select(
        "source_slot", "pos", "commit_lsn", big("change_seq_in_txn")
    )


@query
def wal_txn_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return delivered(spark, folder).select(
        "slot", "begin_pos", "commit_pos", "xid", "begin_lsn", "commit_lsn", "commit_ts", big("change_count")
    )


@query
def wal_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return transactions.first_deliveries(delivered(spark, folder)).select("slot", "begin_pos", "commit_lsn")


TRANSACTION_OUT = ("source_slot", "source_db", "xid", "begin_lsn", "commit_lsn", "commit_ts", "change_count")
CHANGE_OUT = (
    "source_slot", "commit_lsn", "change_seq_in_txn", "schema_name", "table_name", "table_oid", "op", "old_row", "new_row",
)


def out(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    counts = ("change_count", "change_seq_in_txn")
    return rows.select(*[big(c) if c in counts else F.col(c) for c in columns])


@query
def wal_persist_txn(spark: SparkSession, folder: str) -> DataFrame:
    return out(inputs.stored_batch(spark, folder).transactions(), TRANSACTION_OUT)


@query
def wal_persist_change(spark: SparkSession, folder: str) -> DataFrame:
    return out(inputs.stored_batch(spark, folder).changes(), CHANGE_OUT)


def shown_flat(rows: DataFrame) -> DataFrame:
    """Lists as their sizes, bytes as text, numbers as text, for comparison."""

    def flat(name: str, kind: str) -> Column:
        if kind.startswith("array"):
            return F.size(name).cast("bigint").alias(name)
        if kind == "binary":
            return F.hex(name).alias(name)
        return F.col(name) if kind in ("string", "timestamp_ntz") else shown(name)

    return rows.select(*[flat(c, t) for c, t in rows.dtypes])


@query
def wal_defaults(spark: SparkSession, folder: str) -> DataFrame:
    """All columns of every stored change but the images; most are never filled by the capture."""
    stored = inputs.stored_batch(spark, folder).changes()
    return shown_flat(stored.drop("old_row", "new_row", "begin_pos"))


@query
def wal_txn_defaults(spark: SparkSession, folder: str) -> DataFrame:
    """All columns of every stored transaction."""
    return shown_flat(inputs.stored_batch(spark, folder).transactions().drop("begin_pos"))


@query
def trail_defaults(spark: SparkSession, folder: str) -> DataFrame:
    """Trails and events that come with and without their moments."""
    moment = F.lit("2024-03-03 00:00:00")
    some = lambda c: F.when(F.col("id").cast("bigint") % 2 == 0, F.col(c))
    trails_ = inputs.trails(spark, folder).where(~F.col("id").startswith("empty")).withColumn("created_at", some("created_at"))
    events_ = inputs.events(spark, folder).withColumn("occured_at", some("occured_at"))
    return (
        with_defaults(trails_.drop("updated_at"), "trails", moment)
        .select(F.lit("trail").alias("level"), "id", "created_at", "updated_at")
        .unionByName(
            with_defaults(events_, "events", moment).select(
                F.lit("event").alias("level"), "id", F.col("occured_at").alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("updated_at")
            )
        )
    )


@query
def wal_row_pk(spark: SparkSession, folder: str) -> DataFrame:
    """What identifies the row of each change, and the condition that finds it afterwards."""
    return inputs.described_changes(spark, folder).select(
        "source_slot", "pos", "replica_identity_mode", "row_pk", "reverse_where_sql"
    )


@query
def wal_change_statements(spark: SparkSession, folder: str) -> DataFrame:
    """The statement that repeats each change, the one that undoes it, and their hashes."""
    return inputs.described_changes(spark, folder).select(
        "source_slot", "pos", "forward_dml_sql", "reverse_dml_sql",
        F.hex("forward_sql_hash").alias("forward_sql_hash"), F.hex("reverse_sql_hash").alias("reverse_sql_hash"),
    )


@query
def wal_changed_columns(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.described_changes(spark, folder).select(
        "source_slot", "pos", F.size("changed_columns").cast("bigint").alias("n"), F.array_join("changed_columns", ",").alias("changed_columns")
    )


@query
def wal_txn_statements(spark: SparkSession, folder: str) -> DataFrame:
    """Each transaction's statements in order and backwards."""
    rows = described.statement_fragments(inputs.described_changes(spark, folder))
    return rows.select("source_slot", "commit_lsn", "direction", "place", "statement")


@query
def wal_txn_sql_hashes(spark: SparkSession, folder: str) -> DataFrame:
    rows = described.statement_hashes(described.statement_fragments(inputs.described_changes(spark, folder)))
    return rows.select("source_slot", "commit_lsn", "direction", "n", "missing", F.hex("sql_hash").alias("sql_hash"))


@query
def wal_safety_flags(spark: SparkSession, folder: str) -> DataFrame:
    """The flags of every change and of every transaction."""
    rows = inputs.described_changes(spark, folder)
    whole = safety.transaction_flags(rows, ["source_slot", "commit_lsn"])
    names = F.array_join("safety_flags", ",").alias("safety_flags")
    return rows.select("source_slot", "commit_lsn", big("change_seq_in_txn"), names).unionByName(
        whole.select("source_slot", "commit_lsn", F.lit(0).cast("bigint").alias("change_seq_in_txn"), names)
    )


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    return undo.judged_requests(inputs.described_changes(spark, folder), inputs.undo_requests(spark, folder))


@query
def wal_undo_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Every request with its outcome: accepted, repeated, or refused with the reason."""
    return _judged(spark, folder).select("requested_by", "place", "action", "outcome", "reason", "before", "after")


@query
def wal_undo_status(spark: SparkSession, folder: str) -> DataFrame:
    rows = undo.undo_status(_judged(spark, folder))
    return rows.withColumn("change_seq_in_txn", big("change_seq_in_txn"))


def loaded(spark: SparkSession, folder: str) -> DataFrame:
    return checkpoints.load_checkpoints(
        inputs.slots(inputs.change_log(spark, folder)), inputs.stored_checkpoints(spark, folder)
    )


@query
def wal_checkpoint_load(spark: SparkSession, folder: str) -> DataFrame:
    return loaded(spark, folder).select("slot", big("last_lsn_num"))


@query
def wal_checkpoint_history(spark: SparkSession, folder: str) -> DataFrame:
    sent = delivered_transactions(inputs.change_log(spark, folder))
    return checkpoints.checkpoint_history(sent, loaded(spark, folder)).select(
        "slot", "pos", big("commit_lsn_num"), "last_lsn"
    )


@query
def wal_checkpoint_final(spark: SparkSession, folder: str) -> DataFrame:
    return checkpoints.final_checkpoints(delivered(spark, folder), loaded(spark, folder)).select(
        "slot", big("last_lsn_num"), "last_lsn"
    )


@query
def wal_checkpoint_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Save the position of every commit message in arrival order; the last one stays.

    slot_2 has no save and keeps its stored row; slot_3 has no stored row.
    """
    saves = (
        inputs.change_log(spark, folder)
        .where((F.col("kind") == "C") & (F.col("slot") != "slot_2"))
        .select(F.col("slot").alias("slot_name"), F.col("lsn").alias("last_lsn"), F.col("pos").alias("arrival"), "commit_ts")
    )
    return checkpoints.upsert_checkpoints(
        inputs.stored_checkpoints(spark, folder), saves, F.col("commit_ts")
    ).select("slot_name", "last_lsn", big("last_lsn_num"), "updated_at")


@query
def wal_resume(spark: SparkSession, folder: str) -> DataFrame:
    return checkpoints.resume(inputs.change_log(spark, folder), loaded(spark, folder)).select(
        "slot", "begin_pos", "commit_pos", "xid", "commit_lsn"
    )


@query
def wal_resume_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files of the landed log, where each slot resumes, and which of them that opens."""
    index = inputs.log_in_pieces(spark, folder)
    points = index.resume_points(checkpoints.stored_positions(inputs.stored_checkpoints(spark, folder)))
    opened = index.chosen_files(points).select("slot", "file", F.lit(True).alias("opened"))
    piece = F.regexp_extract("file", r"piece=(\d+)", 1).cast("bigint").alias("piece")
    return (
        index.files()
        .join(points, "slot")
        .join(opened, ["slot", "file"], "left")
        .select("slot", piece, "first_pos", "last_pos", "resume_pos", F.coalesce("opened", F.lit(False)).alias("opened"))
    )


@query
def wal_resume_capture(spark: SparkSession, folder: str) -> DataFrame:
    """Half the log is stored; then the capture is restarted at the stored checkpoints."""
    store = Store(spark, scratch_folder(spark, "resume-store"))
    capture_batch(store, inputs.log_steps(spark, folder)[0], 0, clock=F.lit("2024-01-01"), run="first")
    resume_capture(store, inputs.log_in_pieces(spark, folder), clock=F.lit("2025-01-01"))
    return out(store.changes(), CHANGE_OUT)


@query
def wal_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Messages whose text can't be used, with the reason."""
    return raw.decode_messages(inputs.raw_log(spark, folder))[1].select("slot", "pos", "reason")


@query
def wal_disposition_raw(spark: SparkSession, folder: str) -> DataFrame:
    """What happens to each message of the raw log, undecodable and unknown ones too."""
    rows = changes.dispositions(decoded_once(raw.decode_messages(inputs.raw_log(spark, folder))[0]))
    return rows.select("slot", "pos", "kind", "disposition")


@query
def wal_trace_text(spark: SparkSession, folder: str) -> DataFrame:
    return trace.trace(inputs.change_log(spark, folder))


# Audits, on tables with faults.


def faulty_events(spark: SparkSession, folder: str) -> DataFrame:
    """All events; some twice, some with a missing trail, some without a type."""
    number = F.col("id").cast("bigint") % 500
    return (
        inputs.events(spark, folder)
        .withColumn("copy", F.explode(F.when(number == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
        .withColumn(
            "trail_id", F.when(number == 4, F.concat("trail_id", F.lit("-missing"))).otherwise(F.col("trail_id"))
        )
        .withColumn("type", F.when(number != 5, F.col("type")))
        .drop("copy")
    )


def _doubled(rows: DataFrame, some: Column) -> DataFrame:
    """Some rows twice."""
    return rows.unionByName(rows.where(some))


@query
def audit_pk(spark: SparkSession, folder: str) -> DataFrame:
    """The three keys, on tables in which some rows stand twice."""
    some = F.col("id").cast("bigint") % 50 == 7
    stored = inputs.trails(spark, folder).where(~F.col("id").startswith("empty"))
    saved = inputs.stored_batch(spark, folder).checkpoints()
    return (
        audits.primary_key(faulty_events(spark, folder), "id", "events_pk")
        .unionByName(audits.primary_key(_doubled(stored, some), "id", "trails_pk"))
        .unionByName(
            audits.primary_key(_doubled(saved, F.col("slot_name") == "slot_3"), "slot_name", "wal_checkpoint_pk")
            .withColumnRenamed("slot_name", "id")
        )
    )


@query
def audit_event_fk(spark: SparkSession, folder: str) -> DataFrame:
    rows = audits.missing_parents(
        faulty_events(spark, folder), inputs.trails(spark, folder), ["trail_id"], ["id"], "events_trail_fk"
    )
    return rows.select("id", "trail_id", "rule")


@query
def audit_sequence(spark: SparkSession, folder: str) -> DataFrame:
    return audits.duplicate_keys(faulty_events(spark, folder), ["trail_id", "sequence"], "events_trail_sequence")


@query
def audit_not_null(spark: SparkSession, folder: str) -> DataFrame:
    """The stored tables with some values taken away, and checkpoints without a whole column."""
    store = inputs.stored_batch(spark, folder)
    unless = lambda c, bad: F.when(~bad, F.col(c)).alias(c)
    key = F.concat_ws(":", "source_slot", "commit_lsn").alias("id")
    number = F.col("id").cast("bigint")
    named = inputs.trails(spark, folder).where(~F.col("id").startswith("empty")).withColumn("name", unless("name", number % 40 == 3))
    done = store.transactions().select(key, "*").withColumn("commit_ts", unless("commit_ts", F.col("xid") % 70 == 2))
    changed = store.changes().select(
        F.concat_ws(":", "source_slot", "commit_lsn", "change_seq_in_txn").alias("id"), "*"
    ).withColumn("op", unless("op", F.col("table_oid") == 16387)).withColumn("table_name", unless("table_name", F.col("change_seq_in_txn") == 6))
    saved = store.checkpoints().select(F.col("slot_name").alias("id"), "slot_name", "updated_at")
    found = [
        audits.nulls(faulty_events(spark, folder), "events"),
        audits.nulls(named, "trails"),
        audits.nulls(done, "wal_transaction"),
        audits.nulls(changed, "wal_change"),
        audits.nulls(saved, "wal_checkpoint"),
    ]
    rows = [f.select("id", "column", "rule") for f in found]
    out_ = rows[0]
    for more in rows[1:]:
        out_ = out_.unionByName(more)
    return out_


@query
def audit_length(spark: SparkSession, folder: str) -> DataFrame:
    """Whole document texts as trail names, page addresses as event types."""
    named = inputs.table(spark, folder, "documents").select(inputs.text("doc_id").alias("id"), F.col("text").alias("name"))
    typed = inputs.table(spark, folder, "pages").select(
        inputs.text("page_id").alias("id"), inputs.text("page_id").alias("trail_id"), F.col("url").alias("type")
    )
    return (
        audits.too_long(named, audits.TRAIL_LENGTHS, "trails_length")
        .select("id", "column", "rule", F.char_length("name").cast("bigint").alias("n_chars"))
        .unionByName(
            audits.too_long(typed, audits.EVENT_LENGTHS, "events_length").select(
                "id", "column", "rule", F.char_length("type").cast("bigint").alias("n_chars")
            )
        )
    )


@query
def audit_op(spark: SparkSession, folder: str) -> DataFrame:
    """The log as a loader would store it that took every message for a change."""
    rows = inputs.change_log(spark, folder).select("slot", "pos", F.col("kind").alias("op"))
    return audits.bad_operations(rows)


@query
def audit_wal_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of the transactions before redeliveries are dropped."""
    rows = delivered_transactions(inputs.change_log(spark, folder)).select("slot", "xid", "commit_lsn")
    found = audits.duplicate_keys(rows, ["slot", "commit_lsn"], "slot_commit_lsn").unionByName(
        audits.duplicate_keys(rows, ["slot", "xid", "commit_lsn"], "slot_xid_commit_lsn"), allowMissingColumns=True
    )
    # Some changes stand twice.
    stored = _doubled(inputs.stored_batch(spark, folder).changes(), F.col("table_oid") == 16390)
    numbers = audits.duplicate_keys(stored, ["source_slot", "commit_lsn", "change_seq_in_txn"], "change_seq")
    return found.unionByName(
        numbers.select(F.col("source_slot").alias("slot"), "commit_lsn", "copies", "rule"), allowMissingColumns=True
    ).select("slot", shown("xid"), "commit_lsn", "copies", "rule")


@query
def audit_change_fk(spark: SparkSession, folder: str) -> DataFrame:
    """Changes taken from the log whose transaction was never stored, per segment."""
    log = inputs.change_log(spark, folder)
    taken = changes.pieces(log).where(F.col("n") > 0).select("slot", "begin_pos", "n")
    stored = inputs.stored_batch(spark, folder).transactions()
    rows = audits.missing_parents(taken, stored, ["slot", "begin_pos"], ["source_slot", "begin_pos"], "change_transaction_fk")
    return rows.groupBy("slot", "begin_pos", "rule").agg(F.sum("n").alias("n"))


# Streams.


def _captured(spark: SparkSession, folder: str, *starts: tuple[int, str, str]) -> Store:
    """A store after several streams over one arriving log. ``starts``: how many steps of
    the log have arrived, the progress folder, and the moment of the stream's stamps."""
    store = Store(spark, scratch_folder(spark, "stream-store"))
    arriving, here = scratch_folder(spark, "arriving-log"), 0
    steps = inputs.log_steps(spark, folder)
    for upto, progress, moment in starts:
        for step in steps[here:upto]:
            step.write.mode("append").parquet(arriving)
        here = max(here, upto)
        messages = read_message_stream(spark, arriving)
        capture_stream.start_capture(messages, store, progress, once=True, clock=F.lit(moment)).awaitTermination()
    return store


@query
def stream_capture(spark: SparkSession, folder: str) -> DataFrame:
    """The whole log in micro-batches; the stream is stopped and resumed in between."""
    progress, moment = scratch_folder(spark, "progress"), "2024-01-01"
    store = _captured(spark, folder, *[(n, progress, moment) for n in (1, 2, 3)])
    return out(store.changes(), CHANGE_OUT)


@query
def stream_restart(spark: SparkSession, folder: str) -> DataFrame:
    """A stream over half the log; then one that lost its progress, over the whole log."""
    first, second = scratch_folder(spark, "progress"), scratch_folder(spark, "progress")
    store = _captured(spark, folder, (1, first, "2024-01-01"), (3, second, "2025-01-01"))
    return out(store.changes(), CHANGE_OUT)


@query
def wal_checkpoint_stored(spark: SparkSession, folder: str) -> DataFrame:
    """Checkpoints after two streams: a slot is stamped by the last one that moved it.

    The second stream brings redeliveries only, and for slot_1 none at all.
    """
    store = Store(spark, scratch_folder(spark, "checkpoint-store"))
    log = inputs.change_log(spark, folder)
    later = F.col("pos") >= inputs.redelivery_shift(spark, folder)
    low = F.col("slot").isin("slot_0", "slot_1") | (F.col("pos") < inputs.middle_of(log.where(~later), "pos"))
    capture_batch(store, log.where(~later & low), 0, clock=F.lit("2024-01-01"), run="first")
    capture_batch(store, log.where(F.col("slot") != "slot_1"), 0, clock=F.lit("2025-01-01"), run="second")
    return store.checkpoints().select("slot_name", "last_lsn", big("last_lsn_num"), "updated_at")


def _appended(spark: SparkSession, folder: str, *starts: tuple[int, str]) -> Store:
    """A store after several streams over arriving events. ``starts``: how many of the two
    halves have arrived, and the progress folder."""
    store = Store(spark, scratch_folder(spark, "append-store"))
    arriving, here = scratch_folder(spark, "arriving-events"), 0
    append_stream.prepare(store, inputs.stored_events(spark, folder))
    steps = inputs.halves(inputs.pending_events(spark, folder), "arrival")
    trails_ = inputs.trails_before_append(spark, folder)
    for upto, progress in starts:
        for step in steps[here:upto]:
            step.write.mode("append").parquet(arriving)
        here = max(here, upto)
        pending = spark.readStream.schema(schemas.PENDING).parquet(arriving)
        append_stream.start_append(pending, trails_, store, progress, once=True).awaitTermination()
    return store


@query
def stream_append(spark: SparkSession, folder: str) -> DataFrame:
    """Pending events arrive in two steps and are numbered after the stored ones."""
    progress = scratch_folder(spark, "progress")
    return append_stream.appended(_appended(spark, folder, (1, progress), (2, progress)))


@query
def stream_append_restart(spark: SparkSession, folder: str) -> DataFrame:
    """The second stream has lost its progress and reads everything again; trails as touched."""
    first, second = scratch_folder(spark, "progress"), scratch_folder(spark, "progress")
    store = _appended(spark, folder, (1, first), (2, second))
    lengths = append_stream.appended(store).groupBy(F.col("trail_id").alias("id")).agg(F.count("*").alias("added"))
    touched = append_stream.touched_trails(store, inputs.trails_before_append(spark, folder))
    return touched.join(lengths, "id", "left").select("id", "updated_at", F.coalesce("added", F.lit(0)).alias("added"))
