"""Canonical schemas. Every operator reads and returns these columns."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT, LONG, INT, TIME, BYTES = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampNTZType(), T.BinaryType()
TEXTS = T.ArrayType(T.StringType())
LSN_NUMBER = T.DecimalType(20, 0)
TUPLE = T.ArrayType(T.StructType([T.StructField("kind", TEXT), T.StructField("value", TEXT)]))


def table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, data_type) for name, data_type in columns.items()])


TRAILS = table(id=TEXT, name=TEXT, created_at=TIME, updated_at=TIME)

# ``occured_at`` keeps its customary spelling in the stored data.
EVENTS = table(id=TEXT, trail_id=TEXT, type=TEXT, payload=TEXT, occured_at=TIME, sequence=LONG)

# Events still to be numbered; ``arrival`` is their order.
PENDING = table(id=TEXT, trail_id=TEXT, type=TEXT, payload=TEXT, occured_at=TIME, arrival=LONG)

# One row per decoded change message; ``pos`` is the arrival order within a slot
# and unique there. ``kind``: B begin, C commit, R relation, I insert, U update,
# D delete, T truncate; NULL marks a message that could not be decoded. ``carried``
# is set only on a BEGIN taken over from an earlier micro-batch: how many of its
# changes are stored already. ``column_types`` (type ids of a relation's columns) and
# ``truncated`` (ids of truncated relations) are for the trace only. ``identity`` (replica
# identity: d default, n nothing, f full, i index) and ``key_flags`` (one per column: part of
# the key) belong to relation messages and are used by described changes only.
MESSAGES = table(
    slot=TEXT,
    pos=LONG,
    kind=TEXT,
    xid=LONG,
    lsn=TEXT,
    commit_ts=TIME,
    relation_id=LONG,
    namespace=TEXT,
    relation=TEXT,
    columns=TEXTS,
    old_tuple=TUPLE,
    new_tuple=TUPLE,
    received_at=TIME,
    carried=LONG,
    column_types=T.ArrayType(LONG),
    truncated=T.ArrayType(LONG),
    identity=TEXT,
    key_flags=T.ArrayType(T.BooleanType()),
)

# A transaction is identified by its slot and commit position; ``begin_pos`` links
# it to its changes, also while its commit is not known yet.
WAL_TRANSACTION = table(
    source_slot=TEXT,
    source_db=TEXT,
    xid=LONG,
    begin_lsn=TEXT,
    commit_lsn=TEXT,
    commit_lsn_num=LSN_NUMBER,
    end_lsn=TEXT,
    commit_ts=TIME,
    origin_name=TEXT,
    tenant_id=TEXT,
    change_count=INT,
    forward_sql_text=TEXT,
    reverse_sql_text=TEXT,
    forward_sql_hash=BYTES,
    reverse_sql_hash=BYTES,
    safety_flags=TEXTS,
    ingest_batch_id=TEXT,
    ingested_at=TIME,
    begin_pos=LONG,
)

WAL_CHANGE = table(
    source_slot=TEXT,
    commit_lsn=TEXT,
    begin_pos=LONG,
    change_seq_in_txn=INT,
    change_lsn=TEXT,
    tenant_id=TEXT,
    schema_name=TEXT,
    table_name=TEXT,
    table_oid=LONG,
    op=TEXT,
    replica_identity_mode=TEXT,
    row_pk=TEXT,
    old_row=TEXT,
    new_row=TEXT,
    changed_columns=TEXTS,
    forward_dml_sql=TEXT,
    reverse_dml_sql=TEXT,
    forward_sql_hash=BYTES,
    reverse_sql_hash=BYTES,
    reverse_where_sql=TEXT,
    affected_row_count=INT,
    undo_status=TEXT,
    undo_applied_at=TIME,
    undo_applied_by=TEXT,
    safety_flags=TEXTS,
    created_at=TIME,
)

WAL_CHECKPOINT = table(slot_name=TEXT, last_lsn=TEXT, last_lsn_num=LSN_NUMBER, updated_at=TIME)
