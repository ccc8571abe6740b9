"""Changes with everything that can be told of them: key, statements, hashes, flags.

All of it comes from the two tuples and the relation version that the as-of lookup has
found, as column expressions in the one wide pass of ``numbered_changes``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions import statements as st
from annalist.operators import safety
from annalist.operators.buckets import DEFAULT_BITS
from annalist.operators.changes import numbered_changes

# What a change keeps of its message and relation until its number is known.
_CARRIED = ("identity", "keys", "repeats", "old_image", "new_image")


def carried_columns() -> dict[str, Column]:
    kind, columns = F.col("kind"), F.col("known.columns")
    return {
        "identity": F.col("known.identity"),
        "keys": st.key_names(columns, F.col("known.key_flags")),
        "repeats": F.col("known.repeats"),
        "old_image": F.when(kind.isin("U", "D"), st.image_of(columns, F.col("old_tuple"), F.col("known.repeats"))),
        "new_image": F.when(kind.isin("I", "U"), st.image_of(columns, F.col("new_tuple"), F.col("known.repeats"))),
    }


def _hash(text: str | Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def described_changes(log: DataFrame, chosen: DataFrame, counted: DataFrame, bits: int = DEFAULT_BITS) -> DataFrame:
    """``numbered_changes`` with the columns that the capture leaves at their defaults.

    A statement that cannot be given is NULL. ``change_count`` is that of the whole
    transaction. Each step below is used by the next, so it is worked out once.
    """
    rows = numbered_changes(log, chosen, counted, bits, carried_columns())
    kind, old, new = F.col("op"), F.col("old_image"), F.col("new_image")
    identity, keys = F.col("identity"), F.col("keys")
    return (
        rows.withColumns(
            {
                "key_before": st.key_before(kind, old, new, identity, keys),
                "key_after": st.key_after(kind, new, identity, keys),
                "changed_columns": F.when(kind == "U", st.changed_columns(old, new, identity, keys)).otherwise(F.array().cast("array<string>")),
                "target": st.qualified(F.col("schema_name"), F.col("table_name")),
            }
        )
        .withColumns(
            {
                "replica_identity_mode": st.identity_word(identity),
                "row_pk": st.as_json(F.when(kind == "I", F.col("key_after")).otherwise(F.col("key_before"))),
                "reverse_where_sql": st.where_clause(F.col("key_after")),
                "where_before": st.where_clause(F.col("key_before")),
            }
        )
        .withColumns(
            {
                "forward_dml_sql": st.forward_statement(kind, F.col("target"), new, F.col("where_before")),
                "reverse_dml_sql": st.reverse_statement(kind, F.col("target"), old, identity, F.col("reverse_where_sql")),
            }
        )
        .withColumns(
            {
                "forward_sql_hash": _hash("forward_dml_sql"),
                "reverse_sql_hash": _hash("reverse_dml_sql"),
                "flag_bits": safety.flag_bits(safety.rules()),
            }
        )
        .withColumn("safety_flags", safety.flag_names(F.col("flag_bits"), list(safety.rules())))
        .drop(*_CARRIED, "target", "where_before", "key_before", "key_after")
    )


TRANSACTION = ["source_slot", "commit_lsn", "begin_pos"]
FORWARD, REVERSE = "forward", "reverse"
# So many digests make up one of the next level.
FAN_OUT_BITS, LEVELS = 10, 4


def statement_fragments(described: DataFrame) -> DataFrame:
    """The statements of each transaction as numbered fragments, in order and, to undo it,
    backwards. A fragment without a statement is NULL.

    A change knows its number and its transaction's size, so its place in both directions
    needs no other row: a transaction of any size is nowhere gathered.
    """
    seq = F.col("change_seq_in_txn").cast("bigint")
    ways = F.array(
        F.struct(F.lit(FORWARD).alias("direction"), seq.alias("place"), F.col("forward_dml_sql").alias("statement")),
        F.struct(F.lit(REVERSE).alias("direction"), (F.col("change_count") + 1 - seq).alias("place"), F.col("reverse_dml_sql").alias("statement")),
    )
    return described.select(*TRANSACTION, F.explode(ways).alias("f")).select(*TRANSACTION, "f.*")


def statement_hashes(fragments: DataFrame) -> DataFrame:
    """Per transaction and direction: how many fragments there are, how many of them have
    no statement, and a tree hash of the text, NULL when any statement is missing.

    Level 0 are the SHA-256 hex digests of the statements. 2^10 neighbouring digests, in
    order and joined without anything between, give one of the next level, up to level 4,
    so a task holds 1024 digests of a transaction, not its text. 2^40 changes fit.

    Digests move as bytes. From level 1 on, with a 1024th of the rows, or one for a small
    transaction, a transaction's nodes stay together and move no more.
    """
    keys = [*TRANSACTION, "direction"]
    level = fragments.select(
        *keys, (F.col("place") - 1).alias("place"), _hash("statement").alias("digest"),
        F.lit(1).cast("bigint").alias("n"), F.col("statement").isNull().cast("bigint").alias("missing"),
    )
    none = F.lit("").cast("binary")
    for n in range(LEVELS):
        ordered = F.array_sort(F.collect_list(F.struct("place", F.coalesce("digest", none).alias("digest"))))
        digests = F.transform(ordered, lambda d: F.lower(F.hex(d["digest"])))
        level = (
            level.withColumn("node", F.shiftright("place", FAN_OUT_BITS))
            .groupBy(*keys, "node")
            .agg(_hash(F.array_join(digests, "")).alias("digest"), F.sum("n").alias("n"), F.sum("missing").alias("missing"))
            .withColumnRenamed("node", "place")
        )
        level = level.repartition(*keys) if n == 0 else level
    return level.select(*keys, "n", "missing", F.when(F.col("missing") == 0, F.col("digest")).alias("sql_hash"))
