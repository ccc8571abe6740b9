"""Readable trace of the message log, one text per message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions.clock import trace_stamp
from annalist.functions.tuples import printable_tuple
from annalist.operators.buckets import DEFAULT_BITS
from annalist.operators.relations import with_relations
from annalist.operators.segments import CHANGE_KINDS

# The title of each message kind.
TITLES = {
    "B": "BEGIN TRANSACTION",
    "C": "COMMIT TRANSACTION",
    "R": "RELATION/TABLE SCHEMA",
    "I": "INSERT OPERATION",
    "U": "UPDATE OPERATION",
    "D": "DELETE OPERATION",
    "T": "TRUNCATE OPERATION",
}


# Fixed value: the line after each message.
CLOSING = "  ---"


def _detail(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"  {label}: "), value.cast("string"))


def trace(log: DataFrame, bits: int = DEFAULT_BITS) -> DataFrame:
    """Title with the time of receipt, then the details of the kind, then a closing line.

    Row values and the closing line appear only when the relation is known. Old values are
    left out of updates and deletes that carry none. Type ids are shown where the log has them.
    """
    rows = with_relations(log, bits)
    kind, columns = F.col("kind"), F.col("known.columns")
    title = F.lit(None).cast("string")
    for code, words in TITLES.items():
        title = F.when(kind == code, F.lit(words)).otherwise(title)
    table = F.when(F.col("known").isNull(), F.concat(F.lit("Unknown (relation "), F.col("relation_id"), F.lit(")")))
    table = table.otherwise(F.concat_ws(".", "known.namespace", "known.relation"))
    typed = F.zip_with(
        "columns",
        F.coalesce("column_types", F.array().cast("array<bigint>")),
        lambda name, kind_: F.concat(name, F.coalesce(F.concat(F.lit(" (Type: "), kind_.cast("string"), F.lit(")")), F.lit(""))),
    )
    names = F.transform(typed, lambda name, i: F.concat(F.lit("    Column "), i.cast("string"), F.lit(": "), name))
    relations = F.concat(F.lit("  Relations: ["), F.array_join("truncated", " "), F.lit("]"))
    is_known = F.col("known").isNotNull()
    lines = F.array(
        F.concat(F.lit("["), trace_stamp(F.col("received_at")), F.lit("] "), F.coalesce(title, F.lit("UNKNOWN MESSAGE TYPE"))),
        F.when(kind == "B", _detail("Transaction ID", F.col("xid"))),
        F.when(kind.isin("B", "C"), _detail("LSN", F.col("lsn"))),
        F.when(kind.isin("R", *CHANGE_KINDS), _detail("Relation ID", F.col("relation_id"))),
        F.when(kind == "R", _detail("Namespace", F.col("namespace"))),
        F.when(kind == "R", _detail("Table", F.col("relation"))),
        F.when(kind == "R", _detail("Columns", F.size("columns"))),
        F.when((kind == "R") & (F.size("columns") > 0), F.array_join(names, "\n")),
        F.when(kind == "T", relations),
        F.when(kind.isin(*CHANGE_KINDS), _detail("Table", table)),
        F.when(is_known & (kind == "U") & F.col("old_tuple").isNotNull(), printable_tuple("  Old Row", columns, F.col("old_tuple"))),
        F.when(is_known & (kind == "D") & F.col("old_tuple").isNotNull(), printable_tuple("  Deleted Row", columns, F.col("old_tuple"))),
        F.when(is_known & kind.isin("I", "U"), printable_tuple("  New Row", columns, F.col("new_tuple"))),
        F.when(~F.coalesce(kind.isin(*CHANGE_KINDS), F.lit(False)) | is_known, F.lit(CLOSING)),
    )
    return rows.select("slot", "pos", "kind", F.array_join(lines, "\n").alias("trace"))
