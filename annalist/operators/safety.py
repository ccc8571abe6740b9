"""Flags that warn of a change, from a table of rules, per change and per transaction."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions.tuples import KIND_UNCHANGED


def rules() -> dict[str, Column]:
    """What each flag says of a change, over the columns of ``described_changes``. The order
    is the order of the bits, so new rules are added at the end."""
    missing = lambda c: F.col(c).isNull()
    unsent = lambda c: F.exists(c, lambda e: e["kind"] == KIND_UNCHANGED)
    return {
        "no_identity": F.coalesce(F.col("identity") == "n", F.lit(True)),
        "update_without_old_image": (F.col("op") == "U") & missing("old_image"),
        "delete_without_old_image": (F.col("op") == "D") & missing("old_image"),
        "row_not_found": F.col("op").isin("U", "D") & missing("key_before"),
        "key_changed": (F.col("op") == "U") & F.col("old_image").isNotNull() & (F.col("key_before") != F.col("key_after")),
        "unsent_values": unsent("old_image") | unsent("new_image"),
        "repeated_columns": F.col("repeats"),
        "not_reversible": missing("reverse_dml_sql"),
    }


def flag_bits(table: Mapping[str, Column]) -> Column:
    """All rules in one number, in one pass over the row."""
    bits = [F.when(F.coalesce(holds, F.lit(False)), 1 << i).otherwise(0) for i, holds in enumerate(table.values())]
    out = F.lit(0).cast("bigint")
    for bit in bits:
        out = out + bit
    return out


def flag_names(bits: Column, flags: list[str]) -> Column:
    """The names of the set bits, sorted."""
    present = [F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, F.lit(name)) for name, i in sorted((f, i) for i, f in enumerate(flags))]
    return F.filter(F.array(*present), lambda f: f.isNotNull())


def transaction_flags(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The union of the flags of a transaction's changes. Bits are united map-side, so a
    transaction of any size is one number per task."""
    flags = list(rules())
    return (
        changes.groupBy(*keys)
        .agg(F.bit_or("flag_bits").alias("flag_bits"), F.count(F.lit(1)).alias("change_count"))
        .select(*keys, "change_count", flag_names(F.col("flag_bits"), flags).alias("safety_flags"))
    )
