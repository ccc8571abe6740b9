"""Exact deduplication that treats heavy hitters apart, in DataFrame functions only.

A digest shared by a third of all rows would meet in one task. So a Misra-Gries summary
(Spark's ``approx_top_k``, a frequent-items sketch with a fixed number of counters)
first finds the digests that may be that frequent. Their rows are counted exactly with a
map-side combine, and the few verified winners are broadcast: rows of heavy texts are
decided where they lie. All other digests take an ordinary shuffle: texts that repeat are
counted and their rows joined with the counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.tables import stored

# A digest of at least 1 / HEAVY of all rows is heavy, so there are at most HEAVY of them.
# With COUNTERS counters the sketch errs by at most 3.5 / (2 * COUNTERS) of the rows, so
# it names every heavy digest and fewer than NAMED in all: the broadcast is bounded.
HEAVY = 1024
COUNTERS = 8192
NAMED = 1400


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Which of the rows with equal texts stays: the one of the largest doc_id.

    ``docs`` needs doc_id and text; other columns are ignored. Texts are equal when they
    are identical; a null text is an empty one. Returns one row per input row: doc_id,
    keep_id, group_size, kept, text_sha256.

    Of rows that also share the largest doc_id exactly one is kept. A null doc_id is
    smaller than any other; a group with null ids only keeps one row, with a null
    keep_id. An empty table gives an empty table.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digests = stored(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.monotonically_increasing_id().alias("row"),
            F.xxhash64(text).alias("digest"),
            F.unhex(F.sha2(text, 256)).alias("sha"),
        ),
        "digests",
    )
    named = digests.agg(F.expr(f"approx_top_k(digest, {NAMED}, {COUNTERS})").alias("found"), F.count("*").alias("n"))
    frequent = (
        named.select("n", F.explode("found").alias("item"))
        .where(F.col("item.count") * HEAVY >= F.col("n"))
        .select(F.col("item.item").alias("digest"))
    )
    order = F.struct(F.col("doc_id"), F.col("row"))
    # The summary only names digests; texts are told apart by SHA-256 and counted exactly.
    winners = (
        digests.join(F.broadcast(frequent), "digest", "left_semi")
        .groupBy("sha")
        .agg(F.max(order).alias("winner"), F.count("*").alias("group_size"))
    )
    split = digests.join(F.broadcast(winners), "sha", "left")
    heavy = split.where(F.col("group_size").isNotNull()).select("doc_id", "row", "sha", "winner", "group_size")
    rest = split.where(F.col("group_size").isNull()).select("doc_id", "row", "sha")
    # Counted map-side, into a table of its own, so that adaptive execution can split what
    # meets a text that is just not heavy.
    repeated = stored(
        rest.groupBy("sha").agg(F.max(order).alias("winner"), F.count("*").alias("group_size")).where("group_size > 1"), "repeated-texts"
    )
    other = rest.join(repeated, "sha", "left").select(
        "doc_id", "row", "sha", F.coalesce("winner", order).alias("winner"), F.coalesce("group_size", F.lit(1)).alias("group_size")
    )
    return heavy.unionByName(other).select(
        "doc_id",
        F.col("winner.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("winner.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
