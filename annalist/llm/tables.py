"""Tables that operators write between their steps, in the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.session import scratch_folder

CHUNK_ROWS = 1024


def stored(rows: DataFrame, purpose: str) -> DataFrame:
    """The rows as written to the shared folder: read again, never computed again."""
    path = scratch_folder(rows.sparkSession, purpose)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def text_bytes(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def shuffle_partitions(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_chunks(
    docs: DataFrame, purpose: str, carry: Sequence[str] = (), partition_bytes: int = 32 << 20
) -> tuple[DataFrame, int]:
    """Store the documents so that later steps find a chunk of them together.

    Returns the table (doc_id, text as bytes, rest, row, chunk) and the bytes of all texts.
    ``rest`` is a struct of the columns in ``carry``, so their names cannot clash. A chunk
    is a run of rows of one input partition. The table is bucketed by chunk as it is
    written, without a shuffle; grouping it by chunk needs none either.
    """
    spark = docs.sparkSession
    rest = F.struct(*carry) if carry else F.lit(None).cast("int")
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text"), rest.alias("rest"))
    total = slim.agg(F.sum(F.octet_length("text")).alias("total")).first()["total"] or 0
    n_buckets = min(100_000, max(shuffle_partitions(docs), -(-total // partition_bytes)))
    rows = slim.withColumn("row", F.monotonically_increasing_id()).withColumn(
        "chunk", F.floor(F.col("row") / CHUNK_ROWS).cast("bigint")
    )
    name = f"llm_{purpose}_{uuid.uuid4().hex}".replace("-", "_")
    writer = rows.write.bucketBy(n_buckets, "chunk").option("compression", "zstd")
    writer.option("path", scratch_folder(spark, purpose)).saveAsTable(name)
    chunks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only; the files stay, and so does what has been resolved
    return chunks, total


def bucketed(rows: DataFrame, column: str, n_buckets: int, purpose: str) -> DataFrame:
    """The rows as written to the shared folder in buckets of ``column``, without a shuffle;
    grouping them by it needs none either."""
    spark = rows.sparkSession
    name = f"llm_{purpose}_{uuid.uuid4().hex}".replace("-", "_")
    writer = rows.write.bucketBy(n_buckets, column).option("compression", "zstd")
    writer.option("path", scratch_folder(spark, purpose)).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only; the files stay, and so does what has been resolved
    return table
