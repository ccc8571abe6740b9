"""Decoded change messages, as a table or as a stream with the same schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist import schemas


def normalize(messages: DataFrame) -> DataFrame:
    """Bring messages to the canonical columns; absent ones become NULL."""
    fields = schemas.MESSAGES.fields
    present = set(messages.columns)
    return messages.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in fields
        ]
    )


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return normalize(spark.read.schema(schemas.MESSAGES).parquet(path))


def read_message_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Messages from files in the order the files were added.

    Positions of a slot must not fall from one file to the next if ``max_files``
    bounds the files of a micro-batch; without it a batch takes all new files.
    """
    reader = spark.readStream.schema(schemas.MESSAGES)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return normalize(reader.parquet(path))
