"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "annalist", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.variant.allowDuplicateKeys": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's shared ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a folder on this machine; check.py, bench.py
    and the tests name one.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        shared = tempfile.mkdtemp(prefix="annalist-")
    return os.path.join(shared, f"{purpose}-{uuid.uuid4().hex}")


# While tables are written: the shuffle files of a write go when it has ended, not when the
# driver happens to collect garbage, and rows are not sorted by the folder they go to.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxConcurrentOutputFileWriters": "3"}


@contextmanager
def lean_writes(spark: SparkSession) -> Iterator[None]:
    """The session's settings are as before afterwards, so this must not overlap in threads."""
    before = {name: spark.conf.get(name) for name in WRITING}
    try:
        for name, value in WRITING.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def land(rows: DataFrame, path: str, *parts: str) -> None:
    """Write a table for later steps of the session, in folders by the columns ``parts``."""
    with lean_writes(rows.sparkSession):
        rows.write.mode("overwrite").partitionBy(*parts).option("compression", "zstd").parquet(path)


def kept(rows: DataFrame, purpose: str) -> DataFrame:
    """The rows, worked out once into the scratch folder, for callers that read them again."""
    path = scratch_folder(rows.sparkSession, purpose)
    land(rows, path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
