"""Which positions each file of a landed log holds, so that a restart opens only what it needs.

Per slot and file: the first and last position, the lowest and highest commit position, and
the last control message; and all relation messages, which are few. Files are indexed once.
The positions of a slot must not interleave between files.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist import schemas
from annalist.functions.lsn import lsn_to_num
from annalist.operators.segments import COMMIT, RELATION, control_code
from annalist.sources.messages import normalize

FILES = schemas.table(
    file=schemas.TEXT,
    slot=schemas.TEXT,
    first_pos=schemas.LONG,
    last_pos=schemas.LONG,
    low_commit=schemas.LSN_NUMBER,
    top_commit=schemas.LSN_NUMBER,
    last_control=schemas.LONG,
)


def _plain(file: str) -> str:
    """A file's address with one slash behind the scheme, where Spark's lists differ."""
    return re.sub(r"^(\w+):/+", r"\1:/", file)


@dataclass(frozen=True)
class LogIndex:
    spark: SparkSession
    log: str
    root: str

    def _read(self, table: str, schema) -> DataFrame:
        system = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        there = system.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(system)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}") if there else self.spark.createDataFrame([], schema)

    def files(self) -> DataFrame:
        return self._read("files", FILES)

    def relations(self) -> DataFrame:
        return self._read("relations", schemas.MESSAGES)

    def refresh(self) -> int:
        """Index the files that have arrived since; returns how many. The relation messages
        are written first: a file counts as indexed once its positions are there."""
        here = self.spark.read.schema(schemas.MESSAGES).parquet(self.log).inputFiles()
        known = {_plain(r["file"]) for r in self.files().select("file").distinct().collect()}
        new = [f for f in here if _plain(f) not in known]
        if not new:
            return 0
        rows = self.spark.read.schema(schemas.MESSAGES).parquet(*new).select("*", F.col("_metadata.file_path").alias("file"))
        commit = F.when(F.col("kind") == COMMIT, lsn_to_num(F.col("lsn")))
        found = rows.groupBy("file", "slot").agg(
            F.min("pos").alias("first_pos"),
            F.max("pos").alias("last_pos"),
            F.min(commit).alias("low_commit"),
            F.max(commit).alias("top_commit"),
            F.max(control_code()).alias("last_control"),
        )
        normalize(rows.where(F.col("kind") == RELATION)).write.mode("append").parquet(f"{self.root}/relations")
        found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FILES.fields]).write.mode("append").parquet(f"{self.root}/files")
        return len(new)

    def resume_points(self, loaded: DataFrame) -> DataFrame:
        """slot, resume_pos: where the first transaction begins that reaches the slot's loaded
        position (slot, last_lsn_num), or one that is still open at the end."""
        files = self.files().join(loaded, "slot", "left").withColumn("last_lsn_num", F.coalesce("last_lsn_num", F.lit(0)))
        reached = F.when(F.col("top_commit") >= F.col("last_lsn_num"), F.col("first_pos"))
        starts = files.groupBy("slot").agg(F.min(reached).alias("start"), (F.max("last_pos") + 1).alias("end"))
        before = files.select("slot", "first_pos", "last_control").join(starts, "slot")
        earlier = F.col("first_pos") < F.coalesce("start", "end")
        last = before.groupBy("slot").agg(
            F.max(F.when(earlier, F.col("last_control"))).alias("control"), F.max(F.coalesce("start", "end")).alias("start")
        )
        opened = F.when(F.col("control") % 2 == 1, F.shiftright("control", 1))
        return last.select("slot", F.least(F.coalesce(opened, F.col("start")), F.col("start")).alias("resume_pos"))

    def chosen_files(self, points: DataFrame) -> DataFrame:
        """The files that hold anything from a slot's resume point on."""
        return self.files().join(points, "slot").where(F.col("last_pos") >= F.col("resume_pos"))

    def resumed_messages(self, loaded: DataFrame) -> DataFrame:
        """The messages from the resume points on, and before them the latest of each relation.

        Only the chosen files are opened. Their names pass through the driver, as those of
        any table that Spark reads do.
        """
        points = self.resume_points(loaded)
        chosen = [r["file"] for r in self.chosen_files(points).select("file").distinct().collect()]
        fields = [c for c in schemas.MESSAGES.fieldNames() if c not in ("slot", "relation_id", "pos")]
        known = (
            self.relations()
            .join(points, "slot")
            .where(F.col("pos") < F.col("resume_pos"))
            .groupBy("slot", "relation_id")
            .agg(F.max_by(F.struct(*fields), "pos").alias("last"), F.max("pos").alias("pos"))
            .select("slot", "relation_id", "pos", "last.*")
        )
        known = normalize(known)
        if not chosen:
            return known
        read = normalize(self.spark.read.schema(schemas.MESSAGES).parquet(*chosen))
        rest = read.join(points, "slot").where(F.col("pos") >= F.col("resume_pos")).select(*schemas.MESSAGES.fieldNames())
        return known.unionByName(rest)
