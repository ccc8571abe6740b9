"""The stored change tables: attempts, and a manifest that says which of them count.

Every attempt at a batch writes its tables into a folder of its own. The last thing it
writes is one row of the manifest, and readers follow the manifest only. So a failed
attempt is never seen, not even in part; a retry leaves what readers see untouched until
it is complete; and a batch that is published already is not done again.

A batch is named by the run it belongs to and its number there. Runs count on their own,
so a stream that starts afresh on an old store adds to it.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalist import schemas

MANIFEST = T.StructType(
    [
        T.StructField("place", T.LongType()),
        T.StructField("run", T.StringType()),
        T.StructField("batch", T.IntegerType()),
        T.StructField("attempt", T.StringType()),
    ]
)
MAIN = "main"
CHANGES = "wal_change"
FINISHED, OPEN = f"{CHANGES}/finished=true", f"{CHANGES}/finished=false"
# The manifest is summed up after so many entries.
SUMMARY_EVERY = 64
# Tables that only the next batch of the same run reads.
CARRIED = ("segments", "state")


def _place(name: str) -> int:
    return int(name.split("-")[1])


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str

    # Folders.

    def _hadoop(self, path: str):
        jvm = self.spark.sparkContext._jvm
        found = jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), found

    def _exists(self, path: str) -> bool:
        system, found = self._hadoop(path)
        return system.exists(found)

    def _delete(self, path: str) -> None:
        system, found = self._hadoop(path)
        system.delete(found, True)

    def folder(self, table: str, attempt: str) -> str:
        return f"{self.root}/attempts/{attempt}/{table}"

    # The manifest.

    def _names(self, start: str) -> list[str]:
        """Manifest folders of a kind, in order."""
        system, found = self._hadoop(f"{self.root}/manifest")
        if not system.exists(found):
            return []
        return sorted(n for n in (f.getPath().getName() for f in system.listStatus(found)) if n.startswith(start))

    def _rows(self, names: Sequence[str]) -> list[Row]:
        """Manifest rows; a folder that a crash left unfinished holds none."""
        paths = [f"{self.root}/manifest/{n}" for n in names]
        return self.spark.read.schema(MANIFEST).parquet(*paths).orderBy("place").collect() if paths else []

    def published(self) -> list[Row]:
        """The attempts that count, in the order of their publication, one row per batch.

        They are read from the latest summary of the manifest and the entries since.
        """
        summary: list[Row] = []
        for name in reversed(self._names("summary-")):
            if summary := self._rows([name]):
                break
        last = summary[-1]["place"] if summary else 0
        return summary + self._rows([n for n in self._names("entry-") if _place(n) > last])

    def find(self, run: str, batch: int) -> Row | None:
        return next((r for r in self.published() if (r["run"], r["batch"]) == (run, batch)), None)

    def begin(self, run: str, batch: int) -> str:
        """A new attempt's name."""
        return f"{run}-{batch}-{uuid.uuid4().hex}"

    def next_place(self) -> int:
        """Where the next entry goes: behind all others, also behind an unfinished one."""
        return max((_place(n) for n in (*self._names("summary-"), *self._names("entry-"))), default=0) + 1

    def publish(self, run: str, batch: int, attempt: str) -> None:
        """Make an attempt count. One writer at a time; a second one for the same place fails."""
        place = self.next_place()
        self._manifest(f"entry-{place:09d}", [(place, run, batch, attempt)])
        if place % SUMMARY_EVERY == 0:
            self._summarize(place)

    def _manifest(self, name: str, rows: Sequence[tuple]) -> None:
        frame = self.spark.createDataFrame(list(rows), MANIFEST).coalesce(1)
        frame.write.mode("errorifexists").parquet(f"{self.root}/manifest/{name}")

    def _summarize(self, place: int) -> None:
        """Keep what readers have to open small: one summary and the entries since.

        What only readers of the summary before the previous one needed is deleted. The
        tables of the attempts are left alone.
        """
        self._manifest(f"summary-{place:09d}", self.published())
        old = self._names("summary-")[:-1]
        for name in old[:-1]:
            self._delete(f"{self.root}/manifest/{name}")
        for name in self._names("entry-") if old else ():
            if _place(name) <= _place(old[-1]):
                self._delete(f"{self.root}/manifest/{name}")

    # Tables.

    def write(self, rows: DataFrame, table: str, attempt: str, *parts: str) -> DataFrame:
        """Write one table of an attempt, in folders by the columns ``parts``; returns what was written."""
        path = self.folder(table, attempt)
        rows.write.partitionBy(*parts).option("compression", "zstd").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def attempt(self, table: str, attempt: str) -> DataFrame:
        return self.spark.read.parquet(self.folder(table, attempt))

    def read(self, table: str, schema: T.StructType, entries: Sequence[Row] | None = None) -> DataFrame:
        """A table over all published attempts, or those given; empty without any."""
        entries = self.published() if entries is None else entries
        paths = [p for e in entries if self._exists(p := self.folder(table, e["attempt"]))]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def transactions(self, entries: Sequence[Row] | None = None) -> DataFrame:
        return self.read("wal_transaction", schemas.WAL_TRANSACTION, entries)

    def changes(self) -> DataFrame:
        """Changes of stored transactions, each with its transaction's commit position.

        A change whose commit came in the same batch is stored finished. Only those of
        transactions that went on over batches are joined, by run and begin, with the
        commit that closed them, and stay invisible without one.
        """
        entries = self.published()
        finished = self.read(FINISHED, schemas.WAL_CHANGE, entries)
        opened = self.read(OPEN, OPEN_CHANGE, entries)
        closing = self.read("closing", CLOSING, entries)
        joined = opened.drop("commit_lsn").join(closing, ["run", "source_slot", "begin_pos"])
        return finished.unionByName(joined.select(*schemas.WAL_CHANGE.fieldNames()))

    def checkpoints(self, batch: int | None = None) -> DataFrame:
        """The checkpoint table now, or as of one batch; empty before the first."""
        entries = [e for e in self.published() if batch is None or e["batch"] == batch]
        return self.read("wal_checkpoint", schemas.WAL_CHECKPOINT, entries[-1:])

    # Upkeep.

    def forget_carried(self, run: str, batch: int) -> None:
        """Delete what only the batch after this one needed."""
        entry = self.find(run, batch)
        for table in CARRIED if entry else ():
            self._delete(self.folder(table, entry["attempt"]))


OPEN_CHANGE = T.StructType([*schemas.WAL_CHANGE.fields, T.StructField("run", T.StringType())])
#: The commit position of transactions whose changes are stored over several batches.
CLOSING = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("source_slot", T.StringType()),
        T.StructField("begin_pos", T.LongType()),
        T.StructField("commit_lsn", T.StringType()),
    ]
)
