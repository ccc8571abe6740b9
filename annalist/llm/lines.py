"""Incremental, reversible removal of lines that many documents share.

State, in one folder of shared storage, written anew by each step and never changed:

* ``postings``: signed rows (digest, doc_id, change), what was inserted and deleted;
* ``counts``: per digest the number of documents and the largest of them, exact; a later
  step's row replaces an earlier one's;
* ``filters``: per shard of digests a cuckoo filter of those that occur at all.

The filter of a shard says which digests of a new batch were never seen: they need no
look at the counts, only a new row. The others are looked up exactly. A deletion takes
counts down again, looks up the next largest document where the largest one goes, and
deletes from the filter what no document holds any more.

Before any shuffle a batch is reduced to one row per digest, so a line of a third of all
documents is one row per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from annalist.llm.cuckoo import CuckooFilter
from annalist.llm.tables import shuffle_partitions, stored, text_bytes
from annalist.session import scratch_folder

_SPACE = b" \t\n\x0b\x0c\r"
_POSTINGS = "digest binary, doc_id bigint, change int"
_COUNTS = "digest binary, n bigint, top bigint"
_FILTERS = "shard int, blob binary"
_MARKED = "digest binary, n bigint, top bigint, seen boolean"
SHARD_DIGESTS = 1 << 20


def digest_of(line: bytes, min_chars: int) -> bytes | None:
    """The digest of a line's key, or None for a line too short to count."""
    key = line.strip(_SPACE).lower()  # bytes: only A-Z are lowered
    if len(key) < min_chars or (not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def postings_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """(digest, doc_id): each long line of each document, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, owner = [], []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                keys = {digest_of(line, min_chars) for line in text.split(b"\n")} if text else set()
                keys.discard(None)
                found += keys
                owner += [doc] * len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(owner, pa.int64())], ["digest", "doc_id"])

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = slim.where(F.col("doc_id").isNotNull()).mapInArrow(run, "digest binary, doc_id bigint")
    return rows


# What happens to one shard's filter.


def _numbers(table: pa.Table) -> np.ndarray:
    """The first 64 bits of the digests."""
    return np.frombuffer(b"".join(d[:8] for d in table["digest"].to_pylist()) or b"", np.uint64)


def _filter_rows(shard: int, blob: bytes) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int32()), "blob": pa.array([blob], pa.binary())})


def _mark(batch: pa.Table, state: pa.Table) -> pa.Table:
    """Which digests of a batch the filter has seen; without a filter, none."""
    seen = np.zeros(batch.num_rows, bool)
    if batch.num_rows and state.num_rows:
        seen = CuckooFilter(blob=state["blob"][0].as_py()).contains(_numbers(batch))
    return pa.table([batch["digest"], batch["n"], batch["top"], pa.array(seen, pa.bool_())], ["digest", "n", "top", "seen"])


def _build(table: pa.Table) -> pa.Table:
    numbers = _numbers(table)
    capacity = 2 * len(numbers)
    while not (built := CuckooFilter(capacity)).insert(numbers):
        capacity *= 2
    return _filter_rows(table["shard"][0].as_py(), built.to_bytes())


def _fill(new: pa.Table, state: pa.Table) -> pa.Table:
    """The filter with new digests; an empty blob if it has to be built larger."""
    if not state.num_rows:
        return _build(new)
    grown = CuckooFilter(blob=state["blob"][0].as_py())
    fits = grown.insert(_numbers(new)) and len(grown) <= grown.capacity
    return _filter_rows(state["shard"][0].as_py(), grown.to_bytes() if fits else b"")


def _forget(gone: pa.Table, state: pa.Table) -> pa.Table:
    left = CuckooFilter(blob=state["blob"][0].as_py())
    left.delete(_numbers(gone))
    return _filter_rows(state["shard"][0].as_py(), left.to_bytes())


@dataclass
class LineIndex:
    """The lines of a growing set of documents. ``folder`` is shared storage; ``shards``
    should keep a shard's digests within a task's memory."""

    spark: SparkSession
    folder: str
    shards: int
    version: int = 0

    def _write(self, rows: DataFrame, table: str) -> DataFrame:
        path = f"{self.folder}/{table}/version={self.version}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _read(self, table: str, schema: str) -> DataFrame:
        """All versions of a table up to the current one."""
        if not self.version:
            return self.spark.createDataFrame([], f"{schema}, version int")
        root = f"{self.folder}/{table}"
        paths = [f"{root}/version={v}" for v in range(1, self.version + 1)]
        return self.spark.read.option("basePath", root).schema(f"{schema}, version int").parquet(*paths)

    def _sharded(self, rows: DataFrame) -> GroupedData:
        shard = F.pmod(F.xxhash64("digest"), F.lit(self.shards)).cast("int")
        return rows.withColumn("shard", shard).groupBy("shard")

    def counts(self) -> DataFrame:
        """digest, n, top: the exact counts as they are now; n is 0 for digests that went."""
        rows = self._read("counts", _COUNTS)
        if self.version < 2:
            return rows.drop("version")
        latest = F.max(F.struct("version", "n", "top")).alias("last")
        return rows.groupBy("digest").agg(latest).select("digest", "last.n", "last.top")

    def postings(self) -> DataFrame:
        """digest, doc_id: what is in the index now."""
        rows = self._read("postings", _POSTINGS)
        if rows.where("change < 0").isEmpty():
            return rows.select("digest", "doc_id")
        held = rows.groupBy("digest", "doc_id").agg(F.sum("change").alias("held"))
        return held.where("held > 0").select("digest", "doc_id")

    def _filters(self) -> GroupedData:
        latest = F.max(F.struct("version", "blob")).alias("last")
        rows = self._read("filters", _FILTERS).groupBy("shard").agg(latest)
        return rows.select("shard", "last.blob").groupBy("shard")

    def _rebuild(self) -> None:
        live = self.counts().where("n > 0").select("digest")
        self._write(self._sharded(live).applyInArrow(_build, _FILTERS), "filters")

    def insert(self, postings: DataFrame) -> None:
        """Add documents that are not in the index, given by :func:`postings_of`."""
        counts, filters = self.counts().where("n > 0"), self._filters()
        self.version += 1
        rows = postings.dropDuplicates(["digest", "doc_id"]).select("digest", "doc_id", F.lit(1).alias("change"))
        added = self._write(rows, "postings")
        batch = added.groupBy("digest").agg(F.count("*").alias("n"), F.max("doc_id").alias("top"))
        if self.version == 1:
            self._write(batch, "counts")
            self._rebuild()
            return
        marked = self._write(self._sharded(batch).cogroup(filters).applyInArrow(_mark, _MARKED), "marked")
        # The exact table is read for digests that the filters have seen, and no others.
        seen = marked.where("seen").drop("seen")
        known = counts.join(seen.select("digest"), "digest", "left_semi")
        merged = known.unionByName(seen).groupBy("digest").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
        self._write(merged.unionByName(marked.where("not seen").drop("seen")), "counts")
        # A digest that a filter claimed wrongly goes into it as well, or deleting its twin would lose it.
        new = marked.select("digest").join(known.select("digest"), "digest", "left_anti")
        written = self._write(self._sharded(new).cogroup(filters).applyInArrow(_fill_if_any, _FILTERS), "filters")
        if not written.where(F.octet_length("blob") == 0).isEmpty():
            self._rebuild()

    def delete(self, postings: DataFrame) -> None:
        """Take documents out that are in the index, given by :func:`postings_of`."""
        counts, filters, live = self.counts().where("n > 0"), self._filters(), self.postings()
        self.version += 1
        rows = postings.dropDuplicates(["digest", "doc_id"]).join(live, ["digest", "doc_id"], "left_semi")
        gone = self._write(rows.select("digest", "doc_id", F.lit(-1).alias("change")), "postings")
        lost = gone.groupBy("digest").agg(F.count("*").alias("lost"))
        left = live.join(lost, "digest", "left_semi").join(gone, ["digest", "doc_id"], "left_anti")
        tops = left.groupBy("digest").agg(F.max("doc_id").alias("top"))
        fewer = counts.drop("top").join(lost, "digest").join(tops, "digest", "left")
        changed = self._write(fewer.select("digest", (F.col("n") - F.col("lost")).alias("n"), "top"), "counts")
        empty = changed.where("n = 0").select("digest")
        self._write(self._sharded(empty).cogroup(filters).applyInArrow(_forget_if_any, _FILTERS), "filters")

    def repeated(self, min_docs: int) -> DataFrame:
        """digest, top: lines that at least ``min_docs`` documents hold, and their keeper."""
        return self.counts().where(F.col("n") >= min_docs).select("digest", "top")


def _unchanged(table: pa.Table) -> pa.Table:
    return table.select(["shard", "blob"])


def _fill_if_any(new: pa.Table, state: pa.Table) -> pa.Table:
    return _fill(new, state) if new.num_rows else _unchanged(state)


def _forget_if_any(gone: pa.Table, state: pa.Table) -> pa.Table:
    return _forget(gone, state) if gone.num_rows else _unchanged(state)


def clean(
    docs: DataFrame, index: LineIndex, min_docs: int, min_chars: int, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Drop the repeated lines of documents in the index, but for the largest holder's.

    Returns one row per input row: doc_id, rest (a struct of the columns in ``carry``),
    text (unchanged), kept (the text that is left), n_lines, n_dropped; texts as bytes.
    """
    # A table of its own, so that adaptive execution can split a common line's postings.
    repeated = stored(index.repeated(min_docs), "repeated-lines")
    drops = (
        index.postings()
        .join(repeated, "digest")
        .where(F.col("doc_id") < F.col("top"))
        .groupBy("doc_id")
        .agg(F.collect_set("digest").alias("drops"))  # no more than the document has lines
    )
    rest = F.struct(*carry) if carry else F.lit(None).cast("int")
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), rest.alias("rest"), text_bytes().alias("text"))
    out = slim.withColumns({"kept": F.col("text"), "n_lines": F.lit(0).cast("bigint"), "n_dropped": F.lit(0).cast("bigint")})
    schema = to_arrow_schema(out.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            for text, drop in zip(batch["text"].to_pylist(), batch["drops"].to_pylist(), strict=True):
                lines = left = text.split(b"\n")
                if drop:
                    drop = set(drop)
                    left = [line for line in lines if digest_of(line, min_chars) not in drop]
                kept.append(b"\n".join(left))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
            columns = {c: batch[c] for c in ("doc_id", "rest", "text")} | {"kept": pa.array(kept, pa.binary())}
            columns |= {"n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)

    return slim.join(drops, "doc_id", "left").mapInArrow(run, out.schema)


def drop_repeated_lines(
    docs: DataFrame, min_docs: int = 5, min_chars: int = 40, batches: int = 2, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Drop lines that at least ``min_docs`` documents hold, but for the largest holder's.

    ``docs`` needs doc_id and text; other columns are ignored unless named in ``carry``.
    Lines end at \\n; their key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and
    with A-Z lowered. Keys under ``min_chars`` code points never go. The documents enter
    a new :class:`LineIndex` in ``batches`` steps, as a growing corpus would. Returns what
    :func:`clean` does.

    A null or empty text is one empty line, which stays. All rows of one doc_id are one
    document. A row without doc_id is no holder and keeps its lines. Of a line that stands
    several times in its largest holder, all stay. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    step = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    postings = stored(postings_of(docs, min_chars).withColumn("step", step), "line-postings")
    shards = max(shuffle_partitions(docs), -(-postings.count() // SHARD_DIGESTS))
    index = LineIndex(spark, scratch_folder(spark, "line-index"), shards)
    for i in range(batches):
        index.insert(postings.where(F.col("step") == i).select("digest", "doc_id"))
    return clean(docs, index, min_docs, min_chars, carry)
