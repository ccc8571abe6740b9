"""Exact top-k by inner product: norm-bucketed retrieval.

Vectors are sorted by length into buckets of like length, each one row of packed
integers. Every block of queries first scores the bucket of the longest vectors, which
gives each query a score to beat. Then blocks meet buckets: the score to beat, divided by
the query's and the bucket's length, is the least cosine a vector of the bucket needs.
Above one, the bucket is skipped. Where it is high, the first coordinates and the lengths
of the rest rule out most vectors; where it is low, the vectors' own lengths do. What is
left is multiplied out in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm.tables import stored

BUCKET_ROWS = 2048  # vectors in a bucket
BLOCK_ROWS = 256  # queries in a block
RANGE_ROWS = 1 << 16  # vectors that one task sorts into buckets
CELL = 32  # buckets and blocks that meet in one task
# From this least cosine on, coordinates are tried before lengths.
COORDINATE_COSINE = 0.35
_SAFE = 2.0**52

_PACKED = "dim int, number bigint, longest double, rows binary, ids binary, vectors binary"
_NAMES = [f.split(" ")[0] for f in _PACKED.split(", ")]
_FOUND = "query_row bigint, query_id bigint, vec_id bigint, score bigint"
_FOUND_SCHEMA = pa.schema([(f.split(" ")[0], pa.int64()) for f in _FOUND.split(", ")])


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def integers(vectors: DataFrame) -> DataFrame:
    """row, vec_id, ints, norm: the usable vectors with components floor(256 * x)."""
    usable = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")
    ).where(F.col("vec_id").isNotNull() & _usable(F.col("vector")))
    square = F.aggregate("ints", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return (
        usable.select("vec_id", F.transform("vector", lambda x: F.floor(x * 256).cast("bigint")).alias("ints"))
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("norm", F.sqrt(square))
    )


def _packer(most: int):
    """Pack rows that arrive in order into buckets of one dimension and at most ``most`` rows."""

    def close(held: list[dict], number: int) -> pa.RecordBatch:
        matrix = np.array([r["ints"] for r in held], np.int64).reshape(len(held), -1)
        columns = {
            "dim": pa.array([matrix.shape[1]], pa.int32()),
            "number": pa.array([number], pa.int64()),
            "longest": pa.array([max(r["norm"] for r in held)], pa.float64()),
        }
        for name, values in (("rows", [r["row"] for r in held]), ("ids", [r["vec_id"] for r in held]), ("vectors", matrix)):
            columns[name] = pa.array([np.array(values, np.int64).tobytes()], pa.binary())
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (len(held) == most or len(held[0]["ints"]) != len(row["ints"])):
                    yield close(held, held[0]["row"])
                    held = []
                held.append(row)
        if held:
            yield close(held, held[0]["row"])

    return run


def _packed(rows: DataFrame, n: int, most: int) -> DataFrame:
    """Buckets of vectors of one dimension and like length, each one row."""
    order = [F.size("ints"), F.desc("norm"), F.col("row")]
    ranges = max(1, -(-n // RANGE_ROWS))
    lines = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    return lines.select("row", "vec_id", "ints", "norm").mapInArrow(_packer(most), _PACKED)


class _Bucket:
    """One packed row, opened. The first coordinates are kept apart for pruning."""

    def __init__(self, packed: dict):
        self.dim = packed["dim"]
        self.rows = np.frombuffer(packed["rows"], np.int64)
        self.ids = np.frombuffer(packed["ids"], np.int64)
        self.ints = np.frombuffer(packed["vectors"], np.int64).reshape(len(self.ids), self.dim)
        self.floats = self.ints.astype(np.float64)
        self.norms = np.sqrt((self.floats**2).sum(axis=1))  # falls from row to row
        self.head = max(1, self.dim // 4)
        self.rest = np.sqrt((self.floats[:, self.head :] ** 2).sum(axis=1))
        self.longest = float(self.norms.max(initial=0.0))


def _products(queries: _Bucket, q: np.ndarray, vectors: _Bucket, v: np.ndarray) -> np.ndarray:
    """The exact inner products of pairs."""
    if queries.longest * vectors.longest < _SAFE:
        return np.einsum("ij,ij->i", queries.floats[q], vectors.floats[v]).astype(np.int64)
    wide = [sum(a * b for a, b in zip(queries.ints[i].tolist(), vectors.ints[j].tolist(), strict=True)) for i, j in zip(q, v, strict=True)]
    return np.array([min(max(x, -(2**63 - 1)), 2**63 - 1) for x in wide], np.int64)


class _Best:
    """The k best (score, smaller id) of each query of a block so far."""

    def __init__(self, queries: _Bucket, k: int, beat: np.ndarray):
        self.queries, self.k, self.beat = queries, k, beat.copy()
        empty = np.zeros(0, np.int64)
        self.q, self.ids, self.scores = empty, empty, empty

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        q, ids, scores = (np.concatenate(x) for x in ((self.q, q), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        begin = np.searchsorted(q, np.arange(len(self.queries.ids)))
        rank = np.arange(len(q)) - begin[q]
        kth = rank == self.k - 1
        self.beat[q[kth]] = np.maximum(self.beat[q[kth]], scores[kth].astype(np.float64))
        stay = rank < self.k
        self.q, self.ids, self.scores = q[stay], ids[stay], scores[stay]

    def visit(self, vectors: _Bucket) -> None:
        queries, k = self.queries, self.k
        limit = queries.norms * vectors.longest
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(limit > 0, self.beat / limit, np.where(self.beat > 0, np.inf, -np.inf))
        open_ = cosine <= 1 + 1e-9  # ties are let in, as is whatever rounding may hide
        by_coordinates = open_ & (cosine >= COORDINATE_COSINE)
        pairs = []
        some = np.flatnonzero(by_coordinates)
        if len(some):
            head = queries.head
            bound = queries.floats[some][:, :head] @ vectors.floats[:, :head].T + np.outer(queries.rest[some], vectors.rest)
            q, v = np.nonzero(bound * (1 + 1e-9) + 1e-6 >= self.beat[some][:, None])
            pairs.append((some[q], v))
        others = np.flatnonzero(open_ & ~by_coordinates)
        if len(others):
            bound = np.outer(queries.norms[others], vectors.norms)
            q, v = np.nonzero(bound * (1 + 1e-9) + 1e-6 >= self.beat[others][:, None])
            pairs.append((others[q], v))
        for q, v in pairs:
            own = queries.rows[q] == vectors.rows[v]
            q, v = q[~own], v[~own]
            for a in range(0, len(q), 1 << 18):
                qs, vs = q[a : a + (1 << 18)], v[a : a + (1 << 18)]
                scores = _products(queries, qs, vectors, vs)
                good = scores >= self.beat[qs]
                self.add(qs[good], vectors.ids[vs[good]], scores[good])


def _seed(k: int):
    """Blocks with the scores their queries have to beat, from the buckets they are given."""

    def run(blocks: pa.Table, buckets: pa.Table) -> pa.Table:
        opened = [_Bucket(r) for r in buckets.to_pylist()]
        beat = []
        for row in blocks.to_pylist():
            queries = _Bucket(row)
            best = _Best(queries, k, np.full(len(queries.ids), -np.inf))
            for bucket in opened:
                best.visit(bucket)
            beat.append(best.beat.tobytes())
        return pa.table([blocks[f] for f in _NAMES] + [pa.array(beat, pa.binary())], [*_NAMES, "beat"])

    return run


def _search(k: int):
    def run(blocks: pa.Table, buckets: pa.Table) -> pa.Table:
        opened = [_Bucket(r) for r in sorted(buckets.to_pylist(), key=lambda r: -r["longest"])]
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in _FOUND_SCHEMA]
        for row in blocks.to_pylist():
            queries = _Bucket(row)
            best = _Best(queries, k, np.frombuffer(row["beat"], np.float64))
            for bucket in opened:
                best.visit(bucket)
            for column, values in zip(out, (queries.rows[best.q], queries.ids[best.q], best.ids, best.scores), strict=True):
                column.append(values)
        return pa.table([pa.array(np.concatenate(c)) for c in out], schema=_FOUND_SCHEMA)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """The ``k`` highest inner products of each query with every other row.

    ``vectors`` needs vec_id and embedding; other columns are ignored. Components become
    floor(256 * x). ``is_query`` is a condition on vec_id. Returns query_id, rank (from 1),
    vec_id, score; equal scores rank the smaller vec_id first, and a query with fewer
    other rows gets them all.

    Rows with a null vec_id or a vector that is null or holds a null or non-finite component take
    no part. Only vectors of one dimension are compared. Rows that repeat a vec_id are rows
    of their own: a query does not find itself, but it finds its repetition, and each
    repeated query has its own ranks. Scores beyond 2 ** 63 - 1 in size are clipped to it. An empty table
    gives an empty table.
    """
    rows = stored(integers(vectors), "integers")
    query_rows = rows.where(is_query)
    n, n_queries = rows.count(), query_rows.count()
    buckets = stored(_packed(rows, n, BUCKET_ROWS), "buckets")
    blocks = stored(_packed(query_rows, n_queries, BLOCK_ROWS), "blocks")

    # Blocks meet buckets on a grid of lanes and strips, so a task holds CELL of each.
    lanes = max(1, -(-n_queries // (BLOCK_ROWS * CELL)))
    strips = max(1, -(-n // (BUCKET_ROWS * CELL)))
    dealt = lambda n: F.pmod(F.xxhash64("number"), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))

    # The bucket of the longest vectors of each dimension: one row each.
    longest = buckets.groupBy("dim").agg(F.max_by("number", F.struct("longest", "number")).alias("number"))
    first = buckets.join(longest, ["dim", "number"], "left_semi")
    seeded = (
        blocks.withColumn("lane", dealt(lanes))
        .groupBy("dim", "lane")
        .cogroup(first.withColumn("lane", each(lanes)).groupBy("dim", "lane"))
        .applyInArrow(_seed(k), f"{_PACKED}, beat binary")
    )
    found = (
        stored(seeded, "seeded")
        .withColumn("lane", dealt(lanes))
        .withColumn("strip", each(strips))
        .groupBy("dim", "lane", "strip")
        .cogroup(
            buckets.withColumn("strip", dealt(strips)).withColumn("lane", each(lanes)).groupBy("dim", "lane", "strip")
        )
        .applyInArrow(_search(k), _FOUND)
    )
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
