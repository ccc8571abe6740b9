"""Ranked lexical search with pair-bound MaxScore over a sharded index.

The index is one row per shard, a run of documents of one input partition: the shard's
terms in order, and for each the documents that hold it and how often. It is built in one
pass without a shuffle, holds every term of every row, and serves any set of items.

A search first sums up, over all shards, how many documents hold each of the items' terms.
Then each shard turns its postings into whole-number impacts, notes the maximum impact of
each term, and intersects the lists of the term pairs that items will meet: the largest sum
two terms reach in one document is their joint maximum. Terms are added from the highest
maximum down. What the terms still to come can add is bounded by the joint maxima of their
pairs, which is less than the sum of the single maxima as soon as two terms do not peak in
the same document. Once that bound is below the tenth best score so far, no new document
can enter; the others are completed by lookups and dropped as soon as they cannot.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from annalist.llm.tables import stored, text_bytes
from annalist.llm.tokens import byte_table, tokens_of
from annalist.llm.words import portions

#: Letters and digits of ASCII, and every byte of other characters.
TERM_BYTES = byte_table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: A shard is closed at so many bytes of text or documents; a longer text stands alone.
SHARD_BYTES, SHARD_DOCS = 8 << 20, 1 << 16
PORTION_BYTES = 1 << 20
#: Items are searched in blocks of so many bytes of text; a longer item stands alone.
BLOCK_BYTES = 4 << 20

_INDEX = "shard bigint, n_docs bigint, n_terms bigint, doc_ids binary, known binary, lengths binary, terms binary, begins binary, docs binary, often binary"
_HITS = "item int, doc_id bigint, score bigint"


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every term's hash, the text it stands in, and how many terms each text has."""
    parts = [tokens_of(texts[a:b], TERM_BYTES) for a, b in portions([len(t) for t in texts], PORTION_BYTES)] or [tokens_of([], TERM_BYTES)]
    counts = np.concatenate([p.counts for p in parts])
    hashes = np.concatenate([p.polynomials().at(p.start, p.length) for p in parts])
    return hashes, np.repeat(np.arange(len(texts)), counts), counts


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs."""
    values = np.sort(values)
    begin = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return values[begin], np.diff(np.append(begin, len(values)))


def _shard(number: int, doc_ids: list[int | None], texts: list[bytes]) -> pa.RecordBatch:
    hashes, text, counts = terms_of(texts)
    terms = _distinct(hashes)[0]
    place, often = _distinct(np.searchsorted(terms, hashes) * len(texts) + text)
    term, doc = np.divmod(place, len(texts)) if len(texts) else (place, place)
    begins = np.searchsorted(term, np.arange(len(terms) + 1))
    ids = np.array([d if d is not None else 0 for d in doc_ids], np.int64)
    known = np.packbits([d is not None for d in doc_ids])
    arrays = (ids, known, counts.astype(np.int64), terms, begins.astype(np.int64), doc.astype(np.uint32), often.astype(np.uint32))
    numbers = (number, int((counts > 0).sum()), int(counts.sum()))
    names = [f.split(" ")[0] for f in _INDEX.split(", ")]
    columns = [pa.array([n], pa.int64()) for n in numbers] + [pa.array([a.tobytes()], pa.binary()) for a in arrays]
    return pa.RecordBatch.from_arrays(columns, names)


def build_index(docs: DataFrame) -> DataFrame:
    """Index every row of ``docs`` (doc_id, text; other columns are ignored) as a written
    table, one row per shard. A null text has no terms; every row is a document of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, texts, total = TaskContext.get().partitionId() << 33, [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if texts and (total + len(text) > SHARD_BYTES or len(texts) == SHARD_DOCS):
                    yield _shard(number, ids, texts)
                    number, ids, texts, total = number + 1, [], [], 0
                ids.append(doc_id)
                texts.append(text)
                total += len(text)
        if texts:
            yield _shard(number, ids, texts)

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text"))
    return stored(slim.mapInArrow(run, _INDEX), "lexical-index")


class _Items:
    """A block of items: their vocabulary, and per item the places of its terms in it."""

    def __init__(self, rows: list[Row]):
        hashes, text, _ = terms_of([(r["text"] or "").encode() for r in rows])
        self.ids = [r["item_id"] for r in rows]
        self.vocabulary = np.unique(hashes)
        place = np.searchsorted(self.vocabulary, hashes)
        parts = np.split(place, np.searchsorted(text, np.arange(1, len(rows)))) if len(rows) else []
        self.terms = [np.unique(p) for p in parts]


def _blocks(items: DataFrame) -> Iterator[_Items]:
    rows, total = [], 0
    for row in items.orderBy("item_id").toLocalIterator():
        size = len(row["text"] or "")
        if rows and total + size > BLOCK_BYTES:
            yield _Items(rows)
            rows, total = [], 0
        rows.append(row)
        total += size
    if rows:
        yield _Items(rows)


def _held(row: dict, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which terms of the vocabulary a shard holds, and where their lists begin and end."""
    terms, begins = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["begins"], np.int64)
    if not len(terms):
        return (np.zeros(0, np.int64),) * 3
    at = np.minimum(np.searchsorted(terms, vocabulary), len(terms) - 1)
    held = np.flatnonzero(terms[at] == vocabulary)
    return held, begins[at[held]], begins[at[held] + 1]


def _document_counts(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How many documents hold each term of the vocabulary."""
    shared = index.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                held, begin, end = _held(row, shared.value)
                total[held] += end - begin
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["term", "df"])

    found = index.select("terms", "begins").mapInArrow(run, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    out = np.zeros(len(vocabulary), np.int64)
    for row in found.collect():  # one row per term of the block at most
        out[row["term"]] = row["df"]
    return out


def weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


class Lists:
    """The impact lists of one shard for a vocabulary, with single and joint maxima."""

    def __init__(self, row: dict, vocabulary: np.ndarray, weight: np.ndarray, n: int, total: int):
        held, begin, end = _held(row, vocabulary)
        lengths = np.frombuffer(row["lengths"], np.int64)
        docs, often = np.frombuffer(row["docs"], np.uint32), np.frombuffer(row["often"], np.uint32)
        m = 10 + (90 * lengths * n) // total
        self.n_docs = len(lengths)
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.top: dict[int, int] = {}
        self.joint: dict[tuple[int, int], int] = {}
        for term, a, b in zip(held.tolist(), begin.tolist(), end.tolist(), strict=True):
            doc, tf = docs[a:b].astype(np.int64), often[a:b].astype(np.int64)
            impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
            self.lists[term] = doc, impact
            self.top[term] = int(impact.max())

    def order(self, terms: np.ndarray) -> list[int]:
        """The terms a shard holds, the highest maximum first."""
        return sorted((t for t in terms.tolist() if self.top.get(t, 0) > 0), key=lambda t: (-self.top[t], t))

    def pair(self, a: int, b: int) -> int:
        """The most that two terms add to any document: their joint maximum, or either alone."""
        if (a, b) not in self.joint:
            docs, impacts = self.lists[a]
            other, more = self.lists[b]
            at = np.minimum(np.searchsorted(docs, other), len(docs) - 1)
            both = docs[at] == other
            most = int((impacts[at[both]] + more[both]).max()) if both.any() else 0
            self.joint[a, b] = max(most, self.top[a], self.top[b])
        return self.joint[a, b]

    def bounds(self, order: list[int]) -> list[int]:
        """What the terms from each place on can add at most, pair by pair."""
        out = [0] * (len(order) + 1)
        for i in range(len(order) - 1, -1, -1):
            alone = self.top[order[i]] + out[i + 1]
            out[i] = min(alone, self.pair(order[i], order[i + 1]) + out[i + 2]) if i + 1 < len(order) else alone
        return out

    def best(self, terms: np.ndarray, doc_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents and their scores; equal scores by ascending doc_id."""
        order = self.order(terms)
        bounds = self.bounds(order)
        score, least, at = np.zeros(self.n_docs, np.int64), 1, 0
        while at < len(order) and bounds[at] >= least:
            docs, impacts = self.lists[order[at]]
            score[docs] += impacts
            at += 1
            least = self._kth(score, k, least)
        left = np.flatnonzero((score > 0) & (score + bounds[at] >= least))
        for i in range(at, len(order)):
            docs, impacts = self.lists[order[i]]
            place = np.minimum(np.searchsorted(docs, left), len(docs) - 1)
            score[left] += np.where(docs[place] == left, impacts[place], 0)
            least = self._kth(score[left], k, least)
            left = left[score[left] + bounds[i + 1] >= least]
        found = left[np.lexsort((doc_ids[left], -score[left]))[:k]]
        return found, score[found]

    @staticmethod
    def _kth(score: np.ndarray, k: int, least: int) -> int:
        """The k-th best score so far, which the final one cannot fall below."""
        return max(least, int(np.partition(score, len(score) - k)[len(score) - k])) if len(score) >= k else least


def _searcher(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weight, terms, n, total = block.value
        for batch in batches:
            for row in batch.to_pylist():
                lists = Lists(row, vocabulary, weight, n, total)
                ids = np.frombuffer(row["doc_ids"], np.int64)
                known = np.unpackbits(np.frombuffer(row["known"], np.uint8), count=len(ids)).astype(bool)
                ranks = np.where(known, ids, np.iinfo(np.int64).max)  # nulls come last
                found = [lists.best(t, ranks, k) for t in terms]
                docs = np.concatenate([f[0] for f in found])
                item = np.repeat(np.arange(len(terms), dtype=np.int32), [len(f[0]) for f in found])
                columns = [
                    pa.array(item),
                    pa.array(ids[docs], mask=~known[docs]),
                    pa.array(np.concatenate([f[1] for f in found])),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    return run


def search(index: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The k best documents of an index for each row of ``items`` (item_id, text).

    Returns item_id, rank, doc_id, score. Terms are told apart by 64 bits of hash. Items are
    taken in blocks of ``BLOCK_BYTES``, each a pass over the index: an item's terms are
    looked up in it, the texts are not read again. A null item text has no terms and finds
    nothing; repeated items are ranked each on its own; a null doc_id comes after others
    of its score. Without items, documents or terms the result is empty.
    """
    spark = index.sparkSession
    size = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("total")).first()
    out = spark.createDataFrame([], f"item_id {dict(items.dtypes)['item_id']}, rank int, doc_id bigint, score bigint")
    for block in _blocks(items.select("item_id", "text")) if size["total"] else ():
        weight = weights(_document_counts(index, block.vocabulary), size["n"])
        shared = spark.sparkContext.broadcast((block.vocabulary, weight, block.terms, size["n"], size["total"]))
        hits = index.drop("shard", "n_docs", "n_terms").mapInArrow(_searcher(shared, k), _HITS)
        first = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = hits.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item int, item_id {dict(items.dtypes)['item_id']}")
        out = out.unionByName(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return out


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """:func:`search` in an index built of ``docs``."""
    return search(build_index(docs), items, k)
