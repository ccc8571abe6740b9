"""Removal of passages that occur more than once: fixed-block anchors.

Any window of ``window`` words holds one whole block of ``block`` words that starts at a
multiple of ``block`` in its document, if ``window >= 2 * block - 1``. So:

1. The blocks of all documents are the index. Every rolling window of ``block`` words
   of every document probes it; a block hit twice or more (once is itself) is an anchor.
2. Around each anchor, the windows of ``window`` words that hold it are compared by a
   96-bit digest. Confirmed windows that overlap join to maximal repeats.
3. Every word under a confirmed window goes.

Steps exchange packed arrays of fingerprints, one row per part of a chunk and bucket of
fingerprints, and get bits back. Within a part each fingerprint is sent at most twice,
so a passage that a third of all documents share weighs no more than one that each part
holds twice. No pair of documents is ever formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.tables import in_chunks, shuffle_partitions, stored
from annalist.llm.words import Words, contained, portions, rolling, sorted_unique, windows_of, words_of

WINDOW = 35
# Text handled at once inside a task, and text whose fingerprints meet in one bucket.
PART_BYTES = 1 << 20
BUCKET_BYTES = 32 << 20

_SENT = "bucket int, chunk bigint, part int, indexed binary, probes binary"
_WINDOWS = "bucket int, chunk bigint, part int, high binary, low binary, twice binary"
_BITS = "kind int, chunk bigint, part int, bucket int, bits binary"


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


def _by_bucket(values: np.ndarray, n_buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """The positions of the values of each bucket, in their order."""
    bucket = ((values >> np.uint64(40)) % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for at in np.split(order, cuts):
        if len(at):
            yield int(bucket[at[0]]), at


def _fingerprints(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint32)


class _Part:
    """The texts of one part of a chunk with all hashes that the steps agree on."""

    def __init__(self, texts: list[bytes], window: int, block: int):
        self.window, self.block = window, block
        self.words: Words = words_of(texts)
        within = np.arange(len(self.words.hashes)) - np.repeat(self.words.first[:-1], self.words.counts)
        self.whole = windows_of(self.words, block)
        self.rolled = rolling(self.words, block)
        self.starts = np.flatnonzero(self.whole & (within % block == 0))
        self.blocks = sorted_unique(self.rolled[self.starts])[0]

    def near_anchors(self, bits: dict[int, bytes], n_buckets: int) -> np.ndarray:
        """Where the windows begin that hold an anchor."""
        anchor = np.zeros(len(self.blocks), bool)
        for bucket, at in _by_bucket(self.blocks, n_buckets):
            if bucket in bits:
                anchor[at] = _flags(bits[bucket], len(at))
        hit = self.starts[contained(self.rolled[self.starts], self.blocks[anchor])]
        n = len(self.words.hashes)
        text = np.searchsorted(self.words.first, hit, side="right") - 1
        opens = np.maximum(hit + self.block - self.window, self.words.first[text])
        near = np.cumsum(np.bincount(opens, minlength=n + 1) - np.bincount(hit + 1, minlength=n + 1))[:n] > 0
        return np.flatnonzero(near & windows_of(self.words, self.window))

    def digests(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct digests of the windows at these places: two numbers, whether there are
        several equal ones here, and for each place the index of its digest."""
        high = rolling(self.words, self.window, 0)[at]
        low = rolling(self.words, self.window, 1)[at].astype(np.uint32)
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        new = np.ones(len(at), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        index = np.empty(len(at), np.int64)
        index[order] = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        return high[begin], low[begin], np.diff(np.append(begin, len(at))) > 1, index


def _texts(table: pa.Table) -> tuple[pa.Table, list[bytes]]:
    table = table.sort_by("row")
    return table, table["text"].to_pylist()


def _parts(texts: list[bytes], window: int, block: int) -> Iterator[tuple[int, int, int, _Part]]:
    for part, (a, b) in enumerate(portions([len(t) for t in texts], PART_BYTES)):
        yield part, a, b, _Part(texts[a:b], window, block)


def _bits_of(answers: pa.Table, kind: int) -> dict[int, dict[int, bytes]]:
    """part -> bucket -> bits."""
    found: dict[int, dict[int, bytes]] = {}
    for row in answers.to_pylist():
        if row["kind"] == kind:
            found.setdefault(row["part"], {})[row["bucket"]] = row["bits"]
    return found


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    types = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = (f.split(" ") for f in ddl.split(", "))
    return pa.schema([(name, types[kind]) for name, kind in fields])


def _sender(window: int, block: int, n_buckets: int):
    schema = _arrow(_SENT)

    def send(table: pa.Table) -> pa.Table:
        chunk, rows = table["chunk"][0].as_py(), []
        for part, _, _, p in _parts(_texts(table)[1], window, block):
            probes, several = sorted_unique(p.rolled[p.whole])
            indexed = {b: _fingerprints(p.blocks[at]) for b, at in _by_bucket(p.blocks, n_buckets)}
            for bucket, at in _by_bucket(probes, n_buckets):
                sent = _fingerprints(np.concatenate([probes[at], probes[at[several[at]]]]))
                own = indexed.get(bucket, np.zeros(0, np.uint32))
                rows.append((bucket, chunk, part, own.tobytes(), sent.tobytes()))
        return _table(rows, schema)

    return send


def _probe(table: pa.Table) -> pa.Table:
    """Which indexed blocks of a bucket are hit by two probes or more."""
    probes = np.concatenate([np.frombuffer(x, np.uint32) for x in table["probes"].to_pylist()])
    values, several = sorted_unique(probes)
    values = values[several]
    rows = []
    for row in table.select(["chunk", "part", "bucket", "indexed"]).to_pylist():
        hit = contained(np.frombuffer(row["indexed"], np.uint32), values)
        if hit.any():
            rows.append((1, row["chunk"], row["part"], row["bucket"], _bits(hit)))
    return _table(rows, _arrow(_BITS))


def _extender(window: int, block: int, n_buckets: int):
    schema = _arrow(_WINDOWS)

    def extend(table: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        if not (table.num_rows and answers.num_rows):
            return _table(rows, schema)
        chunk, anchors = table["chunk"][0].as_py(), _bits_of(answers, 1)
        for part, _, _, p in _parts(_texts(table)[1], window, block):
            if part not in anchors:
                continue
            high, low, twice, _ = p.digests(p.near_anchors(anchors[part], n_buckets))
            for bucket, at in _by_bucket(high, n_buckets):
                rows.append((bucket, chunk, part, high[at].tobytes(), low[at].tobytes(), _bits(twice[at])))
        return _table(rows, schema)

    return extend


def _confirm(table: pa.Table) -> pa.Table:
    """Which windows of a bucket occur twice or more."""
    rows = table.to_pylist()
    high = np.concatenate([np.frombuffer(r["high"], np.uint64) for r in rows])
    low = np.concatenate([np.frombuffer(r["low"], np.uint32) for r in rows])
    sizes = [len(r["high"]) // 8 for r in rows]
    repeated = np.concatenate([_flags(r["twice"], n) for r, n in zip(rows, sizes, strict=True)])
    order = np.lexsort((low, high))
    same = (high[order[1:]] == high[order[:-1]]) & (low[order[1:]] == low[order[:-1]])
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    out = []
    for row, flags in zip(rows, np.split(repeated, np.cumsum(sizes)[:-1]), strict=True):
        if flags.any():
            out.append((2, row["chunk"], row["part"], row["bucket"], _bits(flags)))
    return _table(out, _arrow(_BITS))


def _remover(window: int, block: int, n_buckets: int, schema: pa.Schema):
    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        table, texts = _texts(table)
        anchors, confirmed = _bits_of(answers, 1), _bits_of(answers, 2)
        kept, n_words, n_removed = [], [], []
        for part, (a, b) in enumerate(portions([len(t) for t in texts], PART_BYTES)):
            split = [t.split() for t in texts[a:b]]  # bytes split at the very bytes that part words
            counts = np.fromiter(map(len, split), np.int64, b - a)
            stay = np.ones(int(counts.sum()), bool)
            if part in confirmed:
                p = _Part(texts[a:b], window, block)
                at = p.near_anchors(anchors[part], n_buckets)
                high, _, _, index = p.digests(at)
                repeated = np.zeros(len(high), bool)
                for bucket, where in _by_bucket(high, n_buckets):
                    if bucket in confirmed[part]:
                        repeated[where] = _flags(confirmed[part][bucket], len(where))
                at, n = at[repeated[index]], len(stay)
                edges = np.bincount(at, minlength=n + 1) - np.bincount(at + window, minlength=n + 1)
                stay = np.cumsum(edges)[:n] == 0
            for words, flags in zip(split, np.split(stay, np.cumsum(counts)[:-1]), strict=True):
                left = words if flags.all() else [words[i] for i in np.flatnonzero(flags)]
                kept.append(b" ".join(left))
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
        columns = {"doc_id": table["doc_id"], "rest": table["rest"], "text": table["text"]}
        columns |= {"kept": pa.array(kept, pa.binary()), "n_words": pa.array(n_words, pa.int64())}
        columns |= {"n_removed": pa.array(n_removed, pa.int64())}
        return pa.table([columns[f.name].cast(f.type) for f in schema], schema=schema)

    return remove


def remove_repeats(docs: DataFrame, window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove every word under a window of ``window`` words that also starts anywhere else.

    ``docs`` needs doc_id and text; other columns are ignored unless named in ``carry``,
    which come back as fields of the struct ``rest``. Words are ``[^\\x20\\x09-\\x0D]+``.
    Returns one row per input row: doc_id, rest, text (unchanged, as bytes), kept (the
    words left, joined by one space, as bytes), n_words, n_removed.

    A null text is an empty one: no words, kept is empty. A text of fewer words than a
    window is kept. A passage repeated inside one text goes in all its places. Repeated
    rows, also of one doc_id, are repeats of each other. A null doc_id is kept as null.
    An empty table gives an empty table.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    block = (window + 1) // 2
    chunks, total = in_chunks(docs, "repeats", carry)
    n_buckets = max(shuffle_partitions(docs), -(-total // BUCKET_BYTES))
    grouped = chunks.groupBy("chunk")
    sent = grouped.applyInArrow(_sender(window, block, n_buckets), _SENT)
    anchors = stored(sent.groupBy("bucket").applyInArrow(_probe, _BITS), "anchors")
    near = grouped.cogroup(anchors.groupBy("chunk")).applyInArrow(_extender(window, block, n_buckets), _WINDOWS)
    confirmed = stored(near.groupBy("bucket").applyInArrow(_confirm, _BITS), "confirmed")
    answers = anchors.unionByName(confirmed)
    out = chunks.select("doc_id", "rest", "text", F.col("text").alias("kept")).withColumns(
        {"n_words": F.lit(0).cast("bigint"), "n_removed": F.lit(0).cast("bigint")}
    )
    remove = _remover(window, block, n_buckets, to_arrow_schema(out.schema))
    return grouped.cogroup(answers.groupBy("chunk")).applyInArrow(remove, out.schema)
