"""Packing documents into training sequences along a space-filling curve.

Each document becomes a hashed vector of its tokens, projected to a few dimensions and
placed on a Hilbert curve. Documents are laid end to end in the order of the curve, so
neighbours in a sequence are alike, and the line is cut every ``LENGTH`` tokens. What
is left at its very end is cut into powers of two, so nothing is padded at all.

The order is a shuffle into ranges of the curve. How many tokens lie before a range is
known from a sum per range, so ranges are packed independently of each other.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from annalist.llm.tables import shuffle_partitions, stored

LENGTH = 1024
END = 0  # the id that closes every document
BINS, DIMENSIONS, BITS = 256, 4, 8
RANGE_TOKENS = 8 << 20
# Fixed value: the split pattern of byte-level BPE files.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The pattern's \s+(?!\S) steps back through a run of white space; tiktoken gives up near 10^6.
LONG_SPACE = re.compile(r"\s{100000}")
_PROJECTION = np.random.default_rng(7).choice([-1.0, 1.0], (BINS, DIMENSIONS)).astype(np.float32)

_TOKENS = "doc_id bigint, n bigint, ids binary, place array<float>"
_PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
)


# Token ids.


class Encoder:
    """Ids of a byte-level BPE file as the tokenizers library gives them.

    tiktoken encodes with the same vocabulary and pattern, several times faster; texts
    with the string of a special token or a very long run of white space go to the
    tokenizers library itself.
    """

    def __init__(self, model: str):
        self.exact = Tokenizer.from_str(model)
        described = json.loads(model)
        special = {t["content"]: t["id"] for t in described["added_tokens"]}
        shown = _bytes_of_characters()
        ranks = {
            bytes(shown[c] for c in token): i
            for token, i in described["model"]["vocab"].items()
            if i not in special.values()
        }
        self.fast = tiktoken.Encoding("fast", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})
        self.special = tuple(special)
        self.kind = np.dtype("<u2" if max(*ranks.values(), *special.values()) < 2**16 else "<u4")

    def ids(self, text: str) -> list[int]:
        if any(s in text for s in self.special) or (len(text) >= 100_000 and LONG_SPACE.search(text)):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def _bytes_of_characters() -> dict[str, int]:
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


_loaded: dict[str, Encoder] = {}


def _encoder(model: str) -> Encoder:
    if model not in _loaded:
        _loaded.clear()
        _loaded[model] = Encoder(model)
    return _loaded[model]


def place_of(ids: np.ndarray) -> np.ndarray:
    """The hashed vector of a document, projected."""
    bins = np.bincount((ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24), minlength=BINS)
    vector = np.sqrt(bins / max(1, len(ids))).astype(np.float32)
    return vector @ _PROJECTION


def tokens_of(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n, ids (packed), place of every document, each closed by ``END``."""
    with open(path, encoding="utf-8") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                ids = [np.array([*encoder.ids(t or ""), END], encoder.kind) for t in rows["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        rows["doc_id"],
                        pa.array([len(i) for i in ids], pa.int64()),
                        pa.array([i.tobytes() for i in ids], pa.binary()),
                        pa.array([place_of(i) for i in ids], pa.list_(pa.float32())),
                    ],
                    names=["doc_id", "n", "ids", "place"],
                )

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, _TOKENS)


# The curve.


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions along a Hilbert curve of integer cells (rows of coordinates below 2 ** bits)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    # From the highest bit down, turn and mirror the lower bits into the sub-cube's frame.
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(n):
            set_ = (x[i] >> level & 1).astype(bool)
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
    # Gray code across the dimensions.
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[n - 1] >> level & 1, (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> level & 1)
    return key


def _keys(rows: pa.RecordBatch, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The curve position, and below it a hash of the id, so equal documents can be parted."""
    place = np.array(rows["place"].to_pylist(), np.float64).reshape(-1, DIMENSIONS)
    cells = (0.5 + 0.5 * np.tanh((place - centre) / scale)) * (2**BITS)
    key = hilbert(np.clip(cells, 0, 2**BITS - 1).astype(np.int64))
    doc = np.array(rows["doc_id"].fill_null(-1), np.int64).astype(np.uint64)
    spread = (doc + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return key << 31 | (spread >> np.uint64(33)).astype(np.int64)


def _ranged(tokens: DataFrame, centre: np.ndarray, scale: np.ndarray, bounds: np.ndarray) -> DataFrame:
    """The rows with their key and the number of their range of the curve."""
    names = tokens.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            key = _keys(rows, centre, scale)
            part = np.searchsorted(bounds, key, side="right")
            yield pa.RecordBatch.from_arrays(
                [*(rows[c] for c in names), pa.array(key), pa.array(part.astype(np.int32))], names=[*names, "key", "part"]
            )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tokens.schema)
    return tokens.mapInArrow(run, f"{fields}, key bigint, part int")


# Cutting.


def edges_of_tail(total: int, length: int) -> np.ndarray:
    """Where the sequences behind the last full one begin: powers of two, largest first."""
    at, rest, edges = total - total % length, total % length, []
    while rest:
        edges.append(at)
        size = 1 << (rest.bit_length() - 1)
        at, rest = at + size, rest - size
    return np.array([*edges, total], np.int64)


def cut(start: int, n: int, tail: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut n tokens from ``start`` on: first token of each piece, its sequence, its offset there."""
    first = start // length
    edges = np.arange(first, (start + n - 1) // length + 1) * length
    edges = np.concatenate([edges[edges < tail[0]], tail[:-1]])
    edges = edges[(edges < start + n)]
    edges = edges[max(0, np.searchsorted(edges, start, side="right") - 1) :]
    begin = np.maximum(edges, start)
    sequence = np.where(edges < tail[0], edges // length, tail[0] // length + np.searchsorted(tail, edges))
    return begin - start, sequence, begin - edges


def pack(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """Pack all documents into sequences of ``length`` tokens of the tokenizer at ``path``.

    ``docs`` needs doc_id and text; other columns are ignored. Every document ends with
    the id ``END``; a null or empty text is that id alone. Returns one row per piece:
    doc_id, start (ids of its document before it), length, ids_crc32, doc_tokens,
    sequence_id and offset (its place there). Every sequence but those at the very end
    holds ``length`` tokens, and those hold powers of two, so no padding is needed. Rows
    that repeat a doc_id are packed each on its own. An empty table gives an empty table.
    """
    tokens = stored(tokens_of(docs, path), "tokens")
    facts = tokens.agg(
        F.sum("n").alias("total"),
        *(F.avg(F.col("place")[i]).alias(f"m{i}") for i in range(DIMENSIONS)),
        *(F.stddev_pop(F.col("place")[i]).alias(f"s{i}") for i in range(DIMENSIONS)),
    ).first()
    total = facts["total"] or 0
    centre = np.array([facts[f"m{i}"] or 0.0 for i in range(DIMENSIONS)])
    scale = np.array([facts[f"s{i}"] or 1.0 for i in range(DIMENSIONS)])
    n_ranges = max(shuffle_partitions(docs), -(-total // RANGE_TOKENS))
    narrow = tokens.select("doc_id", "n", "place")
    shares = [i / n_ranges for i in range(1, n_ranges)] or [0.5]
    keyed = _ranged(narrow, centre, scale, np.zeros(0, np.int64))
    found = keyed.agg(F.percentile_approx("key", shares, 20 * n_ranges).alias("bounds")).first()["bounds"]
    bounds = np.unique(np.array(found or [0], np.int64))
    sums = _ranged(narrow, centre, scale, bounds).groupBy("part").agg(F.sum("n").alias("n")).collect()
    before = np.zeros(len(bounds) + 2, np.int64)
    for row in sums:
        before[row["part"] + 1] = row["n"]
    before = np.cumsum(before)
    tail = edges_of_tail(total, length)
    schema = pa.schema([(f.split(" ")[0], pa.int64()) for f in _PIECES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = -1, 0
        for rows in batches:
            out: list[list] = [[] for _ in schema]
            for doc, n, packed, row_part in zip(*(rows[c].to_pylist() for c in ("doc_id", "n", "ids", "part")), strict=True):
                if row_part != part:
                    part, at = row_part, int(before[row_part])
                ids = np.frombuffer(packed, "<u2" if len(packed) == 2 * n else "<u4").astype("<u4")
                start, sequence, offset = cut(at, n, tail, length)
                ends = np.append(start[1:], n)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(start.tolist(), ends.tolist(), strict=True)]
                pieces = ([doc] * len(start), start, ends - start, crc, [n] * len(start), sequence, offset)
                for column, values in zip(out, pieces, strict=True):
                    column.extend(values)
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=schema)

    # The curve's ranges are dealt out and sorted there; nothing else moves the tokens.
    along = _ranged(tokens, centre, scale, bounds).select("doc_id", "n", "ids", "key", "part")
    lines = along.repartition(n_ranges, "part").sortWithinPartitions("part", "key", "doc_id")
    return lines.mapInArrow(run, _PIECES)
