"""Token counts under a unigram vocabulary, by dynamic programming over a shared trie.

The distinct pre-tokens of a batch, in order, are the paths of a trie: a prefix that many
words share is one node. The forward score of a node, the cheapest way to spell its
prefix in pieces, is computed once from the nodes above it; the words that end in it take
their count from there. Nodes are worked on depth by depth, all of one depth together.
Counts are kept per worker for the words to come, up to a bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.tables import text_bytes
from annalist.llm.words import mix, powers

KNOWN_WORDS = 600_000
MATRIX_ENTRIES = 1 << 21
SCALE = 1024  # costs are whole numbers, so that equal ones are equal
UNKNOWN = 20 * SCALE  # of each byte of a character that no piece spells
_COUNT_BITS = 24  # below the cost, so that of equal costs the fewest pieces win
_BASE = 0x9E3779B97F4A7C15
_FAR = np.int64(2**62)


def vocabulary(path: str) -> dict[str, int]:
    """Cost of each piece of a sentencepiece file. The file has an order of pieces, no
    probabilities; a piece of rank r is taken to be as frequent as Zipf's law has it."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    return {piece: round(SCALE * math.log(rank + 2)) for rank, piece in enumerate(pieces)}


def _points(words: Sequence[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)


class UnigramCounter:
    """Numbers of pieces of words, given the cost of every piece."""

    def __init__(self, costs: dict[str, int]):
        self.longest = max(map(len, costs), default=1)
        keys = np.array([self._key(p) for p in costs], np.uint64)
        order = np.argsort(keys)
        self.keys, self.costs = keys[order], np.array(list(costs.values()), np.int64)[order]
        self.single = np.sort(_points([p for p in costs if len(p) == 1]))
        self.known: dict[bytes, int] = {}

    @staticmethod
    def _key(piece: str) -> int:
        value = 0
        for point in map(ord, piece):
            value = (value * _BASE + point + 1) % 2**64
        return int(mix(np.array([value], np.uint64))[0])

    def _rows(self, words: Sequence[str]) -> np.ndarray:
        """The counts of ordered words of like length: one row each, one column per depth."""
        n, lengths = len(words), np.fromiter(map(len, words), np.int64, len(words))
        depth = int(lengths.max())
        chars = np.zeros((n, depth), np.uint32)
        column = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        chars[np.repeat(np.arange(n), lengths), column] = _points(words)
        # A row opens a node at each depth where it leaves the row above.
        shared = np.zeros(n, np.int64)
        alike = chars[1:] == chars[:-1]
        shared[1:] = np.where(alike.all(axis=1), depth, alike.argmin(axis=1))
        prefix = np.zeros((n, depth + 1), np.uint64)
        for d in range(depth):
            prefix[:, d + 1] = prefix[:, d] * np.uint64(_BASE) + chars[:, d] + np.uint64(1)
        n_bytes = 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)
        best = np.full((n, depth + 1), _FAR, np.int64)
        best[:, 0] = 0
        power = powers(_BASE, self.longest + 1)
        for d in range(1, depth + 1):
            node = (shared < d) & (lengths >= d)
            rows = np.flatnonzero(node)
            if not len(rows):
                break
            sizes = np.arange(1, min(d, self.longest) + 1)
            keys = mix(prefix[rows, d][:, None] - prefix[rows][:, d - sizes] * power[sizes])
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            cost = np.where(self.keys[at] == keys, (self.costs[at] << _COUNT_BITS) + 1, _FAR)
            before = best[rows][:, d - sizes]
            ways = np.where((cost < _FAR) & (before < _FAR), cost + before, _FAR)
            point, extra = chars[rows, d - 1], n_bytes[rows, d - 1].astype(np.int64)
            spelt = self.single[np.minimum(np.searchsorted(self.single, point), len(self.single) - 1)] == point
            in_bytes = np.where(spelt, _FAR, best[rows, d - 1] + extra * ((UNKNOWN << _COUNT_BITS) + 1))
            best[rows, d] = np.minimum(ways.min(axis=1), in_bytes)
            # The rows below that share the node have its score.
            best[:, d] = best[np.maximum.accumulate(np.where(node, np.arange(n), 0)), d]
        return best[np.arange(n), lengths] & (2**_COUNT_BITS - 1)

    def count(self, words: Sequence[str]) -> list[int]:
        """The number of pieces of each word; bytes count for what no piece spells."""
        out = [0] * len(words)
        groups: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            if word:
                groups.setdefault(len(word).bit_length(), []).append(i)
        for members in groups.values():
            members.sort(key=words.__getitem__)
            step = max(1, MATRIX_ENTRIES // max(len(words[i]) for i in members))
            for a in range(0, len(members), step):
                some = members[a : a + step]
                for i, pieces in zip(some, self._rows([words[i] for i in some]).tolist(), strict=True):
                    out[i] = pieces
        return out

    def totals(self, texts: Sequence[bytes]) -> tuple[list[int], list[int]]:
        """Words and pieces of each text; every word begins with the mark of a space."""
        split = [t.split() for t in texts]
        new = set().union(*split).difference(self.known) if split else set()
        if len(self.known) + len(new) > KNOWN_WORDS:
            self.known = {}
            new = set().union(*split)
        fresh = list(new)
        counts = self.count(["▁" + w.decode("utf-8", "replace") for w in fresh])
        self.known.update(zip(fresh, counts, strict=True))
        return [len(words) for words in split], [sum(map(self.known.__getitem__, words)) for words in split]


_loaded: dict[int, UnigramCounter] = {}


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens of every whole text under the pieces of a sentencepiece file.

    ``docs`` needs doc_id and text; other columns are ignored. Words are
    ``[^\\x20\\x09-\\x0D]+``. A word is spelt with the least cost, and of equal costs in the fewest
    pieces. A null or empty text has neither words nor tokens; a word may be as long as a
    text. Repeated rows are counted alike; an empty table gives an empty table.
    """
    pieces = tuple(vocabulary(path).items())
    costs = docs.sparkSession.sparkContext.broadcast(pieces)
    name = hash(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _loaded:
            _loaded.clear()
            _loaded[name] = UnigramCounter(dict(costs.value))
        counter = _loaded[name]
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                n_words, n_tokens = counter.totals(rows["text"].to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [rows["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())],
                    ["doc_id", "n_words", "n_tokens"],
                )

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, n_words bigint, n_tokens bigint")
