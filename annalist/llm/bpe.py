"""BPE encoding and decoding with segment trees over adjacent pair ranks.

Each pre-token is a row of symbols. The leaves of its tree hold (rank, place) of every
adjacent pair, an inner node the smaller of its children, so the root is the leftmost
pair of the lowest rank. Merging it changes three leaves, each passed up in a
logarithmic number of steps. The trees of many pre-tokens of like length are worked on
together as one array. Every worker keeps the pre-tokens it has seen, up to a bound.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

# Fixed value: the split pattern in the public tokenizer file this operator reads.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
KNOWN_WORDS = 600_000
TREE_ENTRIES = 1 << 21
LONG_WORD = 256

_NONE = np.int64(2**62)
_PLACE_BITS = 32


def _byte_characters() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies:
    itself where printable, otherwise the next one from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = dict.fromkeys(visible)
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def _newer(model: str) -> tuple[str, dict[int, str]]:
    """What this Python's Unicode tables do not have but those of its regex module or of
    the tokenizers library do: ranges of code points that are letters or numbers to the
    former only, and the lower case that only the latter knows. The library is asked."""
    tokenizer = Tokenizer.from_str(model)
    unassigned = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) == "Cn"]
    kinds = regex.compile(r"[\p{L}\p{N}]")
    doubtful = [c for c in unassigned if kinds.match(c)]
    # "!" joins what is neither a letter nor a number.
    points = [ord(c) for c in doubtful if len(tokenizer.pre_tokenizer.pre_tokenize_str("!" + c)) == 1]
    cuts = [i for i in range(1, len(points)) if points[i] != points[i - 1] + 1]
    ranges = zip([0, *cuts], [*cuts, len(points)], strict=True) if points else ()
    lower = {ord(c): tokenizer.normalizer.normalize_str(c) for c in doubtful}
    return (
        "".join(rf"\U{points[a]:08x}-\U{points[b - 1]:08x}" for a, b in ranges),
        {c: small for c, small in lower.items() if small != chr(c)},
    )


class WordBpe:
    """A word-level BPE: lower-cased words, a suffix on the last symbol of each."""

    def __init__(self, model: dict):
        vocabulary, suffix = model["model"]["vocab"], model["model"]["end_of_word_suffix"]
        if model["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != PRE_TOKEN:
            raise ValueError("this tokenizer file splits words by another pattern")
        symbols = _byte_characters()
        self.inner = np.array([vocabulary[c] for c in symbols], np.int64)
        self.last = np.array([vocabulary[c + suffix] for c in symbols], np.int64)
        left, right, merged = (
            np.array(ids, np.int64)
            for ids in zip(*((vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in model["model"]["merges"]), strict=True)
        )
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], order, merged
        self.token = {str(i): t for t, i in vocabulary.items()} | {str(t["id"]): t["content"] for t in model["added_tokens"]}
        self.special = {t["content"]: str(t["id"]) for t in model["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.pattern = regex.compile(PRE_TOKEN)
        newer, self.lower = _newer(json.dumps(model))
        seldom = newer + "".join(rf"\U{c:08x}" for c in self.lower)
        self.seldom = regex.compile(f"[{seldom}]") if seldom else None
        self.careful = self.pattern
        if newer:
            self.careful = regex.compile(
                rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{newer}]]+|[\p{{N}}--[{newer}]]|[[^\s\p{{L}}\p{{N}}]||[{newer}]]+"
            )
        self.known: dict[str, str] = {}

    # Merging.

    def _pairs(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Leaf values of pairs; none where a symbol is missing (-1) or nothing merges."""
        key = left << 32 | np.maximum(right, 0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(found, self.ranks[at] << _PLACE_BITS | place, _NONE)

    def _merge_rows(self, words: Sequence[bytes], leaves: int) -> list[np.ndarray]:
        """The ids of words of at most ``leaves`` symbols, all trees at once."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        rows, place = np.repeat(np.arange(n), lengths), np.arange(leaves)
        column = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        data = np.frombuffer(b"".join(words), np.uint8)
        ids = np.full((n, leaves + 1), -1, np.int64)  # the last column is the end of every word
        ids[rows, column] = np.where(column == lengths[rows] - 1, self.last[data], self.inner[data])
        after = np.broadcast_to(np.arange(1, leaves + 2), (n, leaves + 1)).copy()
        after[:, -1] = leaves
        before = np.broadcast_to(np.arange(-1, leaves), (n, leaves + 1)).copy()
        tree = np.full((n, 2 * leaves), _NONE, np.int64)
        tree[:, leaves:] = self._pairs(ids[:, :-1], ids[:, 1:], place)
        level = leaves
        while level > 1:
            half = level // 2
            np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2], out=tree[:, half:level])
            level = half

        def update(row: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            node = leaf + leaves
            tree[row, node] = value
            while leaves > 1 and node[0] > 1:
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        row = np.arange(n)
        while True:
            row = row[tree[row, 1] < _NONE]
            if not len(row):
                break
            best = tree[row, 1]
            at, rank = best & (2**_PLACE_BITS - 1), best >> _PLACE_BITS
            gone = after[row, at]
            follower = after[row, gone]
            ids[row, at], ids[row, gone] = self.merged[rank], -1
            after[row, at], before[row, follower] = follower, at
            update(row, gone, np.full(len(row), _NONE))
            update(row, at, self._pairs(ids[row, at], ids[row, follower], at))
            left = before[row, at]
            has = left >= 0
            if has.any():
                r, left, at = row[has], left[has], at[has]
                update(r, left, self._pairs(ids[r, left], ids[r, at], left))
        return [x[x >= 0] for x in ids]

    def _merge_long(self, word: bytes) -> np.ndarray:
        """The same for one long word, on plain lists."""
        n, none = len(word), int(_NONE)
        data = np.frombuffer(word, np.uint8)
        start = np.append(self.inner[data[:-1]], self.last[data[-1:]])
        leaves = 1 << (n - 1).bit_length()
        tree = [none] * (2 * leaves)
        tree[leaves : leaves + n - 1] = self._pairs(start[:-1], start[1:], np.arange(n - 1)).tolist()
        for i in range(leaves - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        ids, after, before = start.tolist(), list(range(1, n + 1)), list(range(-1, n))
        ranks = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))

        def update(leaf: int, value: int) -> None:
            node = leaf + leaves
            tree[node] = value
            while node > 1:
                node >>= 1
                small = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == small:
                    break
                tree[node] = small

        def pair(left: int, right: int) -> int:
            rank = ranks.get(ids[left] << 32 | ids[right])
            return none if rank is None else rank << _PLACE_BITS | left

        while tree[1] < none:
            at, rank = tree[1] & (2**_PLACE_BITS - 1), tree[1] >> _PLACE_BITS
            gone = after[at]
            follower = after[gone]
            ids[at], ids[gone], after[at] = int(self.merged[rank]), -1, follower
            update(gone, none)
            if follower < n:
                before[follower] = at
            update(at, pair(at, follower) if follower < n else none)
            if before[at] >= 0:
                update(before[at], pair(before[at], at))
        return np.array([i for i in ids if i >= 0], np.int64)

    def merge(self, words: Sequence[bytes]) -> list[np.ndarray]:
        """The ids of each pre-token, given as bytes."""
        out: list[np.ndarray | None] = [None] * len(words)
        by_size: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            if len(word) > LONG_WORD:
                out[i] = self._merge_long(word)
            else:
                by_size.setdefault(1 << (len(word) - 1).bit_length(), []).append(i)
        for leaves, members in by_size.items():
            step = max(1, TREE_ENTRIES // (2 * leaves))
            for a in range(0, len(members), step):
                some = members[a : a + step]
                for i, ids in zip(some, self._merge_rows([words[i] for i in some], leaves), strict=True):
                    out[i] = ids
        return out

    # Texts.

    def _split(self, text: str) -> list[str]:
        """The pre-tokens of a text; special tokens stand as they are."""
        words: list[str] = []
        pieces = self.special_pattern.split(text) if "<|" in text else [text]
        for i, piece in enumerate(pieces):
            if i % 2:
                words.append(piece)
                continue
            if not piece.isascii():
                piece = unicodedata.normalize("NFC", piece)
            # A final capital sigma is lowered like any other, character by character.
            piece = "".join(map(str.lower, piece)) if "Σ" in piece else piece.lower()
            pattern = self.pattern
            if self.seldom and not piece.isascii() and self.seldom.search(piece):
                piece, pattern = piece.translate(self.lower), self.careful
            words += pattern.findall(piece)
        return words

    def encode(self, texts: Sequence[str]) -> list[str]:
        """Decimal ids joined by one space, per text."""
        split = [self._split(t) for t in texts]
        new = set().union(*split).difference(self.known, self.special) if split else set()
        if len(self.known) + len(new) > KNOWN_WORDS:
            self.known = {}
            new = set().union(*split).difference(self.special)
        fresh = list(new)
        for word, ids in zip(fresh, self.merge([w.encode() for w in fresh]), strict=True):
            self.known[word] = " ".join(map(str, ids.tolist()))
        self.known.update(self.special)
        return [" ".join(map(self.known.__getitem__, words)) for words in split]

    def decode(self, ids: str) -> str:
        """The tokens of decimal ids, joined by one space; unknown ids are left out."""
        if not ids:
            return ""
        tokens = map(self.token.get, ids.split(" "))
        return " ".join(t for t in tokens if t is not None)


_loaded: dict[str, WordBpe] = {}


def load(model: str) -> WordBpe:
    """The tokenizer of a model (its JSON text), once per worker."""
    if model not in _loaded:
        _loaded.clear()
        _loaded[model] = WordBpe(json.loads(model))
    return _loaded[model]


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """Encode every whole text with the tokenizer file at ``path`` and decode the ids again.

    ``docs`` needs doc_id and text; other columns are ignored. The file is read where the
    job is built and travels with it (a few MB). Returns one row per input row: doc_id,
    ids (decimal, joined by one space; ``split(ids, ' ')`` gives a list), n_tokens,
    decoded. A null or empty text has no ids and decodes to an empty text. Repeated rows
    give repeated results; a null doc_id is kept; an empty table gives an empty table.
    """
    with open(path, encoding="utf-8") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                ids = bpe.encode([t or "" for t in rows["text"].to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [
                        rows["doc_id"],
                        pa.array(ids, pa.string()),
                        pa.array([i.count(" ") + 1 if i else 0 for i in ids], pa.int64()),
                        pa.array(map(bpe.decode, ids), pa.string()),
                    ],
                    names=["doc_id", "ids", "n_tokens", "decoded"],
                )

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, ids string, n_tokens bigint, decoded string")
