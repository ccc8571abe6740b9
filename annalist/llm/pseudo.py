"""Scoring documents by masked pseudo-likelihood.

A small network reads a window of words on both sides of every place and gives the
probability of the word that stands there. A document's score is the sum of the logs.

Words are counted exactly over all documents, into a written table. A word belongs to a
class: the most frequent words have one each, the others share one by their last letters.
The network predicts the class, and then the word itself, by turns down a binary tree
over all words of the class (``Leaves``); each node of the trees has a vector of its own,
and so has each word as a neighbour. The model therefore grows with the corpus.

Documents are dealt into parts, whose words are numbered once and read by their numbers from
then on. A part is handed its own words and nodes only, trains on all its places from the
same start, and gives back what it has touched; the results are averaged by how often each
was touched. Words, nodes and vectors travel as packed arrays of a part and bucket. Nothing
of the vocabulary's size reaches the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm.tables import bucketed, shuffle_partitions, stored, text_bytes
from annalist.llm.words import Words, mix, portions, words_of

OWN, SHARED = 64, 64  # classes of one frequent word each, classes by ending
CLASSES = OWN + SHARED
REACH, WIDTH = 2, 16  # words on each side, hidden units
STEP_WORDS, RATE = 4096, 1.0
VECTOR_RATE = 0.05  # of the words' and nodes' vectors, by the size of their gradients so far
PART_BYTES = 1 << 20
DEALT_BYTES = 24 << 20  # text of a part at most, unless one document is longer; about five eighths on average
FIXED = 1 << 10  # vectors are summed as whole numbers of 16 bits, so that no order of rows changes a sum

_OFFSETS = tuple(o for o in range(-REACH, REACH + 1) if o)
_SHAPES = ((len(_OFFSETS), CLASSES + 1, WIDTH), (WIDTH, CLASSES), (CLASSES,))  # the last row: no word there
_SIZES = [int(np.prod(s)) for s in _SHAPES]
# How a neighbour's vector is turned at each offset, so that sides and distances differ.
_TURNED = np.random.default_rng(5).choice(np.float32([-1, 1]), (len(_OFFSETS), WIDTH))
_DENSE, _WORD, _NODE, _LEAF = range(4)  # kinds of vectors; a leaf is a word and its place


def _ending(words: list[bytes]) -> np.ndarray:
    """A number below SHARED for the last two bytes of each word."""
    last = np.frombuffer(b"".join((w[-2:] if len(w) > 1 else b" " + w) for w in words), "<u2")
    return (mix(last.astype(np.uint64)) % np.uint64(SHARED)).astype(np.int64)


def _endings(texts: list[bytes]) -> np.ndarray:
    """The same of every word of some texts."""
    return _ending([w for t in texts for w in t.split()])


@dataclass
class Vocabulary:
    """All words of some documents, in the order of their hashes.

    own: the class of each word that has its own, else -1; totals: words of each class.
    """

    hashes: np.ndarray
    own: np.ndarray
    counts: np.ndarray
    totals: np.ndarray

    def classes(self, words: Words, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Class and number of every word."""
        slots = np.searchsorted(self.hashes, words.hashes)
        own = self.own[slots]
        return np.where(own >= 0, own, OWN + _endings(texts)), slots

    def within(self, classes: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Log share of the words within their classes, whatever stands around them."""
        shared = classes >= OWN
        share = (self.counts[slots] + 1) / (self.totals[classes] + len(self.counts))
        return np.where(shared, np.log(np.minimum(share, 1.0)), 0.0)


def _starts(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    new = np.empty(len(values), bool)
    new[:1] = True
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return np.flatnonzero(new)


def _ranks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, where one of each stands, and of each value its number among them."""
    order = np.argsort(values)
    start = _starts(values[order])
    number = np.empty(len(values), np.int32)
    number[order] = np.repeat(np.arange(len(start), dtype=np.int32), np.diff(np.append(start, len(values))))
    one = order[start]
    return values[one], one, number


@dataclass
class Numbered:
    """The words of some texts by their number among the distinct ones.

    hashes: the distinct words, in order; endings and n of each; numbers: every word in turn;
    counts: words of each text.
    """

    hashes: np.ndarray
    endings: np.ndarray
    n: np.ndarray
    numbers: np.ndarray
    counts: np.ndarray


def _numbered(texts: list[bytes]) -> Numbered:
    hashes, endings, numbers, counts, known = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [], [np.zeros(0, np.int64)], 0
    for a, b in portions([len(t) for t in texts], PART_BYTES):
        words = words_of(texts[a:b])
        own, one, number = _ranks(words.hashes)
        listed = b"\n".join(texts[a:b]).split()
        hashes.append(own)
        endings.append(_ending([listed[i] for i in one.tolist()]))
        numbers.append((known, number))
        counts.append(words.counts)
        known += len(own)
    every, one, among = _ranks(np.concatenate(hashes))
    found = np.concatenate([np.zeros(0, np.int32), *(among[first:][number] for first, number in numbers)])
    return Numbered(every, np.concatenate(endings)[one], np.bincount(found, minlength=len(every)), found, np.concatenate(counts))


def _counted(texts: list[bytes]) -> pa.Table:
    """hash, ending, n of the distinct words."""
    found = _numbered(texts)
    return pa.table({"hash": found.hashes.view(np.int64), "ending": found.endings, "n": found.n})


def vocabulary(docs: DataFrame) -> Vocabulary:
    """Count the words of a few documents (column text, as bytes); their words must fit the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _counted(batch["text"].to_pylist()).to_batches()

    rows = docs.mapInArrow(run, "hash bigint, ending bigint, n bigint").groupBy("hash", "ending").agg(F.sum("n").alias("n")).collect()
    hashes = np.array([r["hash"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    hashes, counts = hashes[order], np.array([r["n"] for r in rows], np.int64)[order]
    endings = np.array([r["ending"] for r in rows], np.int64)[order]
    first = np.lexsort((hashes, -counts))[:OWN]
    own = np.full(len(hashes), -1, np.int64)
    own[first] = np.arange(len(first))
    totals = np.zeros(CLASSES)
    totals[: len(first)] = counts[first]
    totals[OWN:] = np.bincount(endings, counts, minlength=SHARED)
    return Vocabulary(hashes, own, counts, totals)


# The trees.


def tier_of(n):
    """Counts up to 16 have a tier each; above, four tiers to a doubling."""
    return F.when(n <= 16, n).otherwise(F.least(F.lit(120), 17 + F.floor(4 * F.log2(n / 17)))).cast("int")


class Leaves:
    """Where words stand in the tree of their class.

    A class's words are parted into tiers of about equal counts. A Huffman tree over the
    tiers stands above a binary tree over each tier's words by their number there, ``sizes``
    in all. Without training every turn is as likely as the words on that side are frequent.
    """

    def __init__(self, tiers: dict[tuple[int, int], tuple[int, int]]):
        """``tiers``: words and occurrences of each (class, tier)."""
        self.sizes = np.ones((CLASSES, 128), np.int64)
        self.above: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
        by_class: dict[int, list] = {}
        for (c, t), (size, total) in sorted(tiers.items()):
            self.sizes[c, t] = size
            self.above[c, t] = []
            by_class.setdefault(c, []).append((total, t, [t]))
        for c, heap in by_class.items():
            heapq.heapify(heap)
            node = 0
            while len(heap) > 1:
                (n0, _, left), (n1, _, right) = heapq.heappop(heap), heapq.heappop(heap)
                for side, turn in ((left, -1), (right, 1)):
                    for t in side:
                        self.above[c, t].append((self._key(c, 127, 0, node), turn, float(np.log(n1 / n0))))
                heapq.heappush(heap, (n0 + n1, 128 + node, left + right))
                node += 1

    @staticmethod
    def _key(classes, tier, level, prefix):
        return ((classes - OWN) << 56) | (tier << 48) | (level << 40) | prefix


class Part:
    """The words of a part in the order of their hashes, with the vectors of words and nodes.

    The turns to word w stand in ``path`` at ``begin[w]`` and after, ``depth[w]`` of them: twice
    the node's number, and one more for the right side. ``plain``: each node's log odds
    without training.
    """

    def __init__(self, leaves: Leaves, hashes: np.ndarray, classes: np.ndarray, tiers: np.ndarray, index: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.classes = hashes[order], classes[order]
        self._grow(leaves, tiers[order], index[order])
        # One more row stands for no word.
        self.words, self.nodes = (np.zeros((n, w), np.float32) for n, w in ((len(hashes) + 1, WIDTH), (len(self.keys), WIDTH + 1)))
        self.words_seen, self.nodes_seen = np.full(len(hashes) + 1, 1e-12), np.full(len(self.keys), 1e-12)

    def _grow(self, leaves: Leaves, tiers: np.ndarray, index: np.ndarray) -> None:
        """All turns to all words. In the order of their leaves, words below one node stand together."""
        shared = np.flatnonzero(self.classes >= OWN)
        group = self.classes[shared] * 128 + tiers[shared]
        order = np.argsort((group << 47) | index[shared])
        shared, group, index = shared[order].astype(np.int32), group[order], index[shared][order]
        first = _starts(group)
        which = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(group))))
        c, t = group[first] >> 7, group[first] & 127
        size = leaves.sizes[c, t]
        bits = np.array([int(s - 1).bit_length() for s in size], np.int64)
        above = [leaves.above[x] for x in zip(c.tolist(), t.tolist(), strict=True)]
        odds = {key: x for turns in above for key, _, x in turns}
        keys, plain = [np.array(sorted(odds), np.int64)], [np.array([odds[k] for k in sorted(odds)], np.float32)]
        found, n_nodes = [], len(odds)  # words and what stands in their paths, level by level
        for j in range(max(map(len, above), default=0)):
            turns = [x[j] if j < len(x) else (-1, 0, 0.0) for x in above]
            step = 2 * np.searchsorted(keys[0], np.array([x[0] for x in turns], np.int64)) + np.array([x[1] > 0 for x in turns])
            some = np.flatnonzero(np.array([x[0] >= 0 for x in turns])[which])
            found.append((shared.take(some), step.astype(np.int32).take(which.take(some))))
        for level in range(int(bits.max(initial=0))):
            some = np.flatnonzero((bits > level).take(which))
            at, number = which.take(some), index.take(some)
            rest = (bits - level).take(at)
            prefix = number >> rest
            new = _starts((at.astype(np.int64) << 47) | prefix)
            side = (number >> (rest - 1)) & 1
            # Of each node: the words that its right side could hold, and does hold.
            g, prefix, rest = at[new], prefix[new], rest[new]
            half = np.left_shift(1, rest - 1)
            right = np.minimum(size[g] - (prefix << rest) - half, half)
            both, runs = right > 0, np.diff(np.append(new, len(some)))
            number = np.where(both, n_nodes + np.cumsum(both) - 1, -1).astype(np.int32)
            keys.append(Leaves._key(c[g], t[g], level, prefix)[both])
            plain.append(np.log(right[both] / half[both]).astype(np.float32))
            n_nodes += len(keys[-1])
            step = 2 * np.repeat(number, runs) + side.astype(np.int32)
            kept = np.flatnonzero(step >= 0)
            found.append((shared.take(some.take(kept)), step.take(kept)))
        self.keys, self.plain = np.concatenate(keys), np.concatenate(plain)
        self.depth = np.zeros(len(self.classes), np.int64)
        for word, _ in found:
            self.depth[word] += 1
        self.begin = np.cumsum(self.depth) - self.depth
        self.path, filled = np.empty(int(self.depth.sum()), np.int32), self.begin.copy()
        while found:
            word, step = found.pop()
            at = filled.take(word)
            self.path[at] = step
            filled[word] = at + 1

    @cached_property
    def node(self) -> np.ndarray:
        return self.path >> 1

    @cached_property
    def turn(self) -> np.ndarray:
        """-1 to the left, 1 to the right."""
        return ((self.path & 1) * 2 - 1).astype(np.float32)

    @cached_property
    def odds(self) -> np.ndarray:
        return self.plain[self.node]

    def _climbed(self, numbers: np.ndarray, hidden: np.ndarray) -> tuple[np.ndarray, np.ndarray, Iterator[tuple]]:
        """The places by falling depth of their words, the hidden units there with a one
        beside them, and level by level the node, side, vector and side times log odds of
        the first places, as many as go so deep."""
        depth = self.depth[numbers]
        order = np.argsort((255 - depth).astype(np.uint8), kind="stable")
        begin = self.begin[numbers[order]]
        units = np.ones((len(order), WIDTH + 1), np.float32)
        units[:, :WIDTH] = hidden.take(order, axis=0)

        def levels() -> Iterator[tuple]:
            for j, n in enumerate(len(depth) - np.cumsum(np.bincount(depth))):
                if n:
                    step = self.path.take(begin[:n] + j)
                    node, turn = step >> 1, ((step & 1) * 2 - 1).astype(np.float32)
                    vectors = self.nodes.take(node, axis=0)
                    sure = np.einsum("ij,ij->i", vectors, units[:n])
                    sure += self.plain.take(node)
                    sure *= turn
                    yield node, turn, vectors, sure

        return order, units, levels()

    def log_probabilities(self, numbers: np.ndarray, hidden: np.ndarray) -> np.ndarray:
        """Of the words at some places within their classes."""
        order, _, levels = self._climbed(numbers, hidden)
        sums = np.zeros(len(order))
        for _, _, _, sure in levels:
            sums[: len(sure)] -= np.log(1 + np.exp(-np.abs(sure))) - np.minimum(sure, 0)
        out = np.empty(len(order))
        out[order] = sums
        return out

    def learn(self, numbers: np.ndarray, hidden: np.ndarray, rate: float) -> np.ndarray:
        """A step of the nodes towards the words at some places; gives the gradient of the hidden units."""
        order, units, levels = self._climbed(numbers, hidden)
        sums = np.zeros((len(order), WIDTH), np.float32)
        nodes, wrongs, places = [np.zeros(0, np.int32)], [np.zeros(0, np.float32)], [np.zeros(0, np.int64)]
        for node, turn, vectors, sure in levels:
            wrong = turn * np.float32(-rate) / (1 + np.exp(np.minimum(sure, 80)))
            vectors *= wrong[:, None]
            sums[: len(node)] += vectors[:, :WIDTH]
            nodes.append(node)
            wrongs.append(wrong)
            places.append(np.arange(len(node)))
        wrong, place = np.concatenate(wrongs), np.concatenate(places)
        _stepped(self.nodes, self.nodes_seen, np.concatenate(nodes), lambda pair: units.take(place.take(pair), axis=0) * wrong.take(pair)[:, None])
        back = np.empty_like(sums)
        back[order] = sums
        return back


def _stepped(vectors: np.ndarray, seen: np.ndarray, rows: np.ndarray, gradient: Callable[[np.ndarray], np.ndarray]) -> None:
    """A step down the gradient of some rows, each by the size of its gradients so far."""
    if not len(rows):
        return
    bits = np.int64(len(rows)).item().bit_length()
    both = np.sort((rows.astype(np.int64) << bits) | np.arange(len(rows)))  # rows in order, and where each stood
    rows = both >> bits
    begin = _starts(rows)
    sums, at = _summed(gradient(both & ((1 << bits) - 1)), begin), rows.take(begin)
    size = seen.take(at) + np.einsum("ij,ij->i", sums, sums) / sums.shape[1]
    seen[at] = size
    sums *= (VECTOR_RATE / np.sqrt(size)).astype(np.float32)[:, None]
    vectors[at] = vectors.take(at, axis=0) - sums


def _summed(rows: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of runs of rows. Most runs are of a row or two, for which ``reduceat`` is slow."""
    sizes = np.diff(np.append(begin, len(rows)))
    sums = rows.take(begin, axis=0)
    for size in (2, 3):
        some = np.flatnonzero(sizes == size)
        for j in range(1, size):
            sums[some] += rows.take(begin.take(some) + j, axis=0)
    large = sizes > 3
    if large.any():
        held = rows.compress(np.repeat(large, sizes), axis=0)
        sums[large] = np.add.reduceat(held, np.cumsum(sizes[large]) - sizes[large], axis=0)
    return sums


class Network:
    """Sum of the neighbours' vectors, tanh, softmax over classes."""

    def __init__(self, numbers: np.ndarray | None = None):
        if numbers is None:
            rng = np.random.default_rng(3)
            parts = [rng.normal(0, 0.1, s) for s in _SHAPES[:2]] + [np.zeros(_SHAPES[2])]
            numbers = np.concatenate([p.ravel() for p in parts])
        near, self.out, self.bias = (
            c.reshape(s).copy() for c, s in zip(np.split(np.asarray(numbers, np.float32), np.cumsum(_SIZES)[:-1]), _SHAPES, strict=True)
        )
        # A class's vectors at all offsets stand side by side; ``near`` is a view of them.
        self.beside = near.transpose(1, 0, 2).reshape(CLASSES + 1, -1)
        self.near = self.beside.reshape(CLASSES + 1, len(_OFFSETS), WIDTH).transpose(1, 0, 2)

    def numbers(self) -> np.ndarray:
        return np.concatenate([self.near.ravel(), self.out.ravel(), self.bias])

    def hidden(self, around: np.ndarray) -> np.ndarray:
        """``around``: the classes at each offset, one row per offset."""
        return np.tanh(sum(self.near[i][c] for i, c in enumerate(around)))

    def _chances(self, hidden: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits of all classes, perhaps less the highest, their exponentials and the sums of these."""
        logits = hidden @ self.out
        logits += self.bias
        if (np.abs(self.out).sum(axis=0) + np.abs(self.bias)).max() > 60:  # hidden units are below 1
            logits -= logits.max(axis=1, keepdims=True)
        powers = np.exp(logits)
        return logits, powers, powers @ np.ones(CLASSES, np.float32)

    def of_classes(self, hidden: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Log probability of the classes at some places."""
        logits, _, sums = self._chances(hidden)
        return logits[np.arange(len(classes)), classes] - np.log(sums)

    def towards_classes(self, hidden: np.ndarray, classes: np.ndarray, rate: float) -> np.ndarray:
        """One step of the softmax down the gradient of the log loss; gives that of the hidden units."""
        _, error, sums = self._chances(hidden)
        error *= (np.float32(rate) / sums)[:, None]
        error[np.arange(len(classes)), classes] -= np.float32(rate)
        back = error @ self.out.T
        self.out -= hidden.T @ error
        self.bias -= np.ones(len(error), np.float32) @ error
        return back

    def log_probabilities(self, around: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Of the classes at some places."""
        return self.of_classes(self.hidden(around), classes)

    def learn(self, around: np.ndarray, classes: np.ndarray, rate: float) -> None:
        """One step down the gradient of the mean log loss of a batch of places, by classes alone."""
        hidden = self.hidden(around)
        back = self.towards_classes(hidden, classes, rate / len(classes)) * (1 - hidden * hidden)
        for i, c in enumerate(around):
            np.subtract.at(self.near[i], c, back)


class Reader:
    """Batches of the places of numbered texts, with what stands around them.

    The texts follow each other with REACH places between them that hold no word.
    """

    def __init__(self, found: Numbered, part: Part):
        self.part, self.none = part, len(part.hashes)
        self.place = np.arange(len(found.numbers)) + np.repeat(REACH * np.arange(1, len(found.counts) + 1), found.counts)
        self.words = np.full(len(found.numbers) + REACH * (len(found.counts) + 1), self.none, np.int32)
        self.words[self.place] = found.numbers
        self.classes = np.append(part.classes, CLASSES).astype(np.uint8)[self.words]

    def __iter__(self) -> Iterator[tuple[slice, np.ndarray, slice]]:
        """Which words, where they stand in a stretch of places, and that stretch with REACH more at both ends."""
        for a in range(0, len(self.place), STEP_WORDS):
            place = self.place[a : a + STEP_WORDS]
            yield slice(a, a + len(place)), place - place[0], slice(int(place[0]) - REACH, int(place[-1]) + 1 + REACH)

    def hidden(self, network: Network, here: np.ndarray, stretch: slice) -> np.ndarray:
        near = network.beside.take(self.classes[stretch], axis=0)
        vectors = self.part.words.take(self.words[stretch], axis=0)
        n = len(near) - 2 * REACH
        total = np.zeros((n, WIDTH), np.float32)
        for i, offset in enumerate(_OFFSETS):
            at = slice(REACH + offset, REACH + offset + n)
            total += near[at, i * WIDTH : (i + 1) * WIDTH]
            total += _TURNED[i] * vectors[at]
        return np.tanh(total if len(here) == n else total.take(here, axis=0))

    def learn(self, network: Network, some: slice, here: np.ndarray, stretch: slice, rate: float) -> None:
        """One step down the gradient of the mean log loss of a batch."""
        part, hidden = self.part, self.hidden(network, here, stretch)
        words, classes = self.words[stretch], self.classes[stretch]
        back = network.towards_classes(hidden, classes[REACH:][here], rate / len(here))
        back += part.learn(words[REACH:][here], hidden, rate / len(here))
        back *= 1 - hidden * hidden
        n = len(words) - 2 * REACH
        if len(here) < n:
            spread = np.zeros((n, WIDTH), np.float32)
            spread[here] = back
            back = spread
        # What each place is to blame for as a neighbour: at each offset apart, and in all.
        near, own = np.zeros((len(words), len(_OFFSETS) * WIDTH), np.float32), np.zeros((len(words), WIDTH), np.float32)
        for i, offset in enumerate(_OFFSETS):
            at = slice(REACH + offset, REACH + offset + n)
            near[at, i * WIDTH : (i + 1) * WIDTH] = back
            own[at] += _TURNED[i] * back
        order = np.argsort(classes, kind="stable")
        begin = _starts(classes[order])
        network.beside[classes[order[begin]]] -= np.add.reduceat(near.take(order, axis=0), begin, axis=0)
        _stepped(part.words, part.words_seen, words, lambda row: own.take(row, axis=0))
        part.words[-1] = 0


def _around(words: Words, classes: np.ndarray, none: int = CLASSES) -> np.ndarray:
    """The classes at each offset of every word; ``none`` where the text has no word."""
    n = len(classes)
    first = np.repeat(words.first[:-1], words.counts)
    end = np.repeat(words.first[1:], words.counts)
    place = np.arange(n)
    rows = []
    for offset in _OFFSETS:
        at = place + offset
        inside = (at >= first) & (at < end)
        rows.append(np.where(inside, classes[np.clip(at, 0, max(0, n - 1))], none))
    return np.stack(rows)


def scores(docs: DataFrame, known: Vocabulary, network: Network) -> DataFrame:
    """doc_id, n_words, log_likelihood of a few documents (columns doc_id, text as bytes) by
    their classes alone: within its class a word has its share of the counts."""
    model = docs.sparkSession.sparkContext.broadcast((known, network.numbers()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary_, net = model.value[0], Network(model.value[1])
        for batch in batches:
            texts, counts, sums = batch["text"].to_pylist(), [], []
            for a, b in portions([len(t) for t in texts], PART_BYTES):
                words = words_of(texts[a:b])
                classes, slots = vocabulary_.classes(words, texts[a:b])
                around, logs = _around(words, classes), vocabulary_.within(classes, slots)
                for at in range(0, len(classes), STEP_WORDS):
                    some = slice(at, at + STEP_WORDS)
                    logs[some] += net.log_probabilities(around[:, some], classes[some])
                owner = np.repeat(np.arange(b - a), words.counts)
                counts.append(words.counts)
                sums.append(np.bincount(owner, logs, minlength=b - a))
            columns = [batch["doc_id"], pa.array(np.concatenate(counts), pa.int64()), pa.array(np.concatenate(sums), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "log_likelihood"])

    return docs.mapInArrow(run, _SCORED)


# Parts of the documents.

_SCORED = "doc_id bigint, n_words bigint, log_likelihood double"
_WORDS = "part bigint, hash bigint, ending bigint, n bigint"
_DEALT = "part bigint, docs array<bigint>, counts array<bigint>, numbers binary, hashes binary, endings binary, n binary"
_SPREAD = "part bigint, bucket int, hashes binary, endings binary, n binary"
_PLACES = "part bigint, bucket int, places binary"
_PACKED = "part bigint, bucket int, keys binary, weights binary, vectors binary"


def _dealt(docs: DataFrame) -> DataFrame:
    """One row per part: its documents, their words by number, and its distinct words."""

    def row(part: int, ids: list, texts: list[bytes]) -> pa.RecordBatch:
        found = _numbered(texts)
        columns = [
            pa.array([part], pa.int64()),
            *(pa.array([x], pa.list_(pa.int64())) for x in (ids, found.counts)),
            *(pa.array([x.tobytes()], pa.binary()) for x in (found.numbers, found.hashes, found.endings.astype(np.uint8), found.n)),
        ]
        return pa.RecordBatch.from_arrays(columns, ["part", "docs", "counts", "numbers", "hashes", "endings", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, ids, texts = TaskContext.get().partitionId() << 32, 0, [], []
        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if texts and held + len(text) > DEALT_BYTES:
                    yield row(part, ids, texts)
                    part, held, ids, texts = part + 1, 0, [], []
                ids.append(doc)
                texts.append(text)
                held += len(text)
        if texts:
            yield row(part, ids, texts)

    total = docs.agg(F.sum(F.octet_length("text")).alias("total")).first()["total"] or 0
    few = docs.coalesce(max(1, -(-total * 8 // (DEALT_BYTES * 5))))
    return bucketed(few.mapInArrow(run, _DEALT), "part", min(100_000, max(shuffle_partitions(docs), -(-total // DEALT_BYTES))), "parts")


def _bucket_of(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) * np.uint64(n_buckets) >> np.uint64(24)).astype(np.int64)


def _spread(batches: Iterator[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """The distinct words of parts, cut into ranges of hashes."""
    for batch in batches:
        for part, *columns in zip(*(batch[c].to_pylist() for c in ("part", "hashes", "endings", "n")), strict=True):
            arrays = [np.frombuffer(x, kind) for x, kind in zip(columns, (np.uint64, np.uint8, np.int64), strict=True)]
            bucket = _bucket_of(arrays[0], n_buckets)
            start = _starts(bucket)
            cut = [pa.array([x.tobytes() for x in np.split(a, start[1:])][: len(start)], pa.binary()) for a in arrays]
            held = [pa.array(np.full(len(start), part, np.int64)), pa.array(bucket[start].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(held + cut, ["part", "bucket", "hashes", "endings", "n"])


def _column(rows: pa.Table, name: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The arrays of all rows in one, and the length of each."""
    arrays = [np.frombuffer(x, kind) for x in rows[name].to_pylist()]
    return np.concatenate([np.zeros(0, kind), *arrays]), np.array([len(a) for a in arrays], np.int64)


def _distinct(rows: pa.Table) -> pa.Table:
    """part (the first), hash, ending, n of all words of a bucket."""
    rows = rows.sort_by("part")
    (hashes, sizes), (endings, _), (n, _) = (_column(rows, c, k) for c, k in (("hashes", np.uint64), ("endings", np.uint8), ("n", np.int64)))
    order = np.argsort(hashes, kind="stable")
    start = _starts(hashes[order])
    one = order[start]
    sums = np.add.reduceat(n[order], start) if len(start) else n
    return pa.table({"part": np.repeat(rows["part"].to_numpy(), sizes)[one], "hash": hashes[one].view(np.int64), "ending": endings[one].astype(np.int64), "n": sums})


def _placed(rows: pa.Table, places: pa.Table) -> pa.Table:
    """The places of the words of each part, in the order of their hashes."""
    hashes = places["hash"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    hashes, place = hashes[order], places["place"].to_numpy()[order]
    found = [place[np.searchsorted(hashes, np.frombuffer(x, np.uint64))].tobytes() for x in rows["hashes"].to_pylist()]
    return pa.table({"part": rows["part"], "bucket": rows["bucket"], "places": pa.array(found, pa.binary())})


def _planes(values: np.ndarray) -> bytes:
    """Compressed, with the first byte of all numbers first, then the second, and so on."""
    data = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return pa.compress(data, "zstd", asbytes=True) if data else b""


def _unplaned(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(data, n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _whole(vectors: np.ndarray) -> np.ndarray:
    """As whole numbers of 16 bits, one row per component."""
    return np.clip(np.rint(vectors.T.astype(np.float64) * FIXED), -(2**15), 2**15 - 1).astype(np.int16)


def _part_of(rows: pa.Table, leaves: Leaves) -> tuple[Part, np.ndarray]:
    """The part that rows (key, place) of its words describe, and the places in the order of its hashes.

    A place holds a word's class, tier and number there.
    """
    key, place = rows["key"].to_numpy(), rows["place"].to_numpy()
    part = Part(leaves, key.view(np.uint64), place >> 55, place >> 47 & 127, place & (2**47 - 1))
    return part, place[np.argsort(key.view(np.uint64))]


def _trained(texts: list[bytes] | Numbered, rows: pa.Table, leaves: Leaves) -> list[np.ndarray]:
    """kind, key, place, weight, vector of all that training on the texts touches."""
    part, places = _part_of(rows, leaves)
    found = texts if isinstance(texts, Numbered) else _numbered(texts)
    network, reader = Network(), Reader(found, part)
    for steps, batch in enumerate(reader):
        reader.learn(network, *batch, RATE / (1 + (steps + 1) / 2000) ** 0.5)
    flat = network.numbers()
    dense = np.zeros((-(-len(flat) // (WIDTH + 1)), WIDTH + 1), np.float32)
    dense.ravel()[: len(flat)] = flat
    seen = found.n.astype(np.int64)
    touched = np.bincount(part.node, np.repeat(seen, part.depth), minlength=len(part.keys)).astype(np.int64)
    words = np.pad(part.words[:-1], ((0, 0), (0, 1)))
    return [
        np.repeat([_DENSE, _WORD, _NODE], [len(dense), len(words), len(part.keys)]).astype(np.int32),
        np.concatenate([np.arange(len(dense)), part.hashes.view(np.int64), part.keys]),
        np.concatenate([np.zeros(len(dense), np.int64), places, np.zeros(len(part.keys), np.int64)]),
        np.concatenate([np.full(len(dense), seen.sum()), seen, touched]),
        np.concatenate([dense, words, part.nodes]),
    ]


def _shares(kind: np.ndarray, key: np.ndarray, n_buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """The buckets of a part's vectors, and which of them go there, in their order."""
    hashed = (mix(key.view(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)
    bucket = np.where(kind == _DENSE, _DENSE * n_buckets, kind * n_buckets + hashed)
    order = np.argsort(bucket, kind="stable")
    start = _starts(bucket[order])
    for at, some in zip(start, np.split(order, start[1:]), strict=False):
        yield int(bucket[order[at]]), some


def _averaged(rows: pa.Table, n_buckets: int) -> pa.Table:
    """The vectors of a bucket, averaged over the parts and handed back to each in its order."""
    bucket, parts = rows["bucket"][0].as_py(), rows["part"].to_pylist()
    if bucket >= _LEAF * n_buckets:
        return rows.set_column(3, "weights", pa.array([b""] * len(parts), pa.binary()))
    width = WIDTH if bucket // n_buckets == _WORD else WIDTH + 1
    sizes = rows["weights"].to_pylist()
    sizes = [int.from_bytes(x[:8], "little") for x in sizes]
    keys, weights, vectors = (
        [_unplaned(x[skip:], n * w, kind) for x, n in zip(rows[c].to_pylist(), sizes, strict=True)]
        for c, skip, w, kind in (("keys", 0, 1, np.int64), ("weights", 8, 1, np.int64), ("vectors", 0, width, np.int16))
    )
    _, _, number = _ranks(np.concatenate([np.cumsum(k) for k in keys]))
    weight = np.concatenate(weights).astype(np.float64)
    whole = np.maximum(np.bincount(number, weight), 1)
    out = [np.empty((width, n), np.int16) for n in sizes]
    for i in range(width):
        # Sums of whole numbers below 2 ** 53: exact in any order.
        mean = np.rint(np.bincount(number, weight * np.concatenate([v.reshape(width, -1)[i] for v in vectors])) / whole)[number]
        for held, values in zip(out, np.split(mean, np.cumsum(sizes)[:-1]), strict=True):
            held[i] = values
    empty = pa.array([b""] * len(parts), pa.binary())
    return pa.table([rows["part"], rows["bucket"], empty, empty, pa.array([_planes(v) for v in out], pa.binary())], rows.column_names)


def lexicon(held: DataFrame) -> tuple[DataFrame, Leaves]:
    """hash and place of every word, and the trees; ``held``: part, hash, ending, n."""
    return _lexicon(stored(held.groupBy("hash").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"), F.min("part").alias("part")), "counts"))


def _lexicon(counts: DataFrame) -> tuple[DataFrame, Leaves]:
    """The same of words that stand in one row each, with the first part that holds them."""
    top = counts.orderBy(F.col("n").desc(), "hash").limit(OWN).select("hash").collect()
    rank = F.lit(-1).cast("bigint")
    for i, row in enumerate(top):
        rank = F.when(F.col("hash") == row["hash"], F.lit(i).cast("bigint")).otherwise(rank)
    tiered = counts.withColumn("rank", rank).withColumn("tier", tier_of(F.col("n")).cast("bigint"))
    shared = tiered.where("rank < 0").withColumn("class", F.col("ending") + OWN)
    # Words that first stand in one part are neighbours, so a part needs few nodes.
    number = F.row_number().over(Window.partitionBy("class", "tier").orderBy("part", "hash")).cast("bigint") - 1
    place = F.shiftleft("class", 55).bitwiseOR(F.shiftleft("tier", 47)).bitwiseOR(number)
    own = tiered.where("rank >= 0").select("hash", F.shiftleft("rank", 55).alias("place"))
    sizes = shared.groupBy("class", "tier").agg(F.count("*").alias("size"), F.sum("n").alias("total")).collect()
    leaves = Leaves({(r["class"], r["tier"]): (r["size"], r["total"]) for r in sizes})
    return shared.select("hash", place.alias("place")).unionByName(own), leaves


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """Count, train and score over all documents.

    ``docs`` needs doc_id and text; other columns are ignored. Words are
    ``[^\\x20\\x09-\\x0D]+``. Returns doc_id, n_words, log_likelihood (the sum over all words)
    and perplexity (of a word; null without words). A null or empty text has no words and
    a likelihood of 0. Repeated rows count as often as they stand and score alike, up to
    the order of their sums. An empty table gives an empty table. How the input is split
    into parts shifts the averaged network, and so the scores, slightly.
    """
    parts = _dealt(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text")))
    by_part, n_buckets = parts.groupBy("part"), shuffle_partitions(docs)
    words = parts.select("part", "hashes", "endings", "n").mapInArrow(lambda batches: _spread(batches, n_buckets), _SPREAD)
    places, leaves = _lexicon(stored(words.groupBy("bucket").applyInArrow(_distinct, _WORDS), "counts"))
    model = docs.sparkSession.sparkContext.broadcast(leaves)
    bucket = F.shiftright(F.shiftrightunsigned("hash", 40) * n_buckets, 24).cast("int")
    of_bucket = words.select("part", "bucket", "hashes").groupBy("bucket")
    leaf = of_bucket.cogroup(places.withColumn("bucket", bucket).groupBy("bucket")).applyInArrow(_placed, _PLACES)

    def read(row: pa.Table, places_: pa.Table) -> tuple[Numbered, pa.Table]:
        one = {c: row[c][0].as_py() for c in ("counts", "numbers", "hashes", "n")}
        hashes, n = np.frombuffer(one["hashes"], np.int64), np.frombuffer(one["n"], np.int64)
        found = Numbered(hashes.view(np.uint64), np.zeros(0, np.int64), n, np.frombuffer(one["numbers"], np.int32), np.array(one["counts"], np.int64))
        place = _column(places_.sort_by("bucket"), "places", np.int64)[0]
        return found, pa.table({"key": hashes, "place": place})

    def learn(row: pa.Table, places_: pa.Table) -> pa.Table:
        part, (found, rows) = row["part"][0].as_py(), read(row, places_)
        kind, key, place, weight, vectors = _trained(found, rows, model.value)
        # The places go along, to be handed on with the averages.
        out = [(_LEAF * n_buckets + part % n_buckets, place[kind == _WORD].tobytes(), b"", b"")]
        for to, some in _shares(kind, key, n_buckets):
            width = WIDTH if to // n_buckets == _WORD else WIDTH + 1
            packed = _planes(np.diff(key[some], prepend=0)), int(len(some)).to_bytes(8, "little") + _planes(weight[some]), _planes(_whole(vectors[some, :width]))
            out.append((to, *packed))
        columns = [pa.array(x, kind_) for x, kind_ in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 3), strict=True)]
        return pa.table([pa.array([part] * len(out), pa.int64()), *columns], ["part", "bucket", "keys", "weights", "vectors"])

    trained = by_part.cogroup(leaf.groupBy("part")).applyInArrow(learn, _PACKED)
    averaged = trained.groupBy("bucket").applyInArrow(lambda rows: _averaged(rows, n_buckets), _PACKED)

    def score(row: pa.Table, rows: pa.Table) -> pa.Table:
        packed = {b: (k, v) for b, k, v in zip(*(rows[c].to_pylist() for c in ("bucket", "keys", "vectors")), strict=True)}
        leaf_ = next(k for b, (k, _) in packed.items() if b >= _LEAF * n_buckets)
        found, known = read(row, pa.table({"bucket": [0], "places": pa.array([leaf_], pa.binary())}))
        part, _ = _part_of(known, model.value)
        dense = np.zeros((-(-sum(_SIZES) // (WIDTH + 1)), WIDTH + 1), np.float32)
        tables = dense, part.words, part.nodes
        for of, (table, key) in enumerate(zip(tables, (np.arange(len(dense)), part.hashes.view(np.int64), part.keys), strict=True)):
            width = table.shape[1]
            for to, some in _shares(np.full(len(key), of), key, n_buckets):
                table[some] = _unplaned(packed[to][1], len(some) * width, np.int16).reshape(width, -1).T / np.float32(FIXED)
        network, reader = Network(dense.ravel()[: sum(_SIZES)]), Reader(found, part)
        logs = np.zeros(len(found.numbers))
        for some, here, stretch in reader:
            hidden = reader.hidden(network, here, stretch)
            numbers = found.numbers[some]
            logs[some] = network.of_classes(hidden, part.classes[numbers]) + part.log_probabilities(numbers, hidden)
        sums = np.bincount(np.repeat(np.arange(len(found.counts)), found.counts), logs, minlength=len(found.counts))
        return pa.table({"doc_id": pa.array(row["docs"][0].as_py(), pa.int64()), "n_words": found.counts, "log_likelihood": sums})

    scored = stored(by_part.cogroup(averaged.groupBy("part")).applyInArrow(score, _SCORED), "scored")
    rate = -F.col("log_likelihood") / F.col("n_words")
    return scored.withColumn("perplexity", F.when(F.col("n_words") > 0, F.exp(rate)))
