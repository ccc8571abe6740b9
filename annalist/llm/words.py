"""Words, lines and rolling hashes of many texts at once, on byte arrays.

These helpers run inside Spark tasks on the texts of one Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

# Space, tab, line feed, vertical tab, form feed, carriage return.
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = tuple(int(x) * 8 + 5 for x in _RNG.integers(2**59, 2**60, 3))


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0x7FB5D329728EA185)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x81DADEF4BC2DD44D)
    return values ^ (values >> np.uint64(33))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = 1 << max(12, (n - 1).bit_length())
        known = np.full(size, base % 2**64, np.uint64)
        known[0] = 1
        known = np.cumprod(known, dtype=np.uint64)
        if size <= 1 << 21:  # larger tables are not worth keeping
            _powers[base] = known
    return known[:n]


def portions(sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Cut consecutive items into ranges of about ``most`` in total; a larger item stands alone."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


@dataclass
class Words:
    """The words of several texts: a hash per word, and where each text's words begin."""

    hashes: np.ndarray
    first: np.ndarray  # per text the index of its first word; one more entry at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(texts: Sequence[bytes]) -> Words:
    """Hash every word ``[^\\x20\\x09-\\x0D]+`` of every text."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8) if len(texts) else np.zeros(0, np.uint8)
    inside = np.flatnonzero(~_IS_SPACE[data]).astype(np.int32 if len(data) < 2**31 else np.int64)
    if not len(inside):
        return Words(np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64))
    begin = np.empty(len(inside), bool)
    begin[0] = True
    np.not_equal(inside[1:], inside[:-1] + 1, out=begin[1:])
    start = np.flatnonzero(begin)
    lengths = np.diff(np.append(start, len(inside)))
    within = np.arange(len(inside), dtype=inside.dtype) - np.repeat(start.astype(inside.dtype), lengths)
    values = _BYTE[data[inside]] * powers(_BASES[0], int(lengths.max()))[within]
    hashes = mix(np.add.reduceat(values, start) + lengths.astype(np.uint64))
    first = np.searchsorted(inside[start], ends - sizes)
    return Words(hashes, np.append(first, len(start)))


def rolling(words: Words, size: int, seed: int = 0) -> np.ndarray:
    """A hash of ``size`` consecutive words from each word on.

    Windows that leave their text hold a meaningless value; see :func:`windows_of`.
    """
    n = len(words.hashes)
    if n < size:
        return np.zeros(n, np.uint64)
    base = _BASES[1 + seed % 2]
    power = powers(base, size)
    out = np.zeros(n - size + 1, np.uint64)
    if size <= 8:
        for i in range(size):
            out += words.hashes[i : n - size + 1 + i] * power[i]
    else:
        # Sums of prefixes; the factor base ** -start is taken out with the inverse power.
        inverse = pow(base, -1, 2**64)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words.hashes * powers(base, n), out=sums[1:], dtype=np.uint64)
        out = (sums[size:] - sums[: n - size + 1]) * powers(inverse, n - size + 1)
    out = mix(out + np.uint64(size))
    return np.append(out, np.zeros(size - 1, np.uint64))


def windows_of(words: Words, size: int) -> np.ndarray:
    """True for each word where a window of ``size`` words of its text begins."""
    counts = words.counts
    left = np.repeat(words.first[1:], counts) - np.arange(len(words.hashes))
    return left >= size


def sorted_unique(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and which of them occur more than once."""
    values = np.sort(values)
    new = np.empty(len(values), bool)
    new[:1] = True
    np.not_equal(values[1:], values[:-1], out=new[1:])
    start = np.flatnonzero(new)
    return values[start], np.diff(np.append(start, len(values))) > 1


def contained(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values occur in an ordered array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values
