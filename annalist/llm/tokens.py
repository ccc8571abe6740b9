"""Tokens of many texts at once, as places in one array of bytes.

What counts as part of a token is a table of bytes. Only A-Z are lowered. These helpers
run inside Spark tasks on the texts of one Arrow batch.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from annalist.llm.words import mix, powers

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_BYTE = np.random.default_rng(20240301).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x2545F4914F6CDD1D
INVERSE = pow(BASE, -1, 2**64)


def byte_table(inside: Sequence[int]) -> np.ndarray:
    """True for the given bytes."""
    table = np.zeros(256, bool)
    table[list(inside)] = True
    return table


class Polynomials:
    """Fingerprints of any stretch of a sequence, from the sums of its prefixes.

    The fingerprint of values v0 .. vk is mix(v0 + v1 * B + .. + vk * B^k + k + 1) modulo
    2^64: sums of prefixes differ by the stretch's sum, and a power of B's inverse takes
    out where it begins.
    """

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(BASE, len(values)), out=self.sums[1:], dtype=np.uint64)

    def at(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        shift = powers(INVERSE, len(self.sums))[start]
        return mix((self.sums[start + length] - self.sums[start]) * shift + np.asarray(length).astype(np.uint64))


@dataclass
class Tokens:
    """data: all bytes, A-Z lowered; start and length of every token; first: per text the
    index of its first token, and one more entry at the end."""

    data: np.ndarray
    start: np.ndarray
    length: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """For each token the index of its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def polynomials(self) -> Polynomials:
        return Polynomials(_BYTE[self.data])


def tokens_of(texts: Sequence[bytes], inside: np.ndarray) -> Tokens:
    """The maximal runs of ``inside`` bytes of every text; a line feed, which must not be
    one of them, stands between the texts."""
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    data = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    flags = np.zeros(len(data) + 1, bool)
    flags[1:] = inside[data]
    edges = np.flatnonzero(flags[1:] != flags[:-1])
    start, end = edges[0::2], edges[1::2]
    first = np.searchsorted(start, np.concatenate([[0], ends]))
    return Tokens(data, start, end - start, first)
