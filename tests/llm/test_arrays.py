"""The array code that runs inside tasks, against plain versions."""

import itertools
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from annalist.llm.bpe import WordBpe
from annalist.llm.cuckoo import CuckooFilter
from annalist.llm.packing import Encoder, cut, edges_of_tail, hilbert
from annalist.llm.prefix_tree import Jaccard, PrefixTree
from annalist.llm.unigram import UNKNOWN, UnigramCounter, vocabulary
from annalist.llm.words import portions, rolling, sorted_unique, windows_of, words_of

texts = st.lists(st.text(alphabet=st.sampled_from("ab \t\né\x1c\xa0"), max_size=30), max_size=8)


@given(texts)
@settings(deadline=None)
def test_words_are_hashed_by_their_bytes(some):
    some = [t.encode() for t in some]
    split = [t.split() for t in some]
    words = words_of(some)
    assert words.counts.tolist() == list(map(len, split))
    flat = [w for t in split for w in t]
    by_word = {}
    for word, value in zip(flat, words.hashes.tolist(), strict=True):
        assert by_word.setdefault(word, value) == value
    assert len(set(by_word.values())) == len(by_word)


@pytest.mark.parametrize("size", [2, 4, 18])
def test_rolling_windows_are_equal_when_their_words_are(size):
    rng = random.Random(size)
    some = [" ".join(rng.choice("abc") for _ in range(60)).encode() for _ in range(5)]
    words = words_of(some)
    values, whole = rolling(words, size), windows_of(words, size)
    flat = [w for t in some for w in t.split()]
    groups = {}
    for i in np.flatnonzero(whole):
        groups.setdefault(int(values[i]), set()).add(tuple(flat[i : i + size]))
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == len(set().union(*groups.values()))
    assert whole.sum() == 5 * (60 - size + 1)


def test_sorted_unique_and_portions():
    values, several = sorted_unique(np.array([3, 1, 3, 2], np.uint64))
    assert values.tolist() == [1, 2, 3] and several.tolist() == [False, False, True]
    assert list(portions([5, 5, 20, 1], 10)) == [(0, 2), (2, 3), (3, 4)]
    assert list(portions([], 10)) == []


def test_cuckoo_filter_follows_a_multiset():
    rng = np.random.default_rng(1)
    filter_, held = CuckooFilter(4000), []
    for _ in range(6):
        new = rng.integers(0, 2**63, 500, dtype=np.uint64)
        assert filter_.insert(new)
        held += new.tolist()
        gone = [held.pop(int(rng.integers(len(held)))) for _ in range(100)]
        filter_.delete(np.array(gone, np.uint64))
        assert filter_.contains(np.array(held, np.uint64)).all()
        assert len(filter_) == len(held)
    strangers = rng.integers(0, 2**63, 20000, dtype=np.uint64)
    assert filter_.contains(strangers).mean() < 0.01
    again = CuckooFilter(blob=filter_.to_bytes())
    assert again.contains(np.array(held, np.uint64)).all()
    small = CuckooFilter(1)
    assert not small.insert(rng.integers(0, 2**63, 1000, dtype=np.uint64))


@given(st.lists(st.sets(st.integers(0, 25), min_size=1, max_size=20), min_size=1, max_size=25), st.sampled_from([50, 80, 85, 100]))
@settings(deadline=None)
def test_prefix_tree_finds_all_linked_sets(sets, percent):
    jaccard, tree = Jaccard(percent), PrefixTree()
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    for i, a in enumerate(arrays):
        tree.insert(a, i)
    for s, a in zip(sets, arrays, strict=True):
        want = [i for i, o in enumerate(sets) if 100 * len(s & o) >= percent * len(s | o)]
        assert sorted(tree.search(a, jaccard)) == want
        for i in want:
            assert set(sorted(s)[: jaccard.prefix(len(s))]) & set(sorted(sets[i])[: jaccard.prefix(len(sets[i]))])


@pytest.mark.parametrize("dimensions,bits", [(2, 4), (3, 2), (4, 2)])
def test_hilbert_neighbours_touch(dimensions, bits):
    cells = np.array(list(itertools.product(range(2**bits), repeat=dimensions)))
    keys = hilbert(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


@given(st.integers(0, 5000), st.lists(st.integers(1, 2000), max_size=20), st.sampled_from([8, 1024]))
@settings(deadline=None)
def test_cutting_fills_every_sequence(_, sizes, length):
    total = sum(sizes)
    tail, filled, at = edges_of_tail(total, length), {}, 0
    for n in sizes:
        start, sequence, offset = cut(at, n, tail, length)
        for a, b, s, o in zip(start, [*start[1:], n], sequence, offset, strict=True):
            assert filled.get(s, 0) == o
            filled[s] = o + b - a
        at += n
    assert sorted(filled) == list(range(len(filled)))
    assert all(v == length or v & (v - 1) == 0 for v in filled.values())
    assert sum(filled.values()) == total


def odd_texts() -> list[str]:
    rng = random.Random(3)
    points = [c for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000]
    new = ["a" + chr(c) + "b" + chr(c) + chr(c) + " " + chr(c) for c in (0x558, 0x1C89, 0x10D54, 0x323B0)]
    odd = ["", "  ", "don't WE'LL I'M <|endoftext|>x<|startoftext|> <|ENDOFTEXT|>", "ΟΔΟΣ Σ ΣΑΣ İ ﬁ Å ½ ²x", "a" * 300, "ab" * 900]
    return odd + new + ["a" + chr(c) + "b " + chr(c) for c in rng.sample(points, 3000)] + ["\x1c a\x85b\xa0c　d\r\n\n x"]


def test_word_bpe_is_the_librarys():
    import json

    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        ours = WordBpe(json.load(file))
    theirs = Tokenizer.from_file(path)
    odd = odd_texts()
    for text, ids in zip(odd, ours.encode(odd), strict=True):
        want = theirs.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)), text
        assert ours.decode(ids) == theirs.decode(want, skip_special_tokens=False)
    words = [bytes(random.Random(i).choices(b"etaoinsh", k=1 + i % 40)) for i in range(300)]
    for word, ids in zip(words, ours.merge(words), strict=True):
        assert ids.tolist() == ours._merge_long(word).tolist()
    assert ours.decode("320 9999999") == ours.decode("320")


def test_byte_bpe_is_the_librarys():
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        ours = Encoder(file.read())
    theirs = Tokenizer.from_file(path)
    for text in odd_texts():
        assert ours.ids(text) == theirs.encode(text, add_special_tokens=False).ids, text


def test_unigram_counts_are_those_of_the_cheapest_spelling():
    costs = vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    counter = UnigramCounter(costs)

    def plain(word):
        best = [(0, 0)]
        for d in range(1, len(word) + 1):
            ways = [(best[d - n][0] + costs[p], best[d - n][1] + 1) for n in range(1, min(d, 20) + 1) if (p := word[d - n : d]) in costs]
            if word[d - 1] not in costs:
                size = len(word[d - 1].encode())
                ways.append((best[d - 1][0] + size * UNKNOWN, best[d - 1][1] + size))
            best.append(min(ways))
        return best[-1][1]

    rng = random.Random(2)
    words = ["▁" + "".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 14))) for _ in range(800)]
    words += ["▁", "▁a", "▁日本😀x", "▁" + "ab" * 400, "▁\x00", "▁ﬁ½"]
    assert counter.count(words) == [plain(w) for w in words]
    assert counter.count([]) == []
