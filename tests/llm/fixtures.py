"""Small documents with every awkward case, and plain versions of the operators."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

SCHEMA = "doc_id bigint, text string, row string, chunk int, rest int, kept string, score double, n int, node int"
SPACE = " \t\n\x0b\x0c\r"


def rows() -> list[tuple]:
    """(doc_id, text, and columns whose names the operators use inside)."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, license_ = prose(60), "This line stands in many documents, word for word, alike."
    base = prose(200).split()
    texts: list[tuple[int | None, str | None]] = [(i, prose(rng.randint(1, 120))) for i in range(30)]
    texts += [(30 + i, f"{prose(40)}\n{license_}\n {license_.upper()} \n{prose(20)} {passage} {prose(10)}") for i in range(12)]
    for i in range(12):  # near copies: a word changed here and there
        words = list(base)
        words[(i * 17) % 200] = f"x{i}"
        texts.append((50 + i, " ".join(words)))
    texts += [(70 + i, "The very same text in several documents, which is an exact copy.") for i in range(5)]
    texts += [(80, None), (81, ""), (82, " \t\n "), (83, "one"), (84, "One"), (85, "two words"), (86, "\n\n")]
    texts += [(90, "long " * 3000 + prose(3000)), (91, "x" * 20000), (92, "ab" * 3000 + "é" * 40)]
    texts += [(95, "twice the same row of one document"), (95, "twice the same row of one document")]
    texts += [(96, "ties Σίσυφος ΟΔΟΣ İ ﬁ ½ 日本 😀 don't WE'LL <|endoftext|> x<|startoftext|>"), (97, "\x1c a\x85b\xa0c　d")]
    texts += [(None, "a document without an id, of more than a few words"), (None, None)]
    return [(d, t, "r", 1, 2, "k", 0.5, 3, 4) for d, t in texts]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def without_repeats(texts: list[str], window: int) -> list[tuple[int, int, bytes]]:
    """(words, removed words, words left) of each text, by counting every window."""
    split = [t.encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        stay = [True] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                stay[i : i + window] = [False] * window
        left = [x for x, s in zip(w, stay, strict=True) if s]
        out.append((len(w), len(w) - len(left), b" ".join(left)))
    return out


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def without_lines(docs: list[tuple[int | None, str | None]], least: int, chars: int) -> list[tuple[int, int, str]]:
    """(lines, dropped lines, text left) of each document."""
    key = lambda line: lower(line.strip(SPACE))
    holders = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= chars and doc is not None:
                holders[key(line)].add(doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        gone = lambda x: doc is not None and len(holders.get(key(x), ())) >= least and max(holders[key(x)]) != doc  # noqa: B023, E731
        left = [x for x in lines if not gone(x)]
        out.append((len(lines), len(lines) - len(left), "\n".join(left)))
    return out


def shingle_set(text: str | None, size: int) -> frozenset:
    words = lower(text or "").encode().split()
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def near_components(sets: list[frozenset], ids: list[int], percent: int) -> list[int]:
    """The smallest id reachable by links, for each set."""
    above = list(range(len(sets)))

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                above[top(i)] = top(j)
    lowest: dict[int, int] = {}
    for i, doc in enumerate(ids):
        lowest[top(i)] = min(lowest.get(top(i), doc), doc)
    return [lowest[top(i)] for i in range(len(sets))]
