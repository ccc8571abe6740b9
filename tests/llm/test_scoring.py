"""Scoring counts and predicts words themselves, not slots or classes of them."""

from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from annalist.llm import pseudo

SCHEMA = "doc_id bigint, text string"


def test_words_are_counted_exactly(spark):
    """More words than a fixed table of 2^18 slots can tell apart."""
    texts = [" ".join(f"w{i}" for i in range(a, a + 3000)) for a in range(0, 300_000, 3000)] + ["w7 w7 the"]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(4)
    known = pseudo.vocabulary(docs.select(F.col("text").cast("binary").alias("text")))
    assert len(known.counts) == 300_001 and known.counts.sum() == 300_003
    numbers = known.classes(pseudo.words_of([b"w7 w8 the"]), [b"w7 w8 the"])[1]
    assert known.counts[numbers].tolist() == [3, 1, 1]


def test_lexicon_gives_every_word_a_place_of_its_own(spark):
    rng = np.random.default_rng(2)
    counts = Counter({f"{'abc'[i % 3]}{i}": int(n) for i, n in enumerate(rng.zipf(1.3, 5000).clip(1, 10**6))})
    hashes = {w: int(pseudo.words_of([w.encode()]).hashes.view(np.int64)[0]) for w in counts}
    rows = [(i % 4, hashes[w], int(pseudo._endings([w.encode()])[0]), n) for i, (w, n) in enumerate(counts.items())]
    places, leaves = pseudo.lexicon(spark.createDataFrame(rows, pseudo._WORDS))
    of = {r["hash"]: r["place"] for r in places.collect()}
    assert sorted(of) == sorted(hashes.values()) and len(set(of.values())) == len(of)
    place = np.array([of[h] for h in hashes.values()])
    part = pseudo.Part(leaves, np.array(list(hashes.values())).view(np.uint64), place >> 55, place >> 47 & 127, place & (2**47 - 1))
    own = sorted((n for n in counts.values()), reverse=True)[: pseudo.OWN]
    top = [counts[w] for w, p in zip(counts, place, strict=True) if p >> 55 < pseudo.OWN]
    assert sorted(top, reverse=True) == own
    # Whatever the vectors and the context are, the words of a class share one.
    part.nodes[:] = rng.normal(0, 1, part.nodes.shape)
    hidden = np.tile(rng.normal(0, 0.5, pseudo.WIDTH).astype(np.float32), (len(part.hashes), 1))
    sums = defaultdict(float)
    for c, log in zip(part.classes, part.log_probabilities(np.arange(len(part.hashes)), hidden), strict=True):
        if c >= pseudo.OWN:
            sums[c] += np.exp(log)
    assert len(sums) > 10 and all(s == pytest.approx(1, rel=1e-4) for s in sums.values())


def test_context_tells_words_of_one_ending_apart(spark):
    """Words with one ending follow one of two words each; swapped, they must cost more."""
    rng = np.random.default_rng(3)
    common = [f"c{i}" for i in range(70)]  # they take the classes of their own
    left, right = ([f"{s}{i}ing" for i in range(40)] for s in "lr")
    sentence = lambda a, b: " ".join(
        f"{rng.choice(common)} {rng.choice(common)} c0 {rng.choice(a)} c0 {rng.choice(common)} c1 {rng.choice(b)} c1" for _ in range(60)
    )
    texts = [sentence(left, right) for _ in range(60)] + [sentence(right, left) for _ in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).coalesce(1)
    found = {r["doc_id"]: r for r in pseudo.pseudo_likelihood(docs).collect()}
    assert {r["n_words"] for r in found.values()} == {540}
    # Two words in nine are wrong.
    right_ones = np.mean([found[i]["log_likelihood"] for i in range(60)])
    assert all(found[i]["log_likelihood"] < right_ones - 0.5 * 120 for i in range(60, 63))


def test_scores_in_several_parts_are_the_same_each_time(spark, monkeypatch):
    """Sums over parts do not depend on the order in which they come."""
    monkeypatch.setattr(pseudo, "DEALT_BYTES", 3000)
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.4, 150).clip(1, 900)) for _ in range(30)] + ["", None, " \n "]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).coalesce(2)
    found = pseudo.pseudo_likelihood(docs).collect()
    assert {r["doc_id"]: r["n_words"] for r in found} == {i: len((t or "").split()) for i, t in enumerate(texts)}
    again = {r["doc_id"]: r["log_likelihood"] for r in pseudo.pseudo_likelihood(docs).collect()}
    assert all(again[r["doc_id"]] == r["log_likelihood"] for r in found)  # run again, the very same
    assert all(r["log_likelihood"] < 0 or not r["n_words"] for r in found)


def test_scores_of_the_registered_model_by_hand(spark):
    """One part: every word's probability from the trained vectors, turn by turn, in loops."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    vocabulary = [f"{'abc'[i % 3]}{i}{'xy'[i % 2]}" for i in range(150)]
    texts = [" ".join(vocabulary[int(x) % 150] for x in rng.zipf(1.2, int(rng.integers(1, 60)))) for _ in range(60)] + ["", "once"]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).coalesce(1)
    found = {r["doc_id"]: r for r in pseudo.pseudo_likelihood(docs).collect()}

    raw = [t.encode() for t in texts]
    held = pseudo._counted(raw)
    rows = [(0, h, e, n) for h, e, n in zip(*(held[c].to_pylist() for c in ("hash", "ending", "n")), strict=True)]
    assert sum(r[3] for r in rows) == sum(len(t.split()) for t in texts)
    places, leaves = pseudo.lexicon(spark.createDataFrame(rows, pseudo._WORDS))
    known = [(pseudo._LEAF, r["hash"], r["place"]) for r in places.collect()]
    leaf = pa.table({"kind": pa.array([k[0] for k in known], pa.int32()), "key": [k[1] for k in known], "place": [k[2] for k in known]})
    kind, key, place, weight, vectors = pseudo._trained(raw, leaf, leaves)
    vectors = np.rint(vectors.astype(np.float64) * pseudo.FIXED) / pseudo.FIXED
    word = {int(k): v for k, v, x in zip(key, vectors, kind, strict=True) if x == pseudo._WORD}
    node = {int(k): v for k, v, x in zip(key, vectors, kind, strict=True) if x == pseudo._NODE}
    network = pseudo.Network(vectors[kind == pseudo._DENSE].ravel()[: sum(pseudo._SIZES)])
    part, _ = pseudo._part_of(leaf, leaves)
    number = {int(h): i for i, h in enumerate(part.hashes.view(np.int64))}

    def log_probability(hashes, at):
        total = np.zeros(pseudo.WIDTH)
        for i, offset in enumerate(pseudo._OFFSETS):
            inside = 0 <= at + offset < len(hashes)
            beside = number[hashes[at + offset]] if inside else None
            total += network.near[i][part.classes[beside] if inside else pseudo.CLASSES]
            if inside:
                total += pseudo._TURNED[i] * word[hashes[at + offset]][: pseudo.WIDTH]
        hidden, here = np.tanh(total), number[hashes[at]]
        logits = hidden @ network.out + network.bias
        out = logits[part.classes[here]] - np.log(np.exp(logits).sum())
        for turn in range(part.begin[here], part.begin[here] + part.depth[here]):
            vector = node[int(part.keys[part.node[turn]])]
            odds = hidden @ vector[: pseudo.WIDTH] + vector[pseudo.WIDTH] + part.odds[turn]
            out -= np.log1p(np.exp(-part.turn[turn] * odds))
        return out

    for doc, text in enumerate(raw):
        hashes = [int(h) for h in pseudo.words_of([text]).hashes.view(np.int64)]
        want = sum(log_probability(hashes, i) for i in range(len(hashes)))
        assert found[doc]["n_words"] == len(hashes) and found[doc]["log_likelihood"] == pytest.approx(want, rel=1e-3, abs=1e-6)


def test_training_leaves_little_on_disk(spark, monkeypatch):
    """A word of a part costs a few dozen bytes in all that is stored, however many vectors it trains."""
    monkeypatch.setattr(pseudo, "DEALT_BYTES", 400_000)
    rng = np.random.default_rng(4)
    texts = [" ".join(f"{'abcdefgh'[x % 8]}{x}" for x in rng.integers(0, 60_000, 2000).tolist()) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).coalesce(2)
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    before = size()
    assert pseudo.pseudo_likelihood(docs).agg(F.sum("n_words")).first()[0] == 160_000
    assert size() - before < 60 * 160_000


def test_sums_of_runs_of_rows():
    rng = np.random.default_rng(8)
    for sizes in ([1, 1, 2, 3, 4, 1, 9, 3], [5, 4], [1], [2, 2], rng.integers(1, 7, 200).tolist()):
        rows = rng.integers(-9, 9, (sum(sizes), 5)).astype(np.float32)
        begin = np.cumsum(sizes) - sizes
        want = [rows[a : a + n].sum(axis=0) for a, n in zip(begin, sizes, strict=True)]
        assert np.array_equal(pseudo._summed(rows, begin), np.stack(want))


def test_words_and_nodes_are_averaged_by_their_counts():
    """Two parts that share a word: what each gets back is the mean by counts, in its own order."""
    import pyarrow as pa

    rng = np.random.default_rng(12)
    n_buckets, rows, held = 3, [], []
    for part in range(2):
        key = rng.choice(200, 120, replace=False).astype(np.int64)
        weight, whole = rng.integers(1, 50, 120), rng.integers(-999, 999, (120, pseudo.WIDTH)).astype(np.int16)
        held.append((key, weight, whole))
        for bucket, some in pseudo._shares(np.full(120, pseudo._WORD), key, n_buckets):
            packed = pseudo._planes(np.diff(key[some], prepend=0)), len(some).to_bytes(8, "little") + pseudo._planes(weight[some])
            rows.append((part, bucket, *packed, pseudo._planes(whole[some].T)))
    names = ["part", "bucket", "keys", "weights", "vectors"]
    for part, (key, _, _) in enumerate(held):
        for bucket, some in pseudo._shares(np.full(120, pseudo._WORD), key, n_buckets):
            table = pa.table([pa.array(c) for c in zip(*(r for r in rows if r[1] == bucket), strict=True)], names)
            back = pseudo._averaged(table, n_buckets).to_pylist()[part]
            got = pseudo._unplaned(back["vectors"], len(some) * pseudo.WIDTH, np.int16).reshape(pseudo.WIDTH, -1).T
            for k, vector in zip(key[some], got, strict=True):
                both = [(w[ks == k][0], v[ks == k][0].astype(float)) for ks, w, v in held if k in ks]
                want = sum(w * v for w, v in both) / sum(w for w, _ in both)
                assert np.array_equal(vector, np.rint(want))
