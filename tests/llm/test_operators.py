"""Every operator on small documents with every awkward case, against plain versions."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from fixtures import documents, empty, near_components, rows, sha, shingle_set, without_lines, without_repeats
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from annalist.llm import bpe, exact, lines, ngrams, packing, pseudo, quality, substrings, topk, unigram

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def some(value):
    return value if value is not None else ""


def test_token_counts(spark):
    got = Counter(map(tuple, unigram.token_counts(documents(spark), PIECES).collect()))
    counter = unigram.UnigramCounter(unigram.vocabulary(PIECES))
    want = Counter()
    for doc, text, *_ in rows():
        words = some(text).encode().split()
        want[doc, len(words), sum(counter.count(["▁" + w.decode() for w in words]))] += 1
    assert got == want
    assert unigram.token_counts(empty(spark), PIECES).count() == 0


def test_pseudo_likelihood(spark):
    found = pseudo.pseudo_likelihood(documents(spark)).collect()
    assert Counter((r.doc_id, r.n_words) for r in found) == Counter((d, len(some(t).encode().split())) for d, t, *_ in rows())
    assert all(r.log_likelihood <= 0 and (r.perplexity is None) == (r.n_words == 0) for r in found)
    assert pseudo.pseudo_likelihood(empty(spark)).count() == 0


def test_pseudo_likelihood_of_one_document(spark):
    """Each word's probability, worked out by hand from the trained model."""
    texts = [some(t).encode() for _, t, *_ in rows() if some(t).strip()]
    slim = documents(spark).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    known = pseudo.vocabulary(slim.select("text"))
    every = pseudo.words_of([some(t).encode() for _, t, *_ in rows()])
    assert known.counts.sum() == len(every.hashes) == known.totals[pseudo.OWN :].sum()
    network = pseudo.Network(np.random.default_rng(1).normal(0, 0.5, sum(pseudo._SIZES)))
    text = texts[3]
    got = pseudo.scores(slim.where("doc_id = 3"), known, network).first()
    words = pseudo.words_of([text])
    classes, slots = known.classes(words, [text])
    padded = [pseudo.CLASSES] * 2 + classes.tolist() + [pseudo.CLASSES] * 2
    want = 0.0
    for i, c in enumerate(classes):
        near = [padded[i], padded[i + 1], padded[i + 3], padded[i + 4]]
        hidden = np.tanh(sum(network.near[j][x] for j, x in enumerate(near)))
        logits = hidden @ network.out + network.bias
        want += logits[c] - np.log(np.exp(logits).sum())
        if c >= pseudo.OWN:
            want += np.log((known.counts[slots[i]] + 1) / (known.totals[c] + len(known.counts)))
    assert got.n_words == len(classes)
    assert got.log_likelihood == pytest.approx(want, rel=1e-4)


def test_network_learns_what_both_sides_tell():
    rng = np.random.default_rng(0)
    classes = np.tile(np.arange(10), 800)
    classes[rng.random(len(classes)) < 0.05] = 11
    text = pseudo.Words(np.zeros(len(classes), np.uint64), np.array([0, len(classes)]))
    around, network = pseudo._around(text, classes), pseudo.Network()
    before = network.log_probabilities(around, classes).mean()
    for _ in range(60):
        for a in range(0, len(classes), 1000):
            network.learn(around[:, a : a + 1000], classes[a : a + 1000], 1.0)
    after = network.log_probabilities(around, classes).mean()
    assert before < -4 and after > -0.6


@pytest.mark.parametrize("window", [5, 34, 35, 50])
def test_substrings(spark, window):
    got = substrings.remove_repeats(documents(spark), window, carry=("row", "n")).collect()
    plain = without_repeats([some(t) for _, t, *_ in rows()], window)
    want = Counter((r[0], some(r[1]).encode(), *p) for r, p in zip(rows(), plain, strict=True))
    assert Counter((r.doc_id, bytes(r.text), r.n_words, r.n_removed, bytes(r.kept)) for r in got) == want
    assert all(r.rest.row == "r" and r.rest.n == 3 for r in got)
    assert substrings.remove_repeats(empty(spark), window).count() == 0


def test_substrings_in_many_parts(spark, monkeypatch):
    """Chunks, parts and buckets may be as small as can be."""
    frame = documents(spark)
    want = Counter(map(tuple, substrings.remove_repeats(frame, 35).select("doc_id", "n_removed", F.sha2("kept", 256)).collect()))
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 2000)
    monkeypatch.setattr("annalist.llm.tables.CHUNK_ROWS", 4)
    got = substrings.remove_repeats(frame, 35).select("doc_id", "n_removed", F.sha2("kept", 256)).collect()
    assert Counter(map(tuple, got)) == want


def labelled(spark, n=400):
    """Clean prose and shouting, with the quality of two thirds known."""
    rng = np.random.default_rng(4)
    words = np.array([f"{a}{b}" for a in ("tra", "lo", "mi", "ne", "su") for b in ("ta", "ren", "ko", "la", "vi")])
    docs, labels = [], []
    for i in range(n):
        picked = " ".join(rng.choice(words, 30))
        bad = i % 4 == 0
        docs.append((i, f"{picked.upper()}!! ###" if bad else picked + "."))
        if i % 3:
            labels.append((i, int(not bad), 0))
    labels += [(1, None, 0), (10**9, 1, 0), (5, 1, 1), (None, 1, 0)]
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_quality(spark):
    docs, labels = labelled(spark)
    found = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(found) == 400
    held = [r for r in found.values() if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found.values())
    again = {r.doc_id: r.score for r in quality.classify(docs.repartition(5), labels).collect()}
    assert again == {i: r.score for i, r in found.items()}


def test_quality_of_awkward_documents(spark):
    _, labels = labelled(spark)
    found = quality.classify(documents(spark), labels, carry=("score", "rest")).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows())
    assert all(0 <= r.score <= 1 and r.rest.score == 0.5 and r.rest.rest == 2 for r in found)
    assert not any(r.held_out for r in found if r.doc_id is None)
    blank = labels.limit(0)
    assert {r.score for r in quality.classify(documents(spark), blank).collect()} == {0.5}
    assert quality.classify(empty(spark), labels).count() == 0


def test_scores_are_averages_of_rows():
    model = quality.Model(np.random.default_rng(0).normal(0, 1, (1 << 17, 16)).astype(np.float32), np.ones((16, 2), np.float32) * [[0, 1]], np.zeros(2))
    texts = [b"", b"a", "né a a b\n\tb".encode(), b"x" * 500, b" "]
    weights = model.weights()
    want = [1 / (1 + np.exp(-weights[quality.features(t)].astype(float).mean())) for t in texts]
    assert quality.scores(texts, weights, 0.0) == pytest.approx(want, rel=1e-6)


def test_exact(spark):
    found = exact.exact_dedup(documents(spark)).collect()
    groups: dict[str, list] = {}
    for doc, text, *_ in rows():
        groups.setdefault(some(text), []).append(doc)
    best = {t: max((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
    want = Counter((d, best[some(t)], len(groups[some(t)]), sha(some(t))) for d, t, *_ in rows())
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == want
    kept = Counter(r.text_sha256 for r in found if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in found if r.kept)
    assert exact.exact_dedup(empty(spark)).count() == 0


def test_exact_with_heavy_and_light_texts(spark):
    docs = spark.range(20000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "heavy").otherwise(F.concat(F.lit("t"), (F.col("id") % 9000).cast("string"))).alias("text"),
    )
    found = exact.exact_dedup(docs)
    heavy = found.where(F.col("text_sha256") == sha("heavy")).agg(F.count("*").alias("n"), F.min("group_size").alias("a"), F.sum(F.col("kept").cast("int")).alias("k"), F.min("keep_id").alias("id")).first()
    assert heavy == (6667, 6667, 1, 19998)
    want = docs.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    other = found.select("doc_id", "keep_id", "group_size").exceptAll(docs.join(want, "text").select("doc_id", "keep_id", "group_size"))
    assert other.count() == 0


def test_exact_plan_is_native(spark):
    plan = exact.exact_dedup(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80), (1, 50)])
def test_near_duplicates(spark, size, percent):
    found = Counter(map(tuple, ngrams.near_duplicates(documents(spark), size, percent).collect()))
    sets = [shingle_set(t, size) for _, t, *_ in rows()]
    ids = [2**63 - 1 if d is None else d for d, *_ in rows()]
    components = near_components(sets, ids, percent)
    want = Counter((r[0], len(s), None if c == 2**63 - 1 else c) for r, s, c in zip(rows(), sets, components, strict=True))
    assert found == want
    assert ngrams.near_duplicates(empty(spark), size, percent).count() == 0


def test_chains_of_near_duplicates_are_one_component(spark, monkeypatch):
    """Neighbours in a chain are linked, its ends are far apart; and blocks are tiny."""
    monkeypatch.setattr(ngrams, "BLOCK_ROWS", 4)
    monkeypatch.setattr(ngrams, "GROUP_ROWS", 3)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[3 * i : 3 * i + 100]) for i in range(60)]
    order = np.random.default_rng(2).permutation(60).tolist()
    docs = spark.createDataFrame([(order[i], t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    found = {r.doc_id: r.component_id for r in ngrams.near_duplicates(docs, 2, 85).collect()}
    components = near_components([shingle_set(t, 2) for t in texts], order, 85)
    assert found == dict(zip(order, components, strict=True))
    assert set(found.values()) == {0}


def test_a_forest_joins_components_by_few_pairs():
    """Of m single sets that are all alike, m - 1 pairs are tried; two kinds stay two trees."""
    rows = pa.Table.from_pylist(
        [
            {"i": 0, "j": 0, "block": 0, "n": 40, "node": 10 + i, "component": 10 + i, "bitmap": ngrams._bitmap(kind).tobytes()}
            for i in range(60)
            for kind in [np.arange(40, dtype=np.uint64) * np.uint64(7 if i % 3 else 11) + np.uint64(i % 3 == 0)]
        ]
    )
    pairs = ngrams._across(ngrams.Jaccard(80), 0)(rows).to_pylist()
    assert len(pairs) == 58 and all(((p["a"] - 10) % 3 == 0) == ((p["b"] - 10) % 3 == 0) for p in pairs)
    joined = ngrams._Union(70)
    assert all(joined.join(p["a"], p["b"]) for p in pairs)  # no circles


@pytest.mark.parametrize("percent", [33, 50, 80, 85, 99, 100])
def test_linked_sets_stand_in_bands_that_adjoin(percent):
    jaccard, sizes = ngrams.Jaccard(percent), np.arange(300)
    band, up = jaccard.bands(sizes)
    for a in range(1, 300):
        for b in range(a, min(jaccard.sizes(a)[1], 299) + 1):
            assert band[b] - band[a] in (0, 1)
            # The last place of the first shared element, with all others of the smaller set shared.
            assert band[b] == band[a] or jaccard.needed(a, b) > a or a - jaccard.needed(a, b) < up[a]


def test_sets_of_unlike_sizes_do_not_meet(spark, monkeypatch):
    """All begin with the same words; only the two of like size are held against each other."""
    pairs, stored = [], ngrams.stored

    def counted(rows, purpose):
        table = stored(rows, purpose)
        pairs.extend(table.collect() if purpose == "tried" else [])
        return table

    monkeypatch.setattr(ngrams, "stored", counted)
    texts = [" ".join(f"w{j}" for j in range(20 * 2**i)) for i in range(6)] + [" ".join(f"w{j}" for j in range(81))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r.component_id for r in ngrams.near_duplicates(docs, 4, 85).collect()}
    assert found == {i: i for i in range(6)} | {6: 2}
    assert len(pairs) == 1


def test_only_wanted_texts_are_moved(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc"), F.xxhash64("id").alias("mark"), F.col("id").cast("string").alias("text"))
    found = {r.doc for r in ngrams._wanted(docs, docs.where("doc in (7, 8, 1500)")).collect()}
    assert found >= {7, 8, 1500} and len(found) < 10
    assert ngrams._wanted(docs, docs.where("doc < 0")).count() == 0


def test_bpe(spark):
    found = bpe.encode_decode(documents(spark), WORDS).collect()
    theirs = Tokenizer.from_file(WORDS)
    want = Counter()
    for doc, text, *_ in rows():
        ids = theirs.encode(some(text), add_special_tokens=False).ids
        want[doc, " ".join(map(str, ids)), len(ids), theirs.decode(ids, skip_special_tokens=False)] += 1
    assert Counter(map(tuple, found)) == want
    assert bpe.encode_decode(empty(spark), WORDS).count() == 0


def vectors():
    rng = np.random.default_rng(6)
    out = [(i, [float(x) for x in rng.normal(0, 0.2 + (i % 7), 8)]) for i in range(300)]
    out += [(300 + i, [0.5] * 8) for i in range(40)]  # one very common vector
    out += [(400, None), (401, []), (402, [None] * 8), (403, [float("nan")] + [0.0] * 7), (404, [float("inf")] * 8)]
    out += [(405, [0.0] * 8), (410, [1.0, 2.0]), (411, [2.0, 1.0]), (420, [1e12] * 8), (430, [-1e12] * 8), (None, [1.0] * 8)]
    return out + [(310, [0.25] * 8)]  # a vec_id that stands twice


@pytest.mark.parametrize("k", [1, 5])
def test_top_k(spark, monkeypatch, k):
    monkeypatch.setattr(topk, "BUCKET_ROWS", 16)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 4)
    monkeypatch.setattr(topk, "CELL", 3)
    frame = spark.createDataFrame([(i, v, 7, "x") for i, v in vectors()], "vec_id bigint, embedding array<double>, row int, norm string")
    found = [tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 10 == 0, k).collect()]
    usable = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in vectors() if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = Counter()
    for a, (query, q) in enumerate(usable):
        if query % 10 == 0:
            others = [(-sum(x * y for x, y in zip(q, v, strict=True)), i) for b, (i, v) in enumerate(usable) if a != b and len(v) == len(q)]
            for rank, (score, i) in enumerate(sorted(others)[:k], 1):
                want[query, rank, i, min(max(-score, -(2**63 - 1)), 2**63 - 1)] += 1
    assert Counter(found) == want
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 10 == 0, k).count() == 0


def test_packing(spark):
    found = packing.pack(documents(spark), BYTES, length=64).collect()
    encoder = Tokenizer.from_file(BYTES)
    ids = [(d, [*encoder.encode(some(t), add_special_tokens=False).ids, 0]) for d, t, *_ in rows()]
    filled: dict[int, list] = {}
    for r in found:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    total = sum(len(i) for _, i in ids)
    assert sum(r.length for r in found) == total
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 64 or at & (at - 1) == 0
    assert sum(sum(n for _, n in p) != 64 for p in filled.values()) <= 6
    # The pieces of a doc_id, with its rows' ids cut alike.
    for doc, row_ids in ids:
        if sum(d == doc for d, _ in ids) > 1:
            continue
        pieces = sorted((r for r in found if r.doc_id == doc), key=lambda r: r.start)
        at = 0
        for r in pieces:
            assert r.start == at and r.doc_tokens == len(row_ids)
            part = np.array(row_ids[at : at + r.length], "<u4")
            assert r.ids_crc32 == zlib.crc32(part.tobytes())
            at += r.length
        assert at == len(row_ids)
    assert packing.pack(empty(spark), BYTES).count() == 0


def test_alike_documents_are_neighbours(spark):
    base = documents(spark).where("doc_id between 50 and 61 or doc_id < 30")
    found = packing.pack(base, BYTES, length=128).select("doc_id", (F.col("sequence_id") * 128 + F.col("offset")).alias("at")).collect()
    first = {}
    for r in found:
        first[r.doc_id] = min(first.get(r.doc_id, 1 << 60), r.at)
    order = sorted(first, key=first.get)
    places = [order.index(d) for d in range(50, 62)]
    assert max(places) - min(places) < 25


@pytest.mark.parametrize("least,chars,batches", [(5, 40, 2), (2, 3, 3), (5, 40, 1)])
def test_lines(spark, least, chars, batches):
    found = lines.drop_repeated_lines(documents(spark), least, chars, batches, carry=("kept",)).collect()
    plain = without_lines([r[:2] for r in rows()], least, chars)
    want = Counter((r[0], *p) for r, p in zip(rows(), plain, strict=True))
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, bytes(r.kept).decode()) for r in found) == want
    assert all(r.rest.kept == "k" for r in found)
    assert lines.drop_repeated_lines(empty(spark), least, chars, batches).count() == 0


def test_line_index_is_reversible(spark, tmp_path):
    """Documents in, out and in again leave what a new index of those present holds."""
    frame = documents(spark).where("doc_id is not null")
    index = lines.LineIndex(spark, str(tmp_path / "a"), 3)
    posted = lambda condition: lines.postings_of(frame.where(condition), 3)
    index.insert(posted("doc_id < 40"))
    index.insert(posted("doc_id >= 40"))
    index.delete(posted("doc_id % 3 = 0"))
    index.insert(posted("doc_id % 6 = 0"))
    index.delete(posted("doc_id in (41, 74)"))
    fresh = lines.LineIndex(spark, str(tmp_path / "b"), 3)
    fresh.insert(posted("(doc_id % 3 <> 0 or doc_id % 6 = 0) and doc_id not in (41, 74)"))
    now = lambda i: sorted((bytes(r.digest), r.n, r.top) for r in i.counts().where("n > 0").collect())
    assert now(index) == now(fresh)
    held = lambda i: sorted((bytes(r.digest), r.doc_id) for r in i.postings().collect())
    assert held(index) == held(fresh)
    size = lambda i: sum(len(lines.CuckooFilter(blob=bytes(r.blob))) for r in _filters(i))
    assert size(index) == size(fresh) == len(now(fresh))


def _filters(index):
    rows_ = index._read("filters", "shard int, blob binary").collect()
    latest = {}
    for r in sorted(rows_, key=lambda r: r.version):
        latest[r.shard] = r
    return latest.values()


def test_rows_without_an_id_cost_no_more_than_others(spark):
    """Near copies whose rows share an id, or have none, are each compared by their own text."""
    import time

    rng = np.random.default_rng(2)
    words = [f"w{x}" for x in rng.integers(0, 5000, 150)]
    texts = []
    for i in range(600):
        copy = list(words)
        copy[i % 150] = f"x{i}"
        texts.append(" ".join(copy))
    took = {}
    for kind, ids in (("distinct", range(600)), ("null", [None] * 600), ("repeated", [7] * 600)):
        frame = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id bigint, text string").repartition(4)
        start = time.perf_counter()
        found = ngrams.near_duplicates(frame, 5, 80).collect()
        took[kind] = time.perf_counter() - start
        assert len(found) == 600 and {r.component_id for r in found} == {{"distinct": 0, "null": None, "repeated": 7}[kind]}
    assert max(took["null"], took["repeated"]) < 1.5 * took["distinct"] + 5


def test_long_texts_meet_in_lots_of_bounded_size(spark, monkeypatch):
    """Lots are cut by n-grams as well as by members; a text of five million bytes among them."""
    monkeypatch.setattr(ngrams, "GROUP_GRAMS", 3000)
    rng = np.random.default_rng(6)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 1000)]
    texts = [" ".join(base[:500] + [f"x{i}"] + base[501:]) for i in range(30)] + [" ".join(f"v{x}" for x in range(700_000))]
    frame = spark.createDataFrame(list(enumerate([*texts, texts[-1] + " end"])), "doc_id bigint, text string")
    found = {r.doc_id: r.component_id for r in ngrams.near_duplicates(frame, 5, 80).collect()}
    assert found == {**dict.fromkeys(range(30), 0), 30: 30, 31: 30}
