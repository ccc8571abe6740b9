"""Ranked search, phrase mining and toxicity against plain versions, on every awkward case."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from fixtures import documents, empty, lower, rows
from pyspark.sql import functions as F

from annalist.llm import phrases, ranking, tokens, toxicity

# Ranked search.


def terms(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", lower(text or "").encode())


def plain_search(docs, items, k):
    """(item, rank, doc, score) of every item, all documents scored."""
    bags = [(d, Counter(terms(t))) for d, t in docs]
    n = sum(bool(b) for _, b in bags)
    total = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * c + 1))) for t, c in df.items()}
    out = []
    for item, text in items:
        scored = []
        for doc, bag in bags:
            m = 10 + (90 * sum(bag.values()) * n) // total if total else 10
            score = sum(weight[t] * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in set(terms(text)) if t in bag)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return Counter(out)


ITEMS = [
    (1, "w1 w2 w3 W4 w5 w5 w290"), (2, None), (3, ""), (4, "absent words only xyzzy"), (5, "the very SAME text, in several documents"),
    (6, "long long long"), (7, "日本 don't"), (8, " ".join(f"w{i}" for i in range(300))), (9, "one two words"), (9, "one two words"),
    (None, "license stands line w7"),
]


@pytest.mark.parametrize("k", [1, 3, 10])
def test_search(spark, k):
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id int, text string, rank int")
    got = ranking.rank_documents(documents(spark), items, k).collect()
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == plain_search([r[:2] for r in rows()], ITEMS, k)


def test_search_in_many_shards_and_blocks(spark, monkeypatch):
    """Blocks of one item each; a shard per task, of which some hold nothing."""
    monkeypatch.setattr(ranking, "BLOCK_BYTES", 1)
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    index = ranking.build_index(documents(spark).repartition(60))
    got = ranking.search(index, items, 5).collect()
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == plain_search([r[:2] for r in rows()], ITEMS, 5)


def test_search_without_anything(spark):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    assert ranking.rank_documents(empty(spark), items).count() == 0
    assert ranking.rank_documents(documents(spark).where("text is null"), items).count() == 0
    assert ranking.rank_documents(documents(spark), items.limit(0)).count() == 0


def test_pair_bounds_are_tighter_and_safe():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, int(rng.integers(1, 80))) if x < 400).encode() for _ in range(500)]
    row = {n: c[0].as_py() for n, c in zip(*(lambda b: (b.schema.names, b.columns))(ranking._shard(0, list(range(500)), texts)), strict=True)}
    block = ranking._Items([{"item_id": 1, "text": " ".join(f"w{i}" for i in range(1, 60))}])
    n, total = row["n_docs"], row["n_terms"]
    df = np.zeros(len(block.vocabulary), np.int64)
    held, begin, end = ranking._held(row, block.vocabulary)
    df[held] = end - begin
    lists = ranking.Lists(row, block.vocabulary, ranking.weights(df, n), n, total)
    order = lists.order(block.terms[0])
    bounds, singles = lists.bounds(order), np.cumsum([0] + [lists.top[t] for t in order[::-1]])[::-1]
    assert all(b <= s for b, s in zip(bounds, singles, strict=True)) and bounds[0] < singles[0]
    for i in range(len(order)):
        score = np.zeros(500, np.int64)
        for t in order[i:]:
            score[lists.lists[t][0]] += lists.lists[t][1]
        assert score.max() <= bounds[i]


# Phrases.

LANGS = [None, "en", "de", "", "und"]


def language(doc_id):
    return LANGS[(doc_id or 0) % 5]


def plain_collocations(docs, least, top):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", lower(text or "").encode()):
            words = re.findall(rb"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, 6):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, found in counts.items():
        good = {p: f for p, f in found.items() if f >= least and len(p) > 1}
        covered = set()
        for p, f in good.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p) and 100 * f >= 100 * found[p[i:j]]:
                        covered.add(p[i:j])
        ranked = []
        for p, a in good.items():
            if p not in covered:
                cuts = [(1000 * a * totals[lang] // (found[p[:c]] * found[p[c:]]), c) for c in range(1, len(p))]
                score, c = min(cuts)
                ranked.append((-score, -a, b" ".join(p), found[p[:c]], found[p[c:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return Counter(out)


def test_collocations(spark):
    docs = documents(spark).withColumn("lang", F.element_at(F.array(*[F.lit(x) for x in LANGS]), (F.coalesce("doc_id", F.lit(0)) % 5 + 1).cast("int")))
    docs = docs.withColumns({"phrase": F.lit("x"), "a": F.lit(1), "part": F.lit(2), "size": F.lit(3), "n": F.lit(4)})
    for least, top in ((3, 2000), (2, 7)):
        got = phrases.collocations(docs, least, top).collect()
        want = plain_collocations([(language(d), t) for d, t, *_ in rows()], least, top)
        assert Counter(map(tuple, got)) == want and len(want) > 20
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(docs.withColumn("text", F.lit(None).cast("string"))).count() == 0


def test_exact_scores_beyond_64_bits(spark):
    """1000 * a * n here is far beyond 2^63."""
    counts = [("en", 1, "x", 3 * 10**9), ("en", 1, "y", 2 * 10**9), ("en", 2, "x y", 10**9 + 7)]
    found = spark.createDataFrame(counts, "lang string, size int, phrase string, a bigint")
    total = spark.createDataFrame([("en", 10**12 + 3)], "lang string, n bigint")
    patched, phrases.frequent_phrases = phrases.frequent_phrases, lambda docs, least: (found, total)
    try:
        row = phrases.collocations(found).first()
    finally:
        phrases.frequent_phrases = patched
    assert row.score == 1000 * (10**9 + 7) * (10**12 + 3) // (6 * 10**18)


def test_colliding_fingerprints_change_nothing(monkeypatch):
    """With fingerprints of 5 bits nearly all collide; counts are still those of the texts."""
    whole = tokens.Polynomials.at
    monkeypatch.setattr(tokens.Polynomials, "at", lambda self, *a: whole(self, *a) & np.uint64(31))
    texts, least, n_buckets = [(t or "").encode() for _, t, *_ in rows()], 4, 3
    parts = [{n: v[0].as_py() for n, v in zip(b.schema.names, b.columns, strict=True)} for b in (phrases._packed_part(i, "en", texts[i::3]) for i in range(3))]
    bits = [[], [], []]
    for level in (1, 2, 3):
        sent = []
        for i, p in enumerate(parts):
            answers = phrases._answers(pa.Table.from_pylist(bits[i], phrases._arrow(phrases._BITS)))
            sent += [
                {"bucket": b, "part": i, "prints": f, "checks": k, "counts": c}
                for b, f, k, c in phrases._Part(p, n_buckets).messages(level, answers)
            ]
        for bucket in {s["bucket"] for s in sent}:
            table = pa.Table.from_pylist([s for s in sent if s["bucket"] == bucket], phrases._arrow(phrases._SENT))
            for row in phrases._counter(level, least)(table).to_pylist():
                bits[row["part"]].append(row)
    got = Counter()
    for i, p in enumerate(parts):
        answers = phrases._answers(pa.Table.from_pylist(bits[i], phrases._arrow(phrases._BITS)))
        for _, _, phrase, n in phrases._Part(p, n_buckets).phrases(answers):
            got[phrase] += n
    want = Counter()
    for text in texts:
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", lower(text.decode()).encode()):
            words = re.findall(rb"[^\x20\x09]+", piece)
            for size in range(1, 6):
                want.update(b" ".join(words[i : i + size]).decode() for i in range(len(words) - size + 1))
    assert {p: n for p, n in got.items() if n >= least} == {p: n for p, n in want.items() if n >= least}


# Toxicity.


def test_toxicity_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.classify(docs, labels).join(labels, "doc_id").where("held_out").select("toxic", "predicted").collect()
    caught = sum(r.predicted for r in found if r.toxic) / sum(r.toxic for r in found)
    wrong = sum(r.predicted for r in found if not r.toxic) / sum(1 - r.toxic for r in found)
    assert len(found) > 700 and caught >= 0.88 and wrong <= 0.01


def test_toxicity_of_awkward_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(60)] + [(3, None, True), (None, 1, True)], "doc_id bigint, toxic int, other boolean")
    found = toxicity.classify(documents(spark), labels, carry=("row", "rest", "score")).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.rest.row == "r" and r.rest.score == 0.5 for r in found)
    same = {r.score for r in found if r.doc_id == 95}
    assert len(same) == 1 and not any(r.held_out for r in found if r.doc_id is None)
    nothing = toxicity.classify(documents(spark), labels.where("toxic = 0")).collect()
    assert {r.score for r in nothing} == {0.0} and {r.predicted for r in nothing} == {0}
    assert toxicity.classify(empty(spark), labels).count() == 0


def test_label_model_finds_accuracies_and_copies():
    rng = np.random.default_rng(8)
    n, voters = 40_000, len(toxicity.VOTERS)
    truth = rng.random(n) < 0.2
    right = rng.random((n, voters)) < 0.9
    said = np.where(right, truth[:, None], ~truth[:, None])
    said[:, 3] = np.where(rng.random(n) < 0.95, said[:, 2], said[:, 3])  # voter 3 mostly copies voter 2
    patterns, index = np.unique(said @ (1 << np.arange(voters)), return_inverse=True)
    known = rng.random(n) < 0.05
    counts = np.zeros((len(patterns), 3))
    np.add.at(counts, (index, np.where(known, truth + 1, 0)), 1)
    model = toxicity.LabelModel(patterns, counts)
    assert np.abs(model.accuracies() - 0.9).max() < 0.03
    assert model.parent[3] == 2 or model.parent[2] == 3
    assert ((model.posterior(patterns)[index] > 0.5) == truth).mean() > 0.99


def test_near_copies_count_once():
    """Words of one document copied many times are no evidence."""
    words = [f"u{i}ll" for i in range(40)]
    texts = [" ".join(words) + f" extra{chr(97 + i)}" for i in range(20)] + [f"plain text number {chr(97 + i)} here" for i in range(20)]
    bags = [(np.unique(h), np.zeros(len(np.unique(h)), np.int8)) for h in (toxicity.units_of([t.encode()])[0] for t in texts)]
    labels = np.array([1] * 20 + [0] * 20)
    assert len(toxicity.mined(bags, labels, [toxicity._sketch(t.encode()) for t in texts]).hashes) == 0
