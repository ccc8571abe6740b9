"""Toxicity by weak supervision.

*Units* are words and the first 4 to 7 bytes of longer words. Those that stand in toxic far
more often than in clean documents of a bounded, labelled sample make up the lexicons. One
pass over all texts notes which units each document holds and how *voters* judge it: lexicon
voters (a fixed list of insults; two halves of each kind of unit; several units at once) and
pattern voters (shouting, piled-up punctuation, symbols in place of letters).

A generative label model explains the votes of all documents: each voter is right with an
accuracy of its own for either class, and may copy one other voter, as the edges of a
tree (the strongest conditional mutual information) say. It is fitted by expectation
maximisation on the counts of vote patterns, anchored where a label is known. What it
believes of each document is the posterior label, on which a linear classifier over units
and votes is trained; the classifier gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from annalist.llm.quality import held_out
from annalist.llm.tables import stored, text_bytes
from annalist.llm.tokens import byte_table, tokens_of
from annalist.llm.words import mix, portions

#: At most so many labelled documents of each class are mined for units and so many of each
#: posterior class train the classifier; clean ones are more, as they are more varied.
SAMPLE_TOXIC, SAMPLE_CLEAN = 2000, 4000
#: A unit must tell the classes apart by this much (a log-likelihood ratio; 20 is reached by
#: chance about once in 100,000 units) and at least this many times as often in toxic ones.
LEAST_G2, LEAST_RATIO, MOST_UNITS = 20.0, 4.0, 4096
THRESHOLD = 0.5

# Common insults, the lexicon that needs no labels.
INSULTS = (
    "idiot moron stupid dumb loser scum trash garbage pathetic worthless disgusting fool jerk imbecile "
    "dumm trottel abschaum widerlich imbécile crétin abruti débile estúpido imbécil asqueroso basura"
).split()

PREFIXES = (4, 5, 6, 7)
KINDS = 1 + len(PREFIXES)
VOTERS = ("insults", *(f"units-{k}-{half}" for k in range(KINDS) for half in "ab"), "several", "shouting", "piled", "symbols")
SHOUTING, PILED, SYMBOLS = 0.3, 3, 0.1

_LETTERS = byte_table([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_SEEDS = mix(np.arange(1, 5, dtype=np.uint64))
_SHINGLE = 5
PART_BYTES = 1 << 20


def units_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, kind and text of every unit. Units of one kind follow each other."""
    tokens = tokens_of(texts, _LETTERS)
    spelled, text = tokens.polynomials(), tokens.text_of()
    parts = [(spelled.at(tokens.start, tokens.length), text)]
    for size in PREFIXES:
        longer = tokens.length > size
        parts.append((spelled.at(tokens.start[longer], size), text[longer]))
    kinds = [np.full(len(t), k, np.int8) for k, (_, t) in enumerate(parts)]
    # A prefix and a word spelled alike are units of their own.
    hashes = [mix(h + np.uint64(k)) for k, (h, _) in enumerate(parts)]
    return np.concatenate(hashes), np.concatenate(kinds), np.concatenate([t for _, t in parts])


_INSULTS = np.sort(np.array([units_of([w.encode()])[0][0] for w in INSULTS], np.uint64))


def _sketch(text: bytes) -> np.ndarray:
    """Four smallest hashes of the text's runs of five words: near copies share some."""
    tokens = tokens_of([text], _LETTERS)
    hashes = tokens.polynomials().at(tokens.start, tokens.length)
    n = max(1, len(hashes) - _SHINGLE + 1)
    runs = sum((hashes[i : i + n] * np.uint64(2 * i + 1) for i in range(min(_SHINGLE, len(hashes)))), np.zeros(n, np.uint64))
    return np.array([mix(runs ^ seed).min() for seed in _SEEDS], np.uint64)


# Units.


@dataclass
class Units:
    """Hashes of the lexicons' units in order, and their kinds."""

    hashes: np.ndarray
    kinds: np.ndarray

    @property
    def voters(self) -> np.ndarray:
        return 1 + 2 * self.kinds.astype(np.int64) + (self.hashes >> np.uint64(63)).astype(np.int64)


def mined(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, sketches: list[np.ndarray]) -> Units:
    """The units that mark the toxic documents. ``bags``: distinct units and their kinds per
    document. Of near copies only the first counts, or their words would look telling."""
    seen: set[tuple[int, int]] = set()
    chosen = []
    for i, sketch in enumerate(sketches):
        marks = set(enumerate(sketch.tolist()))
        if not marks & seen:
            chosen.append(i)
        seen |= marks
    toxic, clean = (max(1, int((labels[chosen] == c).sum())) for c in (1, 0))
    hashes, kinds = (np.concatenate([bags[i][j] for i in chosen]) for j in (0, 1))
    of = np.repeat(labels[chosen], [len(bags[i][0]) for i in chosen])
    hashes, first, index = np.unique(hashes, return_index=True, return_inverse=True)
    a, b = (np.bincount(index, of == c, len(hashes)) for c in (1, 0))
    share = (a + b) / (toxic + clean)
    g2 = 2 * sum(x * np.log(np.maximum(x, 1e-9) / np.maximum(share * n, 1e-9)) for x, n in ((a, toxic), (b, clean)))
    g2 += 2 * sum((n - x) * np.log(np.maximum(n - x, 1e-9) / np.maximum((1 - share) * n, 1e-9)) for x, n in ((a, toxic), (b, clean)))
    ratio = (a + 0.5) / (toxic + 1) / ((b + 0.5) / (clean + 1))
    good = np.flatnonzero((g2 >= LEAST_G2) & (ratio >= LEAST_RATIO))
    good = np.sort(good[np.argsort(-g2[good], kind="stable")[:MOST_UNITS]])
    return Units(hashes[good], kinds[first][good])


def _marks(labels: DataFrame) -> DataFrame:
    """doc_id, label of the documents that may be learned from."""
    known = F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    return labels.where(known).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label"))


def _sampled(rows: DataFrame, label: str) -> DataFrame:
    """A bounded number of rows of each class, by a hash of their id."""
    some = lambda c, n: rows.where(F.col(label) == c).orderBy(F.xxhash64("doc_id"), F.col("doc_id")).limit(n)
    return some(1, SAMPLE_TOXIC).unionByName(some(0, SAMPLE_CLEAN))


def learn_units(docs: DataFrame, marks: DataFrame) -> Units | None:
    """Mine a bounded sample of labelled documents; None unless it holds both classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, kinds, sketches = [], [], []
            for text in batch["text"].to_pylist():
                found, first = np.unique((u := units_of([text]))[0], return_index=True)
                hashes.append(found.tobytes())
                kinds.append(u[1][first].tobytes())
                sketches.append(_sketch(text).tobytes())
            made = [pa.array(x, pa.binary()) for x in (hashes, kinds, sketches)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], *made], ["doc_id", "label", "hashes", "kinds", "sketch"])

    def fit(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["doc_id"], r["hashes"]))
        labels = np.array([r["label"] for r in rows])
        if len(set(labels.tolist())) < 2:
            return pa.table([pa.array([], pa.binary())] * 2, ["hashes", "kinds"])
        bags = [(np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["kinds"], np.int8)) for r in rows]
        units = mined(bags, labels, [np.frombuffer(r["sketch"], np.uint64) for r in rows])
        return pa.table([pa.array([x.tobytes()], pa.binary()) for x in (units.hashes, units.kinds)], ["hashes", "kinds"])

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text"))
    found = slim.join(F.broadcast(_sampled(marks, "label")), "doc_id").select("doc_id", "label", "text")
    bags = found.mapInArrow(run, "doc_id bigint, label int, hashes binary, kinds binary, sketch binary")
    # Rows that repeat a doc_id must not exceed the bound.
    bags = bags.orderBy("doc_id", "hashes").limit(SAMPLE_TOXIC + SAMPLE_CLEAN)
    rows = bags.groupBy(F.lit(0).alias("all")).applyInArrow(fit, "hashes binary, kinds binary").collect()
    return Units(np.frombuffer(rows[0]["hashes"], np.uint64), np.frombuffer(rows[0]["kinds"], np.int8)) if rows else None


# Votes.


def _patterns(text: bytes) -> tuple[bool, bool, bool]:
    """Shouting, piled-up punctuation, symbols in place of letters."""
    data = np.frombuffer(text, np.uint8)
    letters = int(_LETTERS[data].sum())
    capitals = int(((data >= 0x41) & (data <= 0x5A)).sum())
    loud = (data == 0x21) | (data == 0x3F)
    piled = int((loud[1:] & loud[:-1]).sum())
    odd = int(np.isin(data, np.frombuffer(b"@#$%&*", np.uint8)).sum())
    return letters >= 20 and capitals > SHOUTING * letters, piled >= PILED, len(data) > 0 and odd > SYMBOLS * len(data)


class Voting:
    """Which units texts hold, and what the voters say of them (bit j: voter j says toxic)."""

    def __init__(self, units: Units):
        self.units, self.voters = units, units.voters
        self.coarse = np.zeros(1 << 20, bool)  # most units are ruled out by their first bits
        for hashes in (units.hashes, _INSULTS):
            self.coarse[hashes >> np.uint64(44)] = True

    def vote(self, texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
        hashes, _, text = units_of(texts)
        maybe = np.flatnonzero(self.coarse[hashes >> np.uint64(44)])
        hashes, text = hashes[maybe], text[maybe]
        bits = np.zeros((len(texts), len(VOTERS)), bool)
        bits[text[np.isin(hashes, _INSULTS)], 0] = True
        held = [np.zeros(0, np.int64)] * len(texts)
        if len(self.units.hashes):
            at = np.minimum(np.searchsorted(self.units.hashes, hashes), len(self.units.hashes) - 1)
            hit = self.units.hashes[at] == hashes
            pairs = np.unique(text[hit] * MOST_UNITS + at[hit])
            of, unit = np.divmod(pairs, MOST_UNITS)
            bits[of, self.voters[unit]] = True
            held = np.split(unit, np.searchsorted(of, np.arange(1, len(texts))))
        for i, one in enumerate(texts):
            bits[i, 2 * KINDS + 1] = len(held[i]) > 1
            bits[i, 2 * KINDS + 2 :] = _patterns(one)
        return held, bits @ (1 << np.arange(len(VOTERS)))


def votes(docs: DataFrame, units: Units, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, rest, units (packed places), votes of every document, in one pass over the
    texts; a written table, so that later steps do not read the texts again."""
    rest = F.struct(*carry) if carry else F.lit(None).cast("int")
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), rest.alias("rest"), text_bytes().alias("text"))
    out = slim.select("doc_id", "rest", F.lit(b"").alias("units"), F.lit(0).alias("votes"))
    schema = to_arrow_schema(out.schema)
    shared = docs.sparkSession.sparkContext.broadcast(units)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voting = Voting(shared.value)
        for batch in batches:
            texts, held, said = batch["text"].to_pylist(), [], []
            for a, b in portions([len(t) for t in texts], PART_BYTES):
                some, bits = voting.vote(texts[a:b])
                held += [h.astype(np.int16).tobytes() for h in some]
                said += bits.tolist()
            columns = {"doc_id": batch["doc_id"], "rest": batch["rest"], "units": pa.array(held, pa.binary()), "votes": pa.array(said, pa.int32())}
            yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)

    return stored(slim.mapInArrow(run, out.schema), "votes")


# The label model.


class LabelModel:
    """P(class) and, for each voter, P(vote | class, vote of the voter it copies)."""

    ROUNDS, SMOOTH = 25, 1.0

    def __init__(self, patterns: np.ndarray, counts: np.ndarray):
        """``counts``: per pattern how many documents have no label, label 0, label 1."""
        self.n = len(VOTERS)
        self.parent = np.full(self.n, -1)
        bits = self.bits(patterns)
        known = counts[:, 1:] + 0.0
        self._maximise(bits, known)
        for tree in (False, True):
            if tree:
                belief = self.posterior(patterns)
                self.parent = self._tree(bits, known + counts[:, :1] * np.stack([1 - belief, belief], 1))
            for _ in range(self.ROUNDS):
                belief = self.posterior(patterns)
                self._maximise(bits, known + counts[:, :1] * np.stack([1 - belief, belief], 1))

    def bits(self, patterns: np.ndarray) -> np.ndarray:
        return (patterns[:, None] >> np.arange(self.n)) & 1

    def _maximise(self, bits: np.ndarray, weight: np.ndarray) -> None:
        total = weight.sum(0) + self.SMOOTH
        self.prior = total / total.sum()
        self.said = np.empty((self.n, 2, 2))  # voter, vote of its parent, class: P(says toxic)
        for j, p in enumerate(self.parent):
            for v in (0, 1):
                rows = bits[:, p] == v if p >= 0 else np.ones(len(bits), bool)
                hits = (weight * (bits[:, j] * rows)[:, None]).sum(0)
                self.said[j, v] = (hits + self.SMOOTH * 0.5) / ((weight * rows[:, None]).sum(0) + self.SMOOTH)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(toxic | votes)."""
        bits = self.bits(patterns)
        log = np.tile(np.log(self.prior), (len(patterns), 1))
        for j, p in enumerate(self.parent):
            says = self.said[j][bits[:, p] if p >= 0 else np.zeros(len(bits), int)]
            log += np.log(np.where(bits[:, [j]] == 1, says, 1 - says))
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -700, 700)))

    def _information(self, bits: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Conditional mutual information of every two voters, given the class."""
        out = np.zeros((self.n, self.n))
        for c in (0, 1):
            w = weight[:, c] / max(weight.sum(), 1e-9)
            total = max(w.sum(), 1e-12)
            for x in (0, 1):
                for y in (0, 1):
                    left, right = (bits == x), (bits == y)
                    joint = (left * w[:, None]).T @ right
                    alone = np.outer((left * w[:, None]).sum(0), (right * w[:, None]).sum(0)) / total
                    out += joint * np.log(np.maximum(joint, 1e-12) / np.maximum(alone, 1e-12))
        return out

    def _tree(self, bits: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The heaviest spanning tree, grown from voter 0; an edge without weight is left out."""
        strength, parent, inside = self._information(bits, weight), np.full(self.n, -1), [0]
        while len(inside) < self.n:
            others = [j for j in range(self.n) if j not in inside]
            block = strength[np.ix_(inside, others)]
            i, j = np.unravel_index(block.argmax(), block.shape)
            if block[i, j] > 1e-6:
                parent[others[j]] = inside[i]
            inside.append(others[j])
        return parent

    def accuracies(self) -> np.ndarray:
        """Per voter P(toxic | class 1) and P(clean | class 0), over what its parent says."""
        out = np.empty((self.n, 2))
        for j in range(self.n):
            says = self._alone(j)
            out[j] = says[1], 1 - says[0]
        return out

    def _alone(self, j: int) -> np.ndarray:
        p = self.parent[j]
        if p < 0:
            return self.said[j, 0]
        up = self._alone(p)
        return self.said[j, 0] * (1 - up) + self.said[j, 1] * up


# The classifier.


@dataclass
class Classifier:
    """A weight per unit and per voter, and a bias."""

    weights: np.ndarray
    bias: float

    def scores(self, held: list[bytes], said: np.ndarray) -> np.ndarray:
        n = len(self.weights) - len(VOTERS)
        bits = (said[:, None] >> np.arange(len(VOTERS))) & 1
        odds = self.bias + bits @ self.weights[n:]
        odds += [self.weights[np.frombuffer(h, np.int16)].sum() for h in held]
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def train(held: list[bytes], said: np.ndarray, target: np.ndarray, share: np.ndarray, n_units: int) -> Classifier:
    """Logistic regression on posterior labels by gradient descent with a step per weight.

    ``share``: how much each document counts. Weights are held back by a Gaussian prior.
    """
    bits = (said[:, None] >> np.arange(len(VOTERS))) & 1
    lists = [np.concatenate([np.frombuffer(h, np.int16), n_units + np.flatnonzero(b)]).astype(np.int64) for h, b in zip(held, bits, strict=True)]
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    column = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    size = n_units + len(VOTERS)
    weights, bias, steps = np.zeros(size), 0.0, np.full(size + 1, 1e-6)
    for _ in range(600):
        odds = bias + np.bincount(row, weights[column], len(lists))
        error = share * (1 / (1 + np.exp(-np.clip(odds, -700, 700))) - target)
        slope = np.append(np.bincount(column, error[row], size) + 0.1 * weights, error.sum())
        steps += slope**2
        move = 0.5 * slope / np.sqrt(steps)
        weights, bias = weights - move[:-1], bias - move[-1]
    return Classifier(weights, float(bias))


def learn_classifier(voted: DataFrame, marks: DataFrame, units: Units) -> tuple[LabelModel, Classifier]:
    """Fit the label model on the votes of all documents, and the classifier on what it believes."""
    spark = voted.sparkSession
    judged = voted.select("doc_id", "units", "votes").join(marks, "doc_id", "left")
    state = F.coalesce(F.col("label") + 1, F.lit(0))
    # At most 3 * 2^15 rows, however many documents there are.
    rows = judged.groupBy("votes", state.alias("state")).agg(F.count("*").alias("n")).collect()
    patterns = np.array(sorted({r["votes"] for r in rows}), np.int64)
    counts = np.zeros((len(patterns), 3))
    for r in rows:
        counts[np.searchsorted(patterns, r["votes"]), r["state"]] = r["n"]
    model = LabelModel(patterns, counts)
    belief = spark.createDataFrame(list(zip(patterns.tolist(), model.posterior(patterns).tolist(), strict=True)), "votes int, belief double")
    # A label that is known settles nearly all doubt.
    target = F.when(F.col("label") == 1, 0.98 + 0.02 * F.col("belief")).when(F.col("label") == 0, 0.02 * F.col("belief")).otherwise(F.col("belief"))
    usable = judged.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).join(F.broadcast(belief), "votes")
    usable = usable.withColumn("target", target).withColumn("side", (F.col("target") >= 0.5).cast("int"))
    sizes = {r["side"]: r["n"] for r in usable.groupBy("side").agg(F.count("*").alias("n")).collect()}
    sample = _sampled(usable.select("doc_id", "units", "votes", "target", "side"), "side")
    n_units = len(units.hashes)

    def fit(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["doc_id"], r["units"]))
        side = np.array([r["side"] for r in rows])
        taken = np.bincount(side, minlength=2)
        share = np.array([sizes.get(c, 0) / max(1, taken[c]) for c in (0, 1)])[side]
        share = share / share.mean()
        found = train([r["units"] for r in rows], np.array([r["votes"] for r in rows]), np.array([r["target"] for r in rows]), share, n_units)
        return pa.table([pa.array([found.weights.tobytes()], pa.binary()), pa.array([found.bias])], ["weights", "bias"])

    fitted = sample.groupBy(F.lit(0).alias("all")).applyInArrow(fit, "weights binary, bias double").first()
    return model, Classifier(np.frombuffer(fitted["weights"]), fitted["bias"])


def classify(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, rest (a struct of the columns in ``carry``), held_out, score and predicted (1
    from ``THRESHOLD`` on) of every row of ``docs`` (doc_id, text); labels: doc_id, toxic.

    Only texts enter a score, whole ones. A null text is an empty one; texts without units
    and votes share one score. Of several labels of a document the larger counts; labels of
    unknown documents and null labels count for nothing. Unless documents of both classes
    are known, there is nothing to learn from and every score is 0. Repeated rows are scored
    alike; a null doc_id is scored, but not learned from and never held out. An empty table
    gives an empty table.
    """
    marks = _marks(labels)
    units = learn_units(docs, marks)
    model = None
    voted = votes(docs, units or Units(np.zeros(0, np.uint64), np.zeros(0, np.int8)), carry)
    if units is not None:
        model = learn_classifier(voted, marks, units)[1]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = voted.select("doc_id", "rest", F.lit(0.0).alias("score"))
    schema = to_arrow_schema(out.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = batch["votes"].to_numpy()
            found = shared.value.scores(batch["units"].to_pylist(), said) if shared.value else np.zeros(len(said))
            columns = {"doc_id": batch["doc_id"], "rest": batch["rest"], "score": pa.array(found)}
            yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)

    return voted.mapInArrow(run, out.schema).select(
        "doc_id",
        "rest",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
