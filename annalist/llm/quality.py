"""A quality classifier of supervised subword embeddings.

Every word and every character n-gram of a text is hashed to a row of a table of learned
vectors; a text is the average of its rows, and a softmax over two classes reads it. The
vectors are trained by stochastic gradient descent in numpy on a bounded sample of
labelled documents. As the last layer is linear, scoring needs one number per row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from annalist.llm.tables import text_bytes
from annalist.llm.words import Words, portions, words_of

# Rows of the table: words, then n-grams of 2, 3 and 4 bytes.
WORD_BITS, GRAM_BITS = 16, 16
GRAMS = (2, 3, 4)
REPEATED = 0
WIDTH = 16
#: At most so many labelled documents of each class are learned from.
SAMPLE_PER_CLASS = 2000
#: Passes over the sample, whatever its size.
EPOCHS, RATE = 40, 4.0
LARGEST = np.float32(64)
THRESHOLD = 0.3

_PAD = b"    "
_BLANK = np.arange(256, dtype=np.uint32)
_BLANK[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0x20
PART_BYTES = 1 << 20


def _grams(texts: list[bytes]) -> Iterator[np.ndarray]:
    """For each n-gram length the row of the n-gram at each byte of the joined, padded texts."""
    data = np.frombuffer(_PAD.join([*texts, b""]) + _PAD, np.uint8)
    chars = _BLANK[data]
    n = len(chars) - len(_PAD)
    for size in GRAMS:
        key = np.zeros(n, np.uint32)
        for i in range(size):
            key |= chars[i : n + i] << np.uint32(8 * i)
        row = (key * np.uint32(2654435769) + np.uint32(size * 0x01000193)) * np.uint32(2246822519)
        yield (row >> np.uint32(32 - GRAM_BITS)).astype(np.int64) + (1 << WORD_BITS)


def _starts(texts: list[bytes]) -> np.ndarray:
    """Where each text begins in the joined, padded texts; one more entry at the end."""
    sizes = np.fromiter((len(t) + len(_PAD) for t in texts), np.int64, len(texts))
    return np.concatenate([[0], np.cumsum(sizes)])


def _word_rows(words: Words) -> np.ndarray:
    """The row of each word; a word that stands twice running has a row of its own then."""
    rows = (words.hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    again = np.zeros(len(rows), bool)
    again[1:] = words.hashes[1:] == words.hashes[:-1]
    again[words.first[:-1][words.counts > 0]] = False
    rows[again] = REPEATED
    return rows


def features(text: bytes) -> np.ndarray:
    """The rows of a text's words and n-grams."""
    return np.concatenate([_word_rows(words_of([text])), *(rows[: len(text) + 1] for rows in _grams([text]))])


@dataclass
class Model:
    """vectors: one per row; output: WIDTH x 2; bias: 2."""

    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def weights(self) -> np.ndarray:
        """What a row adds to the log-odds of class 1."""
        return self.vectors @ (self.output[:, 1] - self.output[:, 0])

    def odds(self) -> float:
        return float(self.bias[1] - self.bias[0])


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, shares: np.ndarray, seed: int = 1) -> Model:
    """Stochastic gradient descent over documents given as (rows, how often each).

    ``shares``: how much a document of each class counts, so that a sample balanced
    between the classes still learns how frequent they are.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, ((1 << WORD_BITS) + (1 << GRAM_BITS), WIDTH)).astype(np.float32)
    model = Model(vectors, np.zeros((WIDTH, 2), np.float32), np.zeros(2, np.float32))
    steps, total = 0, EPOCHS * max(1, len(bags))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            rows, often = bags[i]
            rate = RATE * (1 - steps / total) * shares[labels[i]]
            steps += 1
            part = often / often.sum()
            hidden = part @ model.vectors[rows]
            logits = hidden @ model.output + model.bias
            logits = np.exp(logits - logits.max())
            error = logits / logits.sum()
            error[labels[i]] -= 1
            back = model.output @ error
            # No number grows beyond a bound, however few and odd the documents are.
            model.output = np.clip(model.output - np.float32(rate) * np.outer(hidden, error), -LARGEST, LARGEST)
            model.bias = np.clip(model.bias - np.float32(0.1 * rate) * error, -LARGEST, LARGEST)
            model.vectors[rows] = np.clip(model.vectors[rows] - np.float32(rate) * np.outer(part, back), -LARGEST, LARGEST)
    return model


def scores(texts: list[bytes], weights: np.ndarray, odds: float) -> np.ndarray:
    """The probability of class 1 of each text."""
    starts = _starts(texts)
    sums = np.zeros(len(texts))
    edge = (starts[1:, None] - np.arange(1, len(_PAD))).ravel()  # n-grams there may reach the next text
    for rows in _grams(texts):
        values = weights[rows]
        values[edge] = 0
        sums += np.add.reduceat(values, starts[:-1], dtype=np.float64)
    words = words_of(texts)
    values = weights[_word_rows(words)]
    running = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    sums += running[words.first[1:]] - running[words.first[:-1]]
    n = words.counts + len(GRAMS) * (np.diff(starts) - len(_PAD) + 1)
    return 1 / (1 + np.exp(-np.clip(sums / n + odds, -700, 700)))


def held_out(doc_id: Column) -> Column:
    """One document in five is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model | None:
    """Train on at most ``per_class`` labelled documents of each class, chosen by a hash
    of their id, none of them held out. ``labels`` needs doc_id and quality (0 or 1).
    None if there is nothing to learn from."""
    marks = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.max("quality").cast("int").alias("label"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sizes = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = [marks.where(F.col("label") == c).orderBy(*order).limit(per_class) for c in (0, 1)]
    sample = chosen[0].unionByName(chosen[1])  # 2 * per_class ids at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [np.unique(features(t), return_counts=True) for t in batch["text"].to_pylist()]
            rows = [b[0].astype(np.int32).tobytes() for b in bags]
            often = [b[1].astype(np.float32).tobytes() for b in bags]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["label"], pa.array(rows, pa.binary()), pa.array(often, pa.binary())],
                ["doc_id", "label", "rows", "often"],
            )

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text"))
    found = slim.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")
    # A repeated doc_id must not exceed the bound.
    bags = found.mapInArrow(run, "doc_id bigint, label int, rows binary, often binary").orderBy(*order, "rows").limit(2 * per_class)

    def fit(table: pa.Table) -> pa.Table:
        y = table["label"].to_numpy()
        taken = np.bincount(y, minlength=2)
        shares = np.array([sizes.get(c, 0) / max(1, taken[c]) for c in (0, 1)])
        shares = shares / (shares[y].max(initial=0.0) or 1.0)
        packed = zip(table["rows"].to_pylist(), table["often"].to_pylist(), strict=True)
        model = train([(np.frombuffer(r, np.int32), np.frombuffer(o, np.float32)) for r, o in packed], y, shares)
        parts = [model.vectors, model.output.astype(np.float32), model.bias.astype(np.float32)]
        return pa.table([pa.array([p.tobytes()], pa.binary()) for p in parts], ["vectors", "output", "bias"])

    # The bounded sample is one group, trained on in one task; the model alone reaches the driver.
    fitted = bags.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(fit, "vectors binary, output binary, bias binary").collect()
    if not fitted:
        return None
    vectors, output, bias = (np.frombuffer(fitted[0][c], np.float32) for c in ("vectors", "output", "bias"))
    return Model(vectors.reshape(-1, WIDTH), output.reshape(WIDTH, 2), bias)


def score(docs: DataFrame, model: Model | None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, rest (a struct of the columns in ``carry``), text (as bytes), held_out, score
    and predicted (1 from ``THRESHOLD`` on) of every document. Without a model all score 0.5."""
    rest = F.struct(*carry) if carry else F.lit(None).cast("int")
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), rest.alias("rest"), text_bytes().alias("text"))
    weights = docs.sparkSession.sparkContext.broadcast((model.weights(), model.odds()) if model else None)
    out = slim.withColumn("score", F.lit(0.5))
    schema = to_arrow_schema(out.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            found = np.full(len(texts), 0.5)
            if weights.value is not None:
                for a, b in portions([len(t) for t in texts], PART_BYTES):
                    found[a:b] = scores(texts[a:b], *weights.value)
            columns = {c: batch[c] for c in ("doc_id", "rest", "text")} | {"score": pa.array(found)}
            yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)

    return slim.mapInArrow(run, out.schema).select(
        "doc_id",
        "rest",
        "text",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def classify(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Learn from the labelled documents and score all of them; see :func:`learn`, :func:`score`.

    Only texts enter a score. A null text is an empty one, and an empty text is scored by
    its one blank n-gram. Of several labels of a document the larger counts; labels of
    unknown documents and null labels count for nothing. With no labels at all every score
    is 0.5. Repeated rows are scored alike; a null doc_id is never held out. An empty
    table gives an empty table.
    """
    return score(docs, learn(docs, labels), carry)
