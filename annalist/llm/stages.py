"""The stages of the corpus pipeline, each around one operator of this package.

Every stage takes (spark, docs, sf_dir). All but the last return the columns they were
given, whatever else these are called: other columns travel in a struct.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm import lines, ngrams, packing, quality, substrings

MIN_DOCS, MIN_CHARS = 5, 40  # lines
SHINGLE_WORDS, PERCENT = 5, 80  # near duplicates
WINDOW = 50  # words of a repeated passage
TOKENIZER = "byte_bpe_50k.json"


def _others(docs: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in docs.columns if c not in ("doc_id", "text"))


def _as_given(rows: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """The columns of ``docs`` again, with a new text and its length in n_chars."""
    text = text.cast("string")
    known = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.char_length(text)}
    kinds = {f.name: f.dataType for f in docs.schema}
    return rows.select(
        *(known.get(c, F.col("rest").getField(c)).cast(kinds[c]).alias(c) for c in docs.columns)
    )


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from ``labels``, does not reject.

    A null text is judged as an empty one and comes out empty. Repeated rows, and texts of
    any length, are judged whole and alike; without labels all are kept. An empty table
    gives an empty table.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality.classify(docs, labels, carry=_others(docs))
    return _as_given(rows.where("predicted = 1"), docs, F.col("text"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many of them share; the largest doc_id keeps its own.

    No document goes, also one whose lines are all dropped: its text is empty. A null text
    comes out empty. Rows that repeat a doc_id count as one document and lose the same
    lines; a row without doc_id keeps all of its own. An empty table gives an empty table.
    """
    rows = lines.drop_repeated_lines(docs, MIN_DOCS, MIN_CHARS, carry=_others(docs))
    return _as_given(rows, docs, F.col("kept"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest doc_id.

    Rows of one doc_id stay or go together, but equal rows of it are reduced to one. A
    row without doc_id stays.
    """
    judged = ngrams.near_duplicates(docs, SHINGLE_WORDS, PERCENT).where("doc_id IS NOT NULL")
    stays = judged.groupBy("doc_id").agg(
        F.max(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count("*").alias("n")
    )
    gone = stays.where("not stays").select("doc_id")
    several = stays.where("stays and n > 1").select("doc_id")
    left = docs.join(gone, "doc_id", "left_anti")
    if several.isEmpty():
        return left.select(*docs.columns)
    single = left.join(several, "doc_id", "left_anti")
    repeated = left.join(several, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return single.unionByName(repeated).select(*docs.columns)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand anywhere else. A text that loses words has the
    others joined by one space; any other text is as it was.

    No document goes. A null text comes out empty; a text shorter than a passage is kept;
    repeated rows are repeats of each other. An empty table gives an empty table.
    """
    rows = substrings.remove_repeats(docs, WINDOW, carry=_others(docs))
    return _as_given(rows, docs, F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences.

    A null or empty text is the one id 0. Repeated rows and rows without doc_id are packed
    like others; a text longer than a sequence is cut. An empty table gives an empty table.
    """
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", keep_quality),
    ("lines", drop_lines),
    ("near-duplicates", one_of_each),
    ("substrings", drop_passages),
    ("packing", pack),
]
