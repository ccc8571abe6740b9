"""The registered queries against their SQL, or against plain versions, and the pipeline."""

import sys
from collections import Counter

import duckdb
import pytest
from fixtures import documents, near_components, sha, shingle_set, without_lines, without_repeats
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from annalist.llm import quality, queries, stages
from check import TABLES, rows_of

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.REGISTRY))
def test_query(spark, name):
    got = entry.queries()[name](spark, SMALL).toPandas()
    assert len(got) > 0
    if name in queries.ORACLES:
        con = duckdb.connect()
        for table in TABLES:
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
        want = con.execute(entry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)


def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}


def test_substring_query(spark):
    docs = texts(spark)
    want = {(d, n, gone, sha(left)) for d, (n, gone, left) in zip(docs, without_repeats(list(docs.values()), 35), strict=True)}
    assert {tuple(r) for r in entry.queries()["op3_substring_dedup"](spark, SMALL).collect()} == want


def test_ngram_query(spark):
    docs = texts(spark)
    sets = [shingle_set(t, 4) for t in docs.values()]
    want = set(zip(docs, map(len, sets), near_components(sets, list(docs), 85), strict=True))
    assert {tuple(r) for r in entry.queries()["op6_ngram_join"](spark, SMALL).collect()} == want


def test_quality_query(spark):
    """On sf0.01: the smallest tables hold out three bad documents, too few to measure by."""
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    found = entry.queries()["op4_quality"](spark, folder).collect()
    held = [r for r in found if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.97 * len(held) >= 60


def test_stages_return_the_columns_they_get(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (80, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    given = documents(spark)
    for _, stage in stages.STAGES[:-1]:
        assert stage(spark, given, str(tmp_path)).dtypes == given.dtypes
        assert stage(spark, given.limit(0), str(tmp_path)).count() == 0


def test_stage_of_near_duplicates_keeps_one_row(spark):
    kept = stages.one_of_each(spark, documents(spark), "")
    counts = Counter(r.doc_id for r in kept.collect())
    assert counts[95] == 1 and counts[50] == 1 and counts[70] == 1 and counts[None] == 2
    assert not any(counts[d] for d in (*range(51, 62), *range(71, 75), 84))
    assert all(counts[d] == 1 for d in range(30)) and counts[80] == counts[81] == counts[82] == 1


def test_pipeline(spark):
    """Every stage against a plain version, on what the stages before it kept."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    scores = {r.doc_id: r.predicted for r in quality.classify(docs, labels).collect()}
    left = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect() if scores[r.doc_id]]
    left = [(d, text) for (d, _), (_, _, text) in zip(left, without_lines(left, stages.MIN_DOCS, stages.MIN_CHARS), strict=True)]
    sets = [shingle_set(t, stages.SHINGLE_WORDS) for _, t in left]
    components = near_components(sets, [d for d, _ in left], stages.PERCENT)
    left = [x for x, c in zip(left, components, strict=True) if x[0] == c]
    cut = without_repeats([t for _, t in left], stages.WINDOW)
    left = [(d, rest.decode() if gone else t) for (d, t), (_, gone, rest) in zip(left, cut, strict=True)]

    frame = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SMALL)
    found = frame.collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter(left)
    assert all(r.n_chars == len(r.text) for r in found)

    pieces = corpus_pipeline.run(spark, SMALL)
    sums = {r.doc_id: (r.n, r.all) for r in pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()}
    assert set(sums) == {d for d, _ in left} and all(n == whole for n, whole in sums.values())


def test_the_rest_of_the_library_does_without(spark):
    for name, module in list(sys.modules.items()):
        if name.startswith("annalist.") and not name.startswith("annalist.llm"):
            assert not any(getattr(v, "__module__", "").startswith("annalist.llm") for v in vars(module).values() if callable(v))
