"""Registered queries of this package, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm import bpe, exact, lines, ngrams, packing, phrases, pseudo, quality, ranking, substrings, topk, toxicity, unigram

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return unigram.token_counts(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op2_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return pseudo.pseudo_likelihood(table(spark, folder, "documents"))


@query
def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = substrings.remove_repeats(table(spark, folder, "documents"), window=35)
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op3_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 34], ' ') AS words
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w)),
repeated AS (SELECT words FROM windows GROUP BY words HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, i + k AS place FROM windows SEMI JOIN repeated USING (words), range(0, 35) r(k)),
placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM w),
judged AS (
  SELECT p.doc_id, p.word, p.place, g.place IS NULL AS stays
  FROM placed p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.place = p.place)
SELECT w.doc_id, count(j.word) AS n_words, count(j.word) FILTER (NOT stays) AS n_removed,
       sha256(coalesce(string_agg(j.word, ' ' ORDER BY j.place) FILTER (stays), '')) AS kept_sha256
FROM w LEFT JOIN judged j ON j.doc_id = w.doc_id GROUP BY w.doc_id
"""


@query
def op7_bpe(spark: SparkSession, folder: str) -> DataFrame:
    rows = bpe.encode_decode(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return rows.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_dedup(table(spark, folder, "documents"))


ORACLES["op5_exact_dedup"] = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query
def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = lines.drop_repeated_lines(table(spark, folder, "documents"), min_docs=5, min_chars=40)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op10_line_dedup"] = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS place
  FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM split),
repeated AS (
  SELECT key, max(doc_id) AS top FROM keyed
  WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT k.doc_id, k.line, k.place, r.top IS NULL OR r.top = k.doc_id AS stays
  FROM keyed k LEFT JOIN repeated r ON r.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (stays), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query
def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return rows.select("doc_id", "held_out", "score", "predicted")


@query
def op8_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


ORACLES["op8_topk"] = """
WITH ints AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM ints q JOIN ints c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score
  FROM scored)
SELECT * FROM ranked WHERE rank <= 5
"""


@query
def op6_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngrams.near_duplicates(table(spark, folder, "documents"), size=4, percent=85)


ORACLES["op6_ngram_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS words
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS i FROM w WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b
  WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b)
SELECT w.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, least(w.doc_id, coalesce(min(r.b), w.doc_id)) AS component_id
FROM w LEFT JOIN sizes s ON s.doc_id = w.doc_id LEFT JOIN reach r ON r.a = w.doc_id
GROUP BY w.doc_id
"""


@query
def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=10)


ORACLES["op13_lexical_search"] = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
held AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf) AS n FROM held GROUP BY doc_id),
size AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM lengths),
weight AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM held, size GROUP BY term, docs),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
impact AS (
  SELECT h.doc_id, h.term,
         w.w * ((1000000000 * h.tf::BIGINT) // (1000 * h.tf::BIGINT + 8 * (10 + (90 * l.n::BIGINT * s.docs) // s.total))) AS v
  FROM held h JOIN lengths l USING (doc_id) JOIN weight w USING (term), size s),
scored AS (
  SELECT item_id, doc_id, sum(v)::BIGINT AS score FROM asked JOIN impact USING (term) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""


@query
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"), least=100, top=2000)


ORACLES["op12_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
totals AS (SELECT lang, sum(len(words))::HUGEINT AS n FROM split GROUP BY lang),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: array_to_string(words[i:i + k - 1], ' '))) AS phrase
  FROM split, range(1, 6) s(k) WHERE len(words) >= k),
counted AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
candidates AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS words FROM counted WHERE k > 1),
cuts AS (
  SELECT lang, phrase, f, words, unnest(range(1, k)) AS cut FROM candidates),
scored AS (
  SELECT c.lang, c.phrase, c.words, c.f AS a, x.f AS l, y.f AS r, n, (1000 * c.f * n) // (x.f * y.f) AS score,
         row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (1000 * c.f * n) // (x.f * y.f), cut) AS place
  FROM cuts c
  JOIN counted x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1:cut], ' ')
  JOIN counted y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[cut + 1:], ' ')
  JOIN totals t ON t.lang = c.lang),
inner_ AS (
  SELECT lang, array_to_string(words[i:j], ' ') AS phrase, max(f) AS longer
  FROM candidates, range(1, 5) a(i), range(2, 6) b(j)
  WHERE j > i AND j <= k AND j - i + 1 < k GROUP BY ALL),
ranked AS (
  SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, encode(s.phrase)) AS rank,
         s.phrase, a, l, r, n, score
  FROM scored s LEFT JOIN inner_ i ON i.lang = s.lang AND i.phrase = s.phrase
  WHERE place = 1 AND (longer IS NULL OR 100 * longer < 100 * a))
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""


@query
def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    rows = toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return rows.select("doc_id", "held_out", "score", "predicted")
