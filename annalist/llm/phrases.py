"""Frequent phrases and how strongly they hold together, by Rabin-Karp fingerprints.

Texts are written once as parts: the words of some texts of one language, as numbers in
the part's own dictionary. All later steps read the parts where they lie; they are bucketed
and never shuffled.

1. Every part fingerprints its n-grams with prefix polynomials over its words and sends the
   fingerprints of the distinct ones, packed, with a check of 32 bits and their counts.
   Buckets of fingerprints sum the counts of all parts and send a bit per fingerprint back
   to the parts it came from.
2. This is done for single words, for pairs of frequent words, and for the longer n-grams
   all of whose pairs are frequent: a phrase cannot be more frequent than any of its parts.
3. A part keeps one occurrence of each n-gram as a pointer into its words. Of each frequent
   fingerprint a bucket names one part that reads the text at its pointer and gives it the
   whole count. Where n-grams of one fingerprint differ, every part that has any reads its
   texts and gives each its own count, and the counts are summed by text. So a collision
   costs some texts read in vain, and never a wrong count.

Inside a part n-grams are told apart by dictionary numbers, which is exact. Between parts
two n-grams pass for one only if they agree in the fingerprint and the check, 96 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm.tables import bucketed, shuffle_partitions, stored, text_bytes
from annalist.llm.tokens import Polynomials, byte_table, tokens_of
from annalist.llm.words import mix

LONGEST = 5
# What ends a piece, and what parts words within it.
PIECE_ENDS = (0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F, 0x0A, 0x0B, 0x0C, 0x0D)
BLANKS = (0x20, 0x09)
NO_LANGUAGE = "und"

_END = byte_table(PIECE_ENDS)
_WORD = ~byte_table([*PIECE_ENDS, *BLANKS])
#: A part is closed at so many bytes of text; a longer text stands alone. Open parts of all
#: languages of a task hold at most ``OPEN_PARTS`` times as much.
PART_BYTES, OPEN_PARTS = 8 << 20, 4
BUCKET_BYTES = 16 << 20
SALTS = 64

_OTHER = np.uint64(0x6A09E667F3BCC909)
_PART = "part bigint, lang string, n_words bigint, sizes binary, letters binary, ids binary"
_SENT = "bucket int, part bigint, prints binary, checks binary, counts binary"
_BITS = "level int, part bigint, bucket int, bits binary, reads binary, totals binary"
_FOUND = "lang string, size int, phrase string, a bigint"


def _arrow(ddl: str) -> pa.Schema:
    types = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = (f.split(" ") for f in ddl.split(", "))
    return pa.schema([(name, types[kind]) for name, kind in fields])


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    schema = _arrow(ddl)
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _packed_part(number: int, lang: str, texts: list[bytes]) -> pa.RecordBatch:
    """ids: the number of each word in the dictionary, from 1, and 0 where a piece ends."""
    tokens = tokens_of(texts, _WORD)
    inside = np.concatenate([[0], np.cumsum(tokens.length)])
    letters = tokens.data[_WORD[tokens.data]]
    buffers = [None, pa.py_buffer(inside.astype(np.int64)), pa.py_buffer(letters)]
    words = pa.Array.from_buffers(pa.large_binary(), len(tokens.start), buffers).dictionary_encode()
    piece = np.cumsum(_END[tokens.data])[tokens.start] if len(tokens.start) else np.zeros(0, np.int64)
    opens = np.append(False, piece[1:] != piece[:-1]) if len(piece) else np.zeros(0, bool)
    ids = np.zeros(len(piece) + int(opens.sum()), np.int32)
    ids[np.arange(len(piece)) + np.cumsum(opens)] = words.indices.to_numpy() + 1
    known = words.dictionary.to_pylist()
    sizes = np.fromiter(map(len, known), np.uint32, len(known))
    values = (number, lang, len(piece), sizes.tobytes(), b"".join(known), ids.tobytes())
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _arrow(_PART), strict=True)], schema=_arrow(_PART))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number, kept, sizes = TaskContext.get().partitionId() << 33, {}, {}
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            kept.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text)
            full = lang if sizes[lang] >= PART_BYTES else None
            if full is None and sum(sizes.values()) >= OPEN_PARTS * PART_BYTES:
                full = max(sizes, key=sizes.get)
            if full is not None:
                yield _packed_part(number, full, kept.pop(full))
                number, _ = number + 1, sizes.pop(full)
    for lang, texts in kept.items():
        yield _packed_part(number, lang, texts)
        number += 1


def _parts(docs: DataFrame) -> tuple[DataFrame, int]:
    """The packed parts, bucketed by part, and the number of buckets for their fingerprints."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE))
    slim = docs.select(lang.alias("lang"), text_bytes().alias("text"))
    total = slim.agg(F.sum(F.octet_length("text")).alias("total")).first()["total"] or 0
    n = max(shuffle_partitions(docs), -(-total // (4 * PART_BYTES)))
    return bucketed(slim.mapInArrow(_pack, _PART), "part", n, "phrase-parts"), max(shuffle_partitions(docs), -(-total // BUCKET_BYTES))


def _unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each distinct key where it first stands and how often, and for each key its index."""
    _, first, index, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return first, counts, index


class _Grams:
    """Distinct n-grams of one size in a part: an occurrence of each, and their counts."""

    def __init__(self, size: int, where: np.ndarray, counts: np.ndarray):
        self.size, self.where, self.counts = size, where, counts


class _Part:
    """The n-grams of one part, level by level; each level needs the answers to the last."""

    def __init__(self, row: dict, n_buckets: int):
        self.lang, self.n_buckets = row["lang"], n_buckets
        self.sizes = np.frombuffer(row["sizes"], np.uint32).astype(np.int64)
        self.letters = row["letters"]
        self.ids = np.frombuffer(row["ids"], np.int32).astype(np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)])
        spelled = Polynomials(_spread(np.frombuffer(self.letters, np.uint8)))
        self.word_prints = np.concatenate([np.zeros(1, np.uint64), spelled.at(self.begins[:-1], self.sizes)])
        self.prefixes = Polynomials(self.word_prints[self.ids])
        self.others = Polynomials(mix(self.word_prints ^ _OTHER)[self.ids])
        of_lang = Polynomials(_spread(np.frombuffer(self.lang.encode(), np.uint8)))
        self.salt = of_lang.at(np.zeros(1, np.int64), len(self.lang.encode()))

    def _prints(self, grams: list[_Grams]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints in order, their checks and counts, and the order they were put in.

        One entry per n-gram, also where two of them share a fingerprint.
        """
        plain = np.concatenate([self.prefixes.at(g.where, g.size) for g in grams])
        counts = np.concatenate([g.counts for g in grams])
        other = np.concatenate([self.others.at(g.where, g.size) for g in grams])
        prints, checks = mix(plain ^ self.salt), (other >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((np.arange(len(prints)), checks, prints))
        return prints[order], checks[order], counts[order].astype(np.uint32), order

    def _cuts(self, prints: np.ndarray) -> np.ndarray:
        bucket = (prints >> np.uint64(32)) * np.uint64(self.n_buckets) >> np.uint64(32)
        return np.searchsorted(bucket, np.arange(self.n_buckets + 1).astype(np.uint64))

    def messages(self, level: int, answers: dict) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """(bucket, packed fingerprints, checks and counts) of a level."""
        *packed, _ = self._prints(self.grams(level, answers))
        cuts = self._cuts(packed[0])
        for b in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            yield b, *(x[cuts[b] : cuts[b + 1]].tobytes() for x in packed)

    def _answered(self, level: int, grams: list[_Grams], answers: dict) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each list of n-grams which of them are frequent, and the count to give to those
        whose text is to be read here (0 for others)."""
        prints, _, _, order = self._prints(grams)
        cuts = self._cuts(prints)
        flags, totals = np.zeros(len(prints), bool), np.zeros(len(prints), np.int64)
        for bucket, (bits, reads, given) in answers.get(level, {}).items():
            a, b = cuts[bucket], cuts[bucket + 1]
            flags[order[a:b]] = _flags(bits, b - a)
            totals[order[a:b][_flags(reads, b - a)]] = np.frombuffer(given, np.int64)
        ends = np.cumsum([len(g.where) for g in grams])[:-1]
        return np.split(flags, ends), np.split(totals, ends)

    def words(self) -> _Grams:
        first, counts, _ = _unique(self.ids)
        real = self.ids[first] > 0
        return _Grams(1, first[real], counts[real])

    def grams(self, level: int, answers: dict) -> list[_Grams]:
        """Level 1: words; 2: pairs of frequent words; 3: the longer ones made of frequent pairs."""
        words = self.words()
        if level == 1:
            return [words]
        fine = np.zeros(len(self.sizes) + 1, bool)
        fine[self.ids[words.where]] = self._answered(1, [words], answers)[0][0]
        base = len(fine)
        fine_at = fine[self.ids]
        at = np.flatnonzero(fine_at[:-1] & fine_at[1:])
        first, counts, index = _unique(self.ids[at] * base + self.ids[at + 1])
        pairs = _Grams(2, at[first], counts)
        if level == 2:
            return [pairs]
        stays = self._answered(2, [pairs], answers)[0][0][index]
        number = np.full(len(self.ids) + 1, -1)  # of the n-gram that begins here
        number[at[stays]] = index[stays]
        out, at, linked = [], at[stays], number >= 0
        for size in range(3, LONGEST + 1):
            # The n-gram of one word less begins here, and the pair of its last words stays.
            at = at[(number[at] >= 0) & linked[np.minimum(at + size - 2, len(self.ids))]]
            first, counts, index = _unique(number[at] * base + self.ids[np.minimum(at + size - 1, len(self.ids) - 1)])
            out.append(_Grams(size, at[first], counts))
            number = np.full(len(self.ids) + 1, -1)
            number[at] = index
        return out

    def phrases(self, answers: dict) -> Iterator[tuple[str, int, str, int]]:
        """The frequent n-grams that are to be read here as text, each with its count."""
        for level in (1, 2, 3):
            grams = self.grams(level, answers)
            for g, totals in zip(grams, self._answered(level, grams, answers)[1], strict=True):
                read = np.flatnonzero(totals)
                for spot, n in zip(g.where[read].tolist(), totals[read].tolist(), strict=True):
                    words = self.ids[spot : spot + g.size] - 1
                    text = b" ".join(self.letters[self.begins[w] : self.begins[w + 1]] for w in words.tolist())
                    yield self.lang, g.size, text.decode(), n


def _spread(values: np.ndarray) -> np.ndarray:
    return mix(values.astype(np.uint64) + np.uint64(1))


def _flags(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


def _answers(table: pa.Table) -> dict[int, dict[int, tuple[bytes, bytes, bytes]]]:
    """level -> bucket -> what it answered this part."""
    found: dict[int, dict[int, tuple[bytes, bytes, bytes]]] = {}
    for row in table.to_pylist():
        found.setdefault(row["level"], {})[row["bucket"]] = row["bits"], row["reads"], row["totals"]
    return found


def _sender(level: int, n_buckets: int):
    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        known, rows = _answers(answers), []
        if level > 1 and level - 1 not in known:  # nothing of the level before is frequent
            return _table(rows, _SENT)
        for row in table.to_pylist():
            part = _Part(row, n_buckets)
            rows += [(bucket, row["part"], *packed) for bucket, *packed in part.messages(level, known)]
        return _table(rows, _SENT)

    return send


def _counter(level: int, least: int):
    def count(table: pa.Table) -> pa.Table:
        """Sum up the counts of a bucket's fingerprints and answer every part."""
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        joined = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in rows])
        prints, checks, counts = joined("prints", np.uint64), joined("checks", np.uint32), joined("counts", np.uint32).astype(np.int64)
        sizes = np.array([len(r["prints"]) // 8 for r in rows])
        part = np.repeat(np.arange(len(rows)), sizes)
        order = np.argsort(prints, kind="stable")  # entries of one fingerprint, by part
        begins = np.flatnonzero(np.append(True, prints[order][1:] != prints[order][:-1]))
        group = np.empty(len(prints), np.int64)
        group[order] = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(prints))))
        sums = np.add.reduceat(counts[order], begins)
        # Different checks, or two n-grams of one part: the texts must tell them apart.
        apart = np.append(False, (checks[order][1:] != checks[order][:-1]) | (part[order][1:] == part[order][:-1]))
        apart[begins] = False
        mixed = np.add.reduceat(apart, begins) > 0
        first = np.zeros(len(prints), bool)
        first[order[begins]] = True
        frequent = sums[group] >= least
        reads = frequent & (first | mixed[group])
        totals = np.where(mixed[group], counts, sums[group])
        out, ends = [], np.cumsum(sizes)
        for r, a, b in zip(rows, ends - sizes, ends, strict=True):
            if frequent[a:b].any():
                own = reads[a:b]
                packed = np.packbits(frequent[a:b]).tobytes(), np.packbits(own).tobytes(), totals[a:b][own].tobytes()
                out.append((level, r["part"], r["bucket"], *packed))
        return _table(out, _BITS)

    return count


def _materialiser(n_buckets: int):
    def materialise(table: pa.Table, answers: pa.Table) -> pa.Table:
        known, rows = _answers(answers), []
        for row in table.to_pylist() if known else ():
            rows += _Part(row, n_buckets).phrases(known)
        return _table(rows, _FOUND)

    return materialise


def frequent_phrases(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to 5 words found ``least`` times or more in a language (lang, size,
    phrase, a), and the words of each language (lang, n)."""
    spark = docs.sparkSession
    parts, n_buckets = _parts(docs)
    grouped, bits = parts.groupBy("part"), spark.createDataFrame([], _BITS)
    for level in (1, 2, 3):
        sent = grouped.cogroup(bits.groupBy("part")).applyInArrow(_sender(level, n_buckets), _SENT)
        found = sent.groupBy("bucket").applyInArrow(_counter(level, least), _BITS)
        bits = bits.unionByName(stored(found, f"phrase-bits-{level}"))
    read = grouped.cogroup(bits.groupBy("part")).applyInArrow(_materialiser(n_buckets), _FOUND)
    counted = read.groupBy("lang", "size", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return stored(counted, "phrases"), parts.groupBy("lang").agg(F.sum("n_words").alias("n"))


def _words(phrase: Column, first: int | Column, n: int | Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, n), " ")


def _whole(name: str) -> Column:
    return F.col(name).cast("decimal(38,0)")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000) -> DataFrame:
    """The phrases of each language whose words attract each other most.

    ``docs`` needs lang and text; other columns are ignored. A-Z are lowered, texts are cut
    into pieces at ``.,;:!?`` and line ends, and into words at blanks; phrases lie within a
    piece. Returns lang, rank, phrase, a, l, r, n, score: see the package's README.

    A null text is empty, a null language is ``und``. Repeated rows count each. A phrase
    that a longer one of the same count contains is left out. Equal scores are ordered by
    count, then by the phrase's bytes. An empty table gives an empty table.
    """
    counts, totals = frequent_phrases(docs, least)
    several = counts.where(F.col("size") > 1)

    part = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("a").alias(n))
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = several.select("*", cut).select(
        "lang",
        "phrase",
        "a",
        "k",
        _words(F.col("phrase"), 1, F.col("k")).alias("head"),
        _words(F.col("phrase"), F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"),
    )
    scored = (
        cuts.join(part("head", "l"), ["lang", "head"])
        .join(part("rest", "r"), ["lang", "rest"])
        .join(totals, "lang")
        .withColumn("above", F.lit(1000).cast("decimal(4,0)") * _whole("a") * _whole("n"))
        .withColumn("below", _whole("l") * _whole("r"))
        .withColumn("score", F.expr("above div below"))
        .groupBy("lang", "phrase", "a", "n")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    )
    # One word more is enough: what is in between is no rarer than the longer phrase.
    longer = several.where(F.col("size") > 2)
    inner = lambda first: longer.select("lang", _words(F.col("phrase"), first, F.col("size") - 1).alias("phrase"), "a")
    covered = inner(1).unionByName(inner(2)).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = scored.join(covered, ["lang", "phrase"], "left").where(F.coalesce(F.col("longer") < F.col("a"), F.lit(True)))
    rows = left.select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score")

    # Ranked in two steps, as one language may hold nearly all phrases.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
