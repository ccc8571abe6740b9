"""Near-duplicate documents by the Jaccard similarity of their word n-grams: an exact
prefix-tree join.

All sets are ordered alike: n-grams that many documents hold come last, the rest by hash.
How many hold an n-gram is counted over all documents in a sketch of fixed size; the order
is right whatever the sketch says. Linked sets share one of their first elements and are
of like size, so documents meet by those elements within bands of sizes, and only there.

Groups that meet are never expanded into pairs:

1. Equal sets are one class, and only its first document goes on.
2. In each group every member is held against the group's first. Sizes and a parity
   bitmap of each set rule out most; the others are searched for in a prefix tree.
3. Groups that these links leave in several components are compared across them, in
   blocks, by bitmap. At first each set stands in its largest group only, and of the pairs
   that bitmaps allow a spanning forest of the components is searched for in prefix trees,
   nearest pairs first: no more pairs than components, which mostly joins them all. What
   stays apart is compared in all its groups: a member's nearest in each other component,
   then more of the nearest, until none is left out.

Two linked documents meet in some group; there they are held against each other, or are
in one component already. So no link between components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm.graph import components
from annalist.llm.prefix_tree import Jaccard, PrefixTree
from annalist.llm.sketch import summed
from annalist.llm.tables import stored, text_bytes
from annalist.llm.words import mix, portions, rolling, windows_of, words_of

SKETCH_BITS = 18
PART_BYTES = 1 << 20
GROUP_ROWS, GROUP_GRAMS = 1024, 1 << 20  # members and n-grams held against one leader in one task at a time
BLOCK_ROWS = 1024  # members of a group compared by bitmap with as many others
NEAREST, FURTHER = 4, 8  # partners tried per member and component at first; how many times more in the next round

WANTED_SLOTS = 1 << 24  # bits that say whose texts are needed: 2 MB at most, however many documents there are

_SETS = "doc bigint, mark bigint, n int, band int, up int, digest binary, bitmap binary, keys array<bigint>"


# Sets of n-grams.


def shingles(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """The distinct n-gram hashes of each text, ascending. A text of fewer words has its
    whole sequence as one n-gram."""
    for a, b in portions([len(t) for t in texts], PART_BYTES):
        words = words_of([t.lower() for t in texts[a:b]])  # bytes: only A-Z are lowered
        grams, whole = rolling(words, size), windows_of(words, size)
        for first, end in zip(words.first[:-1], words.first[1:], strict=True):
            if 0 < end - first < size:
                short = np.uint64(end - first)
                for h in words.hashes[first:end]:
                    short = mix(np.array([short]) * np.uint64(0x9E3779B97F4A7C15) + h)[0]
                yield np.array([short], np.uint64)
            else:
                yield np.unique(grams[first:end][whole[first:end]])


def _slots(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def common_levels(docs: DataFrame, size: int) -> np.ndarray:
    """For each slot of the sketch how far above the average its n-grams are, as a power
    of two; a table of 2 ** SKETCH_BITS bytes, however many documents there are."""
    n_slots = 1 << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        held = np.zeros(n_slots)
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in portions([len(t) for t in texts], PART_BYTES):
                held += np.bincount(np.concatenate([_slots(g) for g in shingles(texts[a:b], size)]), minlength=n_slots)
        return held

    counts = summed(docs.select(text_bytes().alias("text")), count, n_slots)
    excess = counts - counts.mean() - 4 * np.sqrt(counts.mean())
    return np.where(excess >= 1, np.floor(np.log2(np.maximum(excess, 1))) + 1, 0).astype(np.uint8)


def ordered(grams: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The elements in the order common to all sets, as ascending numbers."""
    return np.sort(levels[_slots(grams)].astype(np.uint64) << np.uint64(56) | grams >> np.uint64(8))


def _digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _bitmap(grams: np.ndarray) -> np.ndarray:
    """The parity of the elements in each of 64 or more bits, at least four times as many as
    elements: sets that differ in a fifth of them rarely look nearer than they are."""
    bits = 1 << max(6, (4 * len(grams) - 1).bit_length())
    parity = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(bool), bitorder="little").view(np.uint64)


def _folded_rows(bitmaps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps, one per row, folded to so many words; parities stay parities."""
    while bitmaps.shape[1] > words:
        half = bitmaps.shape[1] // 2
        bitmaps = bitmaps[:, :half] ^ bitmaps[:, half:]
    return bitmaps


def set_rows(docs: DataFrame, size: int, jaccard: Jaccard, levels: np.ndarray) -> DataFrame:
    """doc, mark, n, band of sizes, digest, bitmap and first elements of every document's set;
    ``up``: how many of these may be the first that a set of the next band shares."""
    table = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, bitmaps, keys = [], [], [], []
            for grams in shingles(batch["text"].to_pylist(), size):
                n.append(len(grams))
                digests.append(_digest(grams))
                bitmaps.append(_bitmap(grams).tobytes() if len(grams) else b"")
                first = ordered(grams, table.value)[: jaccard.prefix(len(grams)) if len(grams) else 0]
                keys.append(first.view(np.int64))
            band, up = jaccard.bands(np.array(n, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc"],
                    batch["mark"],
                    pa.array(n, pa.int32()),
                    pa.array(band, pa.int32()),
                    pa.array(up, pa.int32()),
                    pa.array(digests, pa.binary()),
                    pa.array(bitmaps, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                ["doc", "mark", "n", "band", "up", "digest", "bitmap", "keys"],
            )

    return docs.select("doc", "mark", "text").mapInArrow(run, _SETS)


# Pairs.


def may_link(jaccard: Jaccard, n1: int, map1: np.ndarray, n2: int, map2: np.ndarray) -> bool:
    """False only if sizes or bitmaps show that the sets are not linked."""
    most = n1 + n2 - 2 * jaccard.needed(n1, n2)
    if abs(n1 - n2) > most:
        return False
    words = min(len(map1), len(map2))
    return int(np.bitwise_count(_folded_rows(map1[None], words) ^ _folded_rows(map2[None], words)).sum()) <= most


def _plausible(pairs: DataFrame, nodes: DataFrame, jaccard: Jaccard) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps do not rule out."""
    of = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bitmap").alias(f"map{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = [[np.frombuffer(m, np.uint64) for m in batch[c].to_pylist()] for c in ("mapa", "mapb")]
            sizes = [batch[c].to_pylist() for c in ("na", "nb")]
            good = [may_link(jaccard, *x) for x in zip(sizes[0], maps[0], sizes[1], maps[1], strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(run, "a bigint, b bigint")


class _Union:
    """Which of the numbers 0 .. n - 1 are linked so far."""

    def __init__(self, n: int):
        self.above = list(range(n))

    def top(self, i: int) -> int:
        while self.above[i] != i:
            self.above[i] = i = self.above[self.above[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.top(i), self.top(j)
        self.above[max(i, j)] = min(i, j)
        return i != j


def _links_of_group(nodes: list[int], sets: list[np.ndarray], jaccard: Jaccard) -> list[tuple[int, int]]:
    """Links that join the first node, and then the others, as far as they are linked."""
    tree, joined, links = PrefixTree(), _Union(len(nodes)), []
    for i in range(1, len(nodes)):
        tree.insert(sets[i], i)
    for i in range(len(nodes)):
        if i and joined.top(i) == 0:
            continue  # with the first already, and so held against whatever the first is
        for j in tree.search(sets[i], jaccard):
            if joined.join(i, j):
                links.append((nodes[i], nodes[j]))
    return links


def _slot() -> tuple[Column, Column]:
    """Where the bit of a doc and mark stands: which bitmap, and the place there."""
    slot = F.pmod(F.xxhash64("doc", "mark"), F.lit(WANTED_SLOTS))
    return F.bitmap_bucket_number(slot), F.bitmap_bit_position(slot)


def _wanted(docs: DataFrame, roles: DataFrame) -> DataFrame:
    """The documents whose doc and mark stand in ``roles``, and a few others. The texts of
    all documents need not be moved to find those of some."""
    bucket, place = _slot()
    bits = roles.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(place).alias("bits"))
    held = docs.withColumns({"bucket": bucket, "place": place}).join(F.broadcast(bits), "bucket")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(place div 8 as int) + 1, 1)")), 16, 10).cast("int")
    bit = F.pow(F.lit(2), F.col("place") % 8).cast("int")
    return held.where(byte.bitwiseAND(bit) > 0).select(*docs.columns)


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, jaccard: Jaccard, levels: np.ndarray) -> DataFrame:
    """The links among pairs (a, b): the b of each a are searched for in a prefix tree."""
    table = docs.sparkSession.sparkContext.broadcast(levels)
    sized = pairs.join(nodes.select(F.col("node").alias("b"), F.col("n").alias("grams")), "b")
    most = F.greatest(F.count("*") / GROUP_ROWS, F.sum(F.col("grams").cast("bigint")) / GROUP_GRAMS)
    lots = sized.groupBy("a").agg(F.ceil(most).cast("int").alias("lots"))
    lot = F.pmod(F.xxhash64("b"), F.col("lots")).cast("int").alias("lot")
    members = pairs.join(lots, "a").select("a", lot, F.col("b").alias("node"), F.lit(1).alias("place"))
    leaders = lots.select("a", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot")).select(
        "a", "lot", F.col("a").alias("node"), F.lit(0).alias("place")
    )
    # By id and text, so that rows without an id, or of one id, do not meet each other's texts.
    key = lambda rows: rows.withColumn("doc", F.coalesce("doc", F.lit(0)))
    roles = members.unionByName(leaders).join(key(nodes.select("node", "doc", "mark", "digest")), "node")
    texts = roles.join(_wanted(key(docs), roles), ["doc", "mark"]).select("a", "lot", "place", "node", "digest", "text")

    def links(held: list[dict]) -> list[tuple[int, int]]:
        found: dict[int, np.ndarray] = {}
        for row, grams in zip(held, shingles([r["text"] for r in held], size), strict=True):
            if _digest(grams) == row["digest"]:
                found[row["node"]] = ordered(grams, table.value)
        return _links_of_group(list(found), list(found.values()), jaccard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for row in batch.to_pylist():
                if held and (row["a"], row["lot"]) != (held[0]["a"], held[0]["lot"]):
                    out += links(held)
                    held = []
                # Repeated rows bring the same text for a node, one after the other.
                if not held or (row["node"], row["text"]) != (held[-1]["node"], held[-1]["text"]):
                    held.append(row)
            yield _pairs_batch(out)
        yield _pairs_batch(links(held) if held else [])

    grouped = texts.repartition("a", "lot").sortWithinPartitions("a", "lot", "place", "node")
    return grouped.mapInArrow(run, "a bigint, b bigint")


def _pairs_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    columns = [pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)]
    return pa.RecordBatch.from_arrays(columns, ["a", "b"])


# Groups that fall apart.


_MORE = -1  # stands, with a group's key, for pairs of it that were left for a later round


def _spanning(a: np.ndarray, b: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) make a spanning forest, those of least ``spare`` first."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    joined, chosen = _Union(len(names)), []
    for pair in np.argsort(spare, kind="stable"):
        if joined.join(int(ends[pair]), int(ends[len(a) + pair])):
            chosen.append(pair)
            if len(chosen) == len(names) - 1:
                break
    return np.array(chosen, np.int64)


def _across(jaccard: Jaccard, nearest: int):
    """Plausible pairs of one cell of a group's grid that are in different components:
    for each member and other component the ``nearest`` by bitmap, and the group's key if
    there are more. With ``nearest`` 0, a spanning forest of the components."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["n"], r["node"]))
        side = np.array([r["block"] for r in rows])
        mixed = table["i"][0].as_py() != table["j"][0].as_py()
        n = np.array([r["n"] for r in rows])
        node = np.array([r["node"] for r in rows])
        component = np.array([r["component"] for r in rows])
        # Sizes of bitmaps grow with those of sets, so equal ones stand together.
        maps = [np.frombuffer(r["bitmap"], np.uint64) for r in rows]
        widths = np.array([len(m) for m in maps])
        stacked = {w: np.stack([m for m in maps if len(m) == w]) for w in np.unique(widths)}
        begin = {w: int(np.searchsorted(widths, w)) for w in stacked}
        out, more = [], False
        close: list[tuple] = []  # for the forest: places of both members, and what they have to spare
        for at in range(len(rows)):
            last = int(np.searchsorted(n, jaccard.sizes(int(n[at]))[1], side="right"))
            others = np.arange(at + 1, last)
            others = others[component[others] != component[at]]
            if mixed:
                others = others[side[others] != side[at]]
            if not len(others):
                continue
            apart = np.empty(len(others), np.int64)
            for width in np.unique(widths[others]):
                some = widths[others] == width
                theirs = _folded_rows(stacked[width][others[some] - begin[width]], widths[at])
                apart[some] = np.bitwise_count(theirs ^ maps[at]).sum(axis=1)
            spare = apart - (n[at] + n[others] - 2 * jaccard.needed(n[at], n[others]))
            others, spare = others[spare <= 0], spare[spare <= 0]
            if not nearest:
                close.append((np.full(len(others), at), others, spare))
                continue
            order = np.lexsort((others, spare, component[others]))
            others = others[order]
            first = np.searchsorted(component[others], component[others])
            chosen = np.arange(len(others)) - first < nearest
            more |= not chosen.all()
            out += [(min(node[at], node[o]), max(node[at], node[o])) for o in others[chosen]]
        if close:
            a, b, spare = (np.concatenate(x) for x in zip(*close, strict=True))
            chosen = _spanning(component[a], component[b], spare)
            out = [(min(x, y), max(x, y)) for x, y in zip(node[a[chosen]], node[b[chosen]], strict=True)]
        if more:
            out.append((_MORE, table["key"][0].as_py()))
        return pa.Table.from_batches([_pairs_batch(out)])

    return run


def _left_pairs(members: DataFrame, labels: DataFrame, nodes: DataFrame, jaccard: Jaccard, nearest: int) -> DataFrame:
    """Plausible pairs across components within groups of three or more."""
    named = members.where("m > 2").join(labels, "node", "left").select(
        "key", "m", "node", F.coalesce("component", "node").alias("component")
    )
    mark = F.xxhash64("node")
    split = (
        named.groupBy("key", "m")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.bit_xor(mark).alias("x"), F.sum(mark % 2**31).alias("s"))
        .where("low <> high")
        .groupBy("m", "x", "s")  # many groups have the same members
        .agg(F.min("key").alias("key"))
    )
    blocks = F.ceil(F.col("m") / BLOCK_ROWS).cast("int")
    cells = (
        named.join(split.select("key"), "key")
        .withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("key", "node", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        .join(nodes.select("node", "n", "bitmap"), "node")
    )
    return cells.groupBy("key", "i", "j").applyInArrow(_across(jaccard, nearest), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Components of documents linked by the Jaccard similarity of their n-gram sets.

    ``docs`` needs doc_id and text; other columns are ignored. Words are
    ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; a set holds the distinct n-grams of ``size``
    words, or the whole sequence of a shorter text. Sets are linked when 100 * |intersection|
    >= ``percent`` * |union|. Returns one row per input row: doc_id, n_shingles, component_id
    (the smallest doc_id reachable by links, its own included).

    A text without words, or null, is linked with nothing. Repeated rows are linked, having
    equal sets; rows of one doc_id with different texts are judged each on its own. A null
    doc_id is larger than any other: it is a component_id only where there is no other.
    An empty table gives an empty table. Only components come out, by the links that join
    them; links inside a known component are not counted.
    """
    jaccard = Jaccard(percent)
    text = text_bytes()
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text"))
    levels = common_levels(docs, size)
    sets = stored(set_rows(slim, size, jaccard, levels).withColumn("row", F.monotonically_increasing_id()), "sets")

    full = sets.where("n > 0")
    # Rows without an id come last.
    first = F.min(F.struct(F.col("doc").isNull().alias("nameless"), "doc", "row")).alias("first")
    firsts = full.groupBy("digest").agg(first, F.count("*").alias("copies"))
    # A table of its own, so that adaptive execution can split a large group of copies.
    repeated = stored(firsts.where("copies > 1").select("digest", "first"), "repeated-sets")
    classes = stored(
        full.select("row", "doc", "digest")
        .join(repeated, "digest", "left")
        .select("row", F.coalesce("first.row", "row").alias("node"), F.coalesce("first.doc", "doc").alias("doc")),
        "classes",
    )
    chosen = classes.where("row = node").select("row")
    nodes = full.select(F.col("row").alias("node"), "doc", "mark", "n", "digest", "bitmap").join(
        chosen.withColumnRenamed("row", "node"), "node", "left_semi"
    )
    entries = (
        full.select("row", "band", "up", "keys")
        .join(chosen, "row", "left_semi")
        .select(F.col("row").alias("node"), "band", "up", F.posexplode("keys").alias("place", "key"))
        .select("node", "key", (2 * F.col("band") + (F.col("place") < F.col("up")).cast("int")).alias("side"))
    )
    met = stored(entries.join(entries.groupBy("key").count().where("count > 1").select("key"), "key"), "met")
    # Linked sets are of one band or of two that adjoin. By the first element they share, both
    # stand in the group of the upper band.
    band = F.floor(F.col("side") / 2)
    group = lambda rows, band: rows.select("node", F.xxhash64("key", band).alias("key"))
    grouped = group(met, band).unionByName(group(met.where("side % 2 = 1"), band + 1))
    shared = grouped.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("leader")).where("m > 1")
    members = stored(grouped.join(shared, "key"), "members")

    tried = stored(members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "tried")
    plausible = stored(_plausible(tried, nodes, jaccard), "plausible")
    links = stored(_verified(plausible, nodes, slim, size, jaccard, levels), "found")
    labels = components(links)
    largest = members.groupBy("node").agg(F.max(F.struct("m", "key")).alias("of")).select("node", "of.key", "of.m")
    nearest, more, groups = 0, True, largest
    while more:
        left = stored(_left_pairs(groups, labels, nodes, jaccard, nearest), "left")
        # The other groups have had all their pairs tried; the forest was of the largest groups only.
        groups = members.join(left.where(F.col("a") == _MORE).select(F.col("b").alias("key")), "key", "left_semi") if nearest else members
        more = not nearest or not left.where(F.col("a") == _MORE).isEmpty()
        new = stored(left.where("a >= 0").join(tried, ["a", "b"], "left_anti"), "new")
        if not new.isEmpty():
            links = links.unionByName(stored(_verified(new, nodes, slim, size, jaccard, levels), "found"))
            labels = components(links)
            tried = tried.unionByName(new)
        nearest = nearest * FURTHER or NEAREST

    own = classes.where("row = node").select("node", "doc")
    named = labels.join(own, "node")
    lowest = named.groupBy("component").agg(F.min("doc").alias("lowest"))
    low = named.join(lowest, "component").select("node", "lowest")
    found = classes.join(low, "node", "left").select("row", F.coalesce("lowest", "doc").alias("component_id"))
    return (
        sets.select("row", "doc", "n")
        .join(found, "row", "left")
        .select(
            F.col("doc").alias("doc_id"),
            F.col("n").cast("bigint").alias("n_shingles"),
            F.coalesce("component_id", "doc").alias("component_id"),
        )
    )
