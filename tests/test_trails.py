import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from annalist import schemas
from annalist.operators import audits, numbering, trails, writes
from annalist.operators.numbering import number_within

T0 = datetime(2024, 1, 1)


def make_trails(spark, *names):
    return spark.createDataFrame([(n, f"name-{n}", T0 + timedelta(days=i), T0 + timedelta(days=i)) for i, n in enumerate(names)], schemas.TRAILS)


def make_events(spark, *rows):
    return spark.createDataFrame([(f"{t}-{s}", t, "created", '{"key":"val"}', T0, s) for t, s in rows], schemas.EVENTS)


def make_pending(spark, *rows):
    return spark.createDataFrame([(i, t, ty, p, T0 + timedelta(hours=a), a) for i, t, ty, p, a in rows], schemas.PENDING)


def test_create_and_get(spark):
    requests = spark.createDataFrame([("t1", "my-trail", 1), ("t1", "again", 2), ("old", "x", 3), ("t2", "", 4)], "id string, name string, arrival bigint")
    created, refused = writes.create_trails(make_trails(spark, "old"), requests, F.lit("2024-05-05"))
    assert sorted((r.id, r.name) for r in created.collect()) == [("t1", "my-trail"), ("t2", "")]
    assert sorted((r.id, r.arrival, r.reason) for r in refused.collect()) == [("old", 3, "already exists"), ("t1", 2, "already exists")]
    ids = spark.createDataFrame([("t1",), ("nope",)], "id string")
    assert sorted((r.id, r.name, r.found) for r in trails.lookup(ids, created).collect()) == [("nope", None, False), ("t1", "my-trail", True)]


def test_append_three_and_replay_from_two(spark):
    one = make_trails(spark, "t")
    pending = make_pending(spark, *[(f"e{i}", "t", ty, '{"key":"val"}', i) for i, ty in enumerate(["created", "updated", "deleted"])])
    events, touched, rejects = writes.append_events(one, make_events(spark), pending)
    requests = spark.createDataFrame([("t", 2)], "trail_id string, from_sequence bigint")
    assert [(r.id, r.sequence, r.type) for r in trails.replay(events, requests).collect()] == [("e1", 2, "updated"), ("e2", 3, "deleted")]
    assert touched.first().updated_at == T0 + timedelta(hours=2) and rejects.count() == 0


@pytest.mark.parametrize("start, count", [(-5, 3), (0, 3), (1, 3), (3, 1), (4, 0)])
def test_replay_bounds(spark, start, count):
    events = make_events(spark, ("t", 1), ("t", 2), ("t", 3), ("other", 9))
    requests = spark.createDataFrame([("t", start)], "trail_id string, from_sequence bigint")
    assert trails.replay(events, requests).count() == count


def test_append_counts_instead_of_looking_at_the_highest(spark):
    stored = make_events(spark, ("t", 1), ("t", 7))
    pending = make_pending(spark, ("n", "t", "x", None, 1), ("lost", "nowhere", "x", None, 2))
    events, _, rejects = writes.append_events(make_trails(spark, "t"), stored, pending)
    assert events.where("id = 'n'").first().sequence == 3
    assert [(r.id, r.reason) for r in rejects.collect()] == [("lost", "not found")]
    lengths = trails.trail_lengths(make_trails(spark, "t", "u"), stored).collect()
    assert sorted((r.trail_id, r.length) for r in lengths) == [("t", 2), ("u", 0)]


def test_append_collision_is_reported(spark):
    stored = make_events(spark, ("t", 2))
    events, _, _ = writes.append_events(make_trails(spark, "t"), stored, make_pending(spark, ("n", "t", "x", None, 1)))
    assert [(r.trail_id, r.sequence, r.copies) for r in audits.duplicate_keys(events, ["trail_id", "sequence"], "r").collect()] == [("t", 2, 2)]


@pytest.mark.parametrize("hot_rows", [3, 50, 1 << 20])
def test_numbering_of_hot_keys(spark, hot_rows):
    """One key holds most rows, clumped in places; numbers equal a plain count."""
    rng = random.Random(7)
    rows, position = [], 0
    for _ in range(3000):
        position += rng.choice([1, 1, 1, 1, 500])
        rows.append((rng.choice(["hot"] * 6 + ["a", "b", f"k{rng.randrange(50)}"]), position))
    want, seen = {}, {}
    for key, position in rows:
        seen[key] = want[key, position] = seen.get(key, 0) + 1
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "key string, position bigint")
    got = number_within(frame, ["key"], [F.col("position")], "n", hot_rows).collect()
    assert {(r.key, r.position): r.n for r in got} == want


def test_numbers_do_not_depend_on_where_a_key_is_cut(spark):
    """Order against position, ties, NULLs, and one value far from all others."""
    rng = random.Random(11)
    rows = [("hot", rng.choice([None, rng.randrange(500)]), i) for i in range(3000)] + [("hot", 10**15, -1), ("b", 1, 0)]
    frame = spark.createDataFrame(rows, "key string, lead bigint, position bigint")
    order = [F.col("lead"), F.desc("position")]
    whole = {r.position: r.n for r in number_within(frame, ["key"], order, "n").collect()}
    cut = {r.position: r.n for r in number_within(frame, ["key"], order, "n", 100).collect()}
    assert whole == cut


def test_pieces_of_a_key_are_alike(spark):
    """Positions in clumps and one outlier: no piece is above twice the target."""
    rows = spark.range(20000).select(F.lit("k").alias("key"), F.when(F.col("id") == 0, 10**12).otherwise(F.col("id") % 7000 * F.col("id") % 911 * 1000 + F.col("id")).alias("at"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("_n"))
    cuts = numbering._cuts(rows, ["key"], F.col("at"), sizes, 20000, 1000)
    pieces = rows.join(cuts, "key").groupBy(numbering._piece(F.col("_cuts"), F.col("at"))).count().collect()
    assert len(pieces) == 20 and max(r["count"] for r in pieces) <= 2000


@pytest.mark.parametrize("part_events", [1, 4, 10_000])
def test_assembly_in_parts(spark, part_events):
    sequences = [s for s in range(1, 40) if not 9 <= s <= 20]
    random.Random(3).shuffle(sequences)
    events = make_events(spark, *[("long", s) for s in sequences], ("short", 1), ("unknown", 1))
    rows = trails.nested(make_trails(spark, "long", "short", "empty"), events, part_events).collect()
    assert {r.id for r in rows} == {"long", "short", "empty"}
    parts = sorted((r.part, [e.sequence for e in r.events]) for r in rows if r.id == "long")
    assert sum([p[1] for p in parts], []) == sorted(sequences)
    assert all(0 < len(p[1]) <= part_events for p in parts)
    assert [(r.part, r.events) for r in rows if r.id == "empty"] == [(0, [])]
    assert all(r.name == f"name-{r.id}" for r in rows)


def test_list_is_newest_first(spark):
    rows = trails.list_trails(make_trails(spark, "a", "b", "c"), make_events(spark)).collect()
    assert [r.id for r in rows] == ["c", "b", "a"]


def documents_of(fragments):
    rows = sorted(fragments.collect(), key=lambda r: (r.id, r.section, r.sequence or 0))
    return {i: json.loads("".join(r.json for r in rows if r.id == i)) for i in {r.id for r in rows}}


def test_export(spark):
    done, refused = trails.export_trails(make_trails(spark, "a", "b"), make_events(spark, ("a", 1)))
    documents = documents_of(done)
    assert list(documents["a"]) == ["ID", "Name", "Events", "CreatedAt", "UpdatedAt"]
    assert documents["a"]["Events"] == [
        {"ID": "a-1", "TrailID": "a", "Type": "created", "Payload": {"key": "val"}, "OccuredAt": "2024-01-01T00:00:00Z", "Sequence": 1}
    ]
    assert documents["b"]["Events"] == [] and refused.count() == 0


def test_export_of_a_long_trail_is_one_document(spark, tmp_path):
    """However long a trail is; also as written, where each fragment is a line."""
    order = random.Random(1).sample(range(1, 3001), 3000)
    events = make_events(spark, *[("long", s) for s in order], ("short", 7))
    done, _ = trails.export_trails(make_trails(spark, "long", "short"), events)
    documents = documents_of(done)
    assert [e["Sequence"] for e in documents["long"]["Events"]] == list(range(1, 3001))
    trails.write_documents(done, str(tmp_path / "json"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "json").glob("part-*")))
    assert json.JSONDecoder().raw_decode(lines)[0] == documents["long"]


@pytest.mark.parametrize("payload", ['{"a":1} junk', "[1]", '{"a":', "1"])
def test_unreadable_payloads_are_refused(spark, payload):
    bad = make_events(spark, ("a", 1), ("b", 1), ("b", 2)).withColumn(
        "payload", F.when((F.col("trail_id") == "b") & (F.col("sequence") == 2), payload).otherwise(F.col("payload"))
    )
    done, refused = trails.export_trails(make_trails(spark, "a", "b"), bad)
    assert set(documents_of(done)) == {"a"}
    assert [(r.id, r.reason) for r in refused.collect()] == [("b", "unreadable payload")]
    requests = spark.createDataFrame([("a", 1), ("b", 1)], "trail_id string, from_sequence bigint")
    done, refused = trails.export_replay(bad, requests)
    assert set(documents_of(done)) == {"a"} and [r.id for r in refused.collect()] == ["b"]
    later = spark.createDataFrame([("b", 3)], "trail_id string, from_sequence bigint")
    assert documents_of(trails.export_replay(bad, later)[0]) == {"b": None}


def test_empty_payload_and_empty_replay_export_as_null(spark):
    events = make_events(spark, ("a", 1)).withColumn("payload", F.lit(None).cast("string"))
    requests = spark.createDataFrame([("a", 1), ("b", 1), ("c", 5)], "trail_id string, from_sequence bigint")
    rows = documents_of(trails.export_replay(events, requests)[0])
    assert rows["a"][0]["Payload"] is None and rows["b"] is None and rows["c"] is None


def test_update_sets_name_and_moment_only(spark):
    updates = spark.createDataFrame([("a", "first", 1), ("a", "last", 2), ("zz", "none", 3)], "id string, name string, arrival bigint")
    updated, missing = writes.update_trails(make_trails(spark, "a", "b"), updates, F.lit("2030-01-01"))
    rows = {r.id: r for r in updated.collect()}
    assert (rows["a"].name, rows["a"].created_at, rows["a"].updated_at.year) == ("last", T0, 2030)
    assert rows["b"].name == "name-b" and rows["b"].updated_at == T0 + timedelta(days=1)
    assert [r.id for r in missing.collect()] == ["zz"]


def test_replace_events(spark):
    old = make_events(spark, ("a", 1), ("a", 2), ("b", 1))
    new = make_events(spark, ("a", 5), ("zz", 1))
    replaced = spark.createDataFrame([("a",), ("a",), ("zz",)], "id string")
    rows = writes.replace_events(make_trails(spark, "a", "b"), old, replaced, new).collect()
    assert sorted(r.id for r in rows) == ["a-5", "b-1"]


def test_delete_cascades(spark):
    parents, children = writes.cascade_delete(
        make_trails(spark, "a", "b"), make_events(spark, ("a", 1), ("b", 1)), spark.createDataFrame([("a",)], "id string"), ["id"], ["trail_id"]
    )
    assert [r.id for r in parents.collect()] == ["b"] and [r.id for r in children.collect()] == ["b-1"]


def test_audits(spark):
    events = make_events(spark, ("a", 1), ("a", 1), ("b", 1)).withColumn("type", F.when(F.col("trail_id") == "a", F.repeat(F.lit("x"), 51)))
    known = make_trails(spark, "a")
    assert {(r.id, r.copies) for r in audits.primary_key(events, "id", "pk").collect()} == {("a-1", 2)}
    nothing = events.withColumn("id", F.lit(None).cast("string")).limit(1)
    assert [r.id for r in audits.primary_key(nothing, "id", "pk").collect()] == [None]
    assert [r.id for r in audits.missing_parents(events, known, ["trail_id"], ["id"], "fk").collect()] == ["b-1"]
    assert [(r.id, r.column) for r in audits.nulls(events, "events").collect()] == [("b-1", "type")]
    assert {r.column for r in audits.nulls(events.select("id").limit(1), "events").collect()} == {"trail_id", "type", "occured_at", "sequence"}
    assert [r.column for r in audits.too_long(events, audits.EVENT_LENGTHS, "len").collect()] == ["type", "type"]
    operations = spark.createDataFrame([(o,) for o in ("I", "U", "D", "T", None)], "op string")
    assert {r.op for r in audits.bad_operations(operations).collect()} == {"T", None}
