"""Keys, statements, hashes and flags of changes against a sequential model."""

import hashlib
import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from annalist.operators import described, safety
from annalist.operators.described import FAN_OUT_BITS, LEVELS, statement_fragments, statement_hashes
from annalist.plans.capture import capture_batch, describe
from annalist.sources.store import Store
from logs import frame, message, random_log, run_model


def quoted(name):
    return '"' + name.replace('"', '""') + '"'


def literal(entry):
    return "NULL" if entry[0] == "n" else "'" + (entry[1] or "").replace("'", "''") + "'"


def image(columns, entries):
    """name -> (kind, value), the last of a repeated name, in the order of the last ones."""
    if entries is None:
        return None
    pairs = [(n, tuple(e)) for n, e in zip(columns, entries) if e[0] in "ntu"]
    return {n: e for i, (n, e) in enumerate(pairs) if n not in [x for x, _ in pairs[i + 1 :]]}


def model(relation, m):
    op, columns, identity = m["kind"], relation["columns"], relation["identity"]
    flags = (relation["key_flags"] or [])[: len(columns)]
    keys = [c for i, c in enumerate(columns) if i < len(flags) and flags[i]]
    old = image(columns, m["old_tuple"]) if op in "UD" else None
    new = image(columns, m["new_tuple"]) if op in "IU" else None
    whole = lambda x: x is not None and all(e[0] != "u" for e in x.values())

    def key(x):
        if x is None:
            return None
        if identity in ("d", "i"):
            part = {n: e for n, e in x.items() if n in keys}
            return part if keys and len(part) == len(set(keys)) and whole(part) else None
        return x if identity == "f" and x and whole(x) else None

    where = lambda k: None if k is None else " AND ".join(
        quoted(n) + (" IS NULL" if e[0] == "n" else " = " + literal(e)) for n, e in k.items()
    )
    table = f"{quoted(relation['namespace'])}.{quoted(relation['relation'])}"

    def insert(x):
        if x is None or not whole(x):
            return None
        body = f" ({', '.join(map(quoted, x))}) VALUES ({', '.join(map(literal, x.values()))})" if x else " DEFAULT VALUES"
        return f"INSERT INTO {table}{body}"

    def update(x, w):
        said = {n: e for n, e in (x or {}).items() if e[0] != "u"}
        if not said or w is None:
            return None
        return f"UPDATE {table} SET {', '.join(quoted(n) + ' = ' + literal(e) for n, e in said.items())} WHERE {w}"

    delete = lambda w: None if w is None else f"DELETE FROM {table} WHERE {w}"
    after = key(new) if op in "IU" else None
    before = key(old) if op == "D" or (op == "U" and old is not None) else key(new) if op == "U" and identity in ("d", "i") else None
    complete = old if identity == "f" and whole(old) else None
    forward = {"I": insert(new), "U": update(new, where(before)), "D": delete(where(before))}[op]
    reverse = {"I": delete(where(after)), "U": update(complete, where(after)), "D": insert(complete)}[op]
    changed = []
    if op == "U" and old is not None and new is not None:
        plain = lambda e: e and (e[0], e[1] or "")
        for n in [*new, *[n for n in old if n not in new]]:
            x, y = old.get(n), new.get(n)
            if "u" not in ((x or "-")[0], (y or "-")[0]) and plain(x) != plain(y) and (identity not in ("d", "i") or n in keys):
                changed.append(n)
    pk = after if op == "I" else before
    found = {
        "no_identity": identity in (None, "n"),
        "update_without_old_image": op == "U" and old is None,
        "delete_without_old_image": op == "D" and old is None,
        "row_not_found": op in "UD" and before is None,
        "key_changed": op == "U" and old is not None and before is not None and after is not None and list(before.items()) != list(after.items()),
        "unsent_values": any(e[0] == "u" for x in (old, new) if x for e in x.values()),
        "repeated_columns": len(set(columns)) < len(columns),
        "not_reversible": reverse is None,
    }
    return (
        None if pk is None else json.dumps({n: None if e[0] == "n" else e[1] or "" for n, e in pk.items()}, separators=(",", ":"), ensure_ascii=False),
        where(after),
        forward,
        reverse,
        ",".join(changed),
        ",".join(sorted(f for f, holds in found.items() if holds)),
    )


@pytest.fixture(scope="module")
def logs():
    return {f"slot_{i}": random_log(f"slot_{i}", seed=500 + i, size=150) for i in range(30)}


@pytest.fixture(scope="module")
def expected(logs):
    """(slot, commit, number, what is told) of every change."""
    return [(c[0], c[1], c[2], *c[-1]) for rows in logs.values() for c in run_model(rows, described=model)[1]]


def told(rows):
    fields = ("source_slot", "commit_lsn", "change_seq_in_txn", "row_pk", "reverse_where_sql", "forward_dml_sql", "reverse_dml_sql", "changed", "flags")
    flat = rows.withColumn("changed", F.array_join("changed_columns", ",")).withColumn("flags", F.array_join("safety_flags", ","))
    return [tuple(r) for r in flat.select(*fields).collect()]


@pytest.mark.parametrize("bits", [2, 17])
def test_descriptions(spark, logs, expected, bits):
    rows = [m for log in logs.values() for m in log]
    random.Random(2).shuffle(rows)
    found = told(describe(frame(spark, rows), bits))
    assert sorted(map(repr, found)) == sorted(map(repr, expected))
    flags = {f for row in expected for f in row[-1].split(",")}
    assert flags >= set(safety.rules()), "the logs must exercise every rule"
    assert sum(row[6] is not None for row in expected) > 20


def test_fragments_and_hashes_over_many_buckets(spark, logs, expected):
    """Buckets of 4 positions, so that transactions cross them, and nodes of 2 digests."""
    rows = describe(frame(spark, [m for log in logs.values() for m in log]), 2)
    by_txn = {}
    for slot, commit, number, _, _, forward, reverse, *_ in expected:
        by_txn.setdefault((slot, commit), {})[number] = forward, reverse
    ways = {}
    for (slot, commit), changes in by_txn.items():
        ordered = [changes[n] for n in sorted(changes)]
        ways[slot, commit, "forward"] = [f for f, _ in ordered]
        ways[slot, commit, "reverse"] = [r for _, r in reversed(ordered)]
    fragments = statement_fragments(rows)
    got = {}
    for r in fragments.collect():
        got.setdefault((r.source_slot, r.commit_lsn, r.direction), {})[r.place] = r.statement
    assert {k: [v[i] for i in sorted(v)] for k, v in got.items()} == ways
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in got.values()) and max(map(len, ways.values())) > 4

    bits = described.FAN_OUT_BITS
    try:
        described.FAN_OUT_BITS = 1
        hashes = statement_hashes(fragments).collect()
    finally:
        described.FAN_OUT_BITS = bits
    assert len(hashes) == len(ways)
    for r in hashes:
        parts = ways[r.source_slot, r.commit_lsn, r.direction]
        level = [hashlib.sha256(p.encode()).hexdigest() if p is not None else "" for p in parts]
        for _ in range(LEVELS):
            level = [hashlib.sha256("".join(level[i : i + 2]).encode()).hexdigest() for i in range(0, len(level), 2)]
        assert (r.n, r.missing) == (len(parts), parts.count(None))
        assert (r.sql_hash is None) == (None in parts)
        if r.sql_hash is not None and len(parts) <= 2**LEVELS:
            assert bytes(r.sql_hash).hex() == level[0]
    assert FAN_OUT_BITS == 10


def test_transaction_flags_are_the_union(spark, logs, expected):
    rows = describe(frame(spark, [m for log in logs.values() for m in log]), 3)
    found = safety.transaction_flags(rows, ["source_slot", "commit_lsn"]).collect()
    want = {}
    for row in expected:
        want.setdefault(row[:2], set()).update(f for f in row[-1].split(",") if f)
    assert {(r.source_slot, r.commit_lsn): r.safety_flags for r in found} == {k: sorted(v) for k, v in want.items()}


def one_change(spark, identity, flags, kind, old, new, columns=("a", "b c", "d")):
    rows = [
        message("s", 1, "R", relation_id=9, namespace="sch", relation='t"x', columns=list(columns), identity=identity, key_flags=flags),
        message("s", 2, "B", xid=5, lsn="0/10"),
        message("s", 3, kind, relation_id=9, old_tuple=old, new_tuple=new),
        message("s", 4, "C", lsn="0/20"),
    ]
    return describe(frame(spark, rows)).first()


def test_composite_key(spark):
    values = [("t", "1"), ("t", "it's"), ("n", None)]
    row = one_change(spark, "d", [True, True, False], "U", None, values)
    assert row.row_pk == '{"a":"1","b c":"it\'s"}' and row.replica_identity_mode == "default"
    assert row.forward_dml_sql == 'UPDATE "sch"."t""x" SET "a" = \'1\', "b c" = \'it\'\'s\', "d" = NULL WHERE "a" = \'1\' AND "b c" = \'it\'\'s\''
    assert row.reverse_dml_sql is None and row.safety_flags == ["not_reversible", "update_without_old_image"]
    assert bytes(row.forward_sql_hash) == hashlib.sha256(row.forward_dml_sql.encode()).digest() and row.reverse_sql_hash is None


def test_full_row_identity(spark):
    old, new = [("t", "1"), ("n", None), ("t", "x")], [("t", "1"), ("t", "y"), ("t", "x")]
    row = one_change(spark, "f", [True, True, True], "U", old, new)
    assert row.row_pk == '{"a":"1","b c":null,"d":"x"}' and row.changed_columns == ["b c"]
    assert row.forward_dml_sql.endswith('WHERE "a" = \'1\' AND "b c" IS NULL AND "d" = \'x\'')
    assert row.reverse_dml_sql == 'UPDATE "sch"."t""x" SET "a" = \'1\', "b c" = NULL, "d" = \'x\' WHERE "a" = \'1\' AND "b c" = \'y\' AND "d" = \'x\''
    gone = one_change(spark, "f", [True] * 3, "D", old, None)
    assert gone.reverse_dml_sql == 'INSERT INTO "sch"."t""x" ("a", "b c", "d") VALUES (\'1\', NULL, \'x\')'
    unsent = one_change(spark, "f", [True] * 3, "D", [("u", None), *old[1:]], None)
    assert unsent.reverse_dml_sql is None and unsent.forward_dml_sql is None and "unsent_values" in unsent.safety_flags


def test_changed_key(spark):
    row = one_change(spark, "i", [True, False, False], "U", [("t", "1"), ("n", None), ("n", None)], [("t", "2"), ("t", "y"), ("u", None)])
    assert row.row_pk == '{"a":"1"}' and row.reverse_where_sql == '"a" = \'2\'' and row.changed_columns == ["a"]
    assert row.forward_dml_sql == 'UPDATE "sch"."t""x" SET "a" = \'2\', "b c" = \'y\' WHERE "a" = \'1\''
    assert "key_changed" in row.safety_flags and row.replica_identity_mode == "index"


def test_no_identity_has_no_key(spark):
    for letter in ("n", None):
        row = one_change(spark, letter, None, "I", None, [("t", "1"), ("t", "2"), ("t", "3")])
        assert row.row_pk is None and row.reverse_dml_sql is None and row.forward_dml_sql is not None
        assert row.safety_flags == ["no_identity", "not_reversible"]
    empty = one_change(spark, "f", [], "I", None, [], columns=())
    assert empty.forward_dml_sql == 'INSERT INTO "sch"."t""x" DEFAULT VALUES'


def test_a_batch_can_store_descriptions(spark, tmp_path, logs, expected):
    rows = [m for log in list(logs.values())[:6] for m in log]
    store = Store(spark, str(tmp_path / "store"))
    first, second = [m for m in rows if m["pos"] < 300], [m for m in rows if m["pos"] >= 300]
    for i, step in enumerate((first, second)):
        capture_batch(store, frame(spark, step), i, bits=3, described=True)
    ids = {r.ingest_batch_id for r in store.transactions().select("ingest_batch_id").distinct().collect()}
    assert len(ids) == 2 and all(str(uuid.UUID(i)) == i for i in ids)
    want = [r for r in expected if r[0] in {f"slot_{i}" for i in range(6)}]
    blank = lambda r: (*r[:5], r[5] or "", r[6] or "", *r[7:])
    assert sorted(map(repr, told(store.changes()))) == sorted(repr(blank(r)) for r in want)
