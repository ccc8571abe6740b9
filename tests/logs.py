"""Random message logs and a sequential model of the change capture."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

from annalist import schemas

FIELDS = schemas.MESSAGES.fieldNames()


def message(slot, pos, kind, **values):
    row = dict.fromkeys(FIELDS)
    row.update(slot=slot, pos=pos, kind=kind, **values)
    return row


def frame(spark, rows):
    data = [tuple(row[f] for f in FIELDS) for row in rows]
    return spark.createDataFrame(data, schemas.MESSAGES)


def lsn_text(number):
    return f"{number >> 32:X}/{number & 0xFFFFFFFF:X}"


def random_log(slot: str, seed: int, size: int = 120) -> list[dict]:
    """Stray commits, double begins, unknown relations, repeated commit positions."""
    rng = random.Random(seed)
    rows, pos, xid = [], rng.randrange(5), 0
    commits = []
    for _ in range(size):
        pos += rng.choice([1, 1, 1, 2, 5, 40])
        kind = rng.choices(["B", "C", "R", "I", "U", "D", "T", "X", None], [14, 13, 8, 22, 14, 12, 3, 2, 1])[0]
        values = {}
        if kind == "B":
            xid += 1
            values = {"xid": xid, "lsn": lsn_text(xid * 7 + (1 << 33))}
        elif kind == "C":
            if commits and rng.random() < 0.25:
                values = {"lsn": rng.choice(commits)}
            else:
                values = {"lsn": lsn_text(rng.randrange(1 << 40))}
                commits.append(values["lsn"])
            values["commit_ts"] = datetime(2024, 1, 1) + timedelta(seconds=pos)
        elif kind == "R":
            names = rng.sample(["a", "b", "c", "d"], rng.randrange(5))
            if names and rng.random() < 0.3:
                names.append(names[0])
            values = {
                "relation_id": rng.randrange(1, 5),
                "namespace": "s",
                "relation": f"t{rng.randrange(100)}",
                "columns": names,
            }
            keys = random.Random(seed * 1000 + pos)  # apart, so that the rest stays as it was
            values["identity"] = keys.choice(["d", "d", "f", "f", "i", "n", None])
            values["key_flags"] = keys.choice([[keys.random() < 0.5 for _ in names], None])
        elif kind in ("I", "U", "D"):
            values = {"relation_id": rng.randrange(1, 5)}
            if kind != "I" and rng.random() < 0.7:
                values["old_tuple"] = random_tuple(rng)
            if kind != "D":
                values["new_tuple"] = random_tuple(rng)
        rows.append(message(slot, pos, kind, **values))
    return rows


def random_tuple(rng):
    kinds = rng.choices("ntub", k=rng.randrange(6))
    return [(k, rng.choice(["", "x", 'q"\\', "é\n"]) if k in "tb" else None) for k in kinds]


def image(columns, entries):
    """Row image as a dict; None when the message carries no tuple."""
    if entries is None:
        return None
    row = {}
    for name, (kind, value) in zip(columns, entries):
        if kind == "n":
            row[name] = None
        elif kind == "u":
            row[name] = "<unchanged>"
        elif kind == "t":
            row[name] = value
    return row


def run_model(rows: list[dict], loaded: int = 0, described=None):
    """One message after the other: stored transactions, changes, checkpoint saves.

    ``described``: called with the relation and the message of each change, for one more
    value of the change."""
    relations, current, mark = {}, None, loaded
    stored, transactions, changes, saves = set(), [], [], []
    for m in rows:
        kind = m["kind"]
        if kind == "B":
            current = {"xid": m["xid"], "begin_lsn": m["lsn"], "changes": []}
        elif kind == "C":
            if current and current["changes"]:
                high, low = m["lsn"].split("/")
                number = (int(high, 16) << 32) + int(low, 16)
                if number not in stored:
                    stored.add(number)
                    transactions.append(
                        (m["slot"], current["xid"], current["begin_lsn"], m["lsn"], m["commit_ts"], len(current["changes"]))
                    )
                    changes += [(m["slot"], m["lsn"], *c) for c in current["changes"]]
                if number > mark:
                    mark = number
                    saves.append((m["slot"], m["pos"], number))
            current = None
        elif kind == "R":
            relations[m["relation_id"]] = m
        elif kind in ("I", "U", "D"):
            relation = relations.get(m["relation_id"])
            if relation is None or current is None:
                continue
            columns = relation["columns"]
            current["changes"].append(
                (
                    len(current["changes"]) + 1,
                    relation["namespace"],
                    relation["relation"],
                    m["relation_id"],
                    kind,
                    image(columns, m["old_tuple"]) if kind != "I" else None,
                    image(columns, m["new_tuple"]) if kind != "D" else None,
                    *([described(relation, m)] if described else []),
                )
            )
    return transactions, changes, saves, mark


def as_json(value):
    return None if value is None else json.dumps(value, sort_keys=True)


def parsed(text):
    return None if text is None else as_json(json.loads(text))


def model_changes(changes):
    return sorted(repr((*c[:7], as_json(c[7]), as_json(c[8]))) for c in changes)


def spark_changes(frame):
    return sorted(
        repr(
            (
                r.source_slot, r.commit_lsn, r.change_seq_in_txn, r.schema_name, r.table_name, r.table_oid, r.op,
                parsed(r.old_row), parsed(r.new_row),
            )
        )
        for r in frame.collect()
    )


def spark_transactions(frame):
    return sorted(
        repr((r.source_slot, r.xid, r.begin_lsn, r.commit_lsn, r.commit_ts, r.change_count)) for r in frame.collect()
    )
