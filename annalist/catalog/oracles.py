"""The same results as plain SQL over the given tables, for comparison only."""

from __future__ import annotations

EVENTS = """
base AS (
  SELECT event_id, user_id, ts, props,
         CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'updated' END AS type
  FROM events),
ev AS (
  SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS trail_id, type, props AS payload,
         ts AS occured_at, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence
  FROM base),
tr AS (
  SELECT CAST(user_id AS VARCHAR) AS id, 'user-' || user_id AS name, min(ts) AS created_at, max(ts) AS updated_at
  FROM base GROUP BY user_id
  UNION ALL
  SELECT 'empty-' || i, 'nothing-' || i, TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-01 00:00:00'
  FROM range(1, 3) r(i)),
tr_before AS (
  SELECT tr.id, tr.name, tr.created_at, CASE WHEN tr.id LIKE 'empty%' THEN tr.updated_at ELSE coalesce(s.last, tr.created_at) END AS updated_at
  FROM tr LEFT JOIN (SELECT CAST(user_id AS VARCHAR) AS id, max(ts) AS last FROM base WHERE event_id % 10 <> 9 GROUP BY 1) s
    ON s.id = tr.id),
req AS (
  SELECT CAST(user_id AS VARCHAR) AS trail_id,
         CASE WHEN user_id % 17 = 0 THEN '' WHEN user_id % 19 = 0 THEN 'x' ELSE CAST(user_id % 30 AS VARCHAR) END AS from_text
  FROM (SELECT DISTINCT user_id FROM base)),
args AS (
  SELECT trail_id, from_text,
         CASE WHEN from_text = '' THEN 1 ELSE TRY_CAST(from_text AS BIGINT) END AS from_sequence,
         CASE WHEN from_text <> '' AND TRY_CAST(from_text AS BIGINT) IS NULL
              THEN 'invalid ''from'' query parameter' ELSE 'accepted' END AS status
  FROM req),
stored AS (
  SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS trail_id, type, props AS payload,
         ts AS occured_at, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence
  FROM base WHERE event_id % 10 <> 9),
pending AS (
  SELECT CAST(event_id AS VARCHAR) AS id,
         CAST(user_id AS VARCHAR) || CASE WHEN user_id % 13 = 0 THEN '-missing' ELSE '' END AS trail_id,
         type, props AS payload, ts AS occured_at, event_id AS arrival
  FROM base WHERE event_id % 10 = 9),
added AS (
  SELECT p.id, p.trail_id, p.type, p.payload, p.occured_at,
         coalesce(c.n, 0) + row_number() OVER (PARTITION BY p.trail_id ORDER BY p.arrival) AS sequence
  FROM pending p JOIN tr ON tr.id = p.trail_id
  LEFT JOIN (SELECT trail_id, count(*) AS n FROM stored GROUP BY 1) c ON c.trail_id = p.trail_id),
creq AS (
  SELECT CAST(o_custkey AS VARCHAR) AS id, 'customer-' || o_orderpriority AS name, o_orderdate AS requested_at,
         o_orderkey AS arrival
  FROM orders),
made AS (
  SELECT id, min(arrival) AS arrival FROM creq WHERE id NOT IN (SELECT id FROM tr) GROUP BY id),
conv AS (
  SELECT conv_id || '-' || turn AS id, CAST(conv_id AS VARCHAR) AS trail_id, role AS type, turn + 1 AS sequence, text
  FROM conversations),
faulty AS (
  SELECT e.id,
         e.trail_id || CASE WHEN CAST(e.id AS BIGINT) % 500 = 4 THEN '-missing' ELSE '' END AS trail_id,
         CASE WHEN CAST(e.id AS BIGINT) % 500 <> 5 THEN e.type END AS type, e.sequence
  FROM ev e, range(1, 3) r(copy)
  WHERE r.copy = 1 OR CAST(e.id AS BIGINT) % 500 = 3)
"""

LOG = """
lines AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                               l_extendedprice, l_quantity, l_shipdate) AS rn
  FROM lineitem),
rel AS (
  SELECT o_orderkey AS k, n, o_orderkey // 400 AS v, o_orderdate AS received_at
  FROM orders, range(1, 8) r(n)
  WHERE o_orderkey % 400 < 4 AND (n < 7 OR o_orderkey >= 400)),
vals AS (
  SELECT *,
         CASE WHEN l_tax = 0 THEN NULL ELSE CAST(round(l_tax * 100) AS BIGINT) END AS tax_pct,
         CASE WHEN l_discount >= 0.08 THEN NULL ELSE CAST(round(l_discount * 100) AS BIGINT) END AS discount_pct
  FROM lines),
shown AS (
  SELECT *,
         't=' || l_orderkey || ',t=' || l_partkey || ',t=' || CAST(l_quantity AS BIGINT) || ','
         || CASE WHEN tax_pct IS NULL THEN 'n=' ELSE 't=' || tax_pct END || ','
         || CASE WHEN discount_pct IS NULL THEN 'u=' ELSE 't=' || discount_pct END || ','
         || CASE WHEN l_linestatus = 'F' THEN 'b=F' ELSE 't=' || l_linestatus END AS tup,
         '"orderkey":"' || l_orderkey || '","partkey":"' || l_partkey || '","quantity":"' || CAST(l_quantity AS BIGINT) || '"' AS head,
         ',"tax_pct":' || CASE WHEN tax_pct IS NULL THEN 'null' ELSE '"' || tax_pct || '"' END
         || ',"discount_pct":"' || CASE WHEN discount_pct IS NULL THEN '<unchanged>' ELSE CAST(discount_pct AS VARCHAR) END || '"' AS rest,
         CASE WHEN l_linestatus = 'F' THEN '' ELSE ',"status":"' || l_linestatus || '"' END AS tail,
         (l_returnflag = 'R') OR (l_returnflag = 'A' AND l_linestatus = 'O') AS has_old,
         l_returnflag <> 'R' AS has_new
  FROM vals),
once AS (
  SELECT o_orderkey AS k, 0 AS off, 'B' AS kind, o_orderkey AS xid,
         printf('%X/%X', (o_orderkey * 65536 + 16) >> 32, (o_orderkey * 65536 + 16) & 4294967295) AS lsn,
         CAST(NULL AS TIMESTAMP) AS commit_ts, CAST(NULL AS BIGINT) AS relation_id, CAST(NULL AS VARCHAR) AS namespace,
         CAST(NULL AS VARCHAR) AS relation, CAST(NULL AS VARCHAR) AS columns, NULL AS old_tuple, NULL AS new_tuple,
         CAST(NULL AS VARCHAR) AS head, NULL AS rest, NULL AS tail, o_orderdate AS received_at
  FROM orders WHERE o_orderkey % 77 <> 0
  UNION ALL
  SELECT o_orderkey, 126, 'C', NULL,
         printf('%X/%X', (o_orderkey * 65536 + 32) >> 32, (o_orderkey * 65536 + 32) & 4294967295),
         o_orderdate, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, o_orderdate
  FROM orders WHERE o_orderkey % 50 <> 0
  UNION ALL
  SELECT o_orderkey, 100, 'T', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, o_orderdate
  FROM orders WHERE o_orderkey % 91 = 0
  UNION ALL
  SELECT l_orderkey, 20 + rn, CASE l_returnflag WHEN 'N' THEN 'I' WHEN 'A' THEN 'U' ELSE 'D' END, NULL, NULL, NULL,
         16384 + l_linenumber, NULL, NULL, NULL, CASE WHEN has_old THEN tup END, CASE WHEN has_new THEN tup END,
         head, rest, tail, l_shipdate
  FROM shown),
log AS (
  SELECT 'slot_' || (k % 4) AS slot, k * 128 + off AS pos, CASE WHEN kind IN ('I', 'U', 'D') THEN off - 20 END AS line, once.* EXCLUDE (off)
  FROM once
  UNION ALL
  SELECT 'slot_' || (k % 4), k * 128 + off + shift, CASE WHEN kind IN ('I', 'U', 'D') THEN off - 20 END, once.* EXCLUDE (off)
  FROM once, (SELECT 128 * (max(o_orderkey) + 1) AS shift FROM orders) s WHERE k % 101 = 0
  UNION ALL
  SELECT 'slot_' || (k % 4), k * 128 + 1 + n, NULL, k, 'R', NULL, NULL, NULL, 16384 + n, 'sales', 'lineitem_' || n || '_v' || v,
         'orderkey,partkey,quantity,tax_pct,discount_pct' || CASE WHEN v % 2 = 0 THEN ',status' ELSE '' END,
         NULL, NULL, NULL, NULL, NULL, received_at
  FROM rel)
"""

CONTEXT = LOG + """,
ctl AS (
  SELECT slot, pos AS cpos, kind AS ckind, xid AS cxid, lsn AS clsn, commit_ts AS cts,
         lead(pos) OVER w AS npos, lead(kind) OVER w AS nkind, lead(lsn) OVER w AS nlsn, lead(commit_ts) OVER w AS nts,
         lag(kind) OVER w AS pkind
  FROM log WHERE kind IN ('B', 'C') WINDOW w AS (PARTITION BY slot ORDER BY pos)),
seg AS (
  SELECT slot, cpos AS begin_pos, CASE WHEN ckind = 'B' THEN cxid END AS xid, CASE WHEN ckind = 'B' THEN clsn END AS begin_lsn,
         CASE WHEN ckind = 'B' AND nkind = 'C' THEN npos END AS commit_pos,
         CASE WHEN ckind = 'C' THEN clsn WHEN nkind = 'C' THEN nlsn END AS commit_lsn,
         CASE WHEN ckind = 'C' THEN cts WHEN nkind = 'C' THEN nts END AS commit_ts,
         CASE WHEN ckind = 'C' THEN 'stray_commit' WHEN nkind IS NULL THEN 'open' WHEN nkind = 'C' THEN 'committed'
              ELSE 'discarded' END AS state
  FROM ctl WHERE ckind = 'B' OR coalesce(pkind, 'C') = 'C'),
chg AS (SELECT * FROM log WHERE kind IN ('I', 'U', 'D')),
rels AS (SELECT slot, relation_id, pos AS relation_pos, namespace, relation, columns FROM log WHERE kind = 'R'),
resolved AS (
  SELECT chg.* EXCLUDE (namespace, relation, columns), rels.relation_pos, rels.namespace, rels.relation, rels.columns
  FROM chg ASOF LEFT JOIN rels
    ON chg.slot = rels.slot AND chg.relation_id = rels.relation_id AND chg.pos > rels.relation_pos),
placed AS (
  SELECT a.*, c.ckind, c.cpos, c.cxid, c.clsn, c.nkind, c.npos, c.nlsn, c.nts
  FROM resolved a ASOF LEFT JOIN ctl c ON a.slot = c.slot AND a.pos > c.cpos),
kept AS (
  SELECT *, row_number() OVER (PARTITION BY slot, cpos ORDER BY pos) AS seq
  FROM placed WHERE relation_pos IS NOT NULL AND ckind = 'B'),
txn AS (
  SELECT slot, cpos AS begin_pos, npos AS commit_pos, min(cxid) AS xid, min(clsn) AS begin_lsn, min(nlsn) AS commit_lsn,
         min(nts) AS commit_ts, count(*) AS change_count,
         min(k) * 65536 + 32 AS lsn_num
  FROM kept WHERE nkind = 'C' GROUP BY slot, cpos, npos),
txn_num AS (
  SELECT * EXCLUDE (lsn_num),
         CAST('0x' || split_part(commit_lsn, '/', 1) AS BIGINT) * 4294967296
         + CAST('0x' || split_part(commit_lsn, '/', 2) AS BIGINT) AS lsn_num
  FROM txn),
won AS (
  SELECT * FROM txn_num QUALIFY row_number() OVER (PARTITION BY slot, lsn_num ORDER BY commit_pos) = 1),
images AS (
  SELECT *,
         '{' || head || rest || CASE WHEN columns LIKE '%,status' THEN tail ELSE '' END || '}' AS image
  FROM kept),
changes AS (
  SELECT i.slot AS source_slot, w.commit_lsn, i.pos, i.seq AS change_seq_in_txn, i.namespace AS schema_name,
         i.relation AS table_name, i.relation_id AS table_oid, i.kind AS op,
         CASE WHEN i.old_tuple IS NOT NULL THEN image END AS old_row,
         CASE WHEN i.new_tuple IS NOT NULL THEN image END AS new_row, w.begin_pos, w.xid
  FROM images i JOIN won w ON w.slot = i.slot AND w.begin_pos = i.cpos),
ck AS (
  SELECT 'slot_' || (o_orderkey % 4) AS slot_name, max(o_orderkey) * 65536 + 32 AS num, max(o_orderdate) AS updated_at
  FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' AND o_orderkey % 4 <> 3 GROUP BY 1),
loaded AS (
  SELECT s.slot, coalesce(ck.num, 0) AS last_lsn_num
  FROM (SELECT DISTINCT slot FROM log) s LEFT JOIN ck ON ck.slot_name = s.slot),
disp AS (
  SELECT l.slot, l.pos, l.kind, l.relation_id,
         CASE l.kind WHEN 'B' THEN 'begin' WHEN 'C' THEN CASE WHEN c.pkind = 'B' THEN 'commit' ELSE 'commit_ignored' END
                     WHEN 'R' THEN 'relation' WHEN 'T' THEN 'truncate'
                     ELSE CASE WHEN p.relation_pos IS NULL THEN 'unknown_relation'
                               WHEN coalesce(p.ckind, 'C') <> 'B' THEN 'no_transaction' ELSE 'change' END END AS disposition
  FROM log l LEFT JOIN ctl c ON c.slot = l.slot AND c.cpos = l.pos
  LEFT JOIN placed p ON p.slot = l.slot AND p.pos = l.pos)
"""


def on_events(select: str) -> str:
    return f"WITH {EVENTS} {select}"


def on_log(select: str) -> str:
    return f"WITH {CONTEXT} {select}"


def lsn_text(number: str) -> str:
    return f"printf('%X/%X', ({number}) >> 32, ({number}) & 4294967295)"


def rfc3339(column: str) -> str:
    return f"regexp_replace(strftime({column}, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0+$', '') || 'Z'"


EVENT_JSON = (
    "'{\"ID\":\"' || id || '\",\"TrailID\":\"' || trail_id || '\",\"Type\":\"' || type || '\",\"Payload\":' "
    "|| replace(payload, ' ', '') || ',\"OccuredAt\":\"' || " + rfc3339("occured_at") + " || '\",\"Sequence\":' || sequence || '}'"
)

PART = "(sequence - 1) // 40"

FRAME_HEX = """
frames AS (
  SELECT o_orderkey,
         CASE WHEN o_orderstatus = 'P' THEN head || hex('B' || CAST(o_orderkey AS VARCHAR))
              WHEN o_orderstatus = 'O' THEN hex('k' || CAST(o_orderkey AS VARCHAR))
              WHEN o_orderpriority = '1-URGENT' THEN ''
              WHEN o_orderpriority = '2-HIGH' THEN hex('wabcde')
              WHEN o_orderpriority = '3-MEDIUM' THEN hex('wabcdefghijklmnopqrst')
              WHEN o_orderpriority = '5-LOW' THEN hex('zq')
              ELSE head END AS h
  FROM (SELECT *, hex('w') || printf('%016X', o_orderkey * 65536 + 16) || printf('%016X', o_orderkey * 65536 + 32)
                  || printf('%016X', o_orderkey * 1000) AS head FROM orders)),
routed AS (
  SELECT o_orderkey, h, length(h) // 2 - 1 AS body, substr(h, 1, 2) = '77' AS is_data,
         CASE WHEN h = '' THEN 'empty_frame'
              WHEN substr(h, 1, 2) = '6B' THEN 'keepalive'
              WHEN substr(h, 1, 2) <> '77' THEN 'unknown'
              WHEN length(h) // 2 - 1 < 8 THEN 'short_lt8'
              WHEN length(h) // 2 - 1 < 24 THEN 'short_lt24'
              WHEN length(h) // 2 - 1 = 24 THEN 'empty_payload'
              ELSE 'payload' END AS outcome
  FROM frames)
"""

CHANGE_COLUMNS = (
    "source_slot, commit_lsn, change_seq_in_txn, schema_name, table_name, table_oid, op, old_row, new_row"
)

TITLE = (
    "CASE kind WHEN 'B' THEN 'BEGIN TRANSACTION' WHEN 'C' THEN 'COMMIT TRANSACTION' WHEN 'R' THEN 'RELATION/TABLE SCHEMA' "
    "WHEN 'I' THEN 'INSERT OPERATION' WHEN 'U' THEN 'UPDATE OPERATION' WHEN 'D' THEN 'DELETE OPERATION' "
    "ELSE 'TRUNCATE OPERATION' END"
)


def lines(prefix: str) -> str:
    """Trace lines of a row, from the same values the JSON image is made of."""
    return f"""chr(10) || '{prefix}:' || chr(10) || '    orderkey: "' || l_orderkey || '"' || chr(10) || '    partkey: "' || l_partkey || '"'
    || chr(10) || '    quantity: "' || CAST(l_quantity AS BIGINT) || '"'
    || chr(10) || '    tax_pct: ' || CASE WHEN tax_pct IS NULL THEN 'NULL' ELSE '"' || tax_pct || '"' END
    || chr(10) || '    discount_pct: ' || CASE WHEN discount_pct IS NULL THEN '<unchanged>' ELSE '"' || discount_pct || '"' END
    || CASE WHEN p.columns LIKE '%,status' THEN chr(10) || '    status: "' || l_linestatus || '"'
            || CASE WHEN l_linestatus = 'F' THEN ' (type: b)' ELSE '' END ELSE '' END"""


ORACLES: dict[str, str] = {
    "scan_trails": on_events("SELECT id, name, created_at, updated_at FROM tr"),
    "scan_events": on_events("SELECT id, trail_id, type, payload, occured_at, sequence FROM ev"),
    "trail_lookup": on_events(
        "SELECT r.id, tr.name, tr.created_at, tr.updated_at, tr.id IS NOT NULL AS found "
        "FROM (SELECT DISTINCT id FROM creq) r LEFT JOIN tr ON tr.id = r.id"
    ),
    "trail_length": on_events(
        "SELECT tr.id AS trail_id, count(ev.id) AS length FROM tr LEFT JOIN ev ON ev.trail_id = tr.id GROUP BY tr.id"
    ),
    "trail_assemble": on_events(
        "SELECT tr.id, tr.name, ev.id AS event_id, ev.type AS event_type, ev.payload AS event_payload, "
        "ev.occured_at AS event_occured_at, CAST(ev.sequence AS VARCHAR) AS sequence FROM tr LEFT JOIN ev ON ev.trail_id = tr.id"
    ),
    "trail_nested": on_events(
        f"SELECT tr.id, tr.name, coalesce({PART}, 0) AS part, count(ev.id) AS n_events, "
        "coalesce(string_agg(ev.sequence || ':' || ev.type || ':' || ev.id, ',' ORDER BY ev.sequence), '') AS events "
        "FROM tr LEFT JOIN ev ON ev.trail_id = tr.id GROUP BY 1, 2, 3"
    ),
    "trail_list": on_events(
        "SELECT tr.id, tr.name, tr.created_at, tr.updated_at, ev.id AS event_id, ev.type AS event_type, "
        "CAST(ev.sequence AS VARCHAR) AS sequence FROM tr LEFT JOIN ev ON ev.trail_id = tr.id ORDER BY 3 DESC, 1, ev.sequence"
    ),
    "replay_args": on_events("SELECT trail_id, from_text, CAST(from_sequence AS VARCHAR) AS from_sequence, status FROM args"),
    "replay_from_sequence": on_events(
        "SELECT ev.* FROM ev JOIN args USING (trail_id) WHERE status = 'accepted' AND sequence >= from_sequence"
    ),
    "conversation_replay": on_events(
        "SELECT id, trail_id, type, sequence, md5(text) AS text_md5 FROM conv WHERE sequence >= 2"
    ),
    "event_type_counts": on_events(
        "SELECT type, count(*) AS events, type IN ('created', 'updated', 'deleted', 'replayed') AS named FROM base GROUP BY type"
    ),
    "trail_create": on_events(
        "SELECT m.id, c.name, c.requested_at AS created_at, c.requested_at AS updated_at, m.arrival "
        "FROM made m JOIN creq c ON c.id = m.id AND c.arrival = m.arrival"
    ),
    "trail_create_rejects": on_events(
        "SELECT c.id, c.arrival, 'already exists' AS reason FROM creq c "
        "WHERE NOT EXISTS (SELECT 1 FROM made m WHERE m.id = c.id AND m.arrival = c.arrival)"
    ),
    "trail_append": on_events(
        "SELECT id, trail_id, type, payload, occured_at, sequence FROM stored UNION ALL SELECT * FROM added"
    ),
    "trail_touch": on_events(
        "SELECT tr.id, tr.name, tr.created_at, greatest(tr.updated_at, coalesce(a.last, tr.updated_at)) AS updated_at "
        "FROM tr_before tr LEFT JOIN (SELECT trail_id, max(occured_at) AS last FROM added GROUP BY 1) a ON a.trail_id = tr.id"
    ),
    "append_rejects": on_events(
        "SELECT id, trail_id, type, 'not found' AS reason FROM pending WHERE trail_id NOT IN (SELECT id FROM tr)"
    ),
    "trail_update": on_events(
        "SELECT tr.id, coalesce(u.name, tr.name) AS name, tr.created_at, CASE WHEN u.id IS NULL THEN tr.updated_at ELSE TIMESTAMP '2024-06-01' END AS updated_at "
        "FROM tr LEFT JOIN (SELECT * FROM creq QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrival DESC) = 1) u "
        "ON u.id = tr.id"
    ),
    "trail_update_rejects": on_events(
        "SELECT id, arrival, 'not found' AS reason FROM creq WHERE id NOT IN (SELECT id FROM tr)"
    ),
    "trail_replace_events": on_events(
        "SELECT id, trail_id, type, sequence, md5(payload::JSON ->> 'k') AS content_md5 FROM ev "
        "WHERE trail_id NOT IN (SELECT trail_id FROM conv) UNION ALL "
        "SELECT id, trail_id, type, sequence, md5(text) FROM conv WHERE trail_id IN (SELECT id FROM tr)"
    ),
    "cascade_delete": on_events(
        "SELECT 'trail' AS level, id, CAST(NULL AS VARCHAR) AS trail_id FROM tr "
        "WHERE id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1) UNION ALL "
        "SELECT 'event', id, trail_id FROM ev "
        "WHERE trail_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)"
    ),
    "cascade_delete_wal": on_log(
        "SELECT slot AS source_slot, commit_lsn, 'transaction' AS level, count(*) AS n FROM won "
        "WHERE xid NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1, 2 UNION ALL "
        "SELECT source_slot, commit_lsn, 'change', count(*) FROM changes "
        "WHERE xid NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1, 2"
    ),
    "event_id_stable": on_events("SELECT id, sha256(trail_id || '|' || sequence) AS stable_id FROM ev"),
    "payload_decode": """
        SELECT event_id,
               CASE WHEN event_type = 'signup' THEN 'object'
                    WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'null'
                    WHEN event_type IN ('click', 'view', 'purchase') OR event_id % 2 = 0 THEN 'error' ELSE 'null' END AS class,
               CASE WHEN event_type = 'signup' THEN props::JSON ->> 'k' END AS k,
               CASE WHEN event_type = 'signup' THEN '{"k":"' || (props::JSON ->> 'k') || '"}' END AS encoded
        FROM events""",
    "payload_roundtrip": "SELECT doc_id, 'object' AS class, md5(text) AS text_md5 FROM documents",
    "lsn_parse": f"""
        SELECT o_orderkey,
               CASE o_orderstatus WHEN 'F' THEN 'F' || printf('%07X', o_orderkey) || '/' || lower(printf('%X', o_orderkey))
                                  WHEN 'P' THEN 'bad-' || o_orderkey ELSE {lsn_text('o_orderkey * 65536 + 16')} END AS lsn,
               CASE o_orderstatus WHEN 'F' THEN CAST((CAST(4026531840 AS HUGEINT) + o_orderkey) * 4294967296 + o_orderkey AS VARCHAR)
                                  WHEN 'P' THEN NULL ELSE CAST(o_orderkey * 65536 + 16 AS VARCHAR) END AS number,
               o_orderstatus <> 'P' AS valid
        FROM orders""",
    "lsn_format": f"""
        SELECT o_orderkey, {lsn_text('o_orderkey * 1099511627776 + o_custkey')} AS lsn, {lsn_text('o_custkey')} AS small_lsn
        FROM orders""",
    "lsn_order": on_log(
        "SELECT slot, pos, lsn, CAST(k * 65536 + 32 AS VARCHAR) AS lsn_num, "
        "row_number() OVER (PARTITION BY slot ORDER BY k * 65536 + 32, pos) AS place FROM log WHERE kind = 'C'"
    ),
    "wal_message_scan": on_log(
        "SELECT slot, pos, kind, CAST(xid AS VARCHAR) AS xid, lsn, commit_ts, CAST(relation_id AS VARCHAR) AS relation_id, "
        "namespace, relation, columns, old_tuple, new_tuple FROM log"
    ),
    "wal_frame_route": f"""
        WITH {FRAME_HEX}
        SELECT o_orderkey, outcome,
               CASE WHEN is_data AND body >= 24 THEN CAST(CAST('0x' || substr(h, 3, 16) AS BIGINT) AS VARCHAR) END AS wal_start,
               CASE WHEN is_data AND body >= 24 THEN CAST(CAST('0x' || substr(h, 19, 16) AS BIGINT) AS VARCHAR) END AS wal_end,
               CASE WHEN is_data AND body >= 24 THEN CAST(CAST('0x' || substr(h, 35, 16) AS BIGINT) AS VARCHAR) END AS sent_at,
               CASE WHEN is_data AND body > 24 THEN substr(h, 51) END AS payload_hex,
               CASE WHEN is_data AND body >= 24 THEN {lsn_text("CAST('0x' || substr(h, 3, 16) AS BIGINT)")} END AS change_lsn
        FROM routed""",
    "wal_disposition": on_log("SELECT slot, pos, kind, CAST(relation_id AS VARCHAR) AS relation_id, disposition FROM disp"),
    "wal_message_stats": on_log(
        "SELECT slot, kind, disposition, count(*) AS messages FROM disp GROUP BY 1, 2, 3"
    ),
    "wal_segments": on_log(
        "SELECT slot, begin_pos, CAST(xid AS VARCHAR) AS xid, begin_lsn, CAST(commit_pos AS VARCHAR) AS commit_pos, "
        "commit_lsn, commit_ts, state FROM seg"
    ),
    "wal_relation_asof": on_log(
        "SELECT slot, pos, kind, relation_id, relation_pos, namespace AS schema_name, relation AS table_name, columns "
        "FROM resolved WHERE relation_pos IS NOT NULL"
    ),
    "wal_orphan_changes": on_log(
        "SELECT slot, pos, kind, relation_id FROM disp WHERE disposition = 'no_transaction'"
    ),
    "wal_unknown_relation": on_log(
        "SELECT slot, pos, kind, relation_id FROM disp WHERE disposition = 'unknown_relation'"
    ),
    "wal_empty_txn": on_log(
        "SELECT slot, begin_pos, xid, begin_lsn, commit_pos, commit_lsn, commit_ts FROM seg s WHERE state = 'committed' "
        "AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.slot = s.slot AND k.cpos = s.begin_pos)"
    ),
    "wal_tuple_to_row": on_log(
        "SELECT slot, pos, CASE WHEN new_tuple IS NOT NULL THEN '{' || head || rest || tail || '}' END AS row, "
        "CASE WHEN new_tuple IS NOT NULL THEN '{' || head || '}' END AS cut_row FROM chg"
    ),
    "wal_row_images": on_log("SELECT source_slot, pos, op, old_row, new_row FROM changes"),
    "wal_change_seq": on_log("SELECT source_slot, pos, commit_lsn, change_seq_in_txn FROM changes"),
    "wal_txn_rollup": on_log(
        "SELECT slot, begin_pos, commit_pos, xid, begin_lsn, commit_lsn, commit_ts, change_count FROM txn"
    ),
    "wal_dedup": on_log("SELECT slot, begin_pos, commit_lsn FROM won"),
    "wal_persist_txn": on_log(
        "SELECT slot AS source_slot, 'traildb' AS source_db, xid, begin_lsn, commit_lsn, commit_ts, change_count FROM won"
    ),
    "wal_persist_change": on_log(f"SELECT {CHANGE_COLUMNS} FROM changes"),
    "wal_defaults": on_log("""
        SELECT source_slot, commit_lsn, CAST(change_seq_in_txn AS VARCHAR) AS change_seq_in_txn, CAST(NULL AS VARCHAR) AS change_lsn,
               CAST(NULL AS VARCHAR) AS tenant_id, schema_name, table_name, CAST(table_oid AS VARCHAR) AS table_oid, op,
               CAST(NULL AS VARCHAR) AS replica_identity_mode, CAST(NULL AS VARCHAR) AS row_pk,
               CAST(0 AS BIGINT) AS changed_columns, '' AS forward_dml_sql, '' AS reverse_dml_sql,
               CAST(NULL AS VARCHAR) AS forward_sql_hash, CAST(NULL AS VARCHAR) AS reverse_sql_hash,
               CAST(NULL AS VARCHAR) AS reverse_where_sql, '1' AS affected_row_count,
               'not_applied' AS undo_status, CAST(NULL AS TIMESTAMP) AS undo_applied_at,
               CAST(NULL AS VARCHAR) AS undo_applied_by, CAST(0 AS BIGINT) AS safety_flags,
               TIMESTAMP '2024-01-01 00:00:00' AS created_at
        FROM changes"""),
    "wal_txn_defaults": on_log("""
        SELECT slot AS source_slot, 'traildb' AS source_db, CAST(xid AS VARCHAR) AS xid, begin_lsn, commit_lsn,
               CAST(lsn_num AS VARCHAR) AS commit_lsn_num, CAST(NULL AS VARCHAR) AS end_lsn, commit_ts,
               CAST(NULL AS VARCHAR) AS origin_name, CAST(NULL AS VARCHAR) AS tenant_id, CAST(change_count AS VARCHAR) AS change_count,
               CAST(NULL AS VARCHAR) AS forward_sql_text, CAST(NULL AS VARCHAR) AS reverse_sql_text,
               CAST(NULL AS VARCHAR) AS forward_sql_hash, CAST(NULL AS VARCHAR) AS reverse_sql_hash,
               CAST(0 AS BIGINT) AS safety_flags, CAST(NULL AS VARCHAR) AS ingest_batch_id,
               TIMESTAMP '2024-01-01 00:00:00' AS ingested_at
        FROM won"""),
    "trail_defaults": on_events("""
        SELECT 'trail' AS level, id, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN created_at ELSE TIMESTAMP '2024-03-03' END AS created_at,
               TIMESTAMP '2024-03-03' AS updated_at
        FROM tr WHERE id NOT LIKE 'empty%'
        UNION ALL
        SELECT 'event', id, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN occured_at ELSE TIMESTAMP '2024-03-03' END, NULL FROM ev"""),
    "wal_checkpoint_load": on_log("SELECT slot, last_lsn_num FROM loaded"),
    "wal_checkpoint_history": on_log(
        f"SELECT slot, pos, commit_lsn_num, {lsn_text('commit_lsn_num')} AS last_lsn FROM ("
        "SELECT t.slot, t.commit_pos AS pos, t.lsn_num AS commit_lsn_num, l.last_lsn_num, "
        "max(t.lsn_num) OVER (PARTITION BY t.slot ORDER BY t.commit_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top "
        "FROM txn_num t JOIN loaded l ON l.slot = t.slot) WHERE commit_lsn_num > greatest(coalesce(top, 0), last_lsn_num)"
    ),
    "wal_checkpoint_final": on_log(
        f"SELECT slot, last_lsn_num, {lsn_text('last_lsn_num')} AS last_lsn FROM ("
        "SELECT l.slot, greatest(l.last_lsn_num, coalesce(max(t.lsn_num), 0)) AS last_lsn_num "
        "FROM loaded l LEFT JOIN txn_num t ON t.slot = l.slot GROUP BY l.slot, l.last_lsn_num)"
    ),
    "wal_checkpoint_upsert": on_log(
        "SELECT slot AS slot_name, lsn AS last_lsn, k * 65536 + 32 AS last_lsn_num, commit_ts AS updated_at FROM log "
        "WHERE kind = 'C' AND slot <> 'slot_2' QUALIFY row_number() OVER (PARTITION BY slot ORDER BY pos DESC) = 1 "
        f"UNION ALL SELECT slot_name, {lsn_text('num')}, num, updated_at FROM ck WHERE slot_name = 'slot_2'"
    ),
    "wal_resume": on_log(
        "SELECT s.slot, s.begin_pos, s.commit_pos, s.xid, s.commit_lsn FROM seg s JOIN loaded l ON l.slot = s.slot "
        "WHERE state = 'committed' AND CAST('0x' || split_part(s.commit_lsn, '/', 1) AS BIGINT) * 4294967296 "
        "+ CAST('0x' || split_part(s.commit_lsn, '/', 2) AS BIGINT) >= l.last_lsn_num"
    ),
    "wal_trace_text": on_log(f"""
        SELECT l.slot, l.pos, l.kind,
               '[' || strftime(l.received_at, '%Y-%m-%d %H:%M:%S') || '.000] ' || {TITLE.replace('kind', 'l.kind', 1)}
               || CASE WHEN l.kind = 'B' THEN chr(10) || '  Transaction ID: ' || l.xid ELSE '' END
               || CASE WHEN l.kind IN ('B', 'C') THEN chr(10) || '  LSN: ' || l.lsn ELSE '' END
               || CASE WHEN l.kind IN ('R', 'I', 'U', 'D') THEN chr(10) || '  Relation ID: ' || l.relation_id ELSE '' END
               || CASE WHEN l.kind = 'R' THEN chr(10) || '  Namespace: ' || l.namespace || chr(10) || '  Table: ' || l.relation
                       || chr(10) || '  Columns: ' || len(string_split(l.columns, ',')) || chr(10)
                       || array_to_string(list_transform(string_split(l.columns, ','),
                            lambda c, i: '    Column ' || (i - 1) || ': ' || c || ' (Type: ' || (i + 19) || ')'), chr(10)) ELSE '' END
               || CASE WHEN l.kind = 'T' THEN chr(10) || '  Relations: [16385 ' || (16385 + l.k % 7) || ']' ELSE '' END
               || CASE WHEN l.kind IN ('I', 'U', 'D') THEN chr(10) || '  Table: '
                       || CASE WHEN p.relation_pos IS NULL THEN 'Unknown (relation ' || l.relation_id || ')'
                               ELSE p.namespace || '.' || p.relation END ELSE '' END
               || CASE WHEN p.relation_pos IS NOT NULL AND l.kind = 'U' AND l.old_tuple IS NOT NULL THEN {lines('  Old Row')} ELSE '' END
               || CASE WHEN p.relation_pos IS NOT NULL AND l.kind = 'D' AND l.old_tuple IS NOT NULL THEN {lines('  Deleted Row')} ELSE '' END
               || CASE WHEN p.relation_pos IS NOT NULL AND l.kind IN ('I', 'U') THEN {lines('  New Row')} ELSE '' END
               || CASE WHEN l.kind IN ('I', 'U', 'D') AND p.relation_pos IS NULL THEN '' ELSE chr(10) || '  ---' END AS trace
        FROM log l LEFT JOIN resolved p ON p.slot = l.slot AND p.pos = l.pos
        LEFT JOIN vals v ON v.l_orderkey = l.k AND v.rn = l.line"""),
    "audit_pk": on_events(
        "SELECT id, count(*) AS copies, 'events_pk' AS rule FROM faulty GROUP BY id HAVING count(*) > 1 UNION ALL "
        "SELECT id, 2, 'trails_pk' FROM tr WHERE id NOT LIKE 'empty%' AND CAST(CASE WHEN id LIKE 'empty%' THEN '0' ELSE id END AS BIGINT) % 50 = 7"
    ),
    "audit_event_fk": on_events(
        "SELECT id, trail_id, 'events_trail_fk' AS rule FROM faulty WHERE trail_id NOT IN (SELECT id FROM tr)"
    ),
    "audit_sequence": on_events(
        "SELECT trail_id, sequence, count(*) AS copies, 'events_trail_sequence' AS rule FROM faulty "
        "GROUP BY 1, 2 HAVING count(*) > 1"
    ),
    "audit_length": """
        SELECT CAST(doc_id AS VARCHAR) AS id, 'name' AS "column", 'trails_length' AS rule, length(text) AS n_chars
        FROM documents WHERE length(text) > 255
        UNION ALL
        SELECT CAST(page_id AS VARCHAR), 'type', 'events_length', length(url) FROM pages WHERE length(url) > 50""",
    "audit_op": on_log("SELECT slot, pos, kind AS op, 'op' AS rule FROM log WHERE kind NOT IN ('I', 'U', 'D')"),
    "audit_wal_keys": on_log(
        "SELECT slot, CAST(NULL AS VARCHAR) AS xid, commit_lsn, count(*) AS copies, 'slot_commit_lsn' AS rule FROM txn "
        "GROUP BY 1, 3 HAVING count(*) > 1 UNION ALL "
        "SELECT slot, CAST(xid AS VARCHAR), commit_lsn, count(*), 'slot_xid_commit_lsn' FROM txn GROUP BY 1, 2, 3 HAVING count(*) > 1 "
        "UNION ALL SELECT source_slot, NULL, commit_lsn, 2, 'change_seq' FROM changes WHERE table_oid = 16390"
    ),
    "audit_change_fk": on_log(
        "SELECT k.slot, k.cpos AS begin_pos, 'change_transaction_fk' AS rule, count(*) AS n FROM kept k "
        "WHERE NOT EXISTS (SELECT 1 FROM won w WHERE w.slot = k.slot AND w.begin_pos = k.cpos) GROUP BY 1, 2"
    ),
    "stream_capture": on_log(f"SELECT {CHANGE_COLUMNS} FROM changes"),
    "stream_append": on_events("SELECT * FROM added"),
}

ORACLES["new_trail_stamps"] = on_events(
    "SELECT c.name, count(*) AS n, true AS ids_differ, true AS ids_are_uuids, true AS stamps_in_order, true AS one_moment "
    "FROM made m JOIN creq c ON c.id = m.id AND c.arrival = m.arrival GROUP BY c.name"
)
ORACLES["stream_restart"] = ORACLES["stream_capture"]
ORACLES["wal_checkpoint_stored"] = on_log(
    f"SELECT slot AS slot_name, {lsn_text('num')} AS last_lsn, num AS last_lsn_num, "
    "CASE WHEN num > first THEN TIMESTAMP '2025-01-01' ELSE TIMESTAMP '2024-01-01' END AS updated_at FROM ("
    "SELECT t.slot, max(lsn_num) AS num, max(CASE WHEN commit_pos < s.shift AND (t.slot IN ('slot_0', 'slot_1') "
    "OR commit_pos < h.middle) THEN lsn_num END) AS first, s.shift FROM txn_num t, "
    "(SELECT 128 * (max(o_orderkey) + 1) AS shift FROM orders) s, "
    "(SELECT (min(pos) + max(pos)) // 2 AS middle FROM log WHERE pos < (SELECT 128 * (max(o_orderkey) + 1) FROM orders)) h "
    "GROUP BY t.slot, s.shift)"
)
ORACLES["trail_create_events"] = on_events(
    "SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS trail_id, o_orderstatus AS type, "
    "'{\"priority\":\"' || o_orderpriority || '\"}' AS payload, o_orderdate AS occured_at, "
    "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS sequence "
    "FROM orders WHERE CAST(o_custkey AS VARCHAR) IN (SELECT id FROM made)"
)
FAULTS = "CAST(id AS BIGINT) % 1191 IN (5, 402, 799)"


def documents(trails: str, events: str, faults: str = "false") -> str:
    """Fragments of the documents of trails, and the trails with a faulty payload."""
    return (
        f"bad AS (SELECT DISTINCT trail_id FROM {events} WHERE {faults}), "
        f"good AS (SELECT * FROM {trails} WHERE id NOT IN (SELECT trail_id FROM bad)), "
        "frag AS (SELECT id, 0 AS section, CAST(NULL AS VARCHAR) AS sequence, CAST(NULL AS VARCHAR) AS event_id, "
        "'{\"ID\":\"' || id || '\",\"Name\":\"' || replace(name, '\"', '\\\"') || '\",\"Events\":[' AS json FROM good "
        "UNION ALL SELECT trail_id, 1, CAST(sequence AS VARCHAR), id, "
        f"CASE WHEN row_number() OVER (PARTITION BY trail_id ORDER BY sequence) = 1 THEN '' ELSE ',' END || {EVENT_JSON} "
        f"FROM {events} WHERE trail_id IN (SELECT id FROM good) "
        f"UNION ALL SELECT id, 2, NULL, NULL, '],\"CreatedAt\":\"' || {rfc3339('created_at')} || '\",\"UpdatedAt\":\"' "
        f"|| {rfc3339('updated_at')} || '\"}}' FROM good "
        f"UNION ALL SELECT id, -1, NULL, NULL, 'unreadable payload' FROM {trails} WHERE id IN (SELECT trail_id FROM bad))"
    )


ORACLES["trail_export_json"] = f"WITH {EVENTS}, {documents('tr', 'ev', FAULTS)} SELECT * FROM frag"
ORACLES["service_list"] = ORACLES["trail_export_json"]
ORACLES["service_get"] = ORACLES["trail_export_json"] + (
    " WHERE id IN (SELECT id FROM creq) UNION ALL SELECT DISTINCT id, -1, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 'not found' FROM creq "
    "WHERE id NOT IN (SELECT id FROM tr)"
)
ORACLES["trail_export_long"] = (
    f"WITH {EVENTS}, longev AS (SELECT CAST(event_id AS VARCHAR) AS id, 'all-' || type AS trail_id, type, props AS payload, "
    "ts AS occured_at, row_number() OVER (PARTITION BY type ORDER BY event_id) AS sequence FROM base), "
    "longtr AS (SELECT DISTINCT trail_id AS id, 'by \"type\"' AS name, TIMESTAMP '2024-01-01' AS created_at, "
    f"TIMESTAMP '2024-01-01' AS updated_at FROM longev), {documents('longtr', 'longev')} SELECT * FROM frag"
)
ORACLES["replay_export_json"] = on_events(
    ", rep AS (SELECT ev.* FROM ev JOIN args USING (trail_id) WHERE status = 'accepted' AND sequence >= from_sequence), "
    f"bad AS (SELECT DISTINCT trail_id FROM rep WHERE {FAULTS}), "
    "want AS (SELECT trail_id, trail_id IN (SELECT trail_id FROM rep) AS found FROM args "
    "WHERE status = 'accepted' AND trail_id NOT IN (SELECT trail_id FROM bad)) "
    "SELECT trail_id AS id, 0 AS section, CAST(NULL AS VARCHAR) AS sequence, CAST(NULL AS VARCHAR) AS event_id, "
    "CASE WHEN found THEN '[' ELSE 'null' END AS json FROM want "
    "UNION ALL SELECT trail_id, 1, CAST(sequence AS VARCHAR), id, "
    f"CASE WHEN row_number() OVER (PARTITION BY trail_id ORDER BY sequence) = 1 THEN '' ELSE ',' END || {EVENT_JSON} "
    "FROM rep WHERE trail_id NOT IN (SELECT trail_id FROM bad) "
    "UNION ALL SELECT trail_id, 2, NULL, NULL, ']' FROM want WHERE found "
    "UNION ALL SELECT trail_id, -1, NULL, NULL, 'unreadable payload' FROM bad"
)
ORACLES["service_replay"] = on_events(
    "SELECT trail_id, event_id, result FROM ("
    "SELECT r.trail_id, ev.id AS event_id, CASE WHEN r.start IS NULL THEN 'invalid ''from'' query parameter' "
    "WHEN tr.id IS NULL THEN 'not found' ELSE CAST(ev.sequence AS VARCHAR) END AS result FROM ("
    "SELECT CAST(c_custkey AS VARCHAR) AS trail_id, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN NULL "
    "ELSE c_nationkey END AS start FROM customer) r "
    "LEFT JOIN tr ON tr.id = r.trail_id AND r.start IS NOT NULL "
    "LEFT JOIN ev ON ev.trail_id = tr.id AND ev.sequence >= r.start) WHERE result IS NOT NULL"
)
ORACLES["audit_pk"] = f"WITH {EVENTS}, {LOG} " + ORACLES["audit_pk"].split(EVENTS)[1] + (
    " UNION ALL SELECT 'slot_3', 2, 'wal_checkpoint_pk'"
)
ORACLES["audit_not_null"] = f"WITH {EVENTS}, {CONTEXT} " + (
    "SELECT id, 'type' AS \"column\", 'events_not_null' AS rule FROM faulty WHERE type IS NULL UNION ALL "
    "SELECT id, 'name', 'trails_not_null' FROM tr WHERE id NOT LIKE 'empty%' "
    "AND CAST(CASE WHEN id LIKE 'empty%' THEN '0' ELSE id END AS BIGINT) % 40 = 3 UNION ALL "
    "SELECT slot || ':' || commit_lsn, 'commit_ts', 'wal_transaction_not_null' FROM won WHERE xid % 70 = 2 OR commit_ts IS NULL UNION ALL "
    "SELECT source_slot || ':' || commit_lsn || ':' || change_seq_in_txn, 'op', 'wal_change_not_null' FROM changes WHERE table_oid = 16387 UNION ALL "
    "SELECT source_slot || ':' || commit_lsn || ':' || change_seq_in_txn, 'table_name', 'wal_change_not_null' FROM changes "
    "WHERE change_seq_in_txn = 6 UNION ALL "
    "SELECT DISTINCT slot, 'last_lsn', 'wal_checkpoint_not_null' FROM txn_num"
)
ORACLES["service_append"] = on_events(
    "SELECT id, trail_id, CAST(sequence AS VARCHAR) AS result FROM added UNION ALL "
    "SELECT id, trail_id, 'not found' FROM pending WHERE trail_id NOT IN (SELECT id FROM tr)"
)
ORACLES["service_update"] = on_events(
    "SELECT 'trail' AS level, tr.id, coalesce(u.name, tr.name) || '|' || CASE WHEN u.id IS NULL "
    "THEN rtrim(rtrim(strftime(tr.updated_at, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') ELSE '2024-06-01 00:00:00' END AS content "
    "FROM tr LEFT JOIN (SELECT * FROM creq QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrival DESC) = 1) u ON u.id = tr.id "
    "UNION ALL SELECT 'event', id, trail_id || '|' || type || '|' || sequence FROM ev WHERE trail_id NOT IN (SELECT id FROM creq) "
    "UNION ALL SELECT 'event', CAST(o_orderkey AS VARCHAR), o_custkey || '|' || o_orderstatus || '|' "
    "|| row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) FROM orders "
    "WHERE CAST(o_custkey AS VARCHAR) IN (SELECT id FROM tr) "
    "UNION ALL SELECT 'refused', id, arrival || '|not found' FROM creq WHERE id NOT IN (SELECT id FROM tr)"
)
ORACLES["stream_append_restart"] = on_events(
    "SELECT tr.id, greatest(tr.updated_at, coalesce(a.last, tr.updated_at)) AS updated_at, coalesce(a.n, 0) AS added "
    "FROM tr_before tr LEFT JOIN (SELECT trail_id, max(occured_at) AS last, count(*) AS n FROM added GROUP BY 1) a ON a.trail_id = tr.id"
)


# Described changes. An image is a list of (name, kind, value); see keyed_log for keys and old values.


def sql_key(image: str) -> str:
    part = f"list_filter({image}, lambda e: list_contains(keys, e.name))"
    whole = lambda x: f"len(list_filter({x}, lambda e: e.kind = 'u')) = 0"
    return (
        f"CASE WHEN identity IN ('d', 'i') AND len(keys) > 0 AND len({part}) = len(keys) AND {whole(part)} THEN {part} "
        f"WHEN identity = 'f' AND {whole(image)} THEN {image} END"
    )


def sql_text(image: str, form: str, between: str) -> str:
    value = "CASE WHEN e.kind = 'n' THEN 'NULL' ELSE '''' || e.value || '''' END"
    name = "'\"' || e.name || '\"'"
    forms = {
        "name": name,
        "value": value,
        "set": f"{name} || ' = ' || {value}",
        "where": f"{name} || CASE WHEN e.kind = 'n' THEN ' IS NULL' ELSE ' = ' || {value} END",
        "json": f"{name} || ':' || CASE WHEN e.kind = 'n' THEN 'null' ELSE '\"' || e.value || '\"' END",
    }
    return f"array_to_string(list_transform({image}, lambda e: {forms[form]}), '{between}')"


def sql_image(present: str, quantity: str, partkey: str, tax: str) -> str:
    entry = lambda name, kind, value: f"{{'name': '{name}', 'kind': {kind}, 'value': CAST({value} AS VARCHAR)}}"
    entries = [
        entry("orderkey", "'t'", "k"),
        entry("partkey", "'t'", partkey),
        entry("quantity", "'t'", quantity),
        entry("tax_pct", f"CASE WHEN {tax} IS NULL THEN 'n' ELSE 't' END", tax),
        entry("discount_pct", "CASE WHEN discount_pct IS NULL THEN 'u' ELSE 't' END", "discount_pct"),
        entry("status", "CASE WHEN l_linestatus = 'F' OR NOT six THEN 'b' ELSE 't' END", "l_linestatus"),
    ]
    return f"CASE WHEN {present} THEN list_filter([{', '.join(entries)}], lambda e: e.kind <> 'b') END"


NO_UNSENT = "len(list_filter({0}, lambda e: e.kind = 'u')) = 0"
DESCRIBED = CONTEXT + f""",
told AS (
  SELECT i.slot AS source_slot, w.commit_lsn, w.change_count, i.pos, i.seq, i.kind AS op, i.namespace, i.relation,
         i.relation_id - 16384 AS n, i.columns LIKE '%,status' AS six, i.k, i.old_tuple, i.new_tuple,
         v.l_partkey, CAST(v.l_quantity AS BIGINT) AS quantity, v.tax_pct, v.discount_pct, v.l_linestatus
  FROM kept i JOIN won w ON w.slot = i.slot AND w.begin_pos = i.cpos
  JOIN vals v ON v.l_orderkey = i.k AND v.rn = i.line),
drawn AS (
  SELECT *, CASE WHEN n IN (1, 2) THEN 'd' WHEN n IN (3, 6) THEN 'f' WHEN n = 4 THEN 'n' WHEN n = 5 THEN 'i' END AS identity,
         CASE WHEN n = 1 OR (n = 5 AND six) THEN ['orderkey'] WHEN n = 2 THEN ['orderkey', 'partkey'] WHEN n = 5 THEN ['partkey']
              ELSE CAST([] AS VARCHAR[]) END AS keys,
         '"' || namespace || '"."' || relation || '"' AS target,
         {sql_image("new_tuple IS NOT NULL", "quantity", "l_partkey", "tax_pct")} AS new_image,
         CASE WHEN op = 'U' THEN {sql_image("old_tuple IS NOT NULL", "quantity + 1", "l_partkey + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END", "(CASE WHEN k % 5 = 0 THEN NULL ELSE tax_pct END)")}
              ELSE {sql_image("old_tuple IS NOT NULL", "quantity", "l_partkey", "tax_pct")} END AS old_image
  FROM told),
located AS (
  SELECT *, CASE WHEN op IN ('I', 'U') THEN {sql_key("new_image")} END AS key_after,
         CASE WHEN op = 'D' OR (op = 'U' AND old_image IS NOT NULL) THEN {sql_key("old_image")}
              WHEN op = 'U' AND identity IN ('d', 'i') THEN {sql_key("new_image")} END AS key_before
  FROM drawn),
phrased AS (
  SELECT *, {sql_text("key_after", "where", " AND ")} AS where_after, {sql_text("key_before", "where", " AND ")} AS where_before,
         CASE WHEN identity = 'f' AND {NO_UNSENT.format("old_image")} THEN old_image END AS whole_old,
         list_filter(new_image, lambda e: e.kind <> 'u') AS sent,
         list_filter(list_transform(new_image, lambda e: struct_pack(name := e.name, kind := e.kind, value := e.value,
           old := list_filter(old_image, lambda o: o.name = e.name)[1])),
           lambda e: e.kind <> 'u' AND (e.old.kind <> e.kind OR coalesce(e.old.value, '') <> coalesce(e.value, ''))
                     AND (identity IS NULL OR identity NOT IN ('d', 'i') OR list_contains(keys, e.name))) AS differing
  FROM located),
described AS (
  SELECT *,
         CASE op WHEN 'I' THEN CASE WHEN {NO_UNSENT.format("new_image")} THEN 'INSERT INTO ' || target || ' (' || {sql_text("new_image", "name", ", ")}
                                 || ') VALUES (' || {sql_text("new_image", "value", ", ")} || ')' END
                 WHEN 'U' THEN 'UPDATE ' || target || ' SET ' || {sql_text("sent", "set", ", ")} || ' WHERE ' || where_before
                 ELSE 'DELETE FROM ' || target || ' WHERE ' || where_before END AS forward_dml_sql,
         CASE op WHEN 'I' THEN 'DELETE FROM ' || target || ' WHERE ' || where_after
                 WHEN 'U' THEN 'UPDATE ' || target || ' SET ' || {sql_text("whole_old", "set", ", ")} || ' WHERE ' || where_after
                 ELSE 'INSERT INTO ' || target || ' (' || {sql_text("whole_old", "name", ", ")} || ') VALUES ('
                      || {sql_text("whole_old", "value", ", ")} || ')' END AS reverse_dml_sql
  FROM phrased)
"""


def on_described(select: str) -> str:
    return f"WITH {DESCRIBED} {select}"


ORACLES["wal_row_pk"] = on_described(f"""
    SELECT source_slot, pos, CASE identity WHEN 'd' THEN 'default' WHEN 'f' THEN 'full' WHEN 'n' THEN 'nothing' WHEN 'i' THEN 'index' END
           AS replica_identity_mode, where_after AS reverse_where_sql,
           '{{' || CASE WHEN op = 'I' THEN {sql_text("key_after", "json", ",")} ELSE {sql_text("key_before", "json", ",")} END || '}}' AS row_pk
    FROM described""")
ORACLES["wal_change_statements"] = on_described("""
    SELECT source_slot, pos, forward_dml_sql, reverse_dml_sql, upper(sha256(forward_dml_sql)) AS forward_sql_hash,
           upper(sha256(reverse_dml_sql)) AS reverse_sql_hash FROM described""")
ORACLES["wal_changed_columns"] = on_described("""
    SELECT source_slot, pos, CASE WHEN op = 'U' AND old_image IS NOT NULL THEN len(differing) ELSE 0 END AS n,
           CASE WHEN op = 'U' AND old_image IS NOT NULL THEN array_to_string(list_transform(differing, lambda e: e.name), ',') ELSE '' END AS changed_columns
    FROM described""")
FRAGMENTS = DESCRIBED + """,
fragments AS (
  SELECT source_slot, commit_lsn, 'forward' AS direction, seq AS place, forward_dml_sql AS statement FROM described
  UNION ALL SELECT source_slot, commit_lsn, 'reverse', change_count + 1 - seq, reverse_dml_sql FROM described)
"""
ORACLES["wal_txn_statements"] = f"WITH {FRAGMENTS} SELECT * FROM fragments"


def sql_level(above: str, below: str) -> str:
    return (
        f"{above} AS (SELECT source_slot, commit_lsn, direction, place // 1024 AS place, "
        "sha256(string_agg(coalesce(digest, ''), '' ORDER BY place)) AS digest, sum(n) AS n, sum(missing) AS missing "
        f"FROM {below} GROUP BY source_slot, commit_lsn, direction, place // 1024)"
    )


ORACLES["wal_txn_sql_hashes"] = (
    f"WITH {FRAGMENTS}, level0 AS (SELECT source_slot, commit_lsn, direction, place - 1 AS place, sha256(statement) AS digest, "
    "1 AS n, CASE WHEN statement IS NULL THEN 1 ELSE 0 END AS missing FROM fragments), "
    + ", ".join(sql_level(f"level{i + 1}", f"level{i}") for i in range(4))
    + " SELECT source_slot, commit_lsn, direction, n::BIGINT AS n, missing::BIGINT AS missing, "
    "CASE WHEN missing = 0 THEN upper(digest) END AS sql_hash FROM level4"
)
FLAGGED = DESCRIBED + """,
flagged AS (
  SELECT source_slot, commit_lsn, seq, list_sort(list_filter([
    CASE WHEN identity = 'n' OR identity IS NULL THEN 'no_identity' END,
    CASE WHEN op = 'U' AND old_image IS NULL THEN 'update_without_old_image' END,
    CASE WHEN op = 'D' AND old_image IS NULL THEN 'delete_without_old_image' END,
    CASE WHEN op IN ('U', 'D') AND key_before IS NULL THEN 'row_not_found' END,
    CASE WHEN op = 'U' AND old_image IS NOT NULL AND key_before <> key_after THEN 'key_changed' END,
    CASE WHEN discount_pct IS NULL AND (old_image IS NOT NULL OR new_image IS NOT NULL) THEN 'unsent_values' END,
    CASE WHEN reverse_dml_sql IS NULL THEN 'not_reversible' END], lambda f: f IS NOT NULL)) AS flags
  FROM described)
"""
ORACLES["wal_safety_flags"] = f"""WITH {FLAGGED}
    SELECT source_slot, commit_lsn, seq AS change_seq_in_txn, array_to_string(flags, ',') AS safety_flags FROM flagged
    UNION ALL
    SELECT f.source_slot, f.commit_lsn, 0, coalesce(u.flags, '') FROM (SELECT DISTINCT source_slot, commit_lsn FROM flagged) f
    LEFT JOIN (SELECT source_slot, commit_lsn, string_agg(DISTINCT flag, ',' ORDER BY flag) AS flags
               FROM (SELECT source_slot, commit_lsn, unnest(flags) AS flag FROM flagged) GROUP BY 1, 2) u
      ON u.source_slot = f.source_slot AND u.commit_lsn = f.commit_lsn"""
# Undo requests. What was asked before decides: whether anything was given up, and else whether
# the last of 'undo' and 'redo' that counted was 'undo'. An 'abandon' counts only while nothing is undone.
JUDGED = DESCRIBED + """,
asked AS (
  SELECT CAST(event_id AS VARCHAR) AS requested_by, 'slot_' || (user_id % 4) AS source_slot,
         printf('%X/%X', (user_id * 65536 + 32) >> 32, (user_id * 65536 + 32) & 4294967295) AS commit_lsn,
         event_id % 2 + 1 AS seq, event_id // 2 AS arrival, ts AS requested_at,
         CASE WHEN event_type IN ('purchase', 'view') THEN 'undo' WHEN event_type = 'click' THEN 'redo'
              WHEN event_type = 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 'abandon' ELSE 'undo' END ELSE event_type END AS action
  FROM events),
known AS (
  SELECT a.*, CASE WHEN d.pos IS NULL THEN 'no such change' WHEN a.action NOT IN ('undo', 'redo', 'abandon') THEN 'unknown action'
                   WHEN d.reverse_dml_sql IS NULL THEN 'not reversible' END AS reason
  FROM asked a LEFT JOIN described d ON d.source_slot = a.source_slot AND d.commit_lsn = a.commit_lsn AND d.seq = a.seq),
numbered AS (
  SELECT *, row_number() OVER w AS place,
         last_value(CASE WHEN reason IS NULL AND action <> 'abandon' THEN action END IGNORE NULLS) OVER before AS last_action
  FROM known
  WINDOW w AS (PARTITION BY source_slot, commit_lsn, seq ORDER BY arrival, action, requested_by),
         before AS (PARTITION BY source_slot, commit_lsn, seq ORDER BY arrival, action, requested_by ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
gone AS (
  SELECT *, coalesce(max(CASE WHEN reason IS NULL AND action = 'abandon' AND coalesce(last_action, 'redo') = 'redo' THEN 1 ELSE 0 END) OVER (
           PARTITION BY source_slot, commit_lsn, seq ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS abandoned
  FROM numbered),
stated AS (
  SELECT *, CASE WHEN abandoned THEN 'abandoned' WHEN last_action = 'undo' THEN 'applied' ELSE 'not_applied' END AS before FROM gone),
moved AS (
  SELECT *, CASE WHEN reason IS NOT NULL OR before = 'abandoned' THEN before WHEN action = 'undo' THEN 'applied'
                 WHEN action = 'redo' THEN 'not_applied' WHEN before = 'not_applied' THEN 'abandoned' ELSE before END AS after
  FROM stated),
judged AS (
  SELECT *, CASE WHEN reason IS NOT NULL THEN 'refused' WHEN before <> after THEN 'accepted'
                 WHEN before = CASE action WHEN 'undo' THEN 'applied' WHEN 'redo' THEN 'not_applied' ELSE 'abandoned' END THEN 'repeated'
                 ELSE 'refused' END AS outcome
  FROM moved)
"""
ORACLES["wal_undo_requests"] = f"""WITH {JUDGED}
    SELECT requested_by, place, action, outcome, coalesce(reason, CASE WHEN outcome = 'refused' THEN 'is ' || before END) AS reason, before, after
    FROM judged"""
ORACLES["wal_undo_status"] = f"""WITH {JUDGED}
    SELECT source_slot, commit_lsn, seq AS change_seq_in_txn, after AS undo_status, CASE WHEN after = 'applied' THEN requested_at END AS undo_applied_at,
           CASE WHEN after = 'applied' THEN requested_by END AS undo_applied_by
    FROM judged WHERE outcome = 'accepted' QUALIFY row_number() OVER (PARTITION BY source_slot, commit_lsn, seq ORDER BY place DESC) = 1"""

ORACLES["replay_stored"] = ORACLES["replay_from_sequence"]
ORACLES["wal_resume_capture"] = ORACLES["stream_capture"]
ORACLES["wal_resume_files"] = on_log("""
    , files AS (
      SELECT slot, pos * 16 // (SELECT max(pos) + 1 FROM log) AS piece, min(pos) AS first_pos, max(pos) AS last_pos,
             max(CASE WHEN kind = 'C' THEN k * 65536 + 32 END) AS top_commit,
             max(CASE WHEN kind = 'B' THEN pos * 2 + 1 WHEN kind = 'C' THEN pos * 2 END) AS last_control
      FROM log GROUP BY 1, 2),
    starts AS (
      SELECT f.slot, coalesce(min(CASE WHEN top_commit >= last_lsn_num THEN first_pos END), max(last_pos) + 1) AS start
      FROM files f JOIN loaded l ON l.slot = f.slot GROUP BY f.slot),
    points AS (
      SELECT s.slot, CASE WHEN max(last_control) % 2 = 1 THEN max(last_control) // 2 ELSE any_value(start) END AS resume_pos
      FROM starts s LEFT JOIN files f ON f.slot = s.slot AND f.first_pos < s.start GROUP BY s.slot)
    SELECT f.slot, piece, first_pos, last_pos, resume_pos, last_pos >= resume_pos AS opened
    FROM files f JOIN points p ON p.slot = f.slot""")
# The raw log: some messages can't be used. They keep their places, without a kind or with one nobody knows.
UNUSABLE = """CASE WHEN (kind = 'C' AND (pos // 128) % 83 = 0) OR (kind = 'I' AND (pos // 128) % 61 = 0) THEN 'malformed'
    WHEN kind = 'B' AND (pos // 128) % 97 = 0 THEN 'no kind' WHEN kind = 'T' THEN 'unknown kind Y'
    WHEN kind = 'U' AND (pos // 128) % 59 = 0 THEN 'incomplete' END"""
RAW = (
    LOG.replace("log AS (", "sent AS (")
    + f", read AS (SELECT *, {UNUSABLE} AS reason FROM sent), log AS (SELECT * EXCLUDE (reason) REPLACE "
    "(CASE WHEN reason IS NULL THEN kind WHEN kind = 'T' THEN 'Y' END AS kind) FROM read)"
    + CONTEXT[len(LOG) :]
)
ORACLES["wal_rejects"] = f"WITH {RAW} SELECT slot, pos, reason FROM read WHERE reason IS NOT NULL"
ORACLES["wal_disposition_raw"] = (
    f"WITH {RAW} SELECT slot, pos, kind, CASE WHEN kind IS NULL THEN 'undecodable' WHEN kind = 'Y' THEN 'unknown_kind' "
    "ELSE disposition END AS disposition FROM disp"
)
