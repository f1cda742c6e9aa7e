"""DuckDB SQL for the queries over the same tables. Each states its operator's rules on its own terms."""

from __future__ import annotations

EV = """
ev AS (
  SELECT event_id, event_id % 3 + 1 AS node_id, user_id::VARCHAR AS record_id,
    CASE WHEN event_type <> 'error' THEN 'put' WHEN event_id % 97 = 0 THEN 'del_record' WHEN event_id % 7 = 0 THEN 'del_field' END AS op,
    CASE WHEN event_type <> 'error' THEN event_type WHEN event_id % 97 <> 0 AND event_id % 7 = 0 THEN 'view' END AS col_name,
    CASE WHEN event_type <> 'error' THEN round(value * 100)::BIGINT::VARCHAR END AS value
  FROM events),
log AS (
  SELECT node_id * 1099511627776 + event_id AS seq, record_id, op, col_name, value,
    row_number() OVER (PARTITION BY node_id, record_id, col_name ORDER BY event_id) AS col_version,
    event_id // 3 + 1 AS db_version, node_id, event_id // 3 + 1 AS local_db_version, 0 AS flags
  FROM ev WHERE op IS NOT NULL)"""

#: After log: the clock at each change, from clock 0.
CLOCK = """
arrived AS (SELECT *, row_number() OVER (ORDER BY seq) AS i FROM log),
timed AS (
  SELECT * EXCLUDE (local_db_version, i), (i + greatest(0, max(db_version - i + 1) OVER (ORDER BY seq)))::BIGINT AS local_db_version
  FROM arrived)"""

BEST = "ORDER BY col_version DESC, db_version DESC, node_id DESC, seq"
STATE = "record_id, col_name, value, present, col_version, db_version, node_id"


def merged(source: str = "log", order: str = BEST, keep: str = "op <> 'del_record'") -> str:
    """The cells that a merge of all of source into nothing leaves."""
    return f"""
won AS (
  SELECT *, op = 'put' AS present, row_number() OVER (PARTITION BY record_id, col_name {order}) AS n FROM {source}
  WHERE {keep} AND record_id NOT IN (SELECT record_id FROM {source} WHERE op = 'del_record')),
state AS (SELECT * FROM won WHERE n = 1)"""


def single(node: int, name: str = "r") -> str:
    """One writer's state, read from its log in order: {name}c cells and {name}t tombstones."""
    return f"""
{name}l AS (SELECT * FROM log WHERE node_id = {node}),
{name}t AS (SELECT record_id, db_version, node_id, local_db_version FROM {name}l WHERE op = 'del_record' QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY seq DESC) = 1),
{name}p AS (SELECT record_id, col_name, value FROM {name}l WHERE op = 'put' QUALIFY row_number() OVER (PARTITION BY record_id, col_name ORDER BY seq DESC) = 1),
{name}c AS (
  SELECT v.record_id, v.col_name, p.value, p.record_id IS NOT NULL AS present, v.col_version, v.db_version, v.node_id, v.local_db_version, v.seq
  FROM (SELECT * FROM {name}l WHERE op <> 'del_record' QUALIFY row_number() OVER (PARTITION BY record_id, col_name ORDER BY seq DESC) = 1) v
  LEFT JOIN {name}p p ON p.record_id = v.record_id AND p.col_name = v.col_name
  WHERE v.record_id NOT IN (SELECT record_id FROM {name}t))"""


def q(*ctes: str, select: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + select


CHANGE = "record_id, op, col_name, value, col_version, db_version, node_id, local_db_version"


def since(cells: str, tombs: str, where: str) -> str:
    return f"""
  SELECT record_id, CASE WHEN present THEN 'put' ELSE 'del_field' END AS op, col_name, value, col_version, db_version, node_id, local_db_version FROM {cells} WHERE {where}
  UNION ALL
  SELECT record_id, 'del_record', NULL, NULL, 9223372036854775807, db_version, node_id, local_db_version FROM {tombs} WHERE {where}"""


NEWEST = "row_number() OVER (PARTITION BY record_id, coalesce(col_name, chr(1)) ORDER BY col_version DESC, db_version DESC, node_id DESC)"


def compressed(source: str, columns: str = CHANGE) -> str:
    return f"""
SELECT {columns} FROM (SELECT *, {NEWEST} AS n FROM {source}) WHERE n = 1
  AND (op = 'del_record' OR record_id NOT IN (SELECT record_id FROM {source} WHERE op = 'del_record'))"""


MERGED_STATE = q(EV, merged(), select=f"SELECT {STATE} FROM state")
STAMPED = [EV, CLOCK, merged("timed")]

#: Child: writer 2's log merged into a child of writer 1's state.
CHILD = f"""{EV},{single(1, 'p')},
cl AS (SELECT * FROM log WHERE node_id = 2 AND record_id NOT IN (SELECT record_id FROM pt)),
ct AS (SELECT record_id, db_version, node_id, local_db_version FROM cl WHERE op = 'del_record' QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY seq) = 1),
cboth AS (
  SELECT record_id, col_name, value, present, col_version, db_version, node_id, local_db_version, 0 AS arrived, 0 AS seq FROM pc
  UNION ALL
  SELECT record_id, col_name, value, op = 'put', col_version, db_version, node_id, local_db_version, 1, seq FROM cl WHERE op <> 'del_record'),
cwon AS (
  SELECT * FROM cboth WHERE record_id NOT IN (SELECT record_id FROM ct)
  QUALIFY row_number() OVER (PARTITION BY record_id, col_name ORDER BY col_version DESC, db_version DESC, node_id DESC, arrived, seq) = 1),
cc AS (SELECT * FROM cwon WHERE record_id IN (SELECT record_id FROM cwon WHERE arrived = 1))"""

#: Writer 3's events as operations on writer 1's state; {only} restricts them.
OPS = """{ev},{single},
ops0 AS (SELECT seq, seq // 12 AS call, op, record_id, col_name, value FROM log WHERE node_id = 3 AND op IN ({only})),
dsq AS (SELECT record_id, min(seq) AS dseq FROM ops0 WHERE op = 'del_record' AND record_id NOT IN (SELECT record_id FROM st) GROUP BY record_id),
ops1 AS (
  SELECT o.*, dseq, s.present AS was, s.col_version AS stored,
    o.record_id NOT IN (SELECT record_id FROM st) AND (dseq IS NULL OR seq <= dseq) AS alive
  FROM ops0 o LEFT JOIN dsq USING (record_id) LEFT JOIN (SELECT record_id, col_name, present, col_version FROM sc) s ON s.record_id = o.record_id AND s.col_name = o.col_name),
ops2 AS (
  SELECT *, CASE op
      WHEN 'put' THEN alive
      WHEN 'del_record' THEN alive AND seq = dseq
      ELSE alive AND coalesce(lag(CASE WHEN alive THEN op END) OVER (PARTITION BY record_id, col_name ORDER BY seq) = 'put', was, false) END AS emitted,
    op = 'put' AND row_number() OVER (PARTITION BY call, op = 'put' ORDER BY seq) = 1 AS opens
  FROM ops1),
ops3 AS (
  SELECT *, ((SELECT greatest(max(db_version), max(local_db_version)) FROM sl) + sum((opens OR (op <> 'put' AND emitted))::INT) OVER (ORDER BY seq))::BIGINT AS db_version,
    CASE WHEN op = 'del_record' THEN 9223372036854775807 ELSE (coalesce(stored, 0) + sum(emitted::INT) OVER (PARTITION BY record_id, col_name ORDER BY seq))::BIGINT END AS col_version
  FROM ops2)"""


def ops(*kinds: str) -> str:
    return OPS.format(ev=EV, single=single(1, "s"), only=", ".join(f"'{k}'" for k in kinds))


OUT = "seq, record_id, op, col_name, value, col_version, db_version, 1::BIGINT AS node_id"

ORDERS = """
oc AS (
  SELECT o_orderkey::VARCHAR AS record_id, o_orderstatus AS status, o_orderpriority AS priority, o_custkey::VARCHAR AS custkey, o_orderkey + 1 AS v FROM orders)"""

LINES = """
ln AS (
  SELECT doc_id::VARCHAR AS doc_id, i - 1 AS i, lines[i] AS content, '1_1_' || (i - 1)::VARCHAR AS line_id
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)))"""

EDITED = LINES + """,
ed AS (
  SELECT ln.*, n.node_id, content || ' edit' || n.node_id::VARCHAR AS new FROM ln, (VALUES (2), (3)) AS n(node_id) WHERE i % 5 = 4 AND i % 11 <> 10),
alive AS (SELECT * FROM ln WHERE i % 11 <> 10)"""

CONV = """
cv AS (
  SELECT conv_id::VARCHAR AS list_id, turn, CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END::BIGINT AS replica_id, (turn + 1)::BIGINT AS sequence,
    text, turn % 4 = 3 AS deleted, CASE WHEN turn % 4 <> 3 THEN text END AS value,
    lag((turn + 1)::BIGINT) OVER w AS ol_seq, lag(CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END::BIGINT) OVER w AS ol_rep
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""
#: With no right origins, order is by left origin and own id.
LIST_ORDER = "ol_seq NULLS FIRST, ol_rep NULLS FIRST, sequence, replica_id"

#: The lesser of two clocks, one of them 2000.
COMMON = "(SELECT least(2000, max(greatest(db_version, local_db_version))) FROM b_l)"
WEIGHED = "ORDER BY coalesce(value::BIGINT, -1) DESC, seq"
FIRST_DELETES = "SELECT record_id, db_version, node_id, local_db_version FROM timed WHERE op = 'del_record' QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY seq) = 1"


def live_fields(where: str, name: str) -> str:
    """Fields that a merge of part of the log leaves, without versions."""
    return f"""
{name}s AS (SELECT * FROM log WHERE {where}),
{name} AS (
  SELECT record_id, col_name, value, op FROM {name}s WHERE op <> 'del_record' AND record_id NOT IN (SELECT record_id FROM {name}s WHERE op = 'del_record')
  QUALIFY row_number() OVER (PARTITION BY record_id, col_name {BEST}) = 1)"""


ACCEPTED = [
    EV, CLOCK,
    """
fd AS (SELECT record_id, min(seq) AS dseq FROM timed WHERE op = 'del_record' GROUP BY record_id),
cand AS (SELECT t.* FROM timed t LEFT JOIN fd USING (record_id) WHERE op <> 'del_record' AND (dseq IS NULL OR seq < dseq)),
pre AS (SELECT *, max(struct_pack(a := col_version, b := db_version, c := node_id)) OVER (PARTITION BY record_id, col_name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM cand),
acc AS (
  SELECT seq, record_id, op, col_name, value, db_version, node_id, local_db_version FROM pre
  WHERE top IS NULL OR struct_pack(a := col_version, b := db_version, c := node_id) > top
  UNION ALL SELECT seq, timed.record_id, op, col_name, value, db_version, node_id, local_db_version FROM timed JOIN fd ON fd.record_id = timed.record_id AND seq = dseq)""",
]
LEAVES = """
lf AS (
  SELECT record_id, sha256(record_id) AS place,
    sha256(record_id || '|' || coalesce(string_agg(length(col_name)::VARCHAR || ':' || col_name || coalesce('=' || length(value)::VARCHAR || ':' || value, '-'), ';' ORDER BY col_name) FILTER (WHERE present), '')) AS leaf
  FROM state GROUP BY record_id)"""
NODES = """
l2 AS (SELECT substr(place, 1, 2) AS place, sha256(string_agg(leaf, '' ORDER BY record_id)) AS hash FROM lf GROUP BY 1),
l1 AS (SELECT substr(place, 1, 1) AS up, sha256(string_agg(substr(place, 2, 1) || hash, '' ORDER BY place)) AS hash FROM l2 GROUP BY 1)"""

ORACLES: dict[str, str] = {
    "merge_lww_state": MERGED_STATE,
    "merge_into_state": MERGED_STATE,
    "json_round_trip": MERGED_STATE,
    "parquet_round_trip": MERGED_STATE,
    "stream_merge_state": MERGED_STATE,
    "merge_lineitem_state": f"""
WITH c AS (
  SELECT l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS record_id, unnest(['qty', 'price', 'discount']) AS col_name, unnest([round(l_quantity * 100)::BIGINT::VARCHAR, round(l_extendedprice * 100)::BIGINT::VARCHAR, round(l_discount * 100)::BIGINT::VARCHAR]) AS value,
    true AS present, round(l_extendedprice * 100)::BIGINT * 128 + round(l_discount * 100)::BIGINT AS col_version, l_partkey + 1 AS db_version, l_suppkey AS node_id FROM lineitem)
SELECT {STATE} FROM c QUALIFY row_number() OVER (PARTITION BY record_id, col_name ORDER BY col_version DESC, db_version DESC, node_id DESC) = 1""",
    "merge_stamped_state": q(*STAMPED, select="SELECT record_id, col_name, local_db_version FROM state"),
    "merge_tombstones": q(EV, CLOCK, select="SELECT record_id, db_version, node_id, local_db_version FROM timed WHERE op = 'del_record' QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY seq) = 1"),
    "merge_clock": q(EV, CLOCK, select="SELECT max(local_db_version) AS clock FROM timed"),
    "merge_accepted": q(*ACCEPTED, select="SELECT * FROM acc"),
    "merge_custom_rule_key": q(EV, merged("log", WEIGHED), select=f"SELECT {STATE} FROM state"),
    "merge_custom_rule_fold": q(EV, merged("log", WEIGHED), select=f"SELECT {STATE} FROM state"),
    "merge_context_rule": q(EV, merged("log", "ORDER BY node_id = 2 DESC, col_version DESC, db_version DESC, node_id DESC, seq"), select=f"SELECT {STATE} FROM state"),
    "compress_changes": q(EV, "l2 AS (SELECT * FROM log WHERE op <> 'del_record')", select=compressed("l2", f"seq, {CHANGE}, flags")),
    "compress_with_deletes": q(EV, select=compressed("log", f"seq, {CHANGE}, flags")),
    "compress_custom_order": q(EV, select=compressed("log", f"seq, {CHANGE}, flags").replace("ORDER BY col_version DESC, db_version DESC, node_id DESC", "ORDER BY db_version DESC, node_id DESC, seq")),
    "sync_watermark": q(
        EV, single(1, "a_"), single(2, "b_"),
        f"d AS ({since('a_c', 'a_t', 'local_db_version > 500')})",
        """
m AS (
  SELECT record_id, col_name, value, present, col_version, db_version, node_id, 0 AS src FROM b_c
  UNION ALL SELECT record_id, col_name, value, op = 'put', col_version, db_version, node_id, 1 FROM d WHERE op <> 'del_record')""",
        select=f"""
SELECT {STATE}, greatest(500, (SELECT max(db_version) FROM d))::BIGINT AS last FROM m
WHERE record_id NOT IN (SELECT record_id FROM b_t) AND record_id NOT IN (SELECT record_id FROM d WHERE op = 'del_record')
QUALIFY row_number() OVER (PARTITION BY record_id, col_name ORDER BY col_version DESC, db_version DESC, node_id DESC, src) = 1""",
    ),
    "compact_tombstones": q(EV, single(1), select="SELECT *, (SELECT count(*) FROM rt WHERE db_version < 1500) AS removed FROM rt WHERE db_version >= 1500"),
    "convergence_check": q(
        EV, live_fields("true", "x"), live_fields("node_id < 3", "y"),
        select="""
SELECT 'all' AS replica, true AS converged
UNION ALL SELECT 'behind', NOT EXISTS (
  (SELECT record_id, col_name, value FROM x WHERE op = 'put' EXCEPT ALL SELECT record_id, col_name, value FROM y WHERE op = 'put')
  UNION ALL (SELECT record_id, col_name, value FROM y WHERE op = 'put' EXCEPT ALL SELECT record_id, col_name, value FROM x WHERE op = 'put'))""",
    ),
    "differing_fields": q(
        EV, live_fields("true", "x"), live_fields("node_id < 3", "y"),
        select="""
SELECT x.record_id, x.col_name, x.value, 'left' AS side FROM x LEFT JOIN y ON y.record_id = x.record_id AND y.col_name = x.col_name AND y.value = x.value AND y.op = 'put' WHERE x.op = 'put' AND y.record_id IS NULL
UNION ALL SELECT y.record_id, y.col_name, y.value, 'right' FROM y LEFT JOIN x ON y.record_id = x.record_id AND y.col_name = x.col_name AND y.value = x.value AND x.op = 'put' WHERE y.op = 'put' AND x.record_id IS NULL""",
    ),
    "reset_state": q(EV, single(2), select=f"SELECT {STATE}, local_db_version FROM rc"),
    "tombstone_of_record": q(EV, single(1), select="SELECT * FROM rt ORDER BY record_id LIMIT 1"),
    "insert_containers": """
WITH f AS (
  SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS v, unnest(['segment', 'nation', 'balance']) AS col_name, unnest([c_mktsegment, c_nationkey::VARCHAR, round(c_acctbal * 100)::BIGINT::VARCHAR]) AS value FROM customer)
SELECT c_custkey::VARCHAR AS record_id, col_name, value, true AS present, 1::BIGINT AS col_version, v AS db_version, 4::BIGINT AS node_id, v AS local_db_version FROM f""",
    "local_insert_changes": q(ops("put"), select=f"SELECT {OUT} FROM ops3 WHERE emitted"),
    "local_delete_record": q(ops("put", "del_record"), select="SELECT seq, record_id, db_version, 1::BIGINT AS node_id FROM ops3 WHERE emitted AND op = 'del_record'"),
    "local_delete_field": q(ops("put", "del_field"), select=f"SELECT {OUT} FROM ops3 WHERE emitted AND op = 'del_field'"),
    "local_all_changes": q(ops("put", "del_field", "del_record"), select=f"SELECT {OUT} FROM ops3 WHERE emitted"),
    "local_state": q(
        ops("put", "del_field", "del_record"),
        """
lw AS (SELECT record_id, col_name, CASE WHEN op = 'put' THEN value END AS value, op = 'put' AS present, col_version, db_version, 1::BIGINT AS node_id FROM ops3 WHERE emitted AND op <> 'del_record' QUALIFY row_number() OVER (PARTITION BY record_id, col_name ORDER BY seq DESC) = 1),
al AS (SELECT * FROM lw UNION ALL SELECT record_id, col_name, value, present, col_version, db_version, node_id FROM sc WHERE NOT EXISTS (SELECT 1 FROM lw WHERE lw.record_id = sc.record_id AND lw.col_name = sc.col_name))""",
        select=f"SELECT {STATE} FROM al WHERE record_id NOT IN (SELECT record_id FROM ops3 WHERE emitted AND op = 'del_record')",
    ),
    "from_changes_state": q(EV, single(2), select=f"SELECT {STATE}, local_db_version FROM rc"),
    "changes_since": q(EV, single(1), select=since("rc", "rt", "local_db_version > 1000")),
    "changes_since_excluding": q(
        EV, merged(), "tomb AS (SELECT record_id, db_version, node_id, local_db_version FROM log WHERE op = 'del_record' QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY seq) = 1)",
        select=since("state", "tomb", "local_db_version > 1000 AND node_id <> 2"),
    ),
    "changed_records_since": q(EV, single(1), select=f"SELECT {STATE}, local_db_version FROM rc WHERE record_id IN (SELECT record_id FROM rc WHERE local_db_version > 3000)"),
    "query_records": q(ORDERS, select="SELECT record_id, v AS highest_local FROM oc WHERE status = 'F'"),
    "query_with_projection": q(ORDERS, select="SELECT record_id, custkey, status FROM oc WHERE priority LIKE '1%'"),
    "range_keys": q(ORDERS, select="SELECT record_id, v AS lowest_local, v AS highest_local FROM oc WHERE record_id >= '10' AND record_id < '20'"),
    "get_record": q(EV, merged(), select=f"SELECT {STATE} FROM state WHERE record_id = '7'"),
    "tiered_read": q(EV, merged(), select=f"SELECT {STATE} FROM state WHERE record_id = '7'"),
    "is_tombstoned": q(EV, select="SELECT DISTINCT record_id, record_id IN (SELECT record_id FROM log WHERE op = 'del_record') AS tombstoned FROM ev"),
    "tombstone_count": q(EV, select="SELECT count(DISTINCT record_id) AS tombstones FROM log WHERE op = 'del_record'"),
    "records_modified_since": q(EV, single(1), select="SELECT DISTINCT record_id FROM rc WHERE local_db_version > 3000"),
    "recently_modified_topk": q(EV, single(1), select="SELECT record_id, max(local_db_version) AS local_db_version FROM rc GROUP BY record_id ORDER BY 2 DESC, 1 LIMIT 10"),
    "overlay_child_state": q(CHILD, select=f"SELECT {STATE} FROM cc"),
    "overlay_combined": q(CHILD, select=f"SELECT {STATE} FROM cc UNION ALL SELECT {STATE} FROM pc WHERE record_id NOT IN (SELECT record_id FROM ct) AND record_id NOT IN (SELECT record_id FROM cc)"),
    "overlay_changes_since": q(CHILD, f"d AS ({since('pc', 'pt', 'local_db_version > 2000')} UNION ALL {since('cc', 'ct', 'local_db_version > 2000')}), d1 AS (SELECT DISTINCT * FROM d)", select=compressed("d1")),
    "diff_replicas": q(
        EV, single(1, "a_"), single(2, "b_"),
        f"""
d AS ({since('a_c', 'a_t', 'local_db_version > ' + COMMON)}),
f AS (SELECT * FROM b_c WHERE present),
ids AS (SELECT DISTINCT record_id FROM b_c),
inv AS (
  SELECT f.record_id, 'put' AS op, f.col_name, f.value, f.col_version, f.db_version, 1::BIGINT AS node_id FROM d JOIN f ON f.record_id = d.record_id WHERE d.op = 'del_record'
  UNION ALL
  SELECT d.record_id, CASE WHEN f.record_id IS NOT NULL THEN 'put' WHEN d.record_id IN (SELECT record_id FROM ids) THEN 'del_field' ELSE 'del_record' END,
    CASE WHEN f.record_id IS NOT NULL OR d.record_id IN (SELECT record_id FROM ids) THEN d.col_name END, f.value, coalesce(f.col_version, 0), coalesce(f.db_version, 2000), 1
  FROM d LEFT JOIN f ON f.record_id = d.record_id AND f.col_name = d.col_name WHERE d.op <> 'del_record'
  UNION ALL
  SELECT record_id, op, col_name, value, col_version, db_version, node_id FROM ({since('b_c', 'b_t', 'local_db_version > ' + COMMON)}))""",
        select=compressed("inv", "record_id, op, col_name, value, col_version, db_version, node_id"),
    ),
    "revert_child": q(
        CHILD,
        f"""
d AS ({since('cc', 'ct', 'local_db_version > 0')}),
f AS (SELECT * FROM pc WHERE present),
ids AS (SELECT DISTINCT record_id FROM pc)""",
        select="""
SELECT f.record_id, 'put' AS op, f.col_name, f.value, f.col_version, f.db_version, 2::BIGINT AS node_id FROM d JOIN f ON f.record_id = d.record_id WHERE d.op = 'del_record'
UNION ALL
SELECT d.record_id, CASE WHEN f.record_id IS NOT NULL THEN 'put' WHEN d.record_id IN (SELECT record_id FROM ids) THEN 'del_field' ELSE 'del_record' END,
  CASE WHEN f.record_id IS NOT NULL OR d.record_id IN (SELECT record_id FROM ids) THEN d.col_name END, f.value, coalesce(f.col_version, 0), coalesce(f.db_version, 4000), 2
FROM d LEFT JOIN f ON f.record_id = d.record_id AND f.col_name = d.col_name WHERE d.op <> 'del_record'""",
    ),
    "invert_changes": q(
        EV, single(1, "a_"),
        """
d AS (SELECT * FROM log WHERE node_id = 3),
f AS (SELECT * FROM a_c WHERE present),
ids AS (SELECT DISTINCT record_id FROM a_c)""",
        select="""
SELECT d.seq, f.record_id, 'put' AS op, f.col_name, f.value, f.col_version, f.db_version, 3::BIGINT AS node_id FROM d JOIN f ON f.record_id = d.record_id WHERE d.op = 'del_record'
UNION ALL
SELECT d.seq, d.record_id, CASE WHEN f.record_id IS NOT NULL THEN 'put' WHEN d.record_id IN (SELECT record_id FROM ids) THEN 'del_field' ELSE 'del_record' END,
  CASE WHEN f.record_id IS NOT NULL OR d.record_id IN (SELECT record_id FROM ids) THEN d.col_name END, f.value, coalesce(f.col_version, 0), coalesce(f.db_version, 5000), 3
FROM d LEFT JOIN f ON f.record_id = d.record_id AND f.col_name = d.col_name WHERE d.op <> 'del_record'""",
    ),
    "text_lines_in_order": q(LINES, select="SELECT doc_id, line_id, (10000 * (i + 1))::VARCHAR AS position, content FROM ln"),
    "text_to_text": q(EDITED, select="SELECT a.doc_id, string_agg(coalesce(ed.new, a.content), chr(10) ORDER BY a.i) AS text FROM alive a LEFT JOIN ed ON ed.doc_id = a.doc_id AND ed.i = a.i AND ed.node_id = 3 GROUP BY a.doc_id"),
    "text_merge_lww": q(EDITED, select="SELECT a.doc_id, a.line_id, coalesce(ed.new, a.content) AS content, CASE WHEN ed.i IS NULL THEN 1 ELSE 2 END::BIGINT AS line_version, CASE WHEN ed.i IS NULL THEN 1 ELSE 2 END::BIGINT AS db_version, coalesce(ed.node_id, 1)::BIGINT AS node_id FROM alive a LEFT JOIN ed ON ed.doc_id = a.doc_id AND ed.i = a.i AND ed.node_id = 3"),
    "text_merge_bww": q(EDITED, select="SELECT doc_id, line_id, CASE node_id WHEN 3 THEN 0 ELSE 1 END::BIGINT AS at, 2::BIGINT AS db_version, node_id::BIGINT AS node_id, new AS content FROM ed UNION ALL SELECT doc_id, line_id, 0, 1, 1, content FROM alive WHERE i % 5 <> 4"),
    "text_merge_auto": q(
        EDITED, r"w AS (SELECT *, regexp_extract_all(content, '[^ \t\n\x0B\f\r]+') AS ws FROM alive)",
        select="""
SELECT doc_id, line_id, CASE WHEN i % 5 <> 4 THEN content WHEN len(ws) = 0 THEN content || ' edit3' ELSE 'edit2 ' || array_to_string(ws, ' ') || ' edit3' END AS content,
  CASE WHEN i % 5 = 4 THEN 2 ELSE 1 END::BIGINT AS line_version, CASE WHEN i % 5 = 4 THEN 2 ELSE 1 END::BIGINT AS db_version, CASE WHEN i % 5 = 4 THEN 3 ELSE 1 END::BIGINT AS node_id,
  (i % 5 = 4 AND len(ws) = 0)::INT AS conflicts FROM w""",
    ),
    "text_sync": q(EDITED, select="SELECT a.doc_id, a.line_id, coalesce(ed.new, a.content) AS content, CASE WHEN ed.i IS NULL THEN 1 ELSE 2 END::BIGINT AS line_version, CASE WHEN ed.i IS NULL THEN 1 ELSE 2 END::BIGINT AS db_version, coalesce(ed.node_id, 1)::BIGINT AS node_id FROM alive a LEFT JOIN ed ON ed.doc_id = a.doc_id AND ed.i = a.i AND ed.node_id = 3"),
    "text_collision_order": "SELECT doc_id::VARCHAR AS doc_id, 'by 2,by 3' AS \"order\", 1::BIGINT AS positions FROM documents WHERE text IS NOT NULL",
    "text_word_diff": q(EDITED, select=r"SELECT doc_id, line_id, node_id::BIGINT AS node_id, len(regexp_extract_all(content, '[^ \t\n\x0B\f\r]+'))::INT AS start, len(regexp_extract_all(content, '[^ \t\n\x0B\f\r]+'))::INT AS \"end\", 'edit' || node_id::VARCHAR AS words FROM ed".replace('\\"', '"')),
    "text_tombstones": q(LINES, select="SELECT doc_id, line_id, 1::BIGINT AS line_version, 2::BIGINT AS db_version, 2::BIGINT AS node_id, 2::BIGINT AS local_db_version FROM ln WHERE i % 11 = 10"),
    "text_changes_since": q(EDITED, select="""
SELECT doc_id, line_id, 'Insert' AS type, (10000 * (i + 1))::VARCHAR AS position, new AS content, 2::BIGINT AS line_version, 2::BIGINT AS db_version, 3::BIGINT AS node_id FROM ed WHERE node_id = 3
UNION ALL SELECT doc_id, line_id, 'Delete', NULL, NULL, 1, 2, 2 FROM ln WHERE i % 11 = 10"""),
    "text_split_words": q(LINES, select=r"SELECT doc_id, line_id, len(regexp_extract_all(content, '[^ \t\n\v\f\r]+'))::BIGINT AS n_words FROM ln".replace(r"\v", r"\x0B")),
    "text_positions_between": q(LINES, select="""
SELECT doc_id, CASE WHEN i = max(i) OVER (PARTITION BY doc_id) THEN (10000 * (i + 2))::VARCHAR ELSE (10000 * (i + 1) + 5000)::VARCHAR END AS position, 'new' AS content FROM ln"""),
    "text_edit_lines": q(LINES, select="SELECT doc_id, line_id, CASE WHEN i % 5 = 4 AND i % 11 <> 10 THEN content || ' edit2' ELSE content END AS content, CASE WHEN i % 5 = 4 AND i % 11 <> 10 THEN 2 ELSE 1 END::BIGINT AS line_version, CASE WHEN i % 5 = 4 AND i % 11 <> 10 THEN content END AS base_content FROM ln"),
    "text_delete_lines": q(LINES, select="""
SELECT doc_id, line_id, content, NULL::BIGINT AS deleted_at FROM ln WHERE i % 11 <> 10
UNION ALL SELECT doc_id, line_id, NULL, 1 + row_number() OVER (ORDER BY doc_id::BIGINT, i) FROM ln WHERE i % 11 = 10"""),
    "list_sync": q(CONV, select="SELECT list_id, replica_id, sequence, CASE WHEN NOT deleted THEN text END AS value, deleted FROM cv"),
    "list_values": q(CONV, select=f"SELECT list_id, string_agg(value, '|' ORDER BY {LIST_ORDER}) AS joined, count(*) AS n FROM cv WHERE NOT deleted GROUP BY list_id"),
    "list_merge": q(CONV, select="SELECT list_id, replica_id, sequence, CASE WHEN NOT deleted THEN text END AS value, deleted, CASE WHEN deleted THEN 2 ELSE 1 END::BIGINT AS version FROM cv"),
    "list_delta": q(CONV, select="SELECT list_id, replica_id, sequence, text AS value FROM cv WHERE replica_id = 2 AND NOT deleted"),
    "list_apply_delta": q(CONV, select="SELECT list_id, replica_id, sequence, value, deleted FROM cv"),
    "list_gc": q(CONV, select="SELECT list_id, replica_id, sequence, value FROM cv WHERE NOT deleted"),
    "list_insert": q(CONV, f"v AS (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY {LIST_ORDER}) - 1 AS at FROM cv WHERE NOT deleted)", select="""
SELECT l.list_id, 7::BIGINT AS replica_id, 1::BIGINT AS sequence, 'inserted' AS value, a.sequence AS ol_seq, a.replica_id AS ol_rep, b.sequence AS or_seq, b.replica_id AS or_rep
FROM (SELECT list_id, least(1, max(CASE WHEN deleted THEN 0 ELSE 1 END) OVER (PARTITION BY list_id)) AS one FROM cv) l
LEFT JOIN v a ON a.list_id = l.list_id AND a.at = one - 1 LEFT JOIN v b ON b.list_id = l.list_id AND b.at = one
GROUP BY ALL"""),
    "list_delete": q(CONV, select=f"SELECT list_id, replica_id, sequence, 2::BIGINT AS version, 99::BIGINT AS db_version FROM cv WHERE NOT deleted QUALIFY row_number() OVER (PARTITION BY list_id ORDER BY {LIST_ORDER}) = 1"),
    "list_changes_since": q(CONV, select="SELECT list_id, replica_id, sequence, deleted FROM cv WHERE sequence > 2"),
    "snapshot_recover_state": q(*STAMPED, select=f"SELECT {STATE}, local_db_version FROM state"),
    "incremental_snapshot_delta": q(EV, merged(), select="SELECT record_id, col_name FROM state WHERE record_id IN (SELECT record_id FROM state WHERE node_id = 3)"),
    "wal_replay_state": q(*STAMPED, select=f"SELECT {STATE}, local_db_version FROM state"),
    "store_changes_since": q(
        *STAMPED, f"tomb AS ({FIRST_DELETES})", "half AS (SELECT max(local_db_version) // 2 AS v FROM timed)",
        select=since("state", "tomb", "local_db_version > (SELECT v FROM half)"),
    ),
    "store_outbox": q(*ACCEPTED, select="SELECT * FROM acc"),
    "store_segments": q(*ACCEPTED, select="SELECT (node_id = 3)::BIGINT AS segment, count(*) AS n, true AS closed FROM acc GROUP BY ALL"),
    "store_automatic_snapshots": q(
        EV, live_fields("node_id = 1", "x"), live_fields("true", "z"), live_fields("node_id < 3", "y"), *[c.replace(EV, "").lstrip(",") for c in ACCEPTED[1:]],
        select="""
SELECT 0::BIGINT AS place, true AS whole, count(*) AS cells FROM x
UNION ALL SELECT 1, false, count(*) FROM y WHERE record_id IN (SELECT record_id FROM acc WHERE node_id = 2)
UNION ALL SELECT 2, true, count(*) FROM z""",
    ),
    "store_counts": q(
        *ACCEPTED, live_fields("node_id < 3", "y"), live_fields("true", "z"),
        select="SELECT (SELECT count(DISTINCT record_id) FROM acc WHERE node_id = 3) AS hot, (SELECT count(DISTINCT record_id) FROM y) AS cold, (SELECT count(DISTINCT record_id) FROM z) AS total",
    ),
    "store_cleaned_state": q(*STAMPED, select=f"SELECT {STATE}, local_db_version FROM state"),
    "store_compacted_tombstones": q(EV, CLOCK, f"tomb AS ({FIRST_DELETES})", select="SELECT * FROM tomb WHERE db_version >= 1500"),
    "store_read_by_key": q(
        EV, merged(),
        select="SELECT k AS record_id, k IN (SELECT record_id FROM state) AS there, k IN (SELECT record_id FROM log WHERE op = 'del_record') AS deleted FROM (VALUES ('7'), ('11'), ('none')) AS v(k)",
    ),
    "older_schema": q(EV, merged(), select=f"SELECT {STATE}, NULL::BIGINT AS local_db_version FROM state"),
    "digest_leaves": q(EV, merged(), LEAVES, select="SELECT * FROM lf"),
    "digest_proof": q(EV, merged(), LEAVES, NODES, select="SELECT (SELECT min(record_id) FROM state) AS record_id, sha256(string_agg(up || hash, '' ORDER BY up)) AS root, true AS holds, false AS forged FROM l1"),
    "state_digest": q(EV, merged(), LEAVES, NODES, select="SELECT sha256(string_agg(up || hash, '' ORDER BY up)) AS root FROM l1"),
}
