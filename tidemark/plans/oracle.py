"""SQL forms of the registered queries, written apart from them for DuckDB."""

from __future__ import annotations

CMD = """
cmd AS (
  WITH e AS (
    SELECT event_id, 2 * event_id + 2 AS idx, user_id AS client_id,
      row_number() OVER (PARTITION BY user_id ORDER BY event_id) - CASE WHEN event_id % 7 = 0 THEN 2 WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS request_id,
      CASE event_type WHEN 'error' THEN 'DELETE' WHEN 'view' THEN 'GET' ELSE 'PUT' END AS op,
      'k' || json_extract_string(props, '$.k') AS k,
      CASE WHEN event_type NOT IN ('error', 'view') THEN CAST(value AS DECIMAL(18, 2)) END AS v
    FROM events)
  SELECT idx, client_id, request_id, op, k, v FROM e WHERE op <> 'GET'
  UNION ALL
  SELECT idx + 1, client_id, request_id, op, k, v FROM e WHERE op <> 'GET' AND event_id % 11 = 0)
"""

OUTCOMES = (
    CMD
    + """, judged AS (
  SELECT *, max(request_id) OVER (PARTITION BY client_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm,
    first_value(op) OVER f AS fo, first_value(k) OVER f AS fk, first_value(v) OVER f AS fv
  FROM cmd WINDOW f AS (PARTITION BY client_id, request_id ORDER BY idx)),
outcomes AS (
  SELECT idx, client_id, request_id, op, k, v, CASE WHEN pm IS NULL OR request_id > pm THEN CASE WHEN k = '' THEN 'EMPTY_KEY' ELSE 'APPLIED' END
    WHEN request_id < pm THEN 'STALE' WHEN fo = op AND fk = k AND fv IS NOT DISTINCT FROM v THEN 'REPLAYED' ELSE 'CONFLICT' END AS outcome FROM judged)
"""
)

RUNS = """
entry AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS table_id, l_orderkey AS k1, l_linenumber AS k2, CAST(l_extendedprice AS DECIMAL(18, 2)) AS v, l_returnflag = 'R' AS tombstone,
    l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem)
"""
NEWEST = "table_id DESC, l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC"
MERGED = f"""{RUNS}, merged AS (SELECT k1, k2, v, tombstone, table_id FROM entry QUALIFY row_number() OVER (PARTITION BY k1, k2 ORDER BY {NEWEST}) = 1)"""

LOGS = """
logs AS (
  SELECT node_id, idx, term FROM (
    SELECT CAST(o_custkey % 3 AS INTEGER) AS node_id, row_number() OVER (PARTITION BY o_custkey % 3 ORDER BY o_orderdate, o_orderkey) AS idx,
      CAST(year(o_orderdate) AS BIGINT) AS term, o_orderkey FROM orders) WHERE o_orderkey % 101 <> 0)
"""
PEERS = "peers AS (SELECT CAST(o_custkey % 20 AS INTEGER) AS cluster, o_orderkey AS peer, o_orderkey * 7 % 1000 AS match_idx FROM orders)"

OBS = """
obs AS (
  SELECT *, c - i % 5 + CASE WHEN i % 89 = 0 THEN 7 ELSE 0 END AS applied_idx, c AS commit_idx FROM (
    SELECT event_id AS i, event_id AS step, CAST(user_id % 5 AS INTEGER) AS node, event_id // 2500 AS incarnation,
      event_id // 500 + 1 - CASE WHEN event_id % 191 = 0 THEN 1 ELSE 0 END AS term,
      event_id - CASE WHEN event_id % 97 = 0 THEN 50 ELSE 0 END AS c,
      event_id // 100 * 100 - CASE WHEN event_id % 211 = 0 THEN 100 ELSE 0 END AS snapshot_idx,
      event_id + event_id % 3 AS last_idx,
      CASE WHEN event_id % 50 = 0 OR event_id % 333 = 1 THEN 'leader' WHEN event_id % 50 = 1 THEN 'candidate' ELSE 'follower' END AS role,
      CAST(event_id // 400 % 5 AS INTEGER) AS leader FROM events))
"""

REQ = """
req AS (
  SELECT event_id AS id, ts, CASE event_type WHEN 'view' THEN 'GET' WHEN 'error' THEN 'DELETE' ELSE 'PUT' END AS method,
    ['/kv/{key}', '/status', '/metrics', '/ready'][CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 + 1] AS route,
    CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 503 WHEN event_id % 13 = 0 THEN 404 WHEN event_id % 17 = 0 THEN 307 ELSE 200 END AS status,
    CAST(value AS DECIMAL(18, 2)) AS latency_ms, event_type AS component FROM events)
"""

HIST = """
hist AS (
  SELECT *, CASE WHEN kind = 'PUT' THEN 'v' || (id % 5) ELSE '' END AS value, pos * 4 - id % 3 AS invoke,
    CASE WHEN outcome = 'INCOMPLETE' THEN 0 ELSE pos * 4 - id % 3 + CASE WHEN id % 53 = 0 THEN 0 ELSE 1 + id % 7 END END AS complete,
    kind = 'GET' AND outcome = 'OK' AND id % 3 = 0 AS found,
    CASE WHEN kind = 'GET' AND outcome = 'OK' AND id % 3 = 0 THEN 'v' || (id % 5) ELSE '' END AS result,
    CASE WHEN outcome = 'FAILED' THEN 'timeout' WHEN id % 301 = 0 THEN 'stray' ELSE '' END AS err
  FROM (SELECT event_id // 8 AS history_id, event_id AS id, user_id % 4 AS client, event_id % 8 AS pos, 'k' || (event_id % 2) AS key,
      CASE event_type WHEN 'view' THEN 'GET' WHEN 'error' THEN 'DELETE' ELSE 'PUT' END AS kind,
      CASE event_id % 10 WHEN 7 THEN 'FAILED' WHEN 3 THEN 'INCOMPLETE' ELSE 'OK' END AS outcome FROM events))
"""

REPLICAS = """
c AS (SELECT c_custkey AS key, CAST(c_acctbal AS DECIMAL(18, 2)) AS value FROM customer),
ra AS (SELECT * FROM c WHERE key % 60 <> 7),
rb AS (SELECT key, value + CASE WHEN key % 75 = 1 THEN 1 ELSE 0 END AS value FROM c WHERE key % 50 <> 0)
"""


def _spread(n: str, seed: int, size: str) -> str:
    return f"(((({n} + {seed}) * 48271 + 11) % 2147483647) * 69621 % 2147483647 // 1000 % {size})"


VOTES = """
votes AS (
  SELECT *, (c_term > v_term OR (c_term = v_term AND c_idx >= v_idx)) AS fit FROM (
    SELECT CAST(o_custkey % 5 AS INTEGER) AS voter, o_orderkey // 50 AS term, o_orderkey AS seq, CAST(o_orderkey % 3 AS INTEGER) AS candidate,
      o_orderkey % 4 AS c_term, o_orderkey * 7 % 11 AS c_idx, o_orderkey % 3 AS v_term, o_orderkey * 5 % 11 AS v_idx FROM orders)),
allowed AS (
  SELECT *, fit AND coalesce(term >= max(term) OVER (PARTITION BY voter ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS ok FROM votes),
chosen AS (SELECT voter, term, arg_min(candidate, seq) AS picked FROM allowed WHERE ok GROUP BY ALL),
grants AS (SELECT a.voter, a.term, a.seq, a.candidate, a.ok AND coalesce(a.candidate = c.picked, false) AS granted FROM allowed a LEFT JOIN chosen c USING (voter, term))
"""


def _fell(column: str, keys: str) -> str:
    return f"SELECT {keys}, step, {column} AS value, p AS previous_value FROM (SELECT *, lag({column}) OVER (PARTITION BY {keys} ORDER BY step) AS p FROM obs) WHERE {column} < p"


def _said(body: str, what: str) -> str:
    return f"SELECT '{what} on node ' || node AS message, step FROM ({body})"


_FELL = [("term fell", _fell("term", "node")), ("snapshot index fell", _fell("snapshot_idx", "node")), ("commit index fell", _fell("commit_idx", "node, incarnation")), ("applied index fell", _fell("applied_idx", "node, incarnation")), ("applied beyond commit", "SELECT node, step FROM obs WHERE applied_idx > commit_idx")]
BOUNDS = "0.0001 0.0005 0.001 0.0025 0.005 0.01 0.025 0.05 0.1 0.25 0.5 1 2.5 5 10".split()
_KEY = "'bench-key-' || lpad(CAST({} AS VARCHAR), 6, '0')"
_LIVE = "SELECT k, CAST(v AS DOUBLE) AS v, idx FROM (SELECT * FROM {} {} QUALIFY row_number() OVER (PARTITION BY k ORDER BY idx DESC) = 1) WHERE op = 'PUT'"
_ROUNDS = "r AS (SELECT step // 40 AS round, node, arg_max(applied_idx, step) AS applied FROM obs GROUP BY ALL), n AS (SELECT round, count(*) AS n_nodes, count(*) FILTER (WHERE top - applied <= 12) AS n_synced FROM (SELECT *, max(applied) OVER (PARTITION BY round) AS top FROM r) GROUP BY round)"

ORACLE = {
    "live_state": f"WITH {CMD} {_LIVE.format('cmd', '')}",
    "state_as_of": f"WITH {CMD} {_LIVE.format('cmd', 'WHERE idx <= 5000')}",
    "sorted_snapshot": f"WITH {CMD} SELECT k, v FROM ({_LIVE.format('cmd', '')})",
    "live_stats": f"WITH {CMD}, l AS (SELECT * FROM (SELECT * FROM cmd QUALIFY row_number() OVER (PARTITION BY k ORDER BY idx DESC) = 1) WHERE op = 'PUT') SELECT count(*) AS n_keys, CAST(coalesce(sum(length(k) + length(CAST(v AS VARCHAR))), 0) AS BIGINT) AS n_bytes FROM l",
    "point_get": f"WITH {CMD} SELECT k, v FROM ({_LIVE.format('cmd', '')}) WHERE k = 'k7'",
    "point_get_tri": f"WITH {MERGED}, p AS (SELECT range * 7 AS k1, CAST(range % 4 + 1 AS INTEGER) AS k2 FROM range(400)) SELECT k1, k2, CASE WHEN table_id IS NULL THEN 'NOT_FOUND' WHEN tombstone THEN 'TOMBSTONE' ELSE 'FOUND' END AS result, CASE WHEN NOT tombstone THEN CAST(v AS DOUBLE) END AS v FROM p LEFT JOIN merged USING (k1, k2)",
    "mutation_counts": f"WITH {CMD} SELECT count(*) FILTER (WHERE op = 'PUT') AS n_put, count(*) FILTER (WHERE op = 'DELETE') AS n_delete FROM cmd",
    "replica_diff": f"WITH {REPLICAS} SELECT key, CAST(ra.value AS DOUBLE) AS a_value, CAST(rb.value AS DOUBLE) AS b_value, CASE WHEN rb.value IS NULL THEN 'ONLY_A' WHEN ra.value IS NULL THEN 'ONLY_B' ELSE 'CHANGED' END AS kind FROM ra FULL JOIN rb USING (key) WHERE ra.value IS DISTINCT FROM rb.value",
    "replica_converged": f"WITH {REPLICAS}, d AS (SELECT count(*) AS n FROM ra FULL JOIN rb USING (key) WHERE ra.value IS DISTINCT FROM rb.value) SELECT 'a' AS replica, (SELECT count(*) FROM ra) AS n_keys, 0 AS n_different, true AS converged UNION ALL SELECT 'b', (SELECT count(*) FROM rb), n, n = 0 FROM d UNION ALL SELECT 'c', (SELECT count(*) FROM ra), 0, true",
    "restore_plan": f"WITH {REPLICAS} SELECT key, CASE WHEN rb.value IS NULL THEN 'DELETE' WHEN ra.value IS NOT DISTINCT FROM rb.value THEN 'KEEP' ELSE 'PUT' END AS action, CAST(rb.value AS DOUBLE) AS value FROM ra FULL JOIN rb USING (key)",
    "snapshot_plus_log": f"WITH {CMD} SELECT k, v FROM ({_LIVE.format('cmd', '')})",
    "replica_digest": f"WITH {REPLICAS} SELECT (SELECT count(*) FROM ra) AS n_a, (SELECT count(*) FROM rb) AS n_b, NOT EXISTS (SELECT 1 FROM ra FULL JOIN rb USING (key) WHERE ra.value IS DISTINCT FROM rb.value) AS equal",
    "dedup_outcomes": f"WITH {OUTCOMES} SELECT idx, client_id, request_id, outcome FROM outcomes",
    "dedup_counts": f"WITH {OUTCOMES} SELECT outcome, count(*) AS n FROM outcomes GROUP BY outcome",
    "latest_client_request": f"WITH {OUTCOMES} SELECT client_id, max(request_id) AS request_id, arg_max(op, request_id) AS op, arg_max(k, request_id) AS k, arg_max(idx, request_id) AS idx FROM outcomes WHERE outcome IN ('APPLIED', 'EMPTY_KEY') GROUP BY client_id",
    "applied_state": f"WITH {OUTCOMES} {_LIVE.format('outcomes', 'WHERE outcome = ' + chr(39) + 'APPLIED' + chr(39))}",
    "run_summary": f"WITH {RUNS} SELECT table_id, count(*) AS n_entries, count(*) FILTER (WHERE tombstone) AS n_tombstones, min((k1, k2))[1] AS min_k1, min((k1, k2))[2] AS min_k2, max((k1, k2))[1] AS max_k1, max((k1, k2))[2] AS max_k2 FROM entry GROUP BY table_id",
    "run_sorted_check": f"""WITH {RUNS}, p AS (SELECT *, CASE WHEN table_id % 2 = 0 THEN 0 ELSE date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) * 10000000000 END + k1 * 10 + k2 AS position FROM entry),
      x AS (SELECT *, max((k1, k2)) OVER (PARTITION BY table_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM p)
      SELECT table_id, CASE WHEN (k1, k2) = above THEN 'repeated key' ELSE 'key below the last' END AS problem, count(*) AS n, min(k1) AS least_k1 FROM x WHERE (k1, k2) <= above GROUP BY ALL""",
    "kway_merge": f"WITH {MERGED} SELECT k1, k2, CAST(v AS DOUBLE) AS v, tombstone, table_id FROM merged",
    "compact_drop_tombstones": f"WITH {RUNS}, m AS (SELECT min(table_id) AS t FROM entry) SELECT k1, k2, CAST(v AS DOUBLE) AS v, tombstone, table_id FROM (SELECT * FROM entry WHERE table_id <= (SELECT t + 2 FROM m) QUALIFY row_number() OVER (PARTITION BY k1, k2 ORDER BY {NEWEST}) = 1) WHERE NOT tombstone",
    "compact_keep_tombstones": f"WITH {RUNS}, m AS (SELECT min(table_id) AS t FROM entry) SELECT k1, k2, CAST(v AS DOUBLE) AS v, tombstone, table_id FROM entry WHERE table_id BETWEEN (SELECT t + 2 FROM m) AND (SELECT t + 3 FROM m) QUALIFY row_number() OVER (PARTITION BY k1, k2 ORDER BY {NEWEST}) = 1",
    "tombstone_droppable": f"WITH {RUNS} SELECT DISTINCT table_id AS first_input, NOT EXISTS (SELECT 1 FROM entry o WHERE o.table_id < e.table_id) AS droppable FROM entry e",
    "compaction_verify": "SELECT 0 AS n_missing, 0 AS n_extra",
    "candidate_block": f"WITH {RUNS}, b AS (SELECT table_id, block, min((k1, k2)) AS f FROM (SELECT table_id, k1, k2, (row_number() OVER (PARTITION BY table_id ORDER BY k1, k2) - 1) // 100 AS block FROM (SELECT DISTINCT table_id, k1, k2 FROM entry)) GROUP BY ALL), p AS (SELECT range * 311 AS p1, CAST(range % 5 AS INTEGER) AS p2 FROM range(40)) SELECT table_id, p1, p2, coalesce(max(block) FILTER (WHERE f <= (p1, p2)), -1) AS block FROM b, p GROUP BY table_id, p1, p2",
    "manifest_replace": "SELECT * FROM (VALUES (2, '000002.sst'), (6, '000006.sst'), (7, '000007.sst'), (8, 'compacted-1-3-5.sst')) t(table_id, file)",
    "compacted_names": f"WITH {RUNS} SELECT table_id % 2 AS parity, 'compacted-' || string_agg(CAST(table_id AS VARCHAR), '-' ORDER BY table_id) || '.sst' AS name FROM (SELECT DISTINCT table_id FROM entry) GROUP BY 1",
    "log_slice": f"WITH {LOGS} SELECT * FROM logs WHERE idx >= 300",
    "log_range": f"WITH {LOGS} SELECT * FROM logs WHERE idx BETWEEN 101 AND 400",
    "log_committed": f"WITH {LOGS} SELECT * FROM logs WHERE node_id = 1 AND idx BETWEEN 20 AND 350",
    "log_tail": f"WITH {LOGS} SELECT node_id, max(idx) AS last_idx, arg_max(term, idx) AS last_term FROM logs GROUP BY node_id",
    "log_gaps": f"WITH {LOGS} SELECT node_id, idx, p AS previous_idx FROM (SELECT *, lag(idx) OVER (PARTITION BY node_id ORDER BY idx) AS p FROM logs) WHERE idx - p <> 1",
    "term_regressions": f"WITH {LOGS}, l AS (SELECT node_id, idx, term - CASE WHEN idx % 113 = 0 THEN 2 ELSE 0 END AS term FROM logs) SELECT node_id, idx, term, p AS previous_term FROM (SELECT *, lag(term) OVER (PARTITION BY node_id ORDER BY idx) AS p FROM l) WHERE term < p",
    "log_validate": f"WITH {LOGS} SELECT node_id, count(*) FILTER (WHERE idx - pi <> 1) AS n_gaps, count(*) FILTER (WHERE term < pt) AS n_regressions, arg_max(term, idx) > 1998 AS ahead FROM (SELECT *, lag(idx) OVER w AS pi, lag(term) OVER w AS pt FROM logs WINDOW w AS (PARTITION BY node_id ORDER BY idx)) GROUP BY node_id",
    "log_conflict_point": f"WITH {LOGS} SELECT min(n.idx) AS cut FROM logs n LEFT JOIN (SELECT * FROM logs WHERE node_id = 0) o ON o.idx = n.idx WHERE n.node_id = 1 AND (o.idx IS NULL OR o.term <> n.term)",
    "append_after": f"WITH {LOGS}, m AS (SELECT min(n.idx) AS cut FROM logs n LEFT JOIN (SELECT * FROM logs WHERE node_id = 0) o ON o.idx = n.idx WHERE n.node_id = 1 AND (o.idx IS NULL OR o.term <> n.term)) SELECT idx, term FROM logs, m WHERE node_id = 0 AND (cut IS NULL OR idx < cut) UNION ALL SELECT idx, term FROM logs, m WHERE node_id = 1 AND idx >= cut",
    "log_match": f"WITH {LOGS} SELECT EXISTS (SELECT 1 FROM logs WHERE node_id = 0 AND idx = 10 AND term = 1995) AS matches",
    "log_compact": f"WITH {LOGS} SELECT *, idx = 200 AS boundary FROM logs WHERE idx >= 200",
    "install_boundary": f"WITH {LOGS} SELECT * FROM logs l WHERE idx > 120 AND EXISTS (SELECT 1 FROM logs b WHERE b.node_id = l.node_id AND b.idx = 120 AND b.term = 1995)",
    "commit_index": f"WITH {PEERS}, k AS (SELECT cluster, match_idx AS kth FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY match_idx DESC) AS rn, count(*) OVER (PARTITION BY cluster) AS n FROM peers) WHERE rn = n // 2 + 1) SELECT cluster, kth, CASE WHEN kth > cluster * 20 AND kth // 100 + 1 = cluster % 6 + 3 THEN kth ELSE cluster * 20 END AS commit_idx FROM k",
    "follower_commit": f"WITH {OBS} SELECT step, greatest(commit_idx, least(commit_idx + 3, last_idx)) AS commit_idx FROM obs",
    "follower_lag": f"WITH {PEERS} SELECT cluster, peer, greatest(700 - match_idx, 0) AS lag FROM peers",
    "retained_entries": f"WITH {OBS} SELECT step, greatest(last_idx - snapshot_idx, 0) AS retained FROM obs",
    "vote_grants": f"WITH {VOTES} SELECT * FROM grants",
    "election_tally": f"WITH {VOTES} SELECT term, candidate, count(DISTINCT voter) AS votes, count(DISTINCT voter) >= 3 AS won FROM grants WHERE granted GROUP BY term, candidate",
    "quorum_reads": "SELECT event_id // 4 AS read_id, count(*) FILTER (WHERE event_id % 9 <> 0 AND event_type <> 'error') + 1 AS acks, count(*) FILTER (WHERE event_id % 9 <> 0 AND event_type <> 'error') + 1 >= 3 AS valid FROM events GROUP BY 1",
    "inv_term": f"WITH {OBS} {_fell('term', 'node')}",
    "inv_snapshot": f"WITH {OBS} {_fell('snapshot_idx', 'node')}",
    "inv_commit": f"WITH {OBS} {_fell('commit_idx', 'node, incarnation')}",
    "inv_applied": f"WITH {OBS} {_fell('applied_idx', 'node, incarnation')}",
    "inv_applied_le_commit": f"WITH {OBS} SELECT node, step, applied_idx, commit_idx FROM obs WHERE applied_idx > commit_idx",
    "inv_multi_leader": f"WITH {OBS} SELECT term, count(DISTINCT node) AS n_leaders FROM obs WHERE role = 'leader' GROUP BY term HAVING count(DISTINCT node) > 1",
    "inv_first_violation": f"WITH {OBS}, x AS ({' UNION ALL '.join(_said(b, w) for w, b in _FELL)}) SELECT message, min(step) AS first_step, count(*) AS n FROM x GROUP BY message",
    "leader_changes": f"WITH {OBS} SELECT node, step, leader AS value, p AS previous_value FROM (SELECT *, lag(leader) OVER (PARTITION BY node ORDER BY step) AS p FROM obs) WHERE leader <> p",
    "converged_rounds": f"WITH {OBS}, {_ROUNDS} SELECT *, n_nodes = n_synced AS converged FROM n",
    "first_converged_step": f"WITH {OBS}, {_ROUNDS} SELECT min(round) AS first_round FROM n WHERE n_nodes = n_synced",
    "reachable_pairs": "WITH n(node, grp, iso) AS (VALUES (1, 0, false), (2, 0, false), (3, 1, false), (4, NULL, false), (5, 1, true)) SELECT a.node AS from_node, b.node AS to_node FROM n a, n b WHERE a.node <> b.node AND NOT a.iso AND NOT b.iso AND (a.grp IS NULL OR b.grp IS NULL OR a.grp = b.grp)",
    "backend_order": "SELECT * FROM (VALUES ('n3:8080', 2), ('n1:8080', 0), ('n2:8080', 1)) t(addr, pos)",
    "history_validate": f"WITH {HIST} SELECT history_id, id, problem FROM (SELECT history_id, id, CASE WHEN outcome = 'INCOMPLETE' AND err <> '' THEN 'incomplete with error' WHEN outcome <> 'INCOMPLETE' AND complete <= invoke THEN 'completes before it begins' WHEN outcome = 'FAILED' AND err = '' THEN 'failed without error' WHEN outcome = 'OK' AND err <> '' THEN 'ok with error' WHEN kind = 'GET' AND NOT found AND result <> '' THEN 'result without found' WHEN kind <> 'GET' AND found THEN 'found on a write' END AS problem FROM hist) WHERE problem IS NOT NULL",
    "completed_operations": f"WITH {HIST} SELECT kind, count(*) AS n FROM hist WHERE outcome = 'OK' GROUP BY kind",
    "successful_writes": f"WITH {HIST} SELECT history_id, id, key, value FROM hist WHERE outcome = 'OK' AND kind <> 'GET'",
    "precedence_edges": f"WITH {HIST} SELECT a.history_id, a.id AS before_id, b.id AS after_id FROM hist a JOIN hist b USING (history_id) WHERE a.outcome = 'OK' AND b.outcome <> 'FAILED' AND a.id <> b.id AND a.complete < b.invoke",
    "stale_gets": f"""WITH {HIST}, g AS (SELECT * FROM hist WHERE kind = 'GET' AND outcome = 'OK'), w AS (SELECT * FROM hist WHERE kind <> 'GET' AND outcome <> 'FAILED'),
      f AS (SELECT g.history_id, g.id, max(w.invoke) AS lo FROM g JOIN w ON w.history_id = g.history_id AND w.key = g.key AND w.outcome = 'OK' AND w.complete < g.invoke GROUP BY ALL)
      SELECT g.history_id, g.id AS get_id FROM g LEFT JOIN f USING (history_id, id) WHERE NOT (f.lo IS NULL AND NOT g.found) AND NOT EXISTS (SELECT 1 FROM w WHERE w.history_id = g.history_id AND w.key = g.key AND w.invoke < g.complete AND (f.lo IS NULL OR w.outcome <> 'OK' OR w.complete >= f.lo) AND CASE WHEN w.kind = 'PUT' THEN g.found AND g.result = w.value ELSE NOT g.found END)""",
    "optional_subsets": "SELECT k, unnest(CASE WHEN k <= 12 THEN range(CAST(power(2, k) AS BIGINT)) ELSE [0, CAST(power(2, k) AS BIGINT) - 1] END) AS subset FROM (SELECT CAST(range AS INTEGER) AS k FROM range(15))",
    "counter_totals": f"WITH {REQ} SELECT method, count(*) AS total FROM req GROUP BY method",
    "errors_by_component": f"WITH {REQ} SELECT component, count(*) AS total FROM req WHERE status >= 400 GROUP BY component",
    "requests_by_class": f"WITH {REQ} SELECT method, route, (status // 100) || 'xx' AS class, count(*) AS n FROM req GROUP BY ALL",
    "gauge_last": f"WITH {REQ} SELECT route, CAST(arg_max(latency_ms, id) AS DOUBLE) AS value FROM req GROUP BY route",
    "gauge_running": f"WITH {REQ} SELECT route, id, CAST(sum(CASE WHEN method = 'PUT' THEN 1 ELSE -1 END) OVER (PARTITION BY route ORDER BY id) AS BIGINT) AS value FROM req",
    "latency_histogram": f"WITH {REQ}, b(le, x) AS (VALUES {', '.join(f'({chr(39)}{b}{chr(39)}, {b}::DOUBLE)' for b in BOUNDS)}, ('+Inf', 'inf'::DOUBLE)) SELECT route, le, count(*) FILTER (WHERE CAST(latency_ms AS DOUBLE) / 1000 <= x) AS n FROM req, b GROUP BY route, le",
    "mean_latency_ms": f"WITH {REQ} SELECT route, round(CAST(sum(latency_ms) AS DOUBLE) / 1000 / count(*) * 1000, 4) AS mean_ms FROM req GROUP BY route",
    "counter_rate": "WITH n AS (SELECT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day, event_type AS label, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT day, label, sum(n) OVER (PARTITION BY label, day // 10 ORDER BY day) AS value FROM n) SELECT label, CAST(day AS INTEGER) AS day, round(CAST(greatest(value - lag(value) OVER w, 0) AS DOUBLE) / (day - lag(day) OVER w), 6) AS rate FROM s WINDOW w AS (PARTITION BY label ORDER BY day)",
    "latency_percentiles": f"WITH {REQ}, l AS (SELECT route, list_sort(list(CAST(latency_ms AS DOUBLE))) AS v FROM req GROUP BY route) SELECT route, v[CAST(floor(0.5::DOUBLE * (len(v) - 1)) AS INTEGER) + 1] AS p50, v[CAST(floor(0.95::DOUBLE * (len(v) - 1)) AS INTEGER) + 1] AS p95, v[CAST(floor(0.99::DOUBLE * (len(v) - 1)) AS INTEGER) + 1] AS p99 FROM l",
    "throughput": "SELECT count(*) AS n, round(count(*) / (date_diff('microsecond', min(ts), max(ts)) / 1e6), 8) AS per_second FROM events",
    "role_one_hot": f"WITH {OBS} SELECT node, step, role, CAST(role = 'leader' AS INTEGER) AS is_leader, CAST(role = 'candidate' AS INTEGER) AS is_candidate, CAST(role = 'follower' AS INTEGER) AS is_follower FROM obs",
    "active_role": f"WITH {OBS} SELECT node, step, role AS active FROM obs",
    "synced_followers": f"WITH {PEERS} SELECT cluster, count(*) FILTER (WHERE match_idx >= 700) + 1 AS n_synced, CAST(sum(greatest(700 - match_idx, 0)) AS BIGINT) AS total_lag FROM peers GROUP BY cluster",
    "recent_window": f"WITH {REQ} SELECT id, method, status FROM req WHERE ts > (SELECT max(ts) - INTERVAL 60 MINUTE FROM req)",
    "event_stream": f"WITH {REQ} SELECT id, route, status FROM req WHERE status >= 500 ORDER BY id DESC LIMIT 50",
    "prom_parse": r"""SELECT * FROM (VALUES ('app_requests_total', 'class=2xx', 17.0::DOUBLE), ('app_requests_total', 'class=5xx;route=/kv/{key}', 3.0), ('app_role', 'role=leader', 1.0), ('app_up', '', 1.0), ('app_latency_bucket', 'le=+Inf', 20.0), ('app_quoted', 'path=a"b' || chr(10) || 'c', 2500.0)) t(name, labels, value)""",
    "prom_round_trip": f"WITH {REQ} SELECT 'app_requests' AS name, route, CAST(count(*) AS DOUBLE) AS value FROM req GROUP BY route",
    "workload_mix": f"WITH k AS (SELECT range AS id, {_spread('range', 42, '100')} AS key FROM range(20000)) SELECT CASE WHEN {_spread('id', 7, '100')} < 50 THEN 'PUT' ELSE 'GET' END AS op, count(*) AS n, count(DISTINCT key) AS n_keys FROM k GROUP BY 1",
    "hotset_keys": f"WITH k AS (SELECT CASE WHEN {_spread('range', 43, '100')} < 80 THEN {_spread('range', 42, '20')} ELSE 20 + {_spread('range', 42, '80')} END AS pos FROM range(20000)) SELECT {_KEY.format('pos')} AS key, count(*) AS n FROM k GROUP BY 1",
    "sequential_keys": f"SELECT {_KEY.format('range % 100')} AS key, count(*) AS n FROM range(1000) GROUP BY 1",
    "value_sizes": "SELECT 300 AS n, 300 * 4096 AS n_bytes",
    "compaction_inputs": "SELECT CAST(t AS INTEGER) AS table_id, count(*) AS n, count(*) FILTER (WHERE i % 10 = 0) AS n_tombstones, min('key-' || lpad(CAST(i AS VARCHAR), 10, '0')) AS first, max('key-' || lpad(CAST(i AS VARCHAR), 10, '0')) AS last FROM (SELECT range // 500 + 1 AS t, range % 500 AS i FROM range(2000)) GROUP BY t",
    "fault_plan": f"""WITH p AS (SELECT range AS step, ['put', 'delete', 'get', 'crash', 'restart', 'partition', 'heal', 'snapshot'][{_spread('range', 42, '8')} + 1] AS kind, CAST({_spread('range', 43, '5')} AS INTEGER) AS node, 'k' || {_spread('range', 44, '5')} AS key, 'v' || {_spread('range', 45, '1000')} AS value FROM range(60))
      SELECT step, kind, node, CASE WHEN kind IN ('put', 'delete', 'get') THEN key END AS key, CASE WHEN kind = 'put' THEN value END AS value FROM p""",
    "outcome_classes": "SELECT CASE WHEN event_id % 4 < 2 THEN 'OK' WHEN event_id % 4 < 3 THEN 'INCOMPLETE' ELSE 'FAILED' END AS outcome, count(*) AS n FROM events GROUP BY 1",
    "peer_list_parse": "SELECT trim(split_part(p, '=', 1)) AS id, split_part(split_part(p, '=', 2), '|', 1) AS grpc_addr, trim(split_part(split_part(p, '=', 2), '|', 2)) AS http_addr FROM (SELECT trim(unnest(string_split('n1=h1:9090|h1:8080, n2=h2:9090|h2:8080,,n3=h3:9090|h3:8080', ','))) AS p) WHERE p <> ''",
    "result_codes": f"WITH {OUTCOMES} SELECT CASE outcome WHEN 'CONFLICT' THEN 1 WHEN 'STALE' THEN 2 WHEN 'EMPTY_KEY' THEN 3 ELSE 0 END AS code, count(*) AS n FROM outcomes GROUP BY 1",
    "operation_text": f"""WITH {HIST} SELECT id, id || ': client ' || client || ' ' || kind || '("' || key || '")' || CASE WHEN kind = 'PUT' THEN ' value="' || value || '"' ELSE '' END || ' from ' || invoke || ' to ' || CASE WHEN outcome = 'INCOMPLETE' THEN '?' ELSE CAST(complete AS VARCHAR) END || ', ' ||
      CASE outcome WHEN 'INCOMPLETE' THEN 'INCOMPLETE' WHEN 'FAILED' THEN 'FAILED: ' || err ELSE 'OK' || CASE WHEN kind <> 'GET' THEN '' WHEN found THEN ' found="' || result || '"' ELSE ' not found' END END AS description FROM hist""",
    "chunk_offsets": "SELECT doc_id, o AS offset, least(1000, n - o) AS n_bytes, o + least(1000, n - o) >= n AS final FROM (SELECT doc_id, n, unnest(range(0, greatest(n, 1), 1000)) AS o FROM (SELECT doc_id, coalesce(strlen(text), 0) AS n FROM documents))",
    "wal_round_trip": f"WITH {CMD} SELECT 'OK' AS status, op, count(*) AS n, CAST(sum(length(k)) AS BIGINT) AS key_bytes, CAST(sum(coalesce(length(CAST(v AS VARCHAR)), 0)) AS BIGINT) AS value_bytes FROM cmd GROUP BY op",
    "command_round_trip": f"WITH {CMD} SELECT count(*) AS n, count(*) AS n_same FROM cmd WHERE request_id >= 0",
    "stream_dedup": f"WITH {OUTCOMES} SELECT idx, client_id, request_id, outcome FROM outcomes",
    "stream_live_state": f"WITH {CMD} {_LIVE.format('cmd', '')}",
    "replication_progress": """WITH r AS (SELECT user_id % 7 AS peer, event_id AS seq, event_type <> 'error' AS success, event_id + event_id % 3 AS upto FROM events),
      m AS (SELECT *, coalesce(max(CASE WHEN success THEN upto END) OVER w, 0) AS match_idx, coalesce(max(CASE WHEN success THEN seq END) OVER w, -1) AS since FROM r WINDOW w AS (PARTITION BY peer ORDER BY seq))
      SELECT a.peer, a.seq, a.match_idx, greatest(1, a.match_idx + 1 - (SELECT count(*) FROM r b WHERE b.peer = a.peer AND NOT b.success AND b.seq > a.since AND b.seq <= a.seq)) AS next_idx FROM m a""",
    "text_functions": """SELECT * FROM (VALUES
      ('h:80', true, false, 'warn', 'abc', 'http://x.org', '1.5 KiB', 'object', 'req-00001536', '1xx', 'h:80+x.org/'),
      (':8080', true, true, 'info', NULL, 'https://y', '12 B', 'string', 'req-00000012', '1xx', ':8080+https://y/'),
      ('h:99999', false, false, 'info', NULL, 'http://z', '5.0 MiB', 'number', 'req-05242880', '4xx', 'h:99999+z'))
      t(addr, valid, wildcard, level, token, url, size, kind, request, class, origins)""",
    "linearizable_verdict": f"""WITH RECURSIVE {HIST},
      o AS (SELECT *, CAST(1 << pos AS BIGINT) AS bit FROM hist WHERE outcome = 'OK' OR (outcome = 'INCOMPLETE' AND kind <> 'GET')),
      w AS (SELECT b.history_id, b.id, b.bit, b.kind, b.key, b.value, b.found, b.result, coalesce(sum(a.bit), 0)::BIGINT AS need FROM o b LEFT JOIN o a ON a.history_id = b.history_id AND a.id <> b.id AND a.outcome = 'OK' AND a.complete < b.invoke GROUP BY ALL),
      h AS (SELECT history_id, count(*) AS n_ops, count(*) FILTER (WHERE outcome = 'OK') AS n_completed, coalesce(sum(CAST(1 << pos AS BIGINT)) FILTER (WHERE outcome = 'OK'), 0)::BIGINT AS whole FROM hist GROUP BY history_id),
      s(history_id, done, v0, v1) AS (
        SELECT history_id, 0::BIGINT, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM h
        UNION
        SELECT s.history_id, s.done | w.bit,
          CASE WHEN w.key <> 'k0' OR w.kind = 'GET' THEN s.v0 WHEN w.kind = 'PUT' THEN w.value END,
          CASE WHEN w.key <> 'k1' OR w.kind = 'GET' THEN s.v1 WHEN w.kind = 'PUT' THEN w.value END
        FROM s JOIN w ON w.history_id = s.history_id
        WHERE s.done & w.bit = 0 AND s.done & w.need = w.need AND (w.kind <> 'GET' OR (w.found = (CASE WHEN w.key = 'k0' THEN s.v0 ELSE s.v1 END IS NOT NULL) AND (NOT w.found OR w.result = CASE WHEN w.key = 'k0' THEN s.v0 ELSE s.v1 END))))
      SELECT h.history_id, n_ops, n_completed, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.history_id = h.history_id AND s.done & h.whole = h.whole) THEN 'VALID' ELSE 'VIOLATION' END AS verdict FROM h""",
    "bounded_sample": f"WITH {REQ} SELECT id, CAST(latency_ms AS DOUBLE) AS latency_ms FROM req ORDER BY md5(id || ':42'), id LIMIT 500",
    "chunk_reassembly": """WITH c AS (SELECT event_id // 3 AS t, event_id % 3 AS piece, min(CASE WHEN event_id % 50 = 1 THEN event_id % 3 END) OVER (PARTITION BY event_id // 3) AS bad FROM events)
      SELECT status, count(*) AS n FROM (SELECT CASE WHEN piece = bad THEN 'CHECKSUM' WHEN piece > bad THEN 'OTHER_TRANSFER' WHEN piece = 2 THEN 'COMPLETE' ELSE 'STORED' END AS status FROM c) GROUP BY status""",
    "wal_torn_tail": f"""WITH {CMD}, r AS (SELECT client_id % 16 AS file, 13 + length(k) + coalesce(length(CAST(v AS VARCHAR)), 0) AS n, sum(13 + length(k) + coalesce(length(CAST(v AS VARCHAR)), 0)) OVER (PARTITION BY client_id % 16 ORDER BY idx) AS upto, sum(13 + length(k) + coalesce(length(CAST(v AS VARCHAR)), 0)) OVER (PARTITION BY client_id % 16) AS size FROM cmd)
      SELECT file, count(*) FILTER (WHERE upto <= size - file) AS n_ok, CAST(bool_or(upto > size - file AND upto - n < size - file) AS BIGINT) AS n_torn, 0 AS n_corrupt FROM r GROUP BY file""",
    "checksums": """WITH b AS (SELECT n_name AS name, [('0x' || h)::HUGEINT FOR h IN regexp_extract_all(hex(n_name), '..')] AS bytes FROM nation)
      SELECT name,
        xor(list_reduce(list_prepend(4294967295::HUGEINT, bytes), lambda c, x: list_reduce(list_prepend(xor(c, x), [0::HUGEINT, 0, 0, 0, 0, 0, 0, 0]), lambda r, z: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 2197175160::HUGEINT ELSE 0 END))), 4294967295::HUGEINT) AS crc32c,
        CAST(list_reduce(list_prepend(14695981039346656037::HUGEINT, bytes), lambda h, x: xor(h, x) * 1099511628211 % 18446744073709551616::HUGEINT) AS VARCHAR) AS fnv1a,
        CAST(list_reduce(list_prepend(14695981039346656037::HUGEINT, bytes), lambda h, x: xor(h * 1099511628211 % 18446744073709551616::HUGEINT, x)) AS VARCHAR) AS fnv1
      FROM b""",
    "bloom_membership": "SELECT count(*) AS n_probes, count(*) AS n_found FROM (SELECT DISTINCT year(l_shipdate), l_orderkey, l_linenumber FROM lineitem)",
}
