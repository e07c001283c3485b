"""Registered queries over node states, their transitions and observations, each with its SQL form (``ORACLE``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import history, invariants, raftlog, scan, transitions, workload
from tidemark.plans.oracle import HIST, LOGS, OBS
from tidemark.sources import adapters as a

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: States of nodes, one a customer.
STATES = """
state AS (
  SELECT c_custkey AS node_id, c_custkey % 9 + 1 AS term, 'n' || (c_custkey % 3) AS voted_for, CASE c_custkey % 4 WHEN 0 THEN 'leader' WHEN 1 THEN 'candidate' ELSE 'follower' END AS role,
    c_custkey % 50 + 20 AS commit_idx, c_custkey % 50 + 10 AS applied_idx, c_custkey % 20 AS boundary_idx, c_custkey % 3 AS boundary_term, c_custkey % 50 + 40 AS last_idx
  FROM customer)
"""


def _states(s, d):
    k = F.col("c_custkey")
    role = F.when(k % 4 == 0, "leader").when(k % 4 == 1, "candidate").otherwise("follower")
    return a.table(s, d, "customer").select(
        k.alias("node_id"), (k % 9 + 1).alias("term"), F.concat(F.lit("n"), (k % 3).cast("string")).alias("voted_for"), role.alias("role"),
        (k % 50 + 20).alias("commit_idx"), (k % 50 + 10).alias("applied_idx"), (k % 20).alias("boundary_idx"), (k % 3).alias("boundary_term"), (k % 50 + 40).alias("last_idx"),
    )


@query(f"WITH {STATES}, m AS (SELECT o_custkey AS node_id, max(o_orderkey % 13) AS top FROM orders GROUP BY 1) SELECT node_id, CASE WHEN top > term THEN top ELSE term END AS term, CASE WHEN top > term THEN NULL ELSE voted_for END AS voted_for, CASE WHEN top > term THEN 'follower' ELSE role END AS role, coalesce(top > term, false) AS stepped_down FROM state LEFT JOIN m USING (node_id)")
def step_downs(s, d):
    seen = a.table(s, d, "orders").select(F.col("o_custkey").alias("node_id"), (F.col("o_orderkey") % 13).alias("term"))
    return transitions.step_down(_states(s, d), seen).select("node_id", "term", "voted_for", "role", "stepped_down")


@query(f"WITH {STATES} SELECT node_id, term + 1 AS term, node_id AS voted_for, 'candidate' AS role FROM state WHERE role <> 'leader'")
def elections_started(s, d):
    return transitions.start_elections(_states(s, d).where("role <> 'leader'"), 3).select("node_id", "term", "voted_for", "role")


@query(f"WITH {STATES} SELECT node_id, p AS peer, last_idx + 1 AS next_idx, 0 AS match_idx FROM state, (VALUES (1), (2)) t(p) WHERE role = 'leader'")
def leaders_started(s, d):
    leaders = _states(s, d).where("role = 'leader'")
    peers = leaders.select("node_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("peer"))
    return transitions.leader_progress(leaders, peers)


@query(f"""WITH {STATES}, r AS (SELECT o_orderkey AS request_id, o_custkey AS node_id, o_orderkey % 12 + 1 AS term, o_orderkey % 70 AS prev_idx, o_orderkey % 3 AS prev_term, o_orderkey % 4 AS n_entries, o_orderkey % 90 AS leader_commit FROM orders),
  j AS (SELECT r.*, s.term AS own, s.commit_idx AS had, CASE WHEN prev_idx = boundary_idx THEN boundary_term WHEN prev_idx > boundary_idx AND prev_idx <= last_idx THEN (node_id + prev_idx) % 3 END AS held FROM r JOIN state s USING (node_id)),
  k AS (SELECT *, CASE WHEN term < own THEN 'STALE_TERM' WHEN held IS NULL THEN 'NO_PREVIOUS' WHEN held <> prev_term THEN 'OTHER_TERM' ELSE 'ACCEPTED' END AS reason FROM j)
  SELECT request_id, reason, reason = 'ACCEPTED' AS success, greatest(term, own) AS reply_term, CASE WHEN reason = 'ACCEPTED' THEN greatest(had, least(leader_commit, prev_idx + n_entries)) ELSE had END AS commit_idx FROM k""")
def append_verdicts(s, d):
    k, states = F.col("o_orderkey"), _states(s, d)
    requests = a.table(s, d, "orders").select(k.alias("request_id"), F.col("o_custkey").alias("node_id"), (k % 12 + 1).alias("term"), (k % 70).alias("prev_idx"), (k % 3).alias("prev_term"), (k % 4).alias("n_entries"), (k % 90).alias("leader_commit"))
    log = states.select("node_id", F.explode(F.sequence(F.col("boundary_idx") + 1, "last_idx")).alias("idx")).withColumn("term", (F.col("node_id") + F.col("idx")) % 3)
    return transitions.judge_appends(requests, states, log).select("request_id", "reason", "success", "reply_term", "commit_idx")


@query(f"WITH {STATES}, p AS (SELECT o_orderkey AS seq, s.*, row_number() OVER (PARTITION BY node_id ORDER BY o_orderkey) AS n FROM orders JOIN state s ON node_id = o_custkey) SELECT node_id, seq, CASE WHEN role = 'leader' THEN 'APPENDED' ELSE 'NOT_LEADER' END AS status, CASE WHEN role = 'leader' THEN last_idx + n END AS idx, CASE WHEN role = 'leader' THEN term END AS term FROM p")
def proposals(s, d):
    sent = a.table(s, d, "orders").select(F.col("o_custkey").alias("node_id"), F.col("o_orderkey").alias("seq"))
    return transitions.propose(_states(s, d), sent)


_MARKS = "m AS (SELECT user_id % 5 AS node_id, event_id AS seq, event_id // 3 + event_id % 7 AS idx, event_id // 3 + 4 AS commit_idx FROM events)"


@query(f"WITH {_MARKS}, r AS (SELECT *, coalesce(max(CASE WHEN idx <= commit_idx THEN idx END) OVER (PARTITION BY node_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS applied_idx FROM m) SELECT node_id, seq, applied_idx, CASE WHEN idx <= applied_idx THEN 'NOT_ABOVE' WHEN idx > commit_idx THEN 'NOT_COMMITTED' ELSE 'MARKED' END AS status FROM r")
def applied_marks(s, d):
    i = F.col("event_id")
    marks = a.table(s, d, "events").select((F.col("user_id") % 5).alias("node_id"), i.alias("seq"), (F.floor(i / 3) + i % 7).alias("idx"), (F.floor(i / 3) + 4).alias("commit_idx"))
    return transitions.mark_applied(marks).select("node_id", "seq", "applied_idx", "status")


@query(f"WITH {STATES} SELECT node_id, i, CASE WHEN i = 0 THEN 'ZERO' WHEN i <= boundary_idx THEN 'NOT_ABOVE_BOUNDARY' WHEN i > applied_idx THEN 'NOT_APPLIED' WHEN i > commit_idx THEN 'NOT_COMMITTED' ELSE 'CREATED' END AS status FROM (SELECT *, node_id % 37 AS i FROM state)")
def snapshot_checks(s, d):
    states = _states(s, d).withColumn("i", F.col("node_id") % 37)
    return states.select("node_id", "i", transitions.snapshot_status(F.col("i"), F.col("boundary_idx"), F.col("applied_idx"), F.col("commit_idx")).alias("status"))


def _installed(s, d):
    states = _states(s, d).withColumn("pending_idx", F.lit(None).cast("long"))
    k = F.col("node_id")
    sent = states.where(k % 5 != 0).select("node_id", (k % 11 + 1).alias("term"), (k % 60).alias("idx"), (k % 4).alias("idx_term"))
    log = states.select("node_id", F.explode(F.sequence(F.col("boundary_idx") + 1, "last_idx")).alias("idx")).withColumn("term", (F.col("node_id") + F.col("idx")) % 3)
    return transitions.install_snapshots(states, sent, log)


_INSTALL = f"""WITH {STATES}, t AS (SELECT *, CASE WHEN node_id % 5 <> 0 THEN node_id % 11 + 1 END AS t, node_id % 60 AS i, node_id % 4 AS it FROM state),
  x AS (SELECT *, CASE WHEN t IS NULL THEN NULL WHEN t < term THEN 'STALE_TERM' WHEN i <= boundary_idx THEN 'HAVE_IT' ELSE 'INSTALLED' END AS status FROM t)"""


@query(f"{_INSTALL} SELECT node_id, status, greatest(term, coalesce(t, term)) AS term, CASE WHEN status = 'INSTALLED' THEN i ELSE boundary_idx END AS boundary_idx, CASE WHEN status = 'INSTALLED' THEN greatest(commit_idx, i) ELSE commit_idx END AS commit_idx, CASE WHEN status = 'INSTALLED' THEN i END AS pending_idx FROM x")
def snapshot_installs(s, d):
    return _installed(s, d)[0].select("node_id", "status", "term", "boundary_idx", "commit_idx", "pending_idx")


@query(f"{_INSTALL} SELECT node_id, count(*) AS n, min(idx) AS first_idx FROM (SELECT node_id, unnest(range(boundary_idx + 1, last_idx + 1)) AS idx, status, i, it FROM x) x2 WHERE coalesce(status, '') <> 'INSTALLED' OR (idx > i AND i <= (SELECT last_idx FROM state s WHERE s.node_id = x2.node_id) AND (node_id + i) % 3 = it) GROUP BY node_id")
def snapshot_install_logs(s, d):
    return _installed(s, d)[1].groupBy("node_id").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"))


@query(f"{_INSTALL} SELECT node_id, coalesce(status = 'INSTALLED', false) AND node_id % 2 = 0 AS confirmed, CASE WHEN status = 'INSTALLED' AND node_id % 2 = 0 THEN greatest(applied_idx, i) ELSE applied_idx END AS applied_idx, CASE WHEN status = 'INSTALLED' AND node_id % 2 = 1 THEN i END AS pending_idx FROM x")
def snapshot_confirms(s, d):
    """Half of the nodes confirm what is pending, the other half something else."""
    after, _ = _installed(s, d)
    k = F.col("node_id")
    told = after.select("node_id", (k % 60 + k % 2).alias("idx"))
    return transitions.confirm(after, told).select("node_id", "confirmed", "applied_idx", "pending_idx")


_HEARD = "h AS (SELECT DISTINCT user_id % 5 AS node_id, event_id // 7 * 7 AS tick FROM events WHERE event_id // 100 % 3 <> 1)"


@query(f"WITH {_HEARD}, n AS (SELECT *, coalesce(lead(tick) OVER (PARTITION BY node_id ORDER BY tick), (SELECT max(event_id) + 501 FROM events)) AS nxt FROM h) SELECT node_id, unnest(range(tick + 40, nxt, 40)) AS tick FROM n")
def election_timeouts(s, d):
    e = a.table(s, d, "events")
    i = F.col("event_id")
    heard = e.where(F.floor(i / 100) % 3 != 1).select((F.col("user_id") % 5).alias("node_id"), (F.floor(i / 7) * 7).alias("tick"))
    until = e.agg(F.max("event_id")).first()[0] + 500
    return transitions.election_ticks(heard, 40, until)


@query("SELECT node_id, unnest(range(f, t + 1, 15)) AS tick FROM (SELECT user_id % 5 AS node_id, event_id // 400 AS term, min(event_id) AS f, max(event_id) AS t FROM events GROUP BY ALL)")
def leader_heartbeats(s, d):
    e = a.table(s, d, "events")
    terms = e.groupBy((F.col("user_id") % 5).alias("node_id"), F.floor(F.col("event_id") / 400).alias("term")).agg(F.min("event_id").alias("from_tick"), F.max("event_id").alias("to_tick"))
    return transitions.heartbeat_ticks(terms, 15)


@query(f"WITH {OBS}, t AS (SELECT node AS node_id, step // 30 AS wake, max(commit_idx) AS value FROM obs GROUP BY ALL), r AS (SELECT *, max(value) OVER (PARTITION BY node_id ORDER BY wake ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM t) SELECT node_id, wake, value FROM r WHERE p IS NULL OR value > p")
def commit_notices(s, d):
    return transitions.notified(a.observations(s, d).withColumnRenamed("node", "node_id"), "step", "commit_idx", 30)


_WAITS = "w AS (SELECT n AS node, f AS field, v AS target, s AS from_step FROM (VALUES (0), (1), (2), (3), (4)) a(n), (VALUES ('commit_idx'), ('applied_idx'), ('snapshot_idx')) b(f), (VALUES (100, 0), (700, 650), (1000000000, 5)) c(v, s))"


@query(f"WITH {OBS}, {_WAITS}, l AS (SELECT node, step, 'commit_idx' AS field, commit_idx AS value FROM obs UNION ALL SELECT node, step, 'applied_idx', applied_idx FROM obs UNION ALL SELECT node, step, 'snapshot_idx', snapshot_idx FROM obs) SELECT w.node, w.field, target, from_step, (SELECT min(step) FROM l WHERE l.node = w.node AND l.field = w.field AND value >= target AND step >= from_step AND step <= from_step + 400) AS reached FROM w")
def waits(s, d):
    rows = [(n, f, v, at) for n in range(5) for f in ("commit_idx", "applied_idx", "snapshot_idx") for v, at in ((100, 0), (700, 650), (1000000000, 5))]
    return invariants.first_reached(a.observations(s, d), s.createDataFrame(rows, "node int, field string, target long, from_step long"), 400)


@query(f"WITH {OBS} SELECT min(step) AS step, arg_min(node, step) AS node FROM obs WHERE role = 'leader' AND step >= 60")
def wait_for_leader(s, d):
    return invariants.first_leader(a.observations(s, d), 60)


@query(f"WITH {OBS} SELECT step, 1 AS n_nodes, CAST(role = 'leader' AS INTEGER) AS n_leaders, CAST(step % 10 = 0 AS INTEGER) AS n_isolated FROM obs")
def cluster_observed(s, d):
    obs = a.observations(s, d)
    cut = obs.where("step % 10 = 0").select("step", "node")
    return invariants.observed(obs, cut).select("step", F.size("nodes").alias("n_nodes"), F.size("leaders").alias("n_leaders"), F.size("isolated").alias("n_isolated"))


@query("WITH l AS (SELECT user_id AS node, arg_max(CASE WHEN event_id % 3 = 0 THEN 'crash' ELSE 'restart' END, event_id) AS kind FROM events WHERE event_id % 2 = 0 GROUP BY 1) SELECT DISTINCT e.user_id AS node, coalesce(kind = 'crash', false) AS crashed FROM events e LEFT JOIN l ON l.node = e.user_id")
def live_nodes(s, d):
    e = a.table(s, d, "events")
    crashes = e.where("event_id % 2 = 0").select(F.col("user_id").alias("node"), F.col("event_id").alias("step"), F.when(F.col("event_id") % 3 == 0, "crash").otherwise("restart").alias("kind"))
    return invariants.live(e.select(F.col("user_id").alias("node")).distinct(), crashes)


@query("SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS number FROM orders")
def global_sequence(s, d):
    """Orders numbered 1, 2, ... over all of them, by date."""
    o = a.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate")
    return scan.numbered(o, [], F.col("o_orderdate"), ["id"], "number").select("id", "number")


@query(f"WITH {LOGS} SELECT node_id, 101 AS idx, coalesce(max(term) FILTER (WHERE idx = 101), 1990) AS term FROM logs GROUP BY node_id")
def log_entry_at(s, d):
    return raftlog.entry_at(a.raft_logs(s, d), 101, (101, 1990))


@query(f"WITH {HIST} SELECT history_id, id, invoke FROM hist")
def history_by_invoke(s, d):
    return history.by_invoke(a.history(s, d)).select("history_id", "id", "invoke")


@query("SELECT 'VALID' AS verdict, 600 AS n")
def random_histories(s, d):
    """Verdicts on generated histories with pending operations and faults: none is a violation."""
    made = workload.random_history(s, 600, 12, 7, faults=True)
    return history.verdicts(made).groupBy("verdict").agg(F.count("*").alias("n"))
