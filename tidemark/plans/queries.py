"""Registered queries over the domain tables; ``oracle`` has the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.functions import codecs, text
from tidemark.operators import dedup, history, invariants, kv, metrics, raftlog, runs, snapshots, workload
from tidemark.sources import adapters as a
from tidemark.sources import files
from tidemark.streaming import logstream

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _merged(s, d):
    return runs.merge(a.run_entries(s, d))


# -- key-value state


@query
def live_state(s, d):
    return kv.live(a.writes(s, d)).select("k", F.col("v").cast("double").alias("v"), "idx")


@query
def state_as_of(s, d):
    return kv.live(a.writes(s, d), as_of=5000).select("k", F.col("v").cast("double").alias("v"), "idx")


@query
def sorted_snapshot(s, d):
    return kv.live(a.writes(s, d)).select("k", F.col("v").cast("double").alias("v")).orderBy("k")


@query
def live_stats(s, d):
    return kv.stats(kv.live(a.writes(s, d)))


@query
def point_get(s, d):
    return kv.get(a.writes(s, d), F.lit("k7")).select("k", F.col("v").cast("double").alias("v"))


@query
def point_get_tri(s, d):
    probes = s.range(400).select((F.col("id") * 7).alias("k1"), (F.col("id") % 4 + 1).cast("int").alias("k2"))
    return kv.lookup(probes, _merged(s, d), runs.KEY).withColumn("v", F.col("v").cast("double"))


@query
def mutation_counts(s, d):
    return a.writes(s, d).agg(F.count_if(F.expr("op = 'PUT'")).alias("n_put"), F.count_if(F.expr("op = 'DELETE'")).alias("n_delete"))


@query
def replica_diff(s, d):
    x, y = a.replicas(s, d)
    return kv.difference(x, y).withColumns({c: F.col(c).cast("double") for c in ("a_value", "b_value")})


@query
def replica_converged(s, d):
    x, y = a.replicas(s, d)
    return kv.converged({"a": x, "b": y, "c": x})


@query
def restore_plan(s, d):
    x, y = a.replicas(s, d)
    return kv.restore_plan(x, y).withColumn("value", F.col("value").cast("double"))


@query
def snapshot_plus_log(s, d):
    log = a.writes(s, d)
    base = kv.live(log, as_of=4000).select("k", "v")
    return kv.restored(base, log, 4000).select("k", F.col("v").cast("double").alias("v"))


@query
def replica_digest(s, d):
    x, y = a.replicas(s, d)
    one = snapshots.digest(x, ["key", "value"]).select(F.col("n").alias("n_a"), F.col("digest").alias("_x"))
    other = snapshots.digest(y, ["key", "value"]).agg(F.first("n").alias("n_b"), F.first("digest").alias("_y"))
    both = one.withColumn("_o", other.select(F.struct("n_b", "_y")).scalar())
    return both.select("n_a", F.col("_o.n_b").alias("n_b"), (F.col("_x") == F.col("_o._y")).alias("equal"))


# -- deduplication


@query
def dedup_outcomes(s, d):
    return dedup.outcomes(a.writes(s, d)).select("idx", "client_id", "request_id", "outcome")


@query
def dedup_counts(s, d):
    return dedup.counts(a.writes(s, d))


@query
def latest_client_request(s, d):
    return dedup.client_table(a.writes(s, d)).select("client_id", "request_id", "op", "k", "idx")


@query
def applied_state(s, d):
    return dedup.applied_state(a.writes(s, d)).select("k", F.col("v").cast("double").alias("v"), "idx")


# -- sorted runs


@query
def run_summary(s, d):
    return runs.summary(a.run_entries(s, d))


@query
def run_sorted_check(s, d):
    """Every other table is written by key, the rest by ship date and key."""
    day = F.datediff(F.col("seq.l_shipdate"), F.lit("1990-01-01").cast("date")).cast("long")
    by_key = F.col("k1") * 10 + F.col("k2")
    e = a.run_entries(s, d).withColumn("position", F.when(F.col("table_id") % 2 == 0, by_key).otherwise(day * 10_000_000_000 + by_key))
    return runs.unsorted(e, "position").groupBy("table_id", "problem").agg(F.count("*").alias("n"), F.min("k1").alias("least_k1"))


@query
def kway_merge(s, d):
    return _merged(s, d).withColumn("v", F.col("v").cast("double"))


@query
def compact_drop_tombstones(s, d):
    e = a.run_entries(s, d)
    least = e.agg(F.min("table_id")).first()[0]
    return runs.compact(e, [least, least + 1, least + 2]).withColumn("v", F.col("v").cast("double"))


@query
def compact_keep_tombstones(s, d):
    e = a.run_entries(s, d)
    least = e.agg(F.min("table_id")).first()[0]
    return runs.compact(e, [least + 2, least + 3]).withColumn("v", F.col("v").cast("double"))


@query
def tombstone_droppable(s, d):
    return runs.droppable_from(a.run_entries(s, d))


@query
def compaction_verify(s, d):
    e = a.run_entries(s, d)
    return runs.verify(runs.merge(e), runs.merge_by_rank(e))


@query
def candidate_block(s, d):
    probes = s.createDataFrame([(i * 311, i % 5) for i in range(40)], "p1 long, p2 int")
    return runs.candidate_block(runs.block_index(a.run_entries(s, d), 100), probes)


@query
def manifest_replace(s, d):
    m = s.createDataFrame([(i, f"{i:06d}.sst") for i in range(1, 7)], "table_id int, file string")
    m = runs.add_table(runs.remove_tables(m, [4, 99]), "000007.sst")
    return runs.replace_tables(m, [1, 3, 5], "compacted-1-3-5.sst")


@query
def compacted_names(s, d):
    ids = a.run_entries(s, d).groupBy((F.col("table_id") % 2).alias("parity")).agg(F.collect_set("table_id").alias("ids"))
    return ids.select("parity", runs.output_name(F.col("ids")).alias("name"))


# -- consensus logs


@query
def log_slice(s, d):
    return raftlog.suffix(a.raft_logs(s, d), 300)


@query
def log_range(s, d):
    return raftlog.between(a.raft_logs(s, d), 50, 400, base=100)


@query
def log_committed(s, d):
    return raftlog.committed(a.raft_logs(s, d).where("node_id = 1"), 20, 350)


@query
def log_tail(s, d):
    return raftlog.tail(a.raft_logs(s, d))


@query
def log_gaps(s, d):
    return raftlog.gaps(a.raft_logs(s, d))


@query
def term_regressions(s, d):
    return raftlog.term_regressions(a.raft_logs(s, d).withColumn("term", F.col("term") - F.when(F.col("idx") % 113 == 0, 2).otherwise(0)))


@query
def log_validate(s, d):
    return raftlog.validate(a.raft_logs(s, d), 1998)


def _two(s, d):
    log = a.raft_logs(s, d)
    mine = log.where("node_id = 0").select("idx", "term")
    sent = log.where("node_id = 1").select("idx", "term")
    return mine, sent


@query
def log_conflict_point(s, d):
    return raftlog.conflict_point(*_two(s, d))


@query
def append_after(s, d):
    return raftlog.append_after(*_two(s, d))


@query
def log_match(s, d):
    mine, _ = _two(s, d)
    return raftlog.matches(mine, 10, 1995)


@query
def log_compact(s, d):
    return raftlog.compact(a.raft_logs(s, d), 200)


@query
def install_boundary(s, d):
    return raftlog.install_boundary(a.raft_logs(s, d), 120, 1995)


@query
def commit_index(s, d):
    peers = a.peer_match(s, d)
    terms = peers.select("cluster", F.col("match_idx").alias("idx"), (F.floor(F.col("match_idx") / 100) + 1).alias("term")).distinct()
    cluster = peers.select("cluster").distinct().select("cluster", (F.col("cluster") * 20).cast("long").alias("commit_idx"), (F.col("cluster") % 6 + 3).cast("long").alias("current_term"))
    return raftlog.commit_index(peers.select("cluster", "match_idx"), terms, cluster)


@query
def follower_commit(s, d):
    o = a.observations(s, d)
    return o.select("step", raftlog.follower_commit(F.col("commit_idx"), F.col("commit_idx") + 3, F.col("last_idx")).alias("commit_idx"))


@query
def follower_lag(s, d):
    p = a.peer_match(s, d)
    return p.select("cluster", "peer", raftlog.lag(F.lit(700), F.col("match_idx")).alias("lag"))


@query
def retained_entries(s, d):
    return a.observations(s, d).select("step", raftlog.retained(F.col("last_idx"), F.col("snapshot_idx")).alias("retained"))


def _votes(s, d):
    o = a.table(s, d, "orders")
    k = F.col("o_orderkey")
    return o.select(
        (F.col("o_custkey") % 5).cast("int").alias("voter"),
        F.floor(k / 50).alias("term"),
        k.alias("seq"),
        (k % 3).cast("int").alias("candidate"),
        (k % 4).alias("c_term"),
        (k * 7 % 11).alias("c_idx"),
        (k % 3).alias("v_term"),
        (k * 5 % 11).alias("v_idx"),
    )


@query
def vote_grants(s, d):
    return raftlog.vote_grants(_votes(s, d)).select("voter", "term", "seq", "candidate", "granted")


@query
def election_tally(s, d):
    return raftlog.elected(raftlog.vote_grants(_votes(s, d)), 5)


@query
def quorum_reads(s, d):
    e = a.table(s, d, "events")
    acks = e.select(F.floor(F.col("event_id") / 4).alias("read_id"), (F.col("event_id") % 9 != 0).alias("same_term"), (F.col("event_type") != "error").alias("acked"))
    return raftlog.quorum_reads(acks, 5)


@query
def replication_progress(s, d):
    e = a.table(s, d, "events")
    replies = e.select((F.col("user_id") % 7).alias("peer"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("success"), F.col("event_id").alias("prev_idx"), (F.col("event_id") % 3).alias("n"))
    return raftlog.progress(replies).select("peer", "seq", "match_idx", "next_idx")


# -- invariants


@query
def inv_term(s, d):
    return invariants.term_decreases(a.observations(s, d))


@query
def inv_snapshot(s, d):
    return invariants.snapshot_decreases(a.observations(s, d))


@query
def inv_commit(s, d):
    return invariants.commit_decreases(a.observations(s, d))


@query
def inv_applied(s, d):
    return invariants.applied_decreases(a.observations(s, d))


@query
def inv_applied_le_commit(s, d):
    return invariants.applied_beyond_commit(a.observations(s, d))


@query
def inv_multi_leader(s, d):
    return invariants.rival_leaders(a.observations(s, d))


@query
def inv_first_violation(s, d):
    return invariants.first_violations(a.observations(s, d))


@query
def leader_changes(s, d):
    return invariants.changes(a.observations(s, d), "leader", ["node"])


@query
def converged_rounds(s, d):
    return invariants.converged_rounds(a.observations(s, d), 40, 12)


@query
def first_converged_step(s, d):
    return invariants.first_converged(a.observations(s, d), 40, 12)


@query
def reachable_pairs(s, d):
    nodes = s.createDataFrame([(1, 0, False), (2, 0, False), (3, 1, False), (4, None, False), (5, 1, True)], "node int, grp int, isolated boolean")
    return workload.reachable(nodes)


@query
def backend_order(s, d):
    b = s.createDataFrame([("n1:8080", 0), ("n2:8080", 1), ("n3:8080", 2)], "addr string, pos int")
    return workload.candidate_order(b, "n3:8080")


# -- histories


@query
def history_validate(s, d):
    return history.validate(a.history(s, d))


@query
def completed_operations(s, d):
    h = a.history(s, d)
    return history.completed(h).groupBy("kind").agg(F.count("*").alias("n"))


@query
def successful_writes(s, d):
    return history.successful_writes(a.history(s, d)).select("history_id", "id", "key", "value").orderBy("history_id", "id")


@query
def precedence_edges(s, d):
    return history.precedence(a.history(s, d))


@query
def stale_gets(s, d):
    return history.stale_gets(a.history(s, d))


@query
def linearizable_verdict(s, d):
    return history.verdicts(a.history(s, d)).select("history_id", "n_ops", "n_completed", "verdict")


@query
def minimized_histories(s, d):
    return history.minimized(a.history(s, d))


@query
def verdict_report(s, d):
    return history.report(a.history(s, d))


@query
def optional_subsets(s, d):
    return history.subsets(s.range(15).select(F.col("id").cast("int").alias("k")))


# -- metrics


@query
def counter_totals(s, d):
    return metrics.totals(a.request_log(s, d), "method")


@query
def errors_by_component(s, d):
    return metrics.totals(a.request_log(s, d).where("status >= 400"), "component")


@query
def requests_by_class(s, d):
    return metrics.requests_by_class(a.request_log(s, d))


@query
def gauge_last(s, d):
    return metrics.gauge_last(a.request_log(s, d), "route", "latency_ms", "id").withColumn("value", F.col("value").cast("double"))


@query
def gauge_running(s, d):
    e = a.request_log(s, d).withColumn("delta", F.when(F.col("method") == "PUT", 1).otherwise(-1))
    return metrics.gauge_running(e, "route", "delta", "id").select("route", "id", "value")


@query
def latency_histogram(s, d):
    return metrics.histogram(a.request_log(s, d), "route", F.col("latency_ms").cast("double") / 1000)


@query
def mean_latency_ms(s, d):
    h = a.request_log(s, d).groupBy("route").agg(F.sum("latency_ms").alias("_s"), F.count("*").alias("n"))
    return h.select("route", F.round(metrics.mean_ms(F.col("_s").cast("double") / 1000, F.col("n")), 4).alias("mean_ms"))


@query
def counter_rate(s, d):
    r = metrics.rates(a.samples(s, d), ["label"], "day", "value")
    return r.select("label", "day", F.round(F.col("rate").cast("double"), 6).alias("rate"))


@query
def latency_percentiles(s, d):
    p = metrics.percentiles(a.request_log(s, d), "route", "latency_ms", [0.5, 0.95, 0.99])
    return p.select("route", *[F.col(c).cast("double").alias(c) for c in ("p50", "p95", "p99")])


@query
def throughput(s, d):
    t = metrics.throughput(a.request_log(s, d), "ts")
    return t.select("n", F.round("per_second", 8).alias("per_second"))


@query
def role_one_hot(s, d):
    return metrics.one_hot(a.observations(s, d).select("node", "step", "role"), "role", ["leader", "candidate", "follower"])


@query
def active_role(s, d):
    o = a.observations(s, d).select("node", "step", F.col("role").alias("label"), F.lit(1).alias("value"))
    return metrics.active_label(o, ["node", "step"], "label", "value")


@query
def synced_followers(s, d):
    p = a.peer_match(s, d).select("cluster", raftlog.lag(F.lit(700), F.col("match_idx")).alias("lag"))
    return p.groupBy("cluster").agg((F.count_if(F.expr("lag = 0")) + 1).alias("n_synced"), F.sum("lag").alias("total_lag"))


@query
def recent_window(s, d):
    return metrics.recent(a.request_log(s, d), "ts", 60).select("id", "method", "status")


@query
def event_stream(s, d):
    return metrics.newest(a.request_log(s, d), ["id"], 50, F.col("status") >= 500).select("id", "route", "status")


@query
def bounded_sample(s, d):
    return metrics.sample(a.request_log(s, d), "id", 500).select("id", "latency_ms")


_TEXT = """# HELP app_requests_total Requests
# TYPE app_requests_total counter
app_requests_total{class="2xx"} 17
app_requests_total{class="5xx",route="/kv/{key}"} 3
app_role{role="leader"} 1
  app_up 1
app_bad{ 5
app_nan NaN
app_inf +Inf
app_latency_bucket{le="+Inf"} 20
app_quoted{path="a\\"b\\nc"} 2.5e3
1bad 4
"""


@query
def prom_parse(s, d):
    p = metrics.parse(s.createDataFrame([(_TEXT,)], "text string"), "text")
    return p.select("name", F.array_join(F.array_sort(F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("labels"), "value")


@query
def prom_round_trip(s, d):
    t = metrics.totals(a.request_log(s, d), "route").select(F.lit("app_requests").alias("name"), F.lit("route").alias("label"), F.col("route").alias("label_value"), F.col("total").alias("value"))
    kinds = s.createDataFrame([("app_requests", "Requests by route", "counter")], "name string, help string, kind string")
    return metrics.parse(metrics.exposition(t, kinds), "text").select("name", F.element_at("labels", "route").alias("route"), "value")


# -- workloads, texts, codecs


@query
def workload_mix(s, d):
    return workload.mix(workload.keys(s, 20000, 100), 50).groupBy("op").agg(F.count("*").alias("n"), F.count_distinct("key").alias("n_keys"))


@query
def hotset_keys(s, d):
    return workload.keys(s, 20000, 100, "hotset").groupBy("key").agg(F.count("*").alias("n"))


@query
def sequential_keys(s, d):
    return workload.keys(s, 1000, 100, "sequential").groupBy("key").agg(F.count("*").alias("n"))


@query
def value_sizes(s, d):
    return workload.values(workload.keys(s, 300, 50, "sequential"), 4096).agg(F.count("*").alias("n"), F.sum(F.octet_length("value")).alias("n_bytes"))


@query
def compaction_inputs(s, d):
    e = workload.compaction_inputs(s, 4, 500, False, 10)
    return e.groupBy("table_id").agg(F.count("*").alias("n"), F.count_if(F.expr("tombstone")).alias("n_tombstones"), F.min("key").alias("first"), F.max("key").alias("last"))


@query
def fault_plan(s, d):
    return workload.fault_plan(s, 60, 5)


@query
def outcome_classes(s, d):
    e = a.table(s, d, "events").select((F.col("event_id") % 4 < 3).alias("accepted"), (F.col("event_id") % 4 < 2).alias("applied"))
    return workload.classify(e).groupBy("outcome").agg(F.count("*").alias("n"))


@query
def peer_list_parse(s, d):
    return text.parse_peers(s.createDataFrame([("n1=h1:9090|h1:8080, n2=h2:9090|h2:8080,,n3=h3:9090|h3:8080",)], "x string"), "x")


@query
def text_functions(s, d):
    df = s.createDataFrame([("h:80", " WARN ", "Bearer abc", "x.org/", 1536, '{"a":1}'), (":8080", "loud", "Basic abc", "https://y/", 12, '"t"'), ("h:99999", None, "bearer  q", "z", 5 << 20, "17")], "addr string, level string, auth string, url string, n long, json string")
    return df.select(
        "addr",
        text.valid_address(F.col("addr")).alias("valid"),
        text.wildcard_host(F.col("addr")).alias("wildcard"),
        text.log_level(F.col("level")).alias("level"),
        text.bearer(F.col("auth")).alias("token"),
        text.base_url(F.col("url")).alias("url"),
        text.human_bytes(F.col("n")).alias("size"),
        text.value_type(F.col("json")).alias("kind"),
        text.padded("req-", F.col("n"), 8).alias("request"),
        metrics.status_class(F.col("n") % 500 + 100).alias("class"),
        F.array_join(text.origins(F.concat("addr", F.lit(", ,"), "url")), "+").alias("origins"),
    )


@query
def result_codes(s, d):
    n = dedup.outcomes(a.writes(s, d)).groupBy("outcome").agg(F.count("*").alias("n"))
    code = text.named(F.col("outcome"), {"APPLIED": 0, "REPLAYED": 0, "CONFLICT": 1, "STALE": 2, "EMPTY_KEY": 3})
    return n.groupBy(code.alias("code")).agg(F.sum("n").alias("n"))


@query
def operation_text(s, d):
    h = a.history(s, d)
    return h.select("id", text.describe({c: F.col(c) for c in h.columns if c != "history_id"}).alias("description"))


@query
def chunk_offsets(s, d):
    docs = a.table(s, d, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))
    return snapshots.chunk_offsets(docs, F.col("n"), 1000).select("doc_id", "offset", "n_bytes", "final")


@query
def chunk_reassembly(s, d):
    e = a.table(s, d, "events")
    piece = F.col("event_id") % 3
    data = F.concat(F.lit("part"), piece.cast("string")).cast("binary")
    late = F.when(F.col("event_id") % 50 == 1, 1).otherwise(0)
    chunks = e.select(
        F.floor(F.col("event_id") / 30).alias("receiver"),
        F.col("event_id").alias("seq"),
        F.floor(F.col("event_id") / 3).cast("string").alias("identity"),
        (piece * 5).alias("offset"),
        data.alias("data"),
        F.lit(15).cast("long").alias("total"),
        (codecs.crc32c(data) + late).alias("checksum"),
        (piece == 2).alias("final"),
    )
    return snapshots.reassemble(chunks).groupBy("status").agg(F.count("*").alias("n"))


@query
def wal_round_trip(s, d):
    log = a.writes(s, d).select((F.col("client_id") % 16).alias("file"), "idx", "op", F.col("k").alias("key"), F.col("v").cast("string").alias("value"))
    back = codecs.decode_log(codecs.encode_log(log, ["file"], "idx"))
    return back.groupBy("status", "op").agg(F.count("*").alias("n"), F.sum(F.octet_length("key")).alias("key_bytes"), F.sum(F.octet_length("value")).alias("value_bytes"))


@query
def wal_torn_tail(s, d):
    log = a.writes(s, d).select((F.col("client_id") % 16).alias("file"), "idx", "op", F.col("k").alias("key"), F.col("v").cast("string").alias("value"))
    logs = codecs.encode_log(log, ["file"], "idx")
    cut = logs.withColumn("content", F.expr("substring(content, 1, octet_length(content) - file)"))
    return codecs.decode_log(cut).groupBy("file").agg(F.count_if(F.expr("status = 'OK'")).alias("n_ok"), F.count_if(F.expr("status = 'TORN'")).alias("n_torn"), F.count_if(F.expr("status = 'CORRUPT'")).alias("n_corrupt"))


@query
def checksums(s, d):
    k = a.table(s, d, "nation").select(F.col("n_name").cast("string").alias("name"))
    b = F.col("name").cast("binary")
    return k.select("name", codecs.crc32c(b).alias("crc32c"), codecs.fnv1a(b).cast("string").alias("fnv1a"), codecs.fnv1(b).cast("string").alias("fnv1"))


@query
def command_round_trip(s, d):
    log = a.writes(s, d).select("client_id", "request_id", "op", "k", F.coalesce(F.col("v").cast("string"), F.lit("")).alias("v")).where("request_id >= 0")
    sent = log.withColumn("c", codecs.encoded_command(F.col("client_id").cast("string"), "request_id", "op", F.col("k").cast("binary"), F.col("v").cast("binary")))
    back = sent.select("*", codecs.decoded_command("c").alias("m"))
    same = (F.col("m.client_id") == F.col("client_id").cast("string")) & (F.col("m.request_id") == F.col("request_id")) & (F.col("m.op") == F.col("op")) & (F.col("m.key") == F.col("k").cast("binary")) & (F.col("m.value") == F.col("v").cast("binary"))
    return back.agg(F.count("*").alias("n"), F.count_if(same).alias("n_same"))


@query
def bloom_membership(s, d):
    keys = a.run_entries(s, d).select("table_id", F.concat_ws("/", "k1", "k2").alias("key"))
    probes = a.run_entries(s, d).select(F.concat_ws("/", "k1", "k2").alias("probe"), "table_id").distinct()
    found = codecs.may_contain_own(codecs.bloom_build(keys, "key", ["table_id"]), probes, "probe", ["table_id"])
    return found.agg(F.count("*").alias("n_probes"), F.count_if(F.expr("may_contain")).alias("n_found"))


# -- streams


def _log_files(s: SparkSession, d: str, n: int) -> str:
    """The log as files in the order of the index, as a log writer leaves them."""
    base = files.shared_folder(s)
    folder = f"{base}/log-{uuid.uuid4().hex}"
    log = a.writes(s, d)
    log.repartitionByRange(n, "idx").sortWithinPartitions("idx").write.parquet(f"{folder}/files")
    return folder


@query
def stream_dedup(s, d):
    folder = _log_files(s, d, 4)
    schema = s.read.parquet(f"{folder}/files").schema
    out = logstream.outcomes(logstream.read_log(s, f"{folder}/files", schema))
    logstream.append_to(out, f"{folder}/out", f"{folder}/checkpoint")
    return s.read.parquet(f"{folder}/out").select("idx", "client_id", "request_id", "outcome")


@query
def stream_live_state(s, d):
    folder = _log_files(s, d, 4)
    schema = s.read.parquet(f"{folder}/files").schema
    state = logstream.drain(logstream.latest(logstream.read_log(s, f"{folder}/files", schema)), f"{folder}/out", "complete", f"{folder}/checkpoint")
    return state.where("op = 'PUT'").select("k", F.col("v").cast("double").alias("v"), "idx")
