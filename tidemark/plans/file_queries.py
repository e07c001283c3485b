"""Registered queries over files and fixed layouts, each with its SQL form (``ORACLE``)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import codecs, images, messages, runfile, text
from tidemark.operators import dedup, kv, metrics, runs, snapshots, workload
from tidemark.plans.oracle import _LIVE, CMD, HIST, MERGED, OUTCOMES, REPLICAS, REQ, RUNS
from tidemark.sources import adapters as a
from tidemark.sources import files
from tidemark.streaming import logstream

QUERIES, ORACLE = {}, {}
#: Magic of files that are written and read here; real files have their own.
RUN, STATE, IMAGE, SNAPSHOT, MANIFEST = b"TIDE-RUN", b"TIDE-NOD", b"TIDE-MAC", b"TIDE-SNP", b"TIDE-MAN"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _folder(s) -> str:
    return f"{files.shared_folder(s)}/files-{uuid.uuid4().hex}"


# -- the write-ahead log


def _segments(s, d):
    """Logs of 5000 indexes each, the last one torn within its last record."""
    log = a.writes(s, d).select(F.floor(F.col("idx") / 5000).alias("file"), "idx", "op", F.col("k").alias("key"), F.col("v").cast("string").alias("value"))
    logs = codecs.encode_log(log, ["file"], "idx")
    last = logs.agg(F.max("file")).scalar()
    return logs.withColumn("content", F.when(F.col("file") == last, F.expr("substring(content, 1, octet_length(content) - 3)")).otherwise(F.col("content")))


@query(f"WITH {CMD} {_LIVE.format('cmd', 'WHERE idx < (SELECT max(idx) FROM cmd)')}".replace(", idx FROM", " FROM"))
def store_recovery(s, d):
    state = kv.recovered(codecs.decode_log(_segments(s, d)), ["file"])
    return state.select(F.col("k").cast("string").alias("k"), F.col("v").cast("string").cast("double").alias("v"))


_SIZES = f"WITH {CMD}, r AS (SELECT idx // 5000 AS file, idx, 13 + length(k) + coalesce(length(CAST(v AS VARCHAR)), 0) AS n FROM cmd)"


@query(f"{_SIZES} SELECT file, CAST(sum(n) - max(CASE WHEN file = (SELECT max(file) FROM r) THEN (SELECT arg_max(n, idx) FROM r) ELSE 0 END) AS BIGINT) AS n_bytes, max(CASE WHEN file = (SELECT max(file) FROM r) THEN (SELECT arg_max(n, idx) FROM r) - 3 ELSE 0 END) AS cut FROM r GROUP BY file")
def wal_truncation(s, d):
    return codecs.truncate_torn(_segments(s, d)).select("file", F.octet_length("content").cast("long").alias("n_bytes"), F.col("cut").cast("long").alias("cut"))


@query(f"WITH {CMD} SELECT true AS ready, count(*) > 0 AS found, CAST(NULL AS VARCHAR) AS reason FROM ({_LIVE.format('cmd', '')}) WHERE k = 'k7'")
def ready_probe(s, d):
    return kv.ready(a.writes(s, d), "k7", codecs.decode_log(_segments(s, d)))


@query("SELECT false AS ready, false AS found, 'CORRUPT' AS reason")
def ready_probe_corrupt(s, d):
    bad = _segments(s, d).withColumn("content", F.expr("concat(substring(content, 1, 20), x'FF', substring(content, 22))"))
    return kv.ready(a.writes(s, d), "no such key", codecs.decode_log(bad))


# -- run files

_KEYED = "lpad(CAST(k1 AS VARCHAR), 12, '0') || '/' || k2"
_ENTRIES = f"WITH {MERGED}, e AS (SELECT table_id, {_KEYED} AS key, CASE WHEN tombstone THEN NULL ELSE CAST(v AS VARCHAR) END AS value, tombstone FROM merged)"


#: Values of k1 in a run file: a run is dealt into files by ranges of its keys, so no file grows with the run.
_RANGE = 1 << 16


def _entries(s, d):
    key = F.concat(F.lpad(F.col("k1").cast("string"), 12, "0"), F.lit("/"), F.col("k2").cast("string"))
    return runs.merge(a.run_entries(s, d)).select("table_id", F.floor(F.col("k1") / _RANGE).alias("part"), key.alias("key"), F.col("v").cast("string").alias("value"), "tombstone")


def _run_files(s, d):
    return runfile.encode_runs(_entries(s, d), ["table_id", "part"], RUN)


@query(f"{_ENTRIES} SELECT table_id, key, value, tombstone FROM e")
def run_file_round_trip(s, d):
    back = runfile.decode_runs(_run_files(s, d), RUN)
    return back.select("table_id", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "tombstone")


@query(f"{_ENTRIES} SELECT table_id, count(*) AS n_entries, min(key) AS min_key, max(key) AS max_key FROM e GROUP BY table_id")
def run_file_summary(s, d):
    out = runfile.summaries(_run_files(s, d), RUN)
    whole = out.groupBy("table_id").agg(F.sum("n_entries").alias("n_entries"), F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"))
    return whole.select("table_id", "n_entries", F.col("min_key").cast("string").alias("min_key"), F.col("max_key").cast("string").alias("max_key"))


@query(f"{_ENTRIES}, p AS (SELECT table_id, lpad(CAST(range * 5 AS VARCHAR), 12, '0') || '/' || (range % 4 + 1) AS key FROM range(2000), (SELECT DISTINCT table_id FROM entry)) SELECT table_id, key, CASE WHEN tombstone IS NULL THEN 'NOT_FOUND' WHEN tombstone THEN 'TOMBSTONE' ELSE 'FOUND' END AS result, value FROM p LEFT JOIN e USING (table_id, key)")
def run_file_get(s, d):
    tables = a.run_entries(s, d).select("table_id").distinct()
    key = F.concat(F.lpad((F.col("id") * 5).cast("string"), 12, "0"), F.lit("/"), (F.col("id") % 4 + 1).cast("string"))
    probes = s.range(2000).select(F.floor(F.col("id") * 5 / _RANGE).alias("part"), key.alias("key")).join(tables)
    return runfile.get(_run_files(s, d), probes, ["table_id", "part"], RUN).withColumn("value", F.col("value").cast("string")).drop("part")


@query(f"{_ENTRIES} SELECT table_id, count(*) AS n, count(*) FILTER (WHERE tombstone) AS n_tombstones, true AS in_order FROM e GROUP BY table_id")
def run_table_scan(s, d):
    """A run written as a table of its own, in key order, and scanned."""
    at = _folder(s)
    runs.write_run(runs.merge(a.run_entries(s, d)), at)
    back = runs.read_run(s, at).select("table_id", "tombstone")
    return back.groupBy("table_id").agg(F.count("*").alias("n"), F.count_if("tombstone").alias("n_tombstones")).withColumn("in_order", F.lit(True))


@query(f"WITH {RUNS}, t AS (SELECT DISTINCT table_id FROM entry) SELECT table_id % 2 AS shard, (SELECT max(table_id) + 1 FROM t x WHERE x.table_id % 2 = t.table_id % 2) AS next_id, table_id, lpad(CAST(table_id AS VARCHAR), 6, '0') || '.run' AS file FROM t")
def manifest_round_trip(s, d):
    tables = a.run_entries(s, d).select("table_id").distinct()
    manifest = tables.select((F.col("table_id") % 2).alias("shard"), F.col("table_id").cast("long").alias("table_id"), F.concat(F.lpad(F.col("table_id").cast("string"), 6, "0"), F.lit(".run")).alias("file"))
    return runs.in_order(images.manifest_rows(images.manifest_file(manifest, ["shard"], MANIFEST), ["shard"], MANIFEST))


# -- states, images, messages

_DENSE = "l AS (SELECT CAST(o_custkey % 3 AS INTEGER) AS node_id, row_number() OVER (PARTITION BY o_custkey % 3 ORDER BY o_orderdate, o_orderkey) AS idx, CAST(year(o_orderdate) AS BIGINT) AS term, 'c' || o_orderkey AS command FROM orders)"


@query(f"WITH {_DENSE} SELECT node_id, (idx - 1) // 100000 AS part, max(term) OVER (PARTITION BY node_id, (idx - 1) // 100000) AS current_term, 'n' || node_id AS voted_for, idx, term, command FROM l")
def persisted_state_round_trip(s, d):
    log = a.raft_logs(s, d, every=True).withColumn("part", F.floor((F.col("idx") - 1) / 100000))
    states = log.groupBy("node_id", "part").agg(F.max("term").alias("current_term"), F.concat(F.lit("n"), F.first("node_id").cast("string")).alias("voted_for"))
    held = images.state_file(log, states, ["node_id", "part"], STATE)
    return images.state_rows(held, ["node_id", "part"], STATE).withColumn("command", F.col("command").cast("string"))


def _image(s, d):
    keys, _ = a.replicas(s, d)
    keys = keys.select((F.col("key") % 16).alias("shard"), F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
    table = dedup.client_table(a.writes(s, d))
    none = F.lit(b"")
    clients = table.select((F.col("client_id") % 16).alias("shard"), "client_id", F.greatest("request_id", F.lit(0)).alias("request_id"), "op", F.col("k").alias("key"), F.col("v").cast("string").alias("value"), F.lit(True).alias("applied"), F.lit(False).alias("replayed"), F.col("k").alias("result_key"), none.alias("result_value"), F.lit("none").alias("error"))
    return images.machine_rows(images.machine_file(keys, clients, ["shard"], IMAGE, (1000, 3, SNAPSHOT)), ["shard"], IMAGE, SNAPSHOT)


@query(f"WITH {REPLICAS} SELECT key % 16 AS shard, CAST(key AS VARCHAR) AS key, CAST(value AS DOUBLE) AS value FROM ra")
def machine_image_keys(s, d):
    return _image(s, d)[0].select("shard", F.col("key").cast("string").alias("key"), F.col("value").cast("string").cast("double").alias("value"))


@query(f"WITH {OUTCOMES} SELECT client_id % 16 AS shard, CAST(client_id AS VARCHAR) AS client_id, greatest(max(request_id), 0) AS request_id, arg_max(op, request_id) AS op, arg_max(k, request_id) AS key FROM outcomes WHERE outcome IN ('APPLIED', 'EMPTY_KEY') GROUP BY client_id")
def machine_image_clients(s, d):
    return _image(s, d)[1].select("shard", "client_id", "request_id", "op", F.col("key").cast("string").alias("key"))


def _size(column: str) -> str:
    return f"CASE WHEN {column} = 0 THEN 0 WHEN {column} < 128 THEN 2 WHEN {column} < 16384 THEN 3 WHEN {column} < 2097152 THEN 4 ELSE 5 END"


@query(f"SELECT o_orderkey AS id, {_size('o_orderkey')} + 4 + {_size('o_orderkey * 7')} + {_size('o_orderkey % 300')} AS n_bytes, o_orderkey AS term, 'n' || (o_custkey % 5) AS candidate_id, o_orderkey * 7 AS last_log_index, o_orderkey % 300 AS last_log_term FROM orders")
def rpc_round_trip(s, d):
    """Vote requests as messages and back, with their size."""
    k = F.col("o_orderkey")
    rows = a.table(s, d, "orders").select(k.alias("id"), k.alias("term"), F.concat(F.lit("n"), (F.col("o_custkey") % 5).cast("string")).alias("candidate_id"), (k * 7).alias("last_log_index"), (k % 300).alias("last_log_term"))
    sent = rows.select("id", messages.to_bytes("RequestVoteRequest", "term", "candidate_id", "last_log_index", "last_log_term").alias("data"))
    back = sent.select("id", F.octet_length("data").cast("long").alias("n_bytes"), messages.from_bytes("RequestVoteRequest", F.col("data")).alias("m"))
    return back.select("id", "n_bytes", "m.*")


@query("SELECT o_orderkey AS id, 2 AS n_entries, o_orderkey AS first_idx, 'c' || o_custkey AS command FROM orders")
def rpc_entries_round_trip(s, d):
    """Append requests with two entries each, as messages and back."""
    k = F.col("o_orderkey")
    entry = lambda i: F.struct((k + i).alias("index"), (k % 7).alias("term"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).cast("binary").alias("command"))
    rows = a.table(s, d, "orders").select(k.alias("id"), F.array(entry(0), entry(1)).alias("entries"))
    sent = rows.select("id", messages.to_bytes("AppendEntriesRequest", F.col("id"), F.lit("n1"), F.lit(0), F.lit(0), F.col("entries"), F.lit(0)).alias("data"))
    m = sent.select("id", messages.from_bytes("AppendEntriesRequest", F.col("data")).alias("m"))
    return m.select("id", F.size("m.entries").alias("n_entries"), F.col("m.entries")[0]["index"].alias("first_idx"), F.col("m.entries")[1]["command"].cast("string").alias("command"))


# -- tables in files


@query(f"WITH {HIST} SELECT history_id, id, kind, key, value, outcome FROM hist")
def history_json(s, d):
    at = _folder(s)
    files.save_history(a.history(s, d), at)
    return files.load_history(s, at).select("history_id", "id", "kind", "key", "value", "outcome")


@query(f"WITH {REQ} SELECT id, route, status FROM req ORDER BY id DESC LIMIT 100")
def event_tail(s, d):
    """Events appended twice, half by half, and the last hundred of them: a report."""
    at, log = _folder(s), a.request_log(s, d).select("id", "route", "status")
    for half in (0, 1):
        files.append_events(log.where(F.col("id") % 2 == half), at)
    return files.tail_events(s, at, "id", 100)


@query(f"WITH {REPLICAS} SELECT 2 AS version, key, CAST(value AS DOUBLE) AS value FROM rb")
def version_round_trip(s, d):
    """Two versions of a table; readers take the newest."""
    at = _folder(s)
    x, y = a.replicas(s, d)
    files.save_version(x, at)
    n = files.save_version(y, at)
    return files.load_version(s, at).select(F.lit(n).alias("version"), "key", F.col("value").cast("double").alias("value"))


@query(f"WITH {CMD} SELECT k, CAST(v AS DOUBLE) AS v FROM ({_LIVE.format('cmd', '')})")
def snapshot_round_trip(s, d):
    """A saved snapshot of the first 4000 indexes, and the log after it."""
    at, log = _folder(s), a.writes(s, d)
    head = log.where("idx <= 4000")
    files.save_snapshot(kv.live(head), dedup.client_table(head), 4000, 3, at)
    state, _ = files.load_snapshot(s, at)
    whole = kv.restored(state.select("k", F.col("v").cast("decimal(18,2)").alias("v")), log, 4000)
    return whole.select("k", F.col("v").cast("double").alias("v"))


@query("SELECT 'n' || (o_custkey % 7) AS peer, count(*) AS n, CASE WHEN o_custkey % 7 < 3 THEN 'g' || (o_custkey % 7) || ':1' END AS grpc_addr FROM orders GROUP BY ALL")
def peer_addresses(s, d):
    peers = text.parse_peers(s.createDataFrame([("n0=g0:1|h0:2,n1=g1:1|h1:2,n2=g2:1|h2:2",)], "x string"), "x")
    rows = a.table(s, d, "orders").select(F.concat(F.lit("n"), (F.col("o_custkey") % 7).cast("string")).alias("peer"))
    return files.with_address(rows, peers, "peer").groupBy("peer", "grpc_addr").agg(F.count("*").alias("n"))


@query("SELECT 'h' || (o_custkey % 7) AS addr, count(*) AS n FROM orders WHERE o_custkey % 7 IN (1, 4) GROUP BY 1")
def trusted_hints(s, d):
    hints = a.table(s, d, "orders").select(F.concat(F.lit("h"), (F.col("o_custkey") % 7).cast("string")).alias("addr"))
    backends = s.createDataFrame([("h1",), ("h4",), ("h9",)], "addr string")
    return files.trusted(hints, backends).groupBy("addr").agg(F.count("*").alias("n"))


@query("SELECT doc_id, true AS whole, coalesce(text, '') = '' OR unicode(right(text, 1)) < 128 AS cut_valid FROM documents")
def utf8_validity(s, d):
    """Whether texts are UTF-8, and whether they still are without their last byte (an empty one: yes)."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    cut = F.substring(data, F.lit(1), F.greatest(F.octet_length(data) - 1, F.lit(0)))
    return a.table(s, d, "documents").select("doc_id", files.valid_utf8(data.cast("string")).alias("whole"), files.valid_utf8(cut.cast("string")).alias("cut_valid"))


@query("SELECT o_orderkey AS id, o_orderkey * 7 AS n, o_orderkey * 7 % 65536 AS low FROM orders")
def little_endian_fields(s, d):
    k = F.col("o_orderkey") * 7
    pairs = F.regexp_extract_all(F.lpad(F.hex(k), 14, "0"), F.lit("(..)"), 1)
    rows = a.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.unhex(F.array_join(F.reverse(pairs), "")).alias("data"))
    return rows.select("id", codecs.little_endian(F.col("data"), 1, 7).alias("n"), codecs.little_endian(F.col("data"), 1, 2).alias("low"))


# -- numbers and texts


@query(f"WITH {REQ} SELECT DISTINCT CAST(latency_ms AS DOUBLE) AS x, true AS same FROM req")
def shortest_numbers(s, d):
    """Distinct latencies, and whether their shortest text reads back as the same number."""
    x = a.request_log(s, d).select(F.col("latency_ms").cast("double").alias("x")).distinct()
    return x.withColumn("same", text.shortest(F.col("x")).cast("double") == F.col("x"))


@query("""SELECT * FROM (VALUES (0.0, '0'), (1.0, '1'), (-2.5, '-2.5'), (100000.0, '100000'), (1000000.0, '1e+06'), (123456789.0, '1.23456789e+08'), (0.0001, '0.0001'), (0.00001, '1e-05'), (1e300, '1e+300'), (0.1, '0.1'), (1234.5, '1234.5'), (250000.25, '250000.25')) t(x, said)""")
def shortest_formats(s, d):
    rows = [(x,) for x in (0.0, 1.0, -2.5, 100000.0, 1000000.0, 123456789.0, 0.0001, 0.00001, 1e300, 0.1, 1234.5, 250000.25)]
    return s.createDataFrame(rows, "x double").withColumn("said", text.shortest(F.col("x")))


@query(f"WITH {HIST} SELECT kind, outcome, count(*) AS n FROM hist GROUP BY kind, outcome")
def names_parsed(s, d):
    """Kinds and outcomes read from text of any case."""
    h = a.history(s, d).select(F.lower("kind").alias("kind"), F.concat(F.lit(" "), F.lower("outcome")).alias("outcome"))
    return h.select(text.parsed(F.col("kind"), text.KINDS).alias("kind"), text.parsed(F.col("outcome"), text.OUTCOMES).alias("outcome")).groupBy("kind", "outcome").agg(F.count("*").alias("n"))


_M = 4294967296


def _times(x: str, y: str) -> str:
    return f"(({x})::HUGEINT * ({y})::HUGEINT % {_M})::BIGINT"


@query(f"""WITH a AS (SELECT range AS t, ((1001 + (range + 1) * 1831565813::BIGINT) % {_M})::BIGINT AS s FROM range(5000)),
  b AS (SELECT t, {_times('xor(s, s >> 15)', 's | 1')} AS m FROM a),
  c AS (SELECT t, xor((m + {_times('xor(m, m >> 7)', 'm | 61')}) % {_M}, m) AS m FROM b)
  SELECT t, CASE WHEN t = 4999 THEN 'now' ELSE '-' || (4999 - t) || 'm' END AS label, floor(greatest(0.0, 860 + sin(t / 5000.0::DOUBLE * pi() * 2.4) * 90 + (xor(m, m >> 14) / {_M}.0::DOUBLE - 0.5) * 2 * 40) + 0.5) AS value FROM c""")
def metric_series(s, d):
    return workload.series(s, 5000, 860.0, 90.0, 40.0, 1001)


@query("""SELECT 'up' AS name, CAST(NULL AS VARCHAR) AS route, 1.0 AS value UNION ALL SELECT * FROM (VALUES ('requests', '/a', 7.0), ('requests', '/b', 2.0)) t(name, route, value)""")
def metric_look_ups(s, d):
    told = 'up 1\nrequests{route="/a",class="2xx"} 4\nrequests{class="5xx",route="/a"} 3\nrequests{route="/b"} 2\nrequests 9\n'
    samples = metrics.parse(s.createDataFrame([(told,)], "text string"), "text")
    one = metrics.scalar(samples, "up").select(F.lit("up").alias("name"), F.lit(None).cast("string").alias("route"), "value")
    return one.unionByName(metrics.labelled(samples, "requests", ["route"]).select(F.lit("requests").alias("name"), "route", "value"))


@query("SELECT DISTINCT shard, shard = 0 AS equal FROM (SELECT c_custkey % 4 AS shard FROM customer)")
def shard_digests(s, d):
    """Digests of two copies of each shard, of which all but the first differ in one value."""
    c = a.table(s, d, "customer").select((F.col("c_custkey") % 4).alias("shard"), "c_custkey", "c_name")
    other = c.withColumn("c_name", F.when((F.col("shard") > 0) & (F.col("c_custkey") < 8), "x").otherwise(F.col("c_name")))
    rows = None
    for n in range(4):
        x, y = (snapshots.digest(t.where(F.col("shard") == n), ["c_custkey", "c_name"]) for t in (c, other))
        row = x.select(F.lit(n).cast("long").alias("shard"), (F.col("digest") == y.select("digest").scalar()).alias("equal"))
        rows = row if rows is None else rows.unionByName(row)
    return rows


@query(f"WITH {CMD} {_LIVE.format('cmd', '')}")
def stream_apply_loop(s, d):
    """The log applied batch by batch, with the state of each batch as a version."""
    at = _folder(s)
    log = a.writes(s, d)
    for k in range(3):  # files in the order in which a log writer leaves them
        log.where(F.floor(F.col("idx") / 7000) == k if k < 2 else F.col("idx") >= 14000).coalesce(1).write.mode("append").parquet(f"{at}/files")
    stream = logstream.read_log(s, f"{at}/files", log.schema, files_per_batch=1)
    logstream.apply_loop(stream, f"{at}/state", f"{at}/checkpoint")
    return logstream.applied(s, f"{at}/state").select("k", F.col("v").cast("double").alias("v"), "idx")
