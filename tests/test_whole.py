"""Queries over whole tables, against SQL or loops of their own."""

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.functions import codecs
from tidemark.operators import history, snapshots
from tidemark.plans.oracle import ORACLE
from tidemark.sources import adapters

QUERIES = entry.queries()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{p}')")
    return c


def same(spark, duck, data, name, sql):
    told = duck.execute(sql)
    names = [c[0] for c in told.description]
    want = sorted(told.fetchall())
    df = QUERIES[name](spark, data)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(r) for r in df.select(names).collect()) == want
    return want


PEERS = "WITH peers AS (SELECT CAST(o_custkey % 20 AS INTEGER) AS cluster, o_orderkey AS peer, o_orderkey * 7 % 1000 AS match_idx FROM orders)"


def test_every_order_is_a_peer(spark, duck, data):
    n = duck.execute("SELECT count(*) FROM orders").fetchone()[0]
    assert len(same(spark, duck, data, "follower_lag", f"{PEERS} SELECT cluster, peer, greatest(700 - match_idx, 0) AS lag FROM peers")) == n
    same(spark, duck, data, "synced_followers", f"{PEERS} SELECT cluster, count(*) FILTER (WHERE match_idx >= 700) + 1 AS n_synced, CAST(sum(greatest(700 - match_idx, 0)) AS BIGINT) AS total_lag FROM peers GROUP BY cluster")
    same(spark, duck, data, "commit_index", f"""{PEERS}, k AS (SELECT cluster, list_sort(list(match_idx), 'DESC')[len(list(match_idx)) // 2 + 1] AS kth FROM peers GROUP BY cluster)
      SELECT cluster, kth, CASE WHEN kth > cluster * 20 AND kth // 100 + 1 = cluster % 6 + 3 THEN kth ELSE cluster * 20 END AS commit_idx FROM k""")


def test_every_violation_is_minimized(spark, data):
    ops = {}
    for r in adapters.history(spark, data).collect():
        ops.setdefault(r.history_id, []).append(r.asDict())
    got = {}
    for r in QUERIES["minimized_histories"](spark, data).collect():
        got.setdefault(r.history_id, []).append(r.asDict())
    assert set(got) == {k for k, own in ops.items() if history.check_one(own) == "VIOLATION"} and max(got) >= 40
    for k, small in got.items():
        assert all(o in ops[k] for o in small) and history.check_one(small) == "VIOLATION"
        assert all(history.check_one([x for x in small if x is not o]) != "VIOLATION" for o in small)


def test_every_text_is_cut(spark, duck, data):
    rows = same(spark, duck, data, "chunk_offsets", """
      SELECT doc_id, o AS "offset", least(1000, n - o) AS n_bytes, o + least(1000, n - o) >= n AS final
      FROM (SELECT doc_id, n, unnest(range(0, greatest(n, 1), 1000)) AS o FROM (SELECT doc_id, coalesce(strlen(text), 0) AS n FROM documents))""")
    assert sum(r[2] for r in rows) == duck.execute("SELECT sum(strlen(text)) FROM documents").fetchone()[0]


def test_every_chunk_is_checked(spark, duck, data):
    receivers = {}
    for (i,) in duck.execute("SELECT event_id FROM events ORDER BY event_id").fetchall():
        part = b"part%d" % (i % 3)
        receivers.setdefault(i // 30, []).append({"seq": i, "identity": str(i // 3), "offset": i % 3 * 5, "data": part, "total": 15, "checksum": codecs.crc32c_bytes(part) + (i % 50 == 1), "final": i % 3 == 2})
    want = Counter(status for rows in receivers.values() for _, status, _ in snapshots.arrivals(rows))
    got = {r.status: r.n for r in QUERIES["chunk_reassembly"](spark, data).collect()}
    assert got == want and sum(got.values()) == duck.execute("SELECT count(*) FROM events").fetchone()[0] > 600


def test_every_operation_is_told(spark, duck, data):
    n = duck.execute("SELECT count(*) FROM events").fetchone()[0]
    assert len(same(spark, duck, data, "operation_text", ORACLE["operation_text"])) == n


def test_every_key_is_probed(spark, duck, data):
    n = duck.execute("SELECT count(*) FROM (SELECT DISTINCT year(l_shipdate), l_orderkey, l_linenumber FROM lineitem)").fetchone()[0]
    assert [tuple(r) for r in QUERIES["bloom_membership"](spark, data).collect()] == [(n, n)]


def test_own_filters_are_brute_force(spark):
    keys = [(g, f"{g}-{i}") for g in range(2) for i in range(300)]
    built = codecs.bloom_build(spark.createDataFrame(keys, "g int, key string"), "key", ["g"])
    filters = {r.g: r for r in built.collect()}
    asked = [(g, f"{h}-{i}") for g in range(3) for h in range(2) for i in range(0, 400, 3)]
    got = {(r.g, r.p): r.may_contain for r in codecs.may_contain_own(built, spark.createDataFrame(asked, "g int, p string"), "p", ["g"], 3).collect()}

    def brute(g, p):
        f = filters.get(g)
        return f is not None and all(f.filter[b // 8] >> b % 8 & 1 for b in codecs.probes(p.encode(), f.bits, f.hashes))

    assert got == {(g, p): brute(g, p) for g, p in asked}
    assert all(got[g, p] for g, p in asked if (g, p) in set(keys)) and not all(got.values())
