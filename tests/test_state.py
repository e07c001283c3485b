"""Key-value state, deduplication, runs and ordered scans against plain Python folds."""

import random
from decimal import Decimal as D

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import dedup, kv, runs, scan, snapshots, transitions
from tidemark.streaming import logstream

LOG = "idx long, client_id long, request_id long, op string, k string, v decimal(18,2)"


def make_log(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        op = r.choice(["PUT", "PUT", "DELETE"])
        rows.append((i, r.randint(0, 3), r.randint(0, 25), op, r.choice(["", "a", "b", "c", "é"]), None if op == "DELETE" else D(r.randint(0, 2))))
    return rows


def fold(rows):
    table, state, said = {}, {}, []
    for _, client, request, op, k, v in sorted(rows):
        held = table.get(client)
        if held is None or request > held[0]:
            table[client] = (request, op, k, v)
            if k:
                said.append("APPLIED")
                if op == "PUT":
                    state[k] = v
                else:
                    state.pop(k, None)
            else:
                said.append("EMPTY_KEY")
        elif request < held[0]:
            said.append("STALE")
        else:
            said.append("REPLAYED" if held[1:] == (op, k, v) else "CONFLICT")
    return said, state, table


@pytest.mark.parametrize("seed,width", [(1, 1 << 20), (2, 7), (3, 1)])
def test_dedup_is_the_fold(spark, seed, width):
    rows = make_log(400, seed)
    log = spark.createDataFrame(rows, LOG)
    said, state, table = fold(rows)
    assert [r.outcome for r in dedup.outcomes(log, width).orderBy("idx").collect()] == said
    assert {"APPLIED", "EMPTY_KEY", "STALE", "REPLAYED", "CONFLICT"} >= set(said)
    assert {r.k: r.v for r in dedup.applied_state(log).collect()} == state
    assert {r.client_id: (r.request_id, r.op, r.k, r.v) for r in dedup.client_table(log).collect()} == table


def test_stream_is_the_fold_over_restarts(spark, tmp_path):
    rows = make_log(300, 9)
    said, _, _ = fold(rows)
    src, out, ck = (f"file://{tmp_path}/{x}" for x in ("in", "out", "ck"))
    for part in (rows[:100], rows[100:180], rows[180:]):
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(src)
        log = logstream.read_log(spark, src, spark.createDataFrame([], LOG).schema)
        logstream.append_to(logstream.outcomes(log), out, ck)
    assert [r.outcome for r in spark.read.parquet(out).orderBy("idx").collect()] == said


def test_state_semantics(spark):
    rows = [(1, 0, 1, "PUT", "a", D(1)), (2, 0, 2, "DELETE", "a", None), (3, 0, 3, "DELETE", "gone", None), (4, 0, 4, "PUT", "a", D(2)), (5, 0, 5, "PUT", "b", D(3))]
    log = spark.createDataFrame(rows, LOG)
    assert {r.k: int(r.v) for r in kv.live(log).collect()} == {"a": 2, "b": 3}
    assert {r.k for r in kv.live(log, as_of=3).collect()} == set()
    assert kv.get(log, F.lit("gone")).count() == 0
    assert kv.stats(kv.live(log)).first()[:] == (2, 10)
    assert kv.live(log.limit(0)).count() == 0
    assert kv.stats(kv.live(log.limit(0))).first()[:] == (0, 0)
    snap = spark.createDataFrame([("x", D(7))], "k string, v decimal(18,2)")
    assert {r.k for r in kv.restored(snap, log, 4).collect()} == {"x", "b"}


def test_difference_tells_null_from_missing(spark):
    a = spark.createDataFrame([("x", None), ("y", "1")], "key string, value string")
    b = spark.createDataFrame([("x", None), ("z", "1")], "key string, value string")
    assert {(r.key, r.kind) for r in kv.difference(a, b).collect()} == {("y", "ONLY_A"), ("z", "ONLY_B")}
    assert {(r.key, r.action) for r in kv.restore_plan(a, b).collect()} == {("x", "KEEP"), ("y", "DELETE"), ("z", "PUT")}
    one = snapshots.digest(a, ["key", "value"]).first()
    assert one == snapshots.digest(a.orderBy(F.desc("key")), ["key", "value"]).first() != snapshots.digest(b, ["key", "value"]).first()


@pytest.mark.parametrize("width", [1, 5, 1000])
def test_blocked_scans_are_windows(spark, width):
    r = random.Random(width)
    rows = [(r.choice(["hot", "hot", "a", None]), i, r.choice([None, *range(9)])) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, i long, x long")
    w = Window.partitionBy("g").orderBy("i")
    want = df.select("g", "i", F.lag(F.struct("x")).over(w).alias("p"), F.max("x").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("m"), F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    got = scan.previous(df, ["g"], "i", ["x"], "p", width)
    got = scan.running(got, ["g"], "i", F.col("x"), "m", "max", width=width)
    got = scan.running(got, ["g"], "i", F.col("x"), "s", "sum", inclusive=True, width=width).select("g", "i", "p", "m", "s")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


ENTRY = "table_id int, k1 long, k2 int, v decimal(18,2), tombstone boolean, seq struct<a:int>"


def test_compaction(spark):
    e = spark.createDataFrame([(1, 1, 0, D(10), False, (0,)), (1, 2, 0, D(20), False, (0,)), (2, 1, 0, None, True, (0,)), (3, 2, 0, D(21), False, (0,)), (3, 2, 0, D(22), False, (1,)), (3, 3, 0, None, True, (0,))], ENTRY)
    show = lambda df: {(r.k1, None if r.v is None else int(r.v), r.tombstone) for r in df.collect()}
    assert show(runs.compact(e, [1, 2, 3])) == {(2, 22, False)}
    assert show(runs.compact(e, [2, 3])) == {(1, None, True), (2, 22, False), (3, None, True)}
    assert show(runs.merge(e)) == show(runs.merge_by_rank(e))
    for bad in ([], [1, 1], [1, 9]):
        with pytest.raises(ValueError):
            runs.compact(e, bad)
    assert runs.verify(runs.merge(e), runs.merge_by_rank(e).limit(1)).first()[:] == (0, 2)


def test_manifest(spark):
    m = spark.createDataFrame([(1, "a"), (2, "b")], "table_id int, file string")
    assert {r[:] for r in runs.add_table(m, "c").collect()} == {(1, "a"), (2, "b"), (3, "c")}
    assert {r[:] for r in runs.replace_tables(m, [2, 7], "x").collect()} == {(1, "a"), (3, "x")}
    assert {r[:] for r in runs.add_table(m.limit(0), "c").collect()} == {(1, "c")}


def test_run_files(spark, tmp_path):
    e = spark.range(500).select(F.lit(1).alias("table_id"), (F.col("id") * 7 % 500).alias("k1"), F.lit(0).alias("k2"), F.col("id").alias("v"))
    runs.write_run(e, f"file://{tmp_path}/run")
    assert [r.k1 for r in runs.read_run(spark, f"file://{tmp_path}/run").collect()] == list(range(500))


def test_logs_are_never_broadcast(spark):
    """A log whose guessed size is small, as one made by explode, is sorted and merged with its states."""
    states = spark.range(4).selectExpr("id AS node_id", "5L AS term", "'a' AS voted_for", "'follower' AS role", "3L AS commit_idx", "2L AS applied_idx", "1L AS boundary_idx", "1L AS boundary_term", "9L AS last_idx", "CAST(NULL AS LONG) AS pending_idx")
    log = states.select("node_id", F.explode(F.sequence(F.col("boundary_idx") + 1, "last_idx")).alias("idx")).withColumn("term", F.col("idx") % 3)
    requests = spark.range(8).selectExpr("id AS request_id", "id % 4 AS node_id", "5L AS term", "id AS prev_idx", "id % 3 AS prev_term", "1L AS n_entries", "9L AS leader_commit")
    judged = transitions.judge_appends(requests, states, log)
    _, kept = transitions.install_snapshots(states, spark.createDataFrame([(0, 5, 4, 1), (1, 5, 4, 2), (2, 4, 4, 1)], "node_id long, term long, idx long, idx_term long"), log)
    for df in (judged, kept):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r.request_id: r.reason for r in judged.collect()} == {0: "NO_PREVIOUS", **dict.fromkeys(range(1, 8), "ACCEPTED")}
    got = {}
    for r in kept.collect():
        got.setdefault(r.node_id, []).append(r.idx)
    assert {k: sorted(v) for k, v in got.items()} == {0: [5, 6, 7, 8, 9], 2: list(range(2, 10)), 3: list(range(2, 10))}
