"""Consensus logs, histories, metrics and codecs against loops."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import codecs, text
from tidemark.operators import history, metrics, raftlog, snapshots, workload


def test_append_after_is_the_loop(spark):
    r = random.Random(4)
    for _ in range(12):
        base, term = [], 1
        for i in range(1, r.randint(1, 8)):
            term += r.random() < 0.3
            base.append((i, term))
        start = r.randint(1, len(base) + 1)
        sent, term = [], base[start - 2][1] if start > 1 else 1
        for i in range(start, start + r.randint(0, 5)):
            term += r.random() < 0.3
            sent.append((i, term))
        want = list(base)
        for i, t in sent:
            have = dict(want)
            if have.get(i) != t:
                want = [x for x in want if x[0] < i]
                want.append((i, t))
        local, new = (spark.createDataFrame(x, "idx long, term long") for x in (base, sent))
        assert sorted(x[:] for x in raftlog.append_after(local, new).collect()) == want


def test_commit_index_is_the_loop(spark):
    r = random.Random(5)
    match, terms, cluster, want = [], [], [], {}
    for c in range(40):
        n = r.randint(1, 6)
        held = [r.randint(0, 12) for _ in range(n)]
        own, t = {}, 1
        for i in range(1, 13):
            t += r.random() < 0.3
            own[i] = t
        commit, current = r.randint(0, 5), r.choice([t, t, t + 1])  # a leader has no entry of a later term
        match += [(c, m) for m in held]
        terms += [(c, i, x) for i, x in own.items()]
        cluster.append((c, commit, current))
        new = commit
        for i in range(12, commit, -1):
            if own[i] == current and sum(m >= i for m in held) >= n // 2 + 1:
                new = i
                break
        want[c] = new
    got = raftlog.commit_index(spark.createDataFrame(match, "cluster int, match_idx long"), spark.createDataFrame(terms, "cluster int, idx long, term long"), spark.createDataFrame(cluster, "cluster int, commit_idx long, current_term long"))
    assert {x.cluster: x.commit_idx for x in got.collect()} == want


def test_progress_is_the_loop(spark):
    r = random.Random(6)
    rows, want = [], []
    match, nxt = 0, 1
    for i in range(60):
        ok = r.random() < 0.5
        prev, n = r.randint(0, 20), r.randint(0, 3)
        if ok:
            match = max(match, prev + n)
            nxt = match + 1
        else:
            nxt = max(1, nxt - 1)
        rows.append((1, i, ok, prev, n))
        want.append((match, nxt))
    got = raftlog.progress(spark.createDataFrame(rows, "peer int, seq long, success boolean, prev_idx long, n long")).orderBy("seq")
    assert [(x.match_idx, x.next_idx) for x in got.collect()] == want


def ops(*rows):
    names = ["id", "kind", "key", "value", "invoke", "complete", "outcome", "found", "result"]
    return [dict(zip(names, r, strict=True)) for r in rows]


def test_checker_verdicts():
    fine = ops((1, "PUT", "k", "a", 1, 2, "OK", False, ""), (2, "GET", "k", "", 3, 4, "OK", True, "a"))
    assert history.check_one(fine) == "VALID"
    stale = ops((1, "PUT", "k", "a", 1, 2, "OK", False, ""), (2, "PUT", "k", "b", 3, 4, "OK", False, ""), (3, "GET", "k", "", 5, 6, "OK", True, "a"))
    assert history.check_one(stale) == "VIOLATION"
    maybe = ops((1, "PUT", "k", "a", 1, 0, "INCOMPLETE", False, ""), (2, "GET", "k", "", 3, 4, "OK", True, "a"))
    assert history.check_one(maybe) == "VALID"
    assert history.check_one(stale, budget=1) == "INCONCLUSIVE"
    assert history.check_one([]) == "VALID"
    small = history.minimize_one(stale + ops((9, "GET", "z", "", 7, 8, "OK", False, "")))
    assert history.check_one(small) == "VIOLATION" and len(small) <= 3
    assert history.optional_subsets(2) == [0, 1, 2, 3] and history.optional_subsets(13) == [0, 8191]


def test_checker_against_all_orders():
    r = random.Random(8)
    seen = set()
    for _ in range(150):
        made = []
        for i in range(r.randint(1, 5)):
            kind = r.choice(["PUT", "GET", "DELETE"])
            a = r.randint(0, 8)
            out = r.choice(["OK", "OK", "INCOMPLETE", "FAILED"])
            found = kind == "GET" and r.random() < 0.6
            made += ops((i, kind, r.choice("xy"), r.choice("ab") if kind == "PUT" else "", a, a + r.randint(1, 5), out, found, r.choice("ab") if found else ""))
        want = history.brute_force(made)
        seen.add(want)
        assert (history.check_one(made) == "VALID") == want
    assert seen == {True, False}


def test_percentiles_floor_rank(spark):
    r = random.Random(3)
    rows = [("a", r.choice([None, *range(-50, 50)])) for _ in range(333)] + [("one", 5)]
    got = {x.g: x[1:] for x in metrics.percentiles(spark.createDataFrame(rows, "g string, v long"), "g", "v", [0.0, 0.5, 0.95, 0.99, 1.0]).collect()}
    v = sorted(x for g, x in rows if g == "a" and x is not None)
    assert got["a"] == tuple(v[int(p * (len(v) - 1))] for p in (0.0, 0.5, 0.95, 0.99, 1.0))
    assert got["one"] == (5,) * 5


def test_exposition_round_trip(spark):
    rows = [("m", "path", 'a"b\\c\nd', 1.5), ("m", "path", "x", 2.0), ("plain", None, None, 3.0)]
    s = spark.createDataFrame(rows, "name string, label string, label_value string, value double")
    kinds = spark.createDataFrame([("m", "help", "counter"), ("plain", "help", "gauge")], "name string, help string, kind string")
    back = {(x.name, x.labels.get("path"), x.value) for x in metrics.parse(metrics.exposition(s, kinds), "text").collect()}
    assert back >= {("m", "x", 2.0), ("plain", None, 3.0)} and len(back) == 3


def test_histogram_bounds_are_inclusive(spark):
    df = spark.createDataFrame([("r", 0.1), ("r", 0.11), ("r", 99.0), ("r", None)], "route string, s double")
    got = {x.le: x.n for x in metrics.histogram(df, "route", F.col("s")).collect()}
    assert (got["0.1"], got["0.25"], got["10"], got["+Inf"]) == (1, 2, 2, 3)


def test_rates_clamp_resets(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("a", 4, 1), ("a", 5, 4)], "label string, t long, v long")
    assert [x.rate for x in metrics.rates(df, ["label"], "t", "v").orderBy("t").collect()] == [None, 4.0, 0.0, 3.0]


def test_checksums():
    assert codecs.crc32c_bytes(b"123456789") == 0xE3069283
    assert codecs.fnv64_bytes(b"a") == 0xAF63DC4C8601EC8C
    assert codecs.fnv64_bytes(b"", a=False) == 14695981039346656037


def test_wal_tails():
    whole = codecs.encode_record(1, b"k", b"v") + codecs.encode_record(2, b"kk")
    rows = list(codecs.decode_records(whole))
    assert [(r[1], r[2], r[3], r[4]) for r in rows] == [("PUT", b"k", b"v", "OK"), ("DELETE", b"kk", b"", "OK")]
    for cut in range(len(whole)):
        last = list(codecs.decode_records(whole[:cut]))
        assert all(x[4] in ("OK", "TORN") for x in last)
        if cut not in (0, rows[1][0]):
            assert last[-1][4] == "TORN"
    for at in range(len(whole)):
        bad = bytearray(whole)
        bad[at] ^= 0x55
        assert list(codecs.decode_records(bytes(bad)))[-1][4] in ("CORRUPT", "TORN")
    assert list(codecs.decode_records(b"")) == []
    with pytest.raises(ValueError):
        codecs.encode_record(1, b"")


def test_state_codec():
    log, magic = [(5, 1, b"a"), (6, 2, b""), (7, 2, b"ccc")], b"eightbyt"
    data = codecs.encode_state(3, "n1", log, magic)
    assert codecs.decode_state(data, magic) == (3, "n1", log)
    made = [codecs.encode_state(t, "", entries, magic) for t, entries in ((1, log), (9, [(1, 1, b""), (3, 1, b"")]), (9, [(1, 2, b""), (2, 1, b"")]), (9, [(0, 1, b"")]))]
    for bad in (data[:-1], b"XXXX" + data[4:], data[:30] + b"\xff" + data[31:], b"", data + b"x", *made):
        with pytest.raises(ValueError):
            codecs.decode_state(bad, magic)
    with pytest.raises(ValueError):
        codecs.encode_state(1, "v" * 5000, [], magic)
    with pytest.raises(ValueError):
        codecs.encode_state(1, "", [(1, 1, bytes((1 << 20) + 1))], magic)


def test_command_codec():
    data = codecs.encode_command("c", 7, "PUT", b"k", b"v")
    assert codecs.decode_command(data) == ("c", 7, "PUT", b"k", b"v")
    # operation, client length, client, request, key length, key, value length, value
    assert data == b"\x01" + b"\x01\0\0\0c" + b"\x07\0\0\0\0\0\0\0" + b"\x01\0\0\0k" + b"\x01\0\0\0v"
    assert codecs.decode_command(codecs.encode_command("", 0, "DELETE", b"k", b"")) == ("", 0, "DELETE", b"k", b"")
    for bad in (b"", data[:5], data + b"x", b"\x09" + data[1:], data[:1] + b"\xff\xff" + data[3:], data[:-1]):
        with pytest.raises(ValueError):
            codecs.decode_command(bad)


def test_bloom_never_misses():
    m, k = codecs.bloom_size(1000)
    bits = {p for i in range(1000) for p in codecs.probes(b"key%d" % i, m, k)}
    assert all(set(codecs.probes(b"key%d" % i, m, k)) <= bits for i in range(1000))
    assert sum(set(codecs.probes(b"no%d" % i, m, k)) <= bits for i in range(2000)) < 60
    assert codecs.bloom_size(0)[0] == 64


def test_chunk_arrivals():
    def row(seq, identity, offset, data, total, final, checksum=None):
        return {"seq": seq, "identity": identity, "offset": offset, "data": data, "total": total, "final": final, "checksum": codecs.crc32c_bytes(data) if checksum is None else checksum}

    said = lambda *rows: [s for _, s, _ in snapshots.arrivals(list(rows))]
    assert said(row(1, "a", 0, b"xy", 3, False), row(2, "a", 2, b"z", 3, True)) == ["STORED", "COMPLETE"]
    assert said(row(1, "a", 0, b"xy", 3, False), row(2, "b", 2, b"z", 3, True), row(3, "a", 2, b"z", 3, True)) == ["STORED", "OTHER_TRANSFER", "OTHER_TRANSFER"]
    assert said(row(1, "a", 0, b"xy", 9, False), row(2, "a", 3, b"z", 9, True)) == ["STORED", "GAP"]
    assert said(row(1, "a", 0, b"xy", 3, False, 1)) == ["CHECKSUM"]
    assert said(row(1, "a", 0, b"xyzw", 3, True)) == ["OVERFLOW"]
    assert said(row(1, "a", 0, b"x", 3, True)) == ["SHORT"]
    assert said(row(1, "a", 0, b"x", 1 << 40, True)) == ["TOO_LARGE"]


def test_text_functions(spark):
    df = spark.createDataFrame([("a=1|2,,b=3|4",), ("",), (None,)], "x string")
    assert [r[:] for r in text.parse_peers(df, "x").collect()] == [("a", "1", "2"), ("b", "3", "4")]
    assert df.select(text.log_level(F.col("x"))).first()[0] == "info"
    with pytest.raises(Exception, match="unknown value null"):
        df.where("x is null").select(text.named(F.col("x"), {"q": 1})).collect()
    with pytest.raises(Exception, match="unknown value"):
        df.select(text.named(F.col("x"), {"q": 1})).collect()


def test_generators_repeat(spark):
    assert workload.keys(spark, 50, 9, "hotset").collect() == workload.keys(spark, 50, 9, "hotset").collect()
    for percent in (0, 10, 50, 90, 100):
        n = workload.mix(workload.keys(spark, 5000, 100), percent).where("op = 'PUT'").count()
        assert abs(n - 50 * percent) < 150
    e = workload.compaction_inputs(spark, 3, 10, True, 5)
    assert e.select("key").distinct().count() == 30 and e.where("tombstone").count() == 6


def test_chunks_of_receivers_come_in_order(spark):
    """Receivers get no call of their own, and one that spans batches is one."""
    n = 3 * snapshots.SOME
    chunks = spark.range(n).selectExpr("CASE WHEN id % 3 > 0 THEN id % 3 END AS receiver", "id AS seq", "'a' AS identity", "id DIV 3 AS offset", "CAST('x' AS BINARY) AS data", f"{n // 3}L AS total", f"{codecs.crc32c_bytes(b'x')}L AS checksum", f"id DIV 3 = {n // 3 - 1} AS final")
    out = snapshots.reassemble(chunks)
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.collect()
    assert len(rows) == n and {(r.receiver, bytes(r.data)) for r in rows if r.status == "COMPLETE"} == {(k, b"x" * (n // 3)) for k in (None, 1, 2)}
    assert sum(r.status == "STORED" for r in rows) == n - 3
