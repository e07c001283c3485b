"""Fixed layouts against bytes built by hand and byte-at-a-time loops."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import codecs, messages, runfile, text

MAGIC = b"12345678"


def slow_crc(data):
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def slow_fnv(data, a):
    h = 14695981039346656037
    for b in data:
        h = (h ^ b) * 1099511628211 % 2**64 if a else h * 1099511628211 % 2**64 ^ b
    return h


def test_batches_of_checksums_and_hashes():
    r = random.Random(1)
    data = [r.randbytes(r.choice([0, 1, 3, 50, 255, 256, 257, 512, 1000, 5000])) for _ in range(60)]
    buf, bounds = codecs._joined(data)
    assert codecs.crc32c_many(buf, bounds).tolist() == [slow_crc(x) for x in data] == [codecs.crc32c_bytes(x) for x in data]
    for a in (True, False):
        assert codecs.fnv64_many(buf, bounds, a).tolist() == [slow_fnv(x, a) for x in data]
    assert len(codecs.crc32c_many(*codecs._joined([]))) == 0


def test_checksums_of_columns(spark):
    df = spark.createDataFrame([(b"123456789",), (None,), (b"",)], "b binary")
    got = df.select(codecs.crc32c("b").alias("c"), codecs.fnv1a("b").alias("f")).collect()
    assert [x.c for x in got] == [0xE3069283, None, 0] and [x.f if x.f is None else int(x.f) for x in got] == [slow_fnv(b"123456789", True), None, 14695981039346656037]


def test_logs_of_files(spark):
    r = random.Random(2)
    rows = [(f, i, r.choice(["PUT", "DELETE"]), r.randbytes(r.randint(1, 9)), r.choice([None, b"", r.randbytes(700)])) for f in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "f int, i long, op string, key binary, value binary")
    logs = codecs.encode_log(df, ["f"], "i")
    want = {(f, bytes(k), bytes(v or b"")) for f, _, _, k, v in rows}
    back = codecs.decode_log(logs).collect()
    assert len(back) == len(rows) and {(x.f, bytes(x.key), bytes(x.value)) for x in back} == want
    content = {x.f: bytes(x.content) for x in logs.collect()}
    for f, data in content.items():
        assert data == b"".join(codecs.encode_record(1 if o == "PUT" else 2, k, v or b"") for g, _, o, k, v in rows if g == f)
    cut = logs.withColumn("content", F.expr("substring(content, 1, octet_length(content) - 2)"))
    for x in codecs.truncate_torn(cut).collect():
        whole = content[x.f]
        assert whole.startswith(bytes(x.content)) and list(codecs.decode_records(bytes(x.content)))[-1][4] == "OK" and x.cut > 0
    bad = bytearray(content[0])
    bad[30] ^= 1
    with pytest.raises(ValueError):
        codecs.valid_prefix(bytes(bad))


def test_manifest_and_snapshot_bytes():
    body = MAGIC + struct.pack("<IQI", 1, 9, 1) + struct.pack("<QI", 7, 3) + b"a.r"
    data = codecs.encode_manifest(9, [(7, "a.r")], MAGIC)
    assert data == body + struct.pack("<I", slow_crc(body)) and codecs.decode_manifest(data, MAGIC) == (9, [(7, "a.r")])
    body = MAGIC + struct.pack("<IQQI", 1, 5, 2, 3) + b"xyz"
    data = codecs.encode_snapshot(5, 2, b"xyz", MAGIC)
    assert data == body + struct.pack("<I", slow_crc(body)) and codecs.decode_snapshot(data, MAGIC) == (5, 2, b"xyz")
    for at in range(len(data)):
        bad = bytearray(data)
        bad[at] ^= 0x10
        with pytest.raises(ValueError):
            codecs.decode_snapshot(bytes(bad), MAGIC)
    with pytest.raises(ValueError):
        codecs.decode_manifest(codecs.encode_manifest(2, [(1, "")], MAGIC), MAGIC)


def test_machine_images_are_deterministic():
    keys = [(b"b", b"2"), (b"a", b"")]
    clients = [("z", 4, "PUT", b"b", b"2", True, False, b"b", b"", "none"), ("c", 1, "DELETE", b"a", b"", False, True, b"", b"", "conflict")]
    data = codecs.encode_machine(keys, clients, MAGIC)
    assert data == codecs.encode_machine(keys[::-1], clients[::-1], MAGIC)
    assert codecs.decode_machine(data, MAGIC) == (sorted(keys), sorted(clients))
    assert codecs.decode_machine(codecs.encode_machine([], [], MAGIC), MAGIC) == ([], [])
    for bad in (data[:-1], data[:40] + b"\xff" + data[41:], codecs.seal(MAGIC, b"\0" * 8 + b"x")):
        with pytest.raises(ValueError):
            codecs.decode_machine(bad, MAGIC)


def test_blooms():
    keys = [b"key%d" % i for i in range(500)]
    m, k = codecs.bloom_size(len(keys))
    bits = codecs.bloom_bits(keys, m, k)
    assert codecs.bloom_test(keys, m, k, bits).all() and codecs.bloom_test([b"no%d" % i for i in range(2000)], m, k, bits).sum() < 60
    for key in keys[:20]:  # bit i is bit i % 8 of byte i // 8
        h1, h2 = slow_fnv(key, True), slow_fnv(key, False)
        for i in range(k):
            at = (h1 + i * h2) % 2**64 % m
            assert bits[at // 8] >> at % 8 & 1
    data = codecs.encode_bloom(m, k, bits)
    assert codecs.decode_bloom(data) == (m, k, bits)
    for bad in (data[:-1], b"\0" + data[1:], data[:5] + b"\xff" + data[6:], data[:20] + bytes([data[20] ^ 1]) + data[21:]):
        with pytest.raises(ValueError):
            codecs.decode_bloom(bad)


def test_probes_of_all_filters(spark):
    built = codecs.bloom_build(spark.createDataFrame([(g, f"{g}-{i}") for g in range(3) for i in range(50)], "g int, key string"), "key", ["g"])
    found = codecs.may_contain(built, spark.createDataFrame([("1-7",), ("2-9",)], "p string"), "p").collect()
    assert len(found) == 6 and all(x.may_contain for x in found if x.p[0] == str(x.g))


def test_run_files():
    r = random.Random(3)
    entries = [(b"k%05d" % i, r.randbytes(r.randint(0, 300)), i % 7 == 0) for i in range(0, 400, 2)]
    data = runfile.encode_run(entries, MAGIC)
    run = runfile.Run(data, MAGIC)
    want = [(k, b"" if dead else v, dead) for k, v, dead in entries]
    assert list(run.entries()) == want and (run.n, run.least, run.greatest) == (200, b"k00000", b"k00398") and len(run.index) > 5
    assert all(4096 <= sum(9 + len(k) + len(v) for k, v, _ in runfile.decode_block(data[at : at + n])) for _, at, n in run.index[:-1])
    held = {k: ("TOMBSTONE", None) if dead else ("FOUND", v) for k, v, dead in want}
    keys = [b"k%05d" % i for i in range(-1, 402)] + [b"", b"zzz", b"a"]
    assert run.get(keys) == [held.get(k, ("NOT_FOUND", None)) for k in keys]
    for key in keys:
        assert run.candidate(key) == sum(b[0] <= key for b in run.index) - 1
    block = runfile.encode_block([(b"a", b"xy", False), (b"b", b"gone", True)])
    body = b"\0\x01\0\0\0\x02\0\0\0axy" + b"\x01\x01\0\0\0\0\0\0\0b"
    assert block == body + struct.pack("<I", slow_crc(body))
    footer = data[-64:]
    assert footer[:8] == MAGIC and struct.unpack("<I", footer[-4:])[0] == slow_crc(footer[:-4])
    for bad in (data[:-1], data[1:], b"", data[:-64] + bytes(64), data[:-64] + runfile.encode_footer([(0, 1 << 63), (0, 1), (0, 1)], MAGIC), data[:-64] + runfile.encode_footer([(0, 0), (0, 1), (0, 1)], MAGIC)):
        with pytest.raises(ValueError):
            runfile.Run(bad, MAGIC)
    for wrong in ([], [(b"", b"", False)], [(b"b", b"", False), (b"a", b"", False)], [(b"a", b"", False), (b"a", b"", False)]):
        with pytest.raises(ValueError):
            runfile.encode_run(wrong, MAGIC)
    with pytest.raises(ValueError):
        runfile.decode_block(runfile._checked(b"\x01\x01\0\0\0\x01\0\0\0ax"))


def test_message_bytes():
    assert messages.encode("RequestVoteRequest", {"term": 300, "candidate_id": "n1", "last_log_index": 0, "last_log_term": 1}) == b"\x08\xac\x02\x12\x02n1\x20\x01"
    row = {"term": 2, "leader_id": "é", "prev_log_index": 1 << 60, "prev_log_term": 0, "entries": [{"index": 1, "term": 0, "command": b"\0"}, {"index": 0, "term": 0, "command": b""}], "leader_commit": 5}
    data = messages.encode("AppendEntriesRequest", row)
    assert messages.decode("AppendEntriesRequest", data) == row
    assert messages.decode("RequestVoteReply", b"\x08\x01\x7a\x03abc") == {"term": 1, "vote_granted": False}  # an unknown field is passed over
    for name in messages.MESSAGES:
        empty = messages.decode(name, b"")
        assert messages.encode(name, empty) == b"" and set(empty) == {n for _, n, _ in messages.MESSAGES[name]}
    for bad in (b"\x08", b"\x12\x05ab", b"\x0a\x01a", b"\x0b"):
        with pytest.raises(ValueError):
            messages.decode("RequestVoteReply", bad)


def test_shortest_numbers(spark):
    r = np.random.default_rng(1)
    xs = [0.0, -0.0, 1.0, 1e21, 1e22, 123456.0, 999999.5, 1000000.0, 0.0001, 0.00012, 0.00001, 5e-324, 1.7976931348623157e308, 1e-7, 100.0, -1234567.25, *r.normal(0, 1, 50).tolist(), *(10.0 ** r.uniform(-20, 20, 50)).tolist()]

    def said(x):
        sign, digits, power = __import__("decimal").Decimal(repr(abs(x))).normalize().as_tuple()
        digits = "".join(map(str, digits))
        exp = len(digits) + power - 1
        neg = "-" if str(x)[0] == "-" else ""
        if x == 0:
            return neg + "0"
        if exp < -4 or exp >= 6:
            return f"{neg}{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e{'-' if exp < 0 else '+'}{abs(exp):02d}"
        return neg + (f"0.{'0' * (-exp - 1)}{digits}" if exp < 0 else (digits + "0" * 6)[: exp + 1] + ("." + digits[exp + 1 :] if len(digits) > exp + 1 else ""))

    got = spark.createDataFrame([(float(x),) for x in xs], "x double").select(text.shortest(F.col("x")).alias("s")).collect()
    assert [g.s for g in got] == [said(x) for x in xs]
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "x double").select(text.shortest(F.col("x")).alias("s")).collect()
    assert [g.s for g in odd] == ["NaN", "+Inf", "-Inf", None]


def test_names(spark):
    df = spark.createDataFrame([(" ok ",), ("Failed",)], "x string")
    assert [r[0] for r in df.select(text.parsed(F.col("x"), text.OUTCOMES)).collect()] == ["OK", "FAILED"]
    for value in ("other", None):
        with pytest.raises(Exception, match=f"unknown value {'null' if value is None else value}"):
            spark.createDataFrame([(value,)], "x string").select(text.parsed(F.col("x"), text.OUTCOMES)).collect()
    assert codecs.same_bytes(b"a", b"a") and not codecs.same_bytes(b"a", b"b")


def test_runs_are_dealt_into_files(spark, data):
    """No file has keys of more than one range."""
    from tidemark.plans import file_queries

    files = file_queries._run_files(spark, data)
    assert files.columns == ["table_id", "part", "content"]
    keys = [(r.part, int(r.key[:12])) for r in runfile.decode_runs(files, file_queries.RUN).select("part", F.col("key").cast("string").alias("key")).collect()]
    assert keys and all(k // file_queries._RANGE == part for part, k in keys)


def test_only_asked_files_are_copied(spark):
    rows = [(g, f"k{i}", str(i), i % 2 == 0) for g in (1, None, 3) for i in range(6)]
    made = runfile.encode_runs(spark.createDataFrame(rows, "g int, key string, value string, tombstone boolean"), ["g"], MAGIC)
    bad = made.withColumn("content", F.when(F.col("g") == 3, F.lit(b"no run file")).otherwise(F.col("content")))
    probes = spark.createDataFrame([(1, "k1"), (1, "k2"), (1, "k9"), (None, "k3"), (2, "k1")], "g int, key string")
    got = {(r.g, r.key): (r.result, r.value) for r in runfile.get(bad, probes, ["g"], MAGIC).collect()}
    assert got == {(1, "k1"): ("FOUND", b"1"), (1, "k2"): ("TOMBSTONE", None), (1, "k9"): ("NOT_FOUND", None), (None, "k3"): ("FOUND", b"3"), (2, "k1"): ("NOT_FOUND", None)}
    assert "_parts" in runfile.get(bad, probes, ["g"], MAGIC)._jdf.queryExecution().optimizedPlan().toString()
