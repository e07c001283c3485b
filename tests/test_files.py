import pytest

from tidemark.operators import dedup, history, kv, workload
from tidemark.sources import adapters, files


def test_history_round_trip(spark, data, tmp_path):
    ops = adapters.history(spark, data).limit(200)
    files.save_history(ops, f"file://{tmp_path}/h")
    back = files.load_history(spark, f"file://{tmp_path}/h")
    assert sorted(back.collect()) == sorted(ops.select(back.columns).collect())
    (tmp_path / "array.json").write_text('[{"history_id": 1, "id": 2, "found": true}, {"history_id": 1, "id": 3}]')
    assert files.load_history(spark, f"file://{tmp_path}/array.json", whole_files=True).count() == 2
    (tmp_path / "bad.json").write_text('{"history_id": "x"')
    with pytest.raises(Exception):
        files.load_history(spark, f"file://{tmp_path}/bad.json").collect()


def test_versions(spark, tmp_path):
    at = f"file://{tmp_path}/table"
    with pytest.raises(FileNotFoundError):
        files.load_version(spark, at)
    assert [files.save_version(spark.range(n), at) for n in (1, 2)] == [1, 2]
    (tmp_path / "table" / "v3").mkdir()  # of a writer that was lost
    assert files.load_version(spark, at).count() == 2 and files.load_version(spark, at, 1).count() == 1


def test_snapshot_round_trip(spark, data, tmp_path):
    log = adapters.writes(spark, data)
    head = log.where("idx <= 1000")
    files.save_snapshot(kv.live(head), dedup.client_table(head), 1000, 3, f"file://{tmp_path}/snap")
    state, clients = files.load_snapshot(spark, f"file://{tmp_path}/snap")
    assert state.count() == kv.live(head).count() and clients.count() == dedup.client_table(head).count()
    whole = kv.restored(state.select("k", state.v.cast("decimal(18,2)").alias("v")), log, 1000)
    assert {(r.k, r.v) for r in whole.collect()} == {(r.k, r.v) for r in kv.live(log).collect()}


def test_events_peers_and_generators(spark, tmp_path):
    for a in (0, 5):
        files.append_events(spark.range(a, a + 5), f"file://{tmp_path}/events")
    assert [r.id for r in files.tail_events(spark, f"file://{tmp_path}/events", "id", 3).collect()] == [7, 8, 9]
    peers = spark.createDataFrame([("a", "g", "h")], "id string, grpc_addr string, http_addr string")
    rows = spark.createDataFrame([("a",), ("b",)], "peer string")
    assert {r[:] for r in files.with_address(rows, peers, "peer").collect()} == {("a", "g", "h"), ("b", None, None)}
    assert files.trusted(rows, spark.createDataFrame([("b",), ("b",)], "peer string"), "peer").count() == 1
    made = workload.random_history(spark, 20, 10)
    assert history.validate(made).count() == 0 and {r.verdict for r in history.verdicts(made).collect()} == {"VALID"}
    assert workload.series(spark, 50, 1.0, 3.0, 0.5).where("value < 0").count() == 0
