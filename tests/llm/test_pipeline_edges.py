"""Every stage of the pipeline on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm.exchange import Exchange

LONG = " ".join(f"word{i}" for i in range(30_000))
OTHER = " ".join(f"other{i}" for i in range(30_000))
PASSAGE = " ".join(f"b{i}" for i in range(20))
CLASHES = ["ids", "n_tokens", "Round_Trip", "decoded", "spans", "n_words", "anomaly", "hits", "own_0", "masked text", "component_id", "rep", "digest", "_train", "_counts", "_totals", "kept"]


@pytest.fixture(scope="module")
def stages():
    return dict(pytest.importorskip("corpus_pipeline").STAGES)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(5, 1, 0), (6, 1, 0), (7, 0, 0), (7, 1, 0), (None, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, None), (None, ""), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.fixture(scope="module")
def odd(spark):
    text = " ".join(f"t{i}" for i in range(80))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, LONG), (6, text), (7, text + " more"), (7, text + " more"), (None, text), (None, None), (8, LONG + " " + PASSAGE + " " + OTHER), (9, " ".join(f"u{i}" for i in range(60)) + " x.1@mail.example.com")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES]).cache()


def rows(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, "" if r.text is None else r.text) for r in df.collect())


def same_columns(df, odd):
    assert df.columns == odd.columns and {r[c] for r in df.select(CLASHES).collect() for c in CLASHES} <= {f"own {c}" for c in CLASHES}


def test_quality_rules(spark, stages, odd, tables):
    out = stages["quality rules"](spark, odd, tables)
    same_columns(out, odd)
    kept = [i for i, _ in rows(out)]  # fewer than 50 words: 1 to 4 and the null text go
    assert set(kept) <= {-1, 5, 6, 7, 8, 9} and set(kept) & {5, 6}


def test_near_duplicates(spark, stages, odd, tables):
    out = stages["near-duplicates"](spark, odd, tables)
    same_columns(out, odd)
    assert [i for i, _ in rows(out)] == [-1, -1, 1, 2, 3, 4, 5, 6, 8, 9]  # 7 is like 6; null ids stay
    again = stages["near-duplicates"](spark, odd.where("doc_id = 7"), tables)
    assert again.count() == 1


def test_decontamination(spark, stages, odd, tables):
    out = stages["decontamination"](spark, odd, tables)
    same_columns(out, odd)
    assert [i for i, _ in rows(out)] == [-1, -1, 1, 2, 3, 4, 5, 6, 7, 7, 9]


def test_personal_data(spark, stages, odd, tables):
    out = stages["personal data"](spark, odd, tables)
    same_columns(out, odd)
    said = dict(rows(out))
    assert out.count() == odd.count() and said[9].endswith(" [EMAIL]") and said[5] == LONG and said[2] == ""
    assert {r.doc_id: r.n_chars for r in out.where("doc_id in (1, 9)").collect()} == {1: None, 9: len(said[9])}


def test_token_ids(spark, stages, odd, tables):
    out = stages["byte-level BPE"](spark, odd, tables)
    assert [c for c in out.columns if c not in ("n_tokens", "round_trip", "ids")] == [c for c in odd.columns if c.lower() not in ("text", "n_tokens", "round_trip", "ids")]
    told = {r.doc_id: (r.n_tokens, r.round_trip) for r in out.where("doc_id is not null").collect()}
    assert out.count() == odd.count() and told[1] == told[2] == (0, True) and all(t for _, t in told.values()) and told[5][0] > 30_000


def test_empty_tables(spark, stages, odd, tables):
    for name, stage in stages.items():
        assert stage(spark, odd.limit(0), tables).count() == 0, name


def test_no_labels_no_benchmark(spark, stages, odd, tables, tmp_path):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{tables}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    out = stages["quality rules"](spark, odd, str(tmp_path))
    assert [i for i, _ in rows(out)] == [-1, 5, 6, 7, 7, 8, 9]  # the base rules alone
    assert stages["decontamination"](spark, odd, str(tmp_path)).count() == odd.count()


def test_buckets_fill_partitions_one_to_one(spark):
    df = spark.range(5000).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    x = Exchange(df, "text", bucket_bytes=2000)
    assert x.buckets > 90
    per = x.docs.select(F.spark_partition_id().alias("p"), x.key).distinct().groupBy("p").count().collect()
    assert len(per) > 0.98 * x.buckets and {r["count"] for r in per} == {1}
    plan = x.docs.groupBy(x.key).applyInArrow(lambda t: t, x.docs.schema)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
