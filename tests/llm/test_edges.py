"""Nulls, empty and very long texts, repeated rows, empty tables and clashing names, for every operator."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontam, minhash, pii, ppm, pu, rules, secret_scan, substrings, warc

LONG = "wort " * 60_000 + "x" * 50_000
OUTPUTS = ["ids", "decoded", "n_words", "n_hit", "items", "hits", "contaminated", "score", "Predicted", "kept", "anomaly", "base_failed", "spans", "base_spans", "n_removed", "kept_text", "n_tokens", "base_score", "component_id", "n_shingles", "_bucket", "bucket", "part", "candidate", "word_no", "before", "secret", "path", "length"]


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with every oddity, and columns named like outputs."""
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, LONG), (6, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (None, None), (8, "é" * 200 + " 　 😀"), (9, "token = \"1eb9c654e721b4f812088970e66a6345cee33dd6\" x.1@mail.example.com")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in OUTPUTS]).cache()


LABELS = "doc_id long, quality int"


def operators(spark):
    ranks = P.path("byte_bpe_50k.tiktoken")
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, 1), (7, 1), (7, 0), (None, 1), (8, None)], LABELS)
    tests = spark.createDataFrame([(1, "a b c"), (2, None), (None, "d e"), (3, ""), (3, "one")], "item_id long, text string")

    def rule(d):
        d = rules.measured(d)
        return rules.apply_rules(d, *rules.fit(d, labels))

    return {
        "bpe": lambda d: bpe.encode(d, ranks, P.PATTERN, decoded_col="decoded"),
        "ppm": lambda d: ppm.score(d, F.col("doc_id") % 2 == 0),
        "adaptive": lambda d: ppm.adaptive(d.where("length(text) < 1000 or text is null")),
        "pu": lambda d: pu.predict(d, pu.fit(d, labels, F.col("doc_id") > 0)[0]),
        "decontam": lambda d: decontam.scan(d, tests),
        "rules": rule,
        "pii": lambda d: pii.spans(d),
        "substrings": lambda d: substrings.drop_repeats(d, window=5),
        "minhash": lambda d: minhash.mark(d),
        "secrets": lambda d: secret_scan.scan(d, secret_scan.train(secret_scan.labelled_findings(spark, 300), trees=3, depth=4), path_col="doc_id"),
    }


NAMES = ["bpe", "ppm", "adaptive", "pu", "decontam", "rules", "pii", "substrings", "minhash", "secrets"]


@pytest.mark.parametrize("name", NAMES)
def test_oddities(spark, odd, name):
    out = operators(spark)[name](odd).toArrow()
    assert len(set(map(str.lower, out.column_names))) == len(out.column_names)
    if name == "secrets":
        assert out.column("secret").to_pylist() == [True]
    elif name != "adaptive":
        assert out.num_rows == 12
    if name not in ("minhash", "secrets"):
        assert "own path" in out.column("path").to_pylist()


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, odd, name):
    out = operators(spark)[name](odd.limit(0).select("doc_id", "text"))
    assert out.count() == 0


def by_id(df, *cols):
    return {r.doc_id: tuple(r[c] for c in cols) for r in df.where("doc_id is not null").collect()}


def test_defined_results(spark, odd):
    ops = operators(spark)
    ids = by_id(ops["bpe"](odd), "ids", "decoded")
    assert ids[1] == ids[2] == ([], b"") and ids[5][1] == LONG.encode()
    scores = by_id(ops["ppm"](odd), "n_tokens", "n_known")
    assert scores[1] == scores[2] == (1, 1) and scores[5][0] == 60_002
    hit = by_id(ops["decontam"](odd), "n_words", "n_hit", "items", "contaminated")
    assert hit[1] == hit[2] == (0, 0, [], False)
    assert hit[6] == (6, 5, ["1"], True) and hit[4] == (1, 1, ["3"], True)
    kept = by_id(ops["rules"](odd), "n_words", "base_failed", "kept")
    assert kept[1] == (0, True, False) and kept[5][0] == 60_001
    cut = by_id(ops["substrings"](odd), "n_words", "n_removed", "kept_text")
    assert cut[1] == cut[2] == (0, 0, "") and cut[6] == cut[7] == (6, 6, "") and cut[5][1] == 60_000
    near = by_id(ops["minhash"](odd), "n_shingles", "component_id", "kept")
    assert near[1] == (0, 1, True) and near[6] == (2, 6, True) and near[7] == (2, 6, False) and near[4] == (1, 4, True)
    assert [tuple(r) for r in minhash.mark(odd).where("doc_id is null").select("component_id", "kept").collect()] == [(None, True)] * 2
    spans = by_id(ops["pii"](odd), "spans")
    assert spans[1] == ([],) and [s.kind for s in spans[9][0]] == ["email"]


def test_no_tests_no_labels(spark, odd):
    d = odd.select("doc_id", "text")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.scan(d, none).where("contaminated or n_hit > 0").count() == 0
    assert decontam.decontaminate(d, none).count() == 12
    labels = spark.createDataFrame([], LABELS)
    model, _ = pu.fit(d, labels, F.lit(True))
    assert {r.score for r in pu.predict(d, model).collect()} == {0.0}
    d = rules.measured(d)
    forest, threshold = rules.fit(d, labels)
    assert threshold == 2.0 and rules.apply_rules(d, forest, threshold).where("kept").count() == 0


def test_pages(spark):
    rows = [(1, "http://a/ü ?x", "same"), (3, None, "same"), (2, "u", None), (4, "u", ""), (5, "u", "\x1f\x8b\x08" + "WARC/1.1" * 400), (3, "again", "same"), (None, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    out = warc.read(spark, warc.write(pages), split_bytes=50).collect()
    got = sorted((r.record_id or "", r.type, r.payload_bytes, r.refers_to) for r in out)
    assert got == [("", "revisit", 4, "3"), ("1", "revisit", 4, "3"), ("2", "revisit", 0, "4"), ("3", "response", 4, None), ("3", "response", 4, None), ("4", "response", 0, None), ("5", "response", 3204, None)]
    assert {r.payload_digest for r in out if r.payload_bytes == 4} == {warc.base32_sha1(b"same")}
    assert warc.read(spark, warc.write(pages.limit(0))).count() == 0
