"""The registered queries of this subpackage and their SQL forms.

Each query applies one operator with production parameters to its whole table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontam, minhash, pii, ppm, pu, rules, secret_scan, sql, substrings, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded_col="decoded")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(_remainder(7) == 2, F.lit(False))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    out = ppm.score(docs, ~F.col("held_out"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(_remainder(3) == 1, F.lit(False))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model, _ = pu.fit(docs, _table(spark, sf_dir, "labels").select("doc_id", "quality"), ~held_out)
    return pu.predict(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontam.scan(docs, _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "longest")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rules.measured(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    forest, threshold = rules.fit(docs, _table(spark, sf_dir, "labels"))
    out = rules.apply_rules(docs, forest, threshold)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.read(spark, warc.write(_table(spark, sf_dir, "pages")))
    return out.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to").cast("long").alias("refers_to"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.spans(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    numbers = [pii.number_of("base_spans", k).alias(f"n_{k}") for k in pii.BASE]
    return out.select("doc_id", *numbers, F.sha2(pii.listed("base_spans"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = secret_scan.vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    model = secret_scan.train(secret_scan.labelled_findings(spark), words=words)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = secret_scan.scan(docs, model, path_col="source", words=words)
    return found.select("doc_id", "word_no", "run_no", F.sha2("candidate", 256).alias("candidate_sha256"), F.length("candidate").cast("long").alias("n_chars"), "score", "secret")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substrings.drop_repeats(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.mark(_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_ppm": op2_ppm,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_decontamination": op4_decontamination,
    "op5_quality_rules": op5_quality_rules,
    "op6_warc": op6_warc,
    "op7_pii": op7_pii,
    "op8_secret_scan": op8_secret_scan,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_minhash": op10_minhash,
}

SQL: dict[str, str] = {
    "op4_decontamination": sql.DECONTAMINATION,
    "op6_warc": sql.WARC,
    "op9_substring_dedup": sql.SUBSTRINGS,
    "op10_minhash": sql.MINHASH,
}
