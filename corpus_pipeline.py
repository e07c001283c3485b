"""From raw documents to token ids: five stages over the whole corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet in the shared folder and read again as the next one's documents.  All
stages but the last return the columns of documents.

1. quality rules: documents that fail the base rules or the forest's verdict go
2. near-duplicates: one document of each class stays (links from similarity 0.80 on)
3. decontamination: documents with any occurrence of a benchmark window go
4. personal data: spans are replaced by their kind, n_chars follows
5. byte-level BPE: token ids, and whether they decode to the text's bytes

Null and empty texts have no words and go in the first stage; the later stages,
called alone, keep them as they are (no class, no hits, no spans, no tokens).
Very long texts are read whole by all stages.  Of rows that repeat an id the
second stage keeps one, of documents in one class that with the least id.  Null
ids have no label, are never near-duplicates and are cleaned like others.  Empty
tables give empty tables; without labels of both kinds only the base rules
reject, without benchmark items no document is affected.  Columns of documents
may have any names: those of the last stage (n_tokens, round_trip, ids) replace
columns of the same name, no other clashes.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontam, minhash, pii, rules
from tidemark.llm.textcore import fresh, shared_dir, without


def _apart(docs: DataFrame, *needed: str) -> tuple[DataFrame, list]:
    """docs under names that no operator has, save for those needed, and the columns that restore it."""
    names = {c: c if c in needed else f"own_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), [F.col(f"`{n}`").alias(c) for c, n in names.items()]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, back = _apart(docs, "doc_id", "text")
    own = rules.statistics(own)  # measured again for the verdict: a table of texts and counts would take as much disk as the documents
    forest, threshold = rules.fit(own, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rules.apply_rules(own, forest, threshold).where("kept").select(back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, back = _apart(docs, "text", "n_chars")
    out = pii.spans(own, masked_col="masked text").withColumn("text", F.col("masked text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(back)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = without(docs, ["n_tokens", "round_trip", "ids"])
    decoded = fresh(docs, "decoded")
    out = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded_col=decoded)
    same = F.col(decoded) == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return out.select(*[f"`{c}`" for c in docs.columns if c != "text"], F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("byte-level BPE", token_ids),
]

#: The forest, the field and the merges have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; what a stage wrote is removed once the next one has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                _remove(spark, f"{folder}/{k - 1}")
    return docs


def _remove(spark: SparkSession, folder: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
