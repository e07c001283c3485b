"""Secret scan: candidate strings, and a random forest that removes false positives.

DataFrame functions only.  A candidate is a run of ``SHORTEST`` or more characters of
``[A-Za-z0-9+/_=-]`` with a digit, or with a capital after a small letter, within
a word (words end at space and ``\\x09-\\x0D``).  Each gets features: its length,
how its characters change class, how many differ, how much of it dictionary words
cover, what the path says and which words stand beside it.  A random forest
trained from labelled findings gives the probability that it is a real secret.

The dictionary is a list of words, a tokenizer's vocabulary for instance
(``vocabulary``); without one only the built-in words for samples and settings
count.  ``labelled_findings`` makes a small table of invented findings; any table
of the same columns can take its place.  Null and empty texts have no
candidates, a null path or a missing neighbour says nothing.  Texts, words and
candidates are read whole, however long.  A string that stands twice is two
candidates, repeated rows give repeated findings, an empty table gives none.
Columns named like an output are replaced.
"""

from __future__ import annotations

import json
import re

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.textcore import without

SHORTEST = 12
RUN = f"[A-Za-z0-9+/_=-]{{{SHORTEST},}}+"
#: Characters that a candidate can have.
CHARACTERS = 67

#: Words that show a string to be a name, a sample or a placeholder.
DICTIONARY = "example sample test dummy placeholder changeme your default fake mock user name file data image page index version release build config value token secret password private public access client server admin hello world lorem ipsum abcdef 123456 000000 xxxx".split()
#: Neighbours that announce a secret, and those that announce something else.
ANNOUNCE = "token|secret|passw|pwd|api.?key|apikey|auth|credential|private|access.?key|bearer|signature"
DENY = "commit|sha1|sha256|md5|hash|checksum|digest|uuid|guid|revision|etag|fingerprint|blob|session.?id|order|invoice|isbn|trace"
#: Paths where strings are seldom live.
SOFT_PATH = "test|spec|fixture|example|sample|mock|doc|readme|vendor|third_party"

def vocabulary(path: str, most: int = 4000, least: int = 4) -> list[str]:
    """The first ``most`` entries of a tokenizer file (JSON, in order of merging) that are words of ``least`` letters or more."""
    with open(path, encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    words = (re.sub("</w>$", "", w) for w in sorted(ids, key=ids.get))
    return list(dict.fromkeys(w for w in words if re.fullmatch(f"[a-z]{{{least},}}", w)))[:most]


#: Candidates hold a digit, or a capital after a small letter.
MIXED = "[0-9]|[a-z][A-Z]"

FEATURES = ["length", "digits", "uppers", "signs", "switches", "distinct", "hex", "vowels", "repeats", "coverage", "soft_path", "announced", "denied", "assigned", "quoted", "known_form", "dashes", "words"]


def candidates(df: DataFrame, text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """One row per candidate: df's columns less the text, with word_no, run_no (its place among the runs of the word), candidate, before, after, word and path."""
    own = ["word_no", "run_no", "word", "candidate", "before", "before2", "after", "path"]
    df = df.withColumn("_path", F.lower(F.col(path_col).cast("string")) if path_col else F.lit(None).cast("string"))
    df = without(df, [c for c in own if c.lower() != text_col.lower()])
    keep = [f"`{c}`" for c in df.columns if c not in (text_col, "_path")]
    some = df.where(F.col(text_col).rlike(RUN)).select(*keep, F.col("_path").alias("path"), F.split(F.col(text_col), r"[\x20\x09-\x0D]+").alias("_words"))
    # each word that may hold a candidate takes its neighbours with it, so the words of a text are not copied to its candidates
    near = lambda i, k: F.coalesce(F.try_element_at("_words", F.when(i + 1 + k > 0, i + 1 + k)), F.lit(""))
    marked = F.transform("_words", lambda w, i: F.when((F.length(w) >= SHORTEST) & w.rlike(MIXED) & w.rlike(RUN), F.struct(i.cast("long").alias("no"), w.alias("w"), near(i, -1).alias("before"), near(i, -2).alias("before2"), near(i, 1).alias("after"))))
    rows = some.withColumn("_at", F.explode(F.filter(marked, lambda s: s.isNotNull())))
    rows = rows.select(*keep, "path", F.col("_at.no").alias("word_no"), F.col("_at.w").alias("word"), F.col("_at.before").alias("before"), F.col("_at.before2").alias("before2"), F.col("_at.after").alias("after"))
    rows = rows.select("*", F.posexplode(F.regexp_extract_all("word", F.lit(f"({RUN})"), 1)).alias("run_no", "candidate"))
    return rows.withColumn("run_no", F.col("run_no").cast("long")).where(F.col("candidate").rlike(MIXED))


def with_features(found: DataFrame, words: list[str] | None = None) -> DataFrame:
    """Candidates with FEATURES; ``words`` is the dictionary."""
    c, n = F.col("candidate"), F.length("candidate").cast("double")
    share = lambda pattern: F.length(F.regexp_replace(c, pattern, "")) / n  # noqa: E731  of what the pattern leaves
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "l"), "[A-Z]", "u"), "[0-9]", "d")
    near = F.lower(F.concat_ws(" ", "before2", "before", F.split_part("word", F.lit("="), F.lit(1))))
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    dictionary = "|".join(DICTIONARY)
    made: dict[str, Column] = {
        "length": n,
        "digits": share("[^0-9]"),
        "uppers": share("[^A-Z]"),
        "signs": share("[A-Za-z0-9]"),
        "switches": (F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1) / n,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(float(CHARACTERS))),
        "hex": flag(c.rlike("^[0-9a-f]+$|^[0-9A-F]+$")),
        "vowels": share("[^aeiouAEIOU]"),
        "repeats": 1 - F.length(F.regexp_replace(c, r"(.)\1{2,}", "")) / n,
        "coverage": 1 - F.length(F.regexp_replace(F.lower(c), dictionary, "")) / n,
        "soft_path": flag(F.col("path").rlike(SOFT_PATH)),
        "announced": flag(near.rlike(ANNOUNCE)),
        "denied": flag(near.rlike(DENY)),
        "assigned": flag(F.col("before").rlike("[=:]$") | F.col("word").rlike("[A-Za-z]=[\"']?.{16}")),
        "quoted": flag(F.col("word").rlike("[\"'`]")),
        "known_form": flag(c.rlike("^(AKIA|ASIA|gh[pousr]_|sk_live_|xox[bap]-|eyJ)")),
        "dashes": F.length(F.regexp_replace(c, "[^-]", "")) / n,
        "words": _covered(c, words or DICTIONARY) / n,
    }
    return found.withColumns(made)


def _covered(c: Column, words: list[str]) -> Column:
    """Letters of a candidate in runs, as its case and signs part them, that are dictionary words."""
    runs = F.transform(F.regexp_extract_all(c, F.lit("[A-Z]?[a-z]+|[A-Z]+"), 0), lambda r: F.lower(r))
    return F.aggregate(F.filter(runs, lambda r: r.isin(words)), F.lit(0), lambda s, r: s + F.length(r))


def labelled_findings(spark: SparkSession, rows: int = 3000) -> DataFrame:
    """Invented findings with labels: before2, before, word, after, path, candidate and label (1: a real secret)."""
    r = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    pick = lambda salt, xs: F.element_at(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs]), r(salt, len(xs)) + 1)
    hexes = lambda salt, n: F.substring(F.concat(F.sha2(F.concat_ws("a", "id", F.lit(salt)), 256), F.sha2(F.concat_ws("b", "id", F.lit(salt)), 256)), 1, n)
    b64 = lambda salt, n: F.substring(F.regexp_replace(F.base64(F.unhex(hexes(salt, 120))), "[\r\n]", ""), 1, n)
    short = lambda salt, n: F.substring(F.translate(b64(salt, 40), "+/", "x9"), 1, n)
    h = hexes("u", 32)
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    words = ["erth", "thing", "eaux", "schtz", "ción", "handler", "module", "that", "of", "report", "user", "page"]
    sep = pick("sep", ["_", "-", "/"])
    name = F.concat(pick("n1", words), sep, pick("n2", words), sep, pick("n3", words), sep, F.lit("v"), r("v", 100).cast("string"))
    real = pick("real", [hexes("k", 40), hexes("k", 32), F.upper(hexes("k", 40)), b64("k", 40), b64("k", 44), F.concat(F.lit("AKIA"), F.upper(b64("a", 16))), F.concat(F.lit("ghp_"), F.regexp_replace(b64("g", 36), "[+/]", "x")), F.concat(F.lit("sk_live_"), F.regexp_replace(b64("s", 24), "[+/]", "y")), hexes("k", 64), short("w", 12), short("w", 14), F.concat(F.lit("xoxb-"), r("xo", 1 << 30).cast("string"), F.lit("-"), short("xq", 24)), F.concat(F.lit("AIza"), short("ai", 35)), F.concat(F.lit("eyJ"), short("jw", 60))])
    false = pick("false", [hexes("c", 40), hexes("c", 64), uuid, name, F.concat(F.lit("example_token_"), r("e", 10000).cast("string")), F.concat(F.lit("xxxxxxxxxxxxxxxx"), r("x", 1000).cast("string")), F.concat(F.lit("your-api-key-here-"), r("y", 100).cast("string")), F.lpad(r("z", 1 << 30).cast("string"), 20, "0"), F.concat(name, F.lit("_"), name), F.lit("1234567890123456789"), F.concat(F.lit("changeme_password_"), r("p", 100).cast("string")), F.concat(F.lit("2024-"), r("d", 12).cast("string"), F.lit("-10T10-20-30-"), r("t", 1000).cast("string")), F.concat(F.lit("2024-"), F.lpad(r("mo", 12).cast("string"), 2, "0"), F.lit("-"), F.lpad(r("da", 28).cast("string"), 2, "0"), F.lit("T10")), F.concat(pick("ic", words), F.lit("-"), r("in", 10**8).cast("string")), F.concat(pick("cm", ["get", "set", "make", "load"]), F.initcap(pick("cn", words)), F.initcap(pick("co", ["value", "name", "index", "handler"]))), F.concat(F.lit("build_"), r("bl", 10**6).cast("string"))])
    good = F.col("label") == 1
    loud = pick("loud", ["token", "TOKEN", "secret", "password", "api_key", "API-KEY", "auth", "credentials", "access_key", "private_key"])
    quiet = pick("quiet", ["commit", "sha256", "md5", "uuid", "checksum", "digest", "etag", "revision", "hash", *words])
    tell = F.when(good, F.when(r("m", 10) < 9, loud).otherwise(pick("w", words))).otherwise(F.when(r("m", 10) < 8, quiet).otherwise(pick("w", ["token", "api_key", "password", "key"])))
    rest = F.when(r("as", 10) < F.when(good, 8).otherwise(3), F.lit("=")).otherwise(pick("w2", words))
    base = spark.range(rows, numPartitions=1).withColumn("label", F.when(r("label", 2) == 0, 1.0).otherwise(0.0))
    # a string made like a real one, without anything that announces it, counts as false
    base = base.withColumn("candidate", F.when(good, real).otherwise(false)).withColumn("before2", tell).withColumn("before", rest)
    quote = r("q", 2) == 0
    return base.select("id", "label", "candidate", "before2", "before", F.when(quote, F.concat(F.lit('"'), "candidate", F.lit('"'))).otherwise(F.col("candidate")).alias("word"), pick("w3", words).alias("after"), F.when(r("pa", 10) < F.when(good, 1).otherwise(4), F.lit("tests/fixture")).otherwise(pick("pb", ["src1", "src2", "app/main"])).alias("path"))


def train(findings: DataFrame, trees: int = 40, depth: int = 8, seed: int = 3, words: list[str] | None = None) -> PipelineModel:
    """A random forest over FEATURES of labelled findings; their number is the caller's to bound."""
    told = with_features(findings, words).coalesce(1)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="_features"), RandomForestClassifier(featuresCol="_features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_prediction")]).fit(told)


def scan(df: DataFrame, model: PipelineModel, text_col: str = "text", path_col: str | None = None, words: list[str] | None = None) -> DataFrame:
    """One row per candidate: df's columns less the text, word_no, run_no, candidate, before, score and secret (score from 0.5 on).  ``words`` is the dictionary that the model was trained with."""
    outputs = {"word_no", "run_no", "candidate", "before", "score", "secret"}
    kept = [c for c in df.columns if c != text_col and c.lower() not in outputs]
    own = df.select(F.col(f"`{text_col}`").alias("_text"), (F.col(f"`{path_col}`") if path_col else F.lit(None)).cast("string").alias("_source"), *[F.col(f"`{c}`").alias(f"_own_{i}") for i, c in enumerate(kept)])
    scored = model.transform(with_features(candidates(own, "_text", "_source"), words)).withColumn("score", vector_to_array("_probability")[1])
    return scored.select(*[F.col(f"_own_{i}").alias(c) for i, c in enumerate(kept)], "word_no", "run_no", "candidate", "before", "score", (F.col("score") >= 0.5).alias("secret"))
