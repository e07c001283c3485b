"""Quality rules: text statistics, an isolation forest over them, calibrated thresholds.

``statistics`` measures every whole text, ``measured`` does so once for all that
follows.  ``Forest`` is an isolation forest: random splits isolate unusual
documents after few steps, so a short mean path means an anomaly.  It is grown on
a bounded sample of labelled rows; the threshold on its score is calibrated from
all labelled rows.  ``apply_rules`` adds the statistics, the base rules and the
verdict.

Words are runs of characters other than space and ``\\x09-\\x0D``.  Null and empty
texts have no words: all statistics 0 and the base rule on length fails.  Very
long texts are measured whole, repeated rows are rows like others, null ids have
no label, of several labels of an id the greatest counts.  An empty table gives
no rows.  Columns named like an output are replaced.
"""

from __future__ import annotations

import math
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.textcore import SPACE, Texts, Words, attach, shared_dir, tune, windows, without, written

#: Symbols that prose rarely has; fixed by the rule's definition.
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_digits", "n_marks", "n_lines", "n_doubled"]


def count(texts: Texts) -> dict[str, np.ndarray]:
    """COUNTS of each text of a slice."""
    words = Words(texts, SPACE)
    buf, offs, n = texts.buf, texts.offs, len(texts)
    h, bounds, doc = words.hashes(), words.bounds, words.doc()

    def per_text(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return c[offs[1:]] - c[offs[:-1]]

    kinds = _KINDS[buf]
    out = {"n_words": words.counts.astype(np.int64)}
    out["word_chars"] = per_text((kinds & 1) > 0)
    out["n_symbols"] = per_text((kinds & 2) > 0)
    # words in 3-word windows that the text has twice or more
    at, w = windows(h, bounds, 3)
    repeated = np.zeros(len(h) + 3, bool)
    if len(at):
        order = np.lexsort((w, doc[at]))
        d, x = doc[at][order], w[order]
        new = np.concatenate(([True], (d[1:] != d[:-1]) | (x[1:] != x[:-1])))
        size = np.diff(np.append(np.flatnonzero(new), len(new)))
        twice = at[order[np.repeat(size > 1, size)]]
        for k in range(3):
            repeated[twice + k] = True
    out["n_repeat_words"] = np.bincount(doc[repeated[: len(h)]], minlength=n)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    out["n_doubled"] = np.bincount(doc[same], minlength=n)
    out["n_upper"] = per_text((kinds & 4) > 0)
    out["n_letters"] = per_text((kinds & 8) > 0)
    out["n_digits"] = per_text((kinds & 16) > 0)
    out["n_marks"] = per_text((kinds & 32) > 0)
    lines, dup = np.zeros(n, np.int64), np.zeros(n, np.int64)
    breaks = per_text(buf == 10)
    for i in range(n):
        if not out["n_words"][i]:
            continue
        if not breaks[i]:
            lines[i] = 1
            continue
        own = [x for x in texts.bytes(i).split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
        lines[i], dup[i] = len(own), len(own) - len(set(own))
    out["n_lines"], out["n_dup_lines"] = lines, dup
    return out


def _kinds() -> np.ndarray:
    k = np.zeros(256, np.uint8)
    for b in range(256):
        first = b < 0x80 or b >= 0xC0  # first byte of a code point
        k[b] = (1 if first and not SPACE[b] else 0) | (2 if b in SYMBOLS else 0) | (4 if 65 <= b <= 90 else 0) | (8 if first and (b >= 0x80 or 65 <= b <= 90 or 97 <= b <= 122) else 0) | (16 if 48 <= b <= 57 else 0) | (32 if b in b"!?" else 0)
    return k


_KINDS = _kinds()


def statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the COUNTS of its whole texts."""

    def work(batch, texts):
        parts = [count(texts.part(a, b)) for a, b in texts.slices()]
        return [pa.array(np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64), pa.int64()) for c in COUNTS]

    return attach(df, text_col, T.StructType([T.StructField(c, T.LongType(), False) for c in COUNTS]), work)


def measured(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns ``keep``) with the COUNTS of its whole texts, measured once: a table in the shared folder."""
    out = statistics(df, text_col)
    return written(out.select(*[f"`{c}`" for c in keep], *COUNTS) if keep else out)


#: Rates that the forest splits on, from the COUNTS.
RATES = ["symbols", "dup_lines", "repeats", "upper", "digits", "marks", "doubled", "word_length"]


def rates() -> list[Column]:
    c = {x: F.col(x).cast("double") for x in COUNTS}
    words, chars = F.greatest(c["n_words"], F.lit(1.0)), F.greatest(c["word_chars"], F.lit(1.0))
    made = [c["n_symbols"] / words, c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1.0)), c["n_repeat_words"] / words, c["n_upper"] / F.greatest(c["n_letters"], F.lit(1.0)), c["n_digits"] / chars, c["n_marks"] / words, c["n_doubled"] / words, c["word_chars"] / words]
    return [m.alias(n) for m, n in zip(made, RATES, strict=True)]


def _expected(n: float) -> float:
    """Mean path length of an unsuccessful search in a tree of n leaves."""
    if n <= 1:
        return 0.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else 1.0


class Forest:
    """Isolation forest: ``trees`` random trees, each over ``subsample`` rows.

    Splits are drawn from the box ``low``..``high`` of all rows that may come, not
    from the extent of the subsample: a rate that normal rows never have is then
    split off from them too, and what has it is isolated at once.
    """

    def __init__(self, x: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = 300, subsample: int = 1024, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.size = min(subsample, len(x)) or 1
        self.trees = [self._grow(x[rng.choice(len(x), self.size, replace=False)] if len(x) else x, low, high, 0, math.ceil(math.log2(max(self.size, 2))), rng) for _ in range(trees)]

    def _grow(self, x: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, most: int, rng) -> tuple:
        open_ = np.flatnonzero(high > low)
        if depth >= most or len(x) <= 1 or not len(open_):
            return (depth + _expected(len(x)),)
        f = int(rng.choice(open_))
        at = float(rng.uniform(low[f], high[f]))
        left = x[:, f] < at
        cut = lambda box: np.where(np.arange(len(box)) == f, at, box)
        return (f, at, self._grow(x[left], low, cut(high), depth + 1, most, rng), self._grow(x[~left], cut(low), high, depth + 1, most, rng))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1): 2 ** (-mean path / expected path)."""
        total = np.zeros(len(x))

        def walk(node, rows):
            if len(node) == 1:
                total[rows] += node[0]
            elif len(rows):
                left = x[rows, node[0]] < node[1]
                walk(node[2], rows[left])
                walk(node[3], rows[~left])

        for t in self.trees:
            walk(t, np.arange(len(x)))
        return 2.0 ** (-total / len(self.trees) / max(_expected(self.size), 1e-9))


def forest_score(df: DataFrame, forest: Forest, out: str = "anomaly") -> DataFrame:
    """df (with the COUNTS) with the forest's score."""
    tune(df.sparkSession)
    df = without(df, [out])
    names = df.columns
    wide = df.select("*", *[r.alias(f"_rate_{i}") for i, r in enumerate(rates())])
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType(), False)])
    m = len(names)

    def run(batches):
        for b in batches:
            x = np.stack([b.column(m + i).to_numpy(zero_copy_only=False) for i in range(len(RATES))], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns[:m], pa.array(forest.score(x))], names=schema.names)

    return wide.mapInArrow(run, schema)


#: Rows of labelled statistics that the forest is grown on, the first by a hash of their id.
FOREST_ROWS = 4_096
#: A threshold below which clean labelled documents would be lost is not taken.
KEEP_CLEAN = 0.995


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", good: int = 1, trees: int = 300) -> tuple[Forest, float]:
    """A forest and the score from which on a document is rejected; docs are ``measured``.

    The forest sees at most FOREST_ROWS labelled documents marked good, so that
    what is unlike them is isolated early.  The threshold is calibrated on all
    labelled rows that pass the base rule: of the scores that keep at least KEEP_CLEAN of the good rows
    the one with the best balanced accuracy.  Scores are counted in steps of
    0.001, so the driver gets at most 2,000 counts.  Without labelled rows of
    both kinds nothing is rejected.
    """
    own = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label"))
    shared_dir(docs.sparkSession)
    told = docs.select(F.col(f"`{id_col}`").alias("_id"), *COUNTS).join(own, "_id").checkpoint()
    first = told.where(F.col("_label") == good).select("_id", *rates()).orderBy(F.xxhash64("_id"), "_id").limit(FOREST_ROWS).drop("_id")
    x = np.array([tuple(r) for r in first.collect()], float).reshape(-1, len(RATES))
    extent = told.select(*rates()).agg(*[F.min(r).alias(f"low_{r}") for r in RATES], *[F.max(r).alias(f"high_{r}") for r in RATES]).first()
    low, high = (np.array([0.0 if extent[f"{side}_{r}"] is None else extent[f"{side}_{r}"] for r in RATES]) for side in ("low", "high"))
    forest = Forest(x, low, high, trees)
    steps = forest_score(told, forest).where(~base_rule()).groupBy(F.floor(F.col("anomaly") * 1000).cast("int").alias("s"), (F.col("_label") == good).alias("g")).count().collect()
    good_n, bad_n = np.zeros(1002), np.zeros(1002)
    for s, g, n in steps:
        (good_n if g else bad_n)[s] += n
    if not len(x) or not good_n.sum() or not bad_n.sum():
        return forest, 2.0
    kept_good, lost_bad = np.cumsum(good_n) / good_n.sum(), 1 - np.cumsum(bad_n) / bad_n.sum()
    fine = np.flatnonzero(kept_good >= KEEP_CLEAN)
    best = fine[np.argmax((kept_good + lost_bad)[fine])]
    return forest, float(best + 1) / 1000


def apply_rules(docs: DataFrame, forest: Forest, threshold: float) -> DataFrame:
    """docs (``measured``) with anomaly, base_failed and kept (columns of the same names are replaced)."""
    out = without(forest_score(docs, forest), ["base_failed", "kept"])
    return out.withColumn("base_failed", base_rule()).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < threshold))


def base_rule() -> Column:
    """Fewer than 50 words, or over half of them within repeated 3-word windows."""
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
