"""Quality classifier by positive-unlabelled learning.

Only documents marked good are trusted.  A small network on text statistics is
fitted by minimising the non-negative unbiased risk

    pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))

over trusted positives and unlabelled texts of the corpus, with logistic loss, so
its output approximates the probability of label 1 in the corpus.  The class prior
pi is estimated first: any set A of texts has P_u(A) >= pi * P_p(A), so the least
ratio P_u / P_p over the upper level sets of a positive-against-unlabelled score
bounds pi.  The scores are out of fold (each row is scored by a model that has not
seen it), since a model sets the very rows it was fitted on further apart, and
each ratio is taken with half its standard error, since the least of many is too
small.  Features are standardised by the trusted positives, so that what is unlike
them stands out.

The fit uses at most ``SAMPLE`` trusted positives and at most ``SAMPLE`` documents
of the corpus, labelled or not, as unlabelled text: the first by a hash of id and
text.  Negative labels are never read.  Features come from whole texts alone,
however long.  Null and empty texts have all features 0 and a score like any
other.  Without any positive row the score is 0 throughout.  Null labels are not
positive; an id that the labels have twice is positive if one of them is.
Repeated documents are documents like others, those with a null id can be
unlabelled text.  An empty table gives no rows.  Columns named like an output are
replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import rules
from tidemark.llm.textcore import Texts, attach

#: Trusted positives, and unlabelled documents, that a fit uses at most.
SAMPLE = 10_000
#: Parts of the sample, each scored by a model of the others when the prior is estimated.
FOLDS = 4


def features(texts: Texts) -> np.ndarray:
    """Statistics of each text of a slice: rates of rules, shares of bytes, lengths."""
    c = {k: v.astype(float) for k, v in rules.count(texts).items()}
    n, lens = len(texts), np.diff(texts.offs)
    one = lambda x: np.maximum(x, 1.0)
    words, chars = one(c["n_words"]), one(c["word_chars"])
    rate = [c["n_symbols"] / words, c["n_dup_lines"] / one(c["n_lines"]), c["n_repeat_words"] / words, c["n_upper"] / one(c["n_letters"]), c["n_digits"] / chars, c["n_marks"] / words, c["n_doubled"] / words, c["n_lines"] / words]
    byte = np.minimum(texts.buf, 128).astype(np.int64)
    share = np.bincount(np.repeat(np.arange(n), lens) * 129 + byte, minlength=n * 129).reshape(n, 129) / one(lens.astype(float))[:, None]
    rest = np.stack([np.log1p(c["n_words"]) / 10, c["word_chars"] / words / 10], axis=1)
    return np.concatenate([np.sqrt(np.stack(rate, axis=1)), np.sqrt(share), rest], axis=1)


class Model:
    """One hidden layer on features standardised by those of x."""

    def __init__(self, x: np.ndarray, hidden: int, rng):
        self.mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
        self.scale = np.maximum(x.std(0), 0.05) if len(x) else np.ones(x.shape[1])
        self.w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        self.empty = False

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(z @ self.w[0] + self.w[1])
        return z, h, h @ self.w[2] + self.w[3][0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.empty or not len(x):
            return np.zeros(len(x))
        return 1 / (1 + np.exp(-np.clip(self.forward(x)[2], -30, 30)))

    def fit(self, gradient, batches, steps: int, rng, decay: float = 5e-3, rate: float = 0.01) -> Model:
        """Adam on the gradient of a risk in the outputs of a batch of positives and one of unlabelled rows; weights are the mean of the second half."""
        m, v, later = ([np.zeros_like(w) for w in self.w] for _ in range(3))
        for step in range(1, steps + 1):
            x, n = batches(rng)
            z, h, f = self.forward(x)
            g = gradient(f, n)
            back = np.outer(g, self.w[2]) * (1 - h * h)
            grads = [z.T @ back + decay * self.w[0], back.sum(0), h.T @ g + decay * self.w[2], np.array([g.sum()])]
            for k, d in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                self.w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                later[k] += self.w[k] * (step > steps // 2)
        self.w = [w / max(steps - steps // 2, 1) for w in later]
        return self


def _sigmoid(f):
    return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def pu_risk(prior: float, f: np.ndarray, n: int) -> float:
    """The risk of outputs of n positives and, after them, unlabelled rows, before the cut at 0: (pi R_p(+), R_u(-) - pi R_p(-))."""
    soft = lambda x: float(np.logaddexp(0, x).mean())
    p, u = f[:n], f[n:]
    return prior * soft(-p), soft(u) - prior * soft(p)


def pu_gradient(prior: float):
    """Gradient of the non-negative risk: where the negative part is below 0, it alone is ascended."""

    def gradient(f: np.ndarray, n: int) -> np.ndarray:
        p, u = f[:n], f[n:]
        out = np.zeros(len(f))
        if pu_risk(prior, f, n)[1] >= 0:
            out[:n] = (prior * (_sigmoid(p) - 1) - prior * _sigmoid(p)) / n
            out[n:] = _sigmoid(u) / len(u)
        else:
            out[:n] = prior * _sigmoid(p) / n
            out[n:] = -_sigmoid(u) / len(u)
        return out

    return gradient


def estimate_prior(p: np.ndarray, u: np.ndarray, least: float = 0.3) -> float:
    """Least ratio, with half its standard error, of the shares of unlabelled and positive scores above a threshold that ``least`` of the positives pass."""
    at = np.quantile(p, np.linspace(0, 1 - least, 101))
    of_u, of_p = (u[None, :] >= at[:, None]).mean(1), (p[None, :] >= at[:, None]).mean(1)
    error = np.sqrt((1 - of_u) / np.maximum(of_u * len(u), 1) + (1 - of_p) / np.maximum(of_p * len(p), 1))
    return float(np.clip((of_u / of_p * (1 + error / 2)).min(), 0.01, 0.99))


def fit_arrays(own: np.ndarray, text: np.ndarray, hidden: int = 16, steps: int = 500, seed: int = 11, prior: float | None = None) -> tuple[Model, float]:
    """(model, prior) from the features of trusted positives and of unlabelled text."""
    rng = np.random.default_rng(seed)
    model = Model(own if len(own) else text, hidden, rng)
    if not len(own) or not len(text):
        model.empty = True
        return model, 0.0

    def batches(own, text, most=1024):
        def draw(rng):
            a, b = own[rng.integers(0, len(own), min(most, 4 * len(own)))], text[rng.integers(0, len(text), min(most, 4 * len(text)))]
            return np.concatenate([a, b]), len(a)

        return draw

    if prior is None:
        apart = lambda f, n: np.concatenate([(_sigmoid(f[:n]) - 1) / n, _sigmoid(f[n:]) / (len(f) - n)])
        of_own, of_text = rng.permutation(len(own)) % FOLDS, rng.permutation(len(text)) % FOLDS
        p, u = np.zeros(len(own)), np.zeros(len(text))
        for k in range(FOLDS):
            a, b = own[of_own != k], text[of_text != k]
            if not len(a) or not len(b):
                a, b = own, text
            first = Model(own, hidden, rng).fit(apart, batches(a, b), steps // 2, rng)
            p[of_own == k], u[of_text == k] = first.forward(own[of_own == k])[2], first.forward(text[of_text == k])[2]
        prior = estimate_prior(p, u)
    return model.fit(pu_gradient(prior), batches(own, text), steps, rng), prior


def fit(docs: DataFrame, labels: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> tuple[Model, float]:
    """(model, estimated prior) from documents and label rows for which ``use`` (on the id) holds."""
    good = labels.where(use).where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("good_id")).distinct()
    good = good.orderBy(F.xxhash64("good_id"), "good_id").limit(sample)  # bounded, hence the broadcast
    mine = docs.where(F.coalesce(use, F.lit(False))).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    share = min(1.0, 1.1 * sample / max(mine.count(), 1) + 1e-9)
    told = mine.join(F.broadcast(good), F.col("id") == F.col("good_id"), "left").withColumn("order", F.xxhash64("id", "text"))
    drawn = F.pmod("order", F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1)
    told = told.select("text", "order", F.col("good_id").isNotNull().alias("good"), drawn.alias("drawn")).where("good or drawn")
    rows = featured(told, "text").select("order", "good", "drawn", "_features").orderBy(F.pmod("order", F.lit(1 << 30)), "order").limit(4 * sample).toArrow()
    x = np.stack(rows.column("_features").to_numpy()).astype(float) if rows.num_rows else np.zeros((0, 139))
    pick = lambda c: x[np.flatnonzero(np.asarray(rows.column(c)).astype(bool))[:sample]]
    return fit_arrays(pick("good"), pick("drawn"))


def featured(df: DataFrame, text_col: str = "text", out_col: str = "_features") -> DataFrame:
    def work(batch, texts):
        x = np.concatenate([features(texts.part(a, b)) for a, b in texts.slices()]) if len(texts) else np.zeros((0, 139))
        return [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel().astype(np.float32)))]

    return attach(df, text_col, T.StructType([T.StructField(out_col, T.ArrayType(T.FloatType(), False), False)]), work)


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with score (0 to 1) and predicted (1 from 0.5 on)."""

    def work(batch, texts):
        s = np.concatenate([model.probability(features(texts.part(a, b))) for a, b in texts.slices()]) if len(texts) else np.zeros(0)
        return [pa.array(s), pa.array((s >= 0.5).astype(np.int32))]

    return attach(df, text_col, T.StructType([T.StructField("score", T.DoubleType(), False), T.StructField("predicted", T.IntegerType(), False)]), work)
