"""Language-model scores by prediction by partial matching (PPM) over bytes.

The model is a trie of byte contexts of up to ``ORDER`` bytes.  A byte is
predicted from its longest context that training saw; a context escapes to the
next shorter one with the probability of method D (each follower seen c times
keeps c - 1/2, what is left over escapes), and the bytes that the longer context
had are excluded there.  Below order 0 the rest of the alphabet is equally likely.
A text is scored with an end symbol, so scores are probabilities of whole texts.

Training counts cover every byte of every training text.  They are kept as a
distributed trie: contexts are dealt to parts by a hash of their last three
bytes (orders ``ORDER`` to 3); orders 2 to 0, of which there are at most 2**24
counts, go to every part.  Since the followers of a context are among those of
its shorter ones, the excluded bytes of an escape depend on the escaped context
alone, and each byte in its context gets its probability once for the whole
corpus.  Buckets of documents ask for the distinct contexts they hold (see
``exchange``), so neither trie nor texts ever meet in one place.

The same exchange counts words for the base score: the sum over a text's words
and one end token of ``log10((c + 1) / (N + V + 1))``.  Words are keyed by a 64-bit
hash.

Texts are taken with A-Z lower-cased, by words and model alike.  A null text is
the empty text: one end token.  Without training texts all counts are 0 and the
alphabet is uniform.  A null training flag counts as false.  Columns named like
an output are replaced.  ``adaptive`` instead learns from each text itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.exchange import Exchange, part_of, ranges
from tidemark.llm.textcore import SPACE, Texts, Words, attach, fresh, group_starts, mix, pack_sorted, tune, unpack_sorted, without

ORDER = 5
#: Bytes that UTF-8 never has: before a text, and after it.
BEFORE, END = 0xFE, 0xFF
#: Symbols that can be predicted: all bytes and the end, less the padding.
ALPHABET = 255
#: Hash that stands for the end token among words.
END_WORD = int(mix(np.array([0xE0D], np.uint64))[0])

WORDS, CONTEXTS = 0, 1


def codes(texts: Texts, order: int) -> np.ndarray:
    """Each byte (and end) with the ``order`` bytes before it, text after text, as a number of order + 1 bytes."""
    n, lens = len(texts), np.diff(texts.offs)
    shift = np.arange(n) * (order + 1) + order
    padded = np.full(len(texts.buf) + n * (order + 1), BEFORE, np.uint8)
    padded[np.arange(len(texts.buf)) + np.repeat(shift, lens)] = texts.buf
    padded[texts.offs[1:] + shift] = END
    wide = padded.astype(np.uint64)
    out = wide[order:].copy()
    for j in range(1, order + 1):
        out |= wide[order - j : len(wide) - j] << np.uint64(8 * j)
    return out[padded[order:] != BEFORE]


def distinct(a: np.ndarray) -> np.ndarray:
    """Distinct values in ascending order."""
    a = np.sort(a)
    return a[group_starts(a)]


def tally(key: np.ndarray, learnt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, with the number of times that they were learnt."""
    train = np.sort(key[learnt])
    first = group_starts(train)
    a, n = train[first], np.diff(np.append(first, len(train)))
    if learnt.all():
        return a, n
    u = distinct(np.concatenate([a, key[~learnt]]))
    out = np.zeros(len(u), np.int64)
    out[np.searchsorted(u, a)] = n
    return u, out


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One tally of several."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = group_starts(key)
    return key[first], np.add.reduceat(n, first) if len(first) else n


class Level:
    """Counts of one order: followers in their contexts, and totals of contexts."""

    def __init__(self, grams: np.ndarray, n: np.ndarray):
        seen = n > 0
        self.grams, self.n = grams[seen], n[seen].astype(float)
        c = self.grams >> np.uint64(8)
        first = group_starts(c)
        self.contexts = c[first]
        self.total = np.add.reduceat(self.n, first) if len(first) else self.n
        self.distinct = np.diff(np.append(first, len(c))).astype(float)
        self.first = first
        self.excluded = np.zeros(len(first))

    def exclude(self, shorter: Level, order: int) -> Level:
        """Notes the counts that this order's followers have one order below."""
        if len(self.grams):
            below = find(shorter.grams, shorter.n, self.grams & mask(order))
            self.excluded = np.add.reduceat(below, self.first)
        return self


def mask(n: int) -> np.uint64:
    return np.uint64((1 << (8 * n)) - 1)


def find(keys: np.ndarray, values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values of ``at`` in a table with sorted keys; 0 where it has none."""
    if not len(keys):
        return np.zeros(len(at))
    i = np.searchsorted(keys, at)
    i[i == len(keys)] = 0
    return np.where(keys[i] == at, values[i], 0.0)


def shorten(grams: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of an order, from those of a higher one."""
    return merge([(grams & mask(order + 1), n)])


def low_levels(grams: np.ndarray, n: np.ndarray) -> list[Level]:
    """Orders 0, 1 and 2 from counts of three bytes."""
    levels = [Level(*shorten(grams, n, j)) for j in range(3)]
    for j in (1, 2):
        levels[j].exclude(levels[j - 1], j)
    return levels


def log10_probabilities(grams: np.ndarray, n: np.ndarray, low: list[Level], order: int) -> np.ndarray:
    """Of each distinct gram: log10 of the probability of its last byte after the others."""
    levels = list(low)
    for j in range(3, order + 1):
        levels.append(Level(*(shorten(grams, n, j) if j < order else (grams, n))).exclude(levels[j - 1], j))
    out, still = np.zeros(len(grams)), np.ones(len(grams), bool)
    gone, gone_distinct = np.zeros(len(grams)), np.zeros(len(grams))
    with np.errstate(divide="ignore", invalid="ignore"):
        for j in range(order, -1, -1):
            level = levels[j]
            g = grams & mask(j + 1)
            c = g >> np.uint64(8)
            count = find(level.grams, level.n, g)
            total, distinct = find(level.contexts, level.total, c), find(level.contexts, level.distinct, c)
            left, kinds = total - gone, distinct - gone_distinct
            hit = still & (count > 0)
            out[hit] += np.log10((count[hit] - 0.5) / left[hit])
            escape = still & (count == 0) & (kinds > 0)
            out[escape] += np.log10(0.5 * kinds[escape] / left[escape])
            still &= count == 0
            gone, gone_distinct = find(level.contexts, level.excluded, c), distinct
    out[still] -= np.log10(np.maximum(ALPHABET - gone_distinct[still], 1))
    return out


def _lower_orders(df: DataFrame, text_col: str, train_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all runs of three bytes in training texts; at most 2**24."""
    src = df.select(F.col(text_col).alias("t"), F.coalesce(train_col, F.lit(False)).alias("f")).where("f").select("t")

    def run(batches: Iterator[pa.RecordBatch]):
        made = []
        for b in batches:
            texts = Texts.of(b.column(0)).lower()
            made += [np.unique(codes(texts.part(x, y), 2), return_counts=True) for x, y in texts.slices()]
            if len(made) > 16:
                made = [merge(made)]
        g, n = merge(made)
        for a in range(0, len(g), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(g[a : a + 100_000].astype(np.int64)), pa.array(n[a : a + 100_000].astype(np.int64))], names=["g", "n"])

    t = src.mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow().sort_by("g")
    return t.column("g").to_numpy().astype(np.uint64), t.column("n").to_numpy()


def score(df: DataFrame, train: Column, text_col: str = "text", order: int = ORDER) -> DataFrame:
    """df with n_tokens, n_known, train_tokens, base_score and score (log10 probability), learnt where ``train`` holds."""
    if not 3 <= order <= 5:
        raise ValueError("order must be 3, 4 or 5: a byte in its context and its document share one 64-bit key")
    outputs = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    learn, summed, corpus = fresh(df, "_train"), fresh(df, "_counts"), fresh(df, "_totals")
    df = without(df.withColumn(learn, F.coalesce(train, F.lit(False))), outputs)
    tune(df.sparkSession)
    low = df.sparkSession.sparkContext.broadcast(low_levels(*_lower_orders(df, text_col, learn)))
    x = Exchange(df, text_col)
    parts, text, flag, own_bucket = x.parts, x.text, x.docs.columns.index(learn), x.key

    def slices(t: pa.Table):
        texts, train = Texts.of(t.column(text)).lower(), np.asarray(t.column(flag)).astype(bool)
        for a, b in texts.slices(2 << 20):  # larger slices share more contexts
            yield a, b, texts.part(a, b), train[a:b]

    def word_hashes(own: Texts):
        """Hashes and texts of all tokens, the end tokens last."""
        w = Words(own, SPACE)
        return np.concatenate([w.hashes(), np.full(len(own), END_WORD, np.uint64)]), np.concatenate([w.doc(), np.arange(len(own))])

    def grams(own: Texts):
        return codes(own, order), np.repeat(np.arange(len(own)), np.diff(own.offs) + 1)

    def deal(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The part of each gram, by the last three bytes of its context; the order that sorts them by part and gram."""
        part = part_of(mix((g >> np.uint64(8)) & mask(3)), parts)
        return part, np.argsort(part.astype(np.uint16 if parts <= 1 << 16 else np.uint32), kind="stable")

    def tallies(t: pa.Table):
        words, contexts = [], []
        for _, _, own, train in slices(t):
            for made, (key, doc) in ((words, word_hashes(own)), (contexts, grams(own))):
                made.append(tally(key, train[doc]))
        g, n = merge(contexts)
        part, by = deal(g)
        return merge(words), (part[by], g[by], n[by])

    def ask(t: pa.Table):
        bucket = t.column(own_bucket)[0].as_py()
        (w, wn), (part, g, gn) = tallies(t)
        for p, a, b in ranges(part_of(w, parts), parts):
            yield WORDS, p, bucket, pack_sorted(w[a:b]), pack_numbers(wn[a:b])
        for p, a, b in ranges(part, parts):
            yield CONTEXTS, p, bucket, pack_sorted(g[a:b]), pack_numbers(gn[a:b])

    def decide(kind: int, part: int, keys: list[bytes], notes: list[bytes]) -> list[bytes]:
        own = [unpack_sorted(k) for k in keys]
        u, n = merge([(k, unpack_numbers(c)) for k, c in zip(own, notes, strict=True)])
        if kind == WORDS:
            head = int((n > 0).sum()).to_bytes(8, "big") + int(n.sum()).to_bytes(8, "big")
            return [head + pack_numbers(n[np.searchsorted(u, k)]) for k in own]
        p = log10_probabilities(u, n, low.value, order).astype("<f8")
        return [p[np.searchsorted(u, k)].tobytes() for k in own]

    schema = T.StructType([*[f for f in df.schema if f.name != learn], *[T.StructField(c, T.LongType()) for c in outputs[:2]], T.StructField(summed, T.DoubleType()), T.StructField("score", T.DoubleType())])
    kept = [c for c in df.columns if c != learn]

    def finish(t: pa.Table, told: dict[int, list[bytes]]) -> pa.Table:
        n = t.num_rows
        n_tokens, n_known, counts, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        if n:
            # each slice is sorted once, as (key, text), and read twice: for the distinct keys, then for the sums
            held = []
            for a, b, own, _ in slices(t):
                code, doc = grams(own)
                key = code << np.uint64(16) | doc.astype(np.uint64)
                key.sort()
                code = key >> np.uint64(16)
                first = group_starts(code)
                held.append((a, b, code[first], first, (key & mask(2)).astype(np.uint16), word_hashes(own)))
            own_words = distinct(np.concatenate([x[5][0] for x in held]))
            found = np.concatenate([unpack_numbers(x[16:]) for x in told[WORDS]])
            g = distinct(np.concatenate([x[2] for x in held]))
            p = np.empty(len(g))
            p[deal(g)[1]] = np.concatenate([np.frombuffer(x, "<f8") for x in told[CONTEXTS]])
            for a, b, code, first, doc, (h, word_doc) in held:
                c = found[np.searchsorted(own_words, h)]
                n_tokens[a:b] = np.bincount(word_doc, minlength=b - a)
                n_known[a:b] = np.bincount(word_doc[c > 0], minlength=b - a)
                counts[a:b] = np.bincount(word_doc, np.log10(c + 1.0), minlength=b - a)
                each = np.repeat(p[np.searchsorted(g, code)], np.diff(np.append(first, len(doc))))
                total[a:b] = np.bincount(doc, each, minlength=b - a)
        return pa.Table.from_arrays([*(t.column(c) for c in kept), pa.array(n_tokens), pa.array(n_known), pa.array(counts), pa.array(total)], names=schema.names)

    answers = x.answer(x.ask(ask), decide)
    out = x.finish(answers, finish, schema)
    number = lambda at: F.conv(F.hex(F.substring("data", at, 8)), 16, 10).cast("long")
    per_part = answers.where(F.col("kind") == WORDS).groupBy("part").agg(F.max(number(1)).alias("v"), F.max(number(9)).alias("n"))
    totals = per_part.agg(F.struct(F.coalesce(F.sum("v"), F.lit(0)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).alias("s"))
    out = out.withColumn(corpus, totals.scalar())
    base = F.col(summed) - F.col("n_tokens") * F.log10((F.col(f"{corpus}.n") + F.col(f"{corpus}.v") + 1).cast("double"))
    return out.select(*[F.col(f"`{c}`") for c in kept], "n_tokens", "n_known", F.col(f"{corpus}.n").alias("train_tokens"), base.alias("base_score"), "score")


def pack_numbers(a: np.ndarray) -> bytes:
    """Numbers as byte planes: the high ones are mostly zero and compress to nothing."""
    return np.ascontiguousarray(a.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_numbers(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<i8").ravel()


class Trie:
    """The same model one byte at a time, which can also learn while it scores."""

    def __init__(self, order: int = ORDER):
        self.order, self.followers = order, {}

    def symbols(self, text: bytes) -> Iterator[tuple[bytes, int]]:
        padded = bytes([BEFORE]) * self.order + text + bytes([END])
        for i in range(self.order, len(padded)):
            yield padded[i - self.order : i], padded[i]

    def learn(self, context: bytes, symbol: int) -> None:
        for j in range(self.order + 1):
            own = self.followers.setdefault(context[len(context) - j :], {})
            own[symbol] = own.get(symbol, 0) + 1

    def log10(self, context: bytes, symbol: int) -> float:
        out, excluded = 0.0, set()
        for j in range(self.order, -1, -1):
            own = {s: n for s, n in self.followers.get(context[len(context) - j :], {}).items() if s not in excluded}
            if not own:
                continue
            total = sum(own.values())
            if symbol in own:
                return out + math.log10((own[symbol] - 0.5) / total)
            out += math.log10(0.5 * len(own) / total)
            excluded |= own.keys()
        return out - math.log10(max(ALPHABET - len(excluded), 1))

    def score(self, text: bytes, adapt: bool = False) -> float:
        out = 0.0
        for context, symbol in self.symbols(text):
            out += self.log10(context, symbol)
            if adapt:
                self.learn(context, symbol)
        return out


def adaptive(df: DataFrame, text_col: str = "text", order: int = ORDER, out_col: str = "score") -> DataFrame:
    """df with the log10 probability of each text under a model that starts empty and learns from the text itself."""

    def work(batch, texts):
        low = texts.lower()
        return [pa.array([Trie(order).score(low.bytes(i), adapt=True) for i in range(len(low))], pa.float64())]

    return attach(df, text_col, T.StructType([T.StructField(out_col, T.DoubleType(), False)]), work)
