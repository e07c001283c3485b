"""Benchmark decontamination by suffix arrays over the training texts.

Each task turns its documents into shards of word ids and builds a suffix array
of every shard: the starts of all suffixes that can match two words of a test
(or a whole one-word test), sorted by their first ``width`` words.  Every test
suffix is then binary-searched in every shard.  That gives the training suffixes
that share its window and, from the neighbours of the place found, the longest
verbatim match and its location.

Words are runs of characters outside ``\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F`` of the text
with A-Z lower-cased.  A window is ``width`` consecutive words of a test; a test
of fewer words is one window.  A training word inside any occurrence of a
window is hit.

Words are compared by 64-bit hashes: a document word outside the tests'
vocabulary of V words passes for one of them with probability V / 2**64.

Tests reach the tasks as broadcast text, in blocks of at most ``BLOCK_BYTES``
(a larger item stands alone).  The driver holds one block at a time, a worker
builds the arrays of one block at a time (some 40 bytes for each byte of test
text at the peak), and with several blocks it takes ``CHUNK_BYTES`` of documents
through all of them in turn, so memory does not grow with the tests.

Null or empty texts have no words, no hits and are never contaminated.  Items
without words match nothing.  Items with a null id hit words but are not
listed.  Repeated ids are listed once; repeated documents are documents like
others.  An empty test table leaves every document clean, an empty table of
documents gives none.  Very long texts are searched whole, as a shard of their
own.  Columns named like an output are replaced, in any case of letters; of
other columns none clashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.exchange import member
from tidemark.llm.textcore import NON_ALNUM, Texts, Words, group_starts, tune, without

#: Test text, in bytes, that one broadcast block holds.
BLOCK_BYTES = 4 << 20
#: Bytes of documents that a worker takes through all blocks, where there are several.
CHUNK_BYTES = 16 << 20
WIDTH = 13


class Tests:
    """Word ids, suffixes and windows of a block of tests.

    Suffixes stand in the order of their first ``width`` words, equal ones once
    for the search (``key``) and each with its item and place (``item``, ``place``).
    A window that several items have, or one item twice, is searched once.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], width: int = WIDTH):
        self.width = width
        self.names = [i for i, _ in items]
        texts = Texts.of(pa.array([t for _, t in items], pa.large_string())).lower()
        words = Words(texts, NON_ALNUM)
        h, doc = words.hashes(), words.doc()
        self.vocabulary = np.unique(h)
        self.n = len(self.vocabulary) + 1
        at = np.arange(len(h)) + doc  # one 0 after each item
        self.seq = np.zeros(len(h) + len(items) + width, np.uint32)
        self.seq[at] = np.searchsorted(self.vocabulary, h) + 1
        key = keys(self.seq, at, width)
        order = np.argsort(key, kind="stable")
        key, at, self.item = key[order], at[order], doc[order]
        self.place = at - doc[order] - words.bounds[:-1][self.item] if len(h) else np.zeros(0, np.int64)
        left = words.counts[self.item] - self.place if len(h) else np.zeros(0, np.int64)
        window = (left >= width) | (self.place == 0)
        self.first = group_starts(key)  # of the suffixes that share their first words
        self.key, self.at, self.position = key[self.first], at[self.first], at
        group = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(key))))
        # windows: of each its key, its words, and its items (owners[bounds[i]:bounds[i + 1]])
        rows = np.flatnonzero(window)
        pairs = np.unique(group[rows] * len(items) + self.item[rows])
        self.window, begin = np.unique(pairs // max(len(items), 1), return_index=True)
        self.owners, self.owner_bounds = pairs % max(len(items), 1), np.append(begin, len(pairs))
        self.span = np.minimum((self.seq[self.at[self.window][:, None] + np.arange(width)] > 0).cumprod(1).sum(1), width) if len(rows) else np.zeros(0, np.int64)
        high = self.seq[self.at[self.window][:, None] + np.arange(width)] if len(rows) else np.zeros((0, width), np.uint32)
        high[np.arange(width) >= self.span[:, None]] = 0xFFFFFFFF  # after every continuation
        self.ends = as_keys(high)
        second = self.seq[self.at + 1]
        self.pair = self.seq[self.at].astype(np.uint64) * np.uint64(self.n) + second
        self.pairs = np.unique(self.pair)
        self.alone = np.unique(self.seq[self.at[self.window[self.span == 1]]])
        self.is_alone = np.isin(self.seq[self.at], self.alone)
        self.table = None
        if self.n * self.n <= 1 << 26:
            self.table = np.zeros(self.n * self.n, bool)
            self.table[self.pairs.astype(np.int64)] = True
            self.table[self.alone.astype(np.int64)[:, None] * self.n + np.arange(self.n)] = True

    def ids_of(self, h: np.ndarray) -> np.ndarray:
        """Ids of hashed words; 0 for words that no test has."""
        if not len(self.vocabulary) or not len(h):
            return np.zeros(len(h), np.uint32)
        at = np.searchsorted(self.vocabulary, h)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == h, at + 1, 0).astype(np.uint32)

    def may_start(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a.astype(np.int64) * self.n + b
        if self.table is not None:
            return self.table[code] & (a > 0)
        return (a > 0) & (member(code.astype(np.uint64), self.pairs) | np.isin(a, self.alone))

    def present(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which distinct suffixes share two words (or are a one-word test's word) with training suffixes that begin with a, b."""
        code = np.unique(a.astype(np.uint64) * np.uint64(self.n) + b)
        return np.flatnonzero(member(self.pair, code) | (self.is_alone & np.isin(self.seq[self.at], a)))


def as_keys(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").ravel() if len(rows) else np.zeros(0, f"S{4 * rows.shape[1]}")


def keys(seq: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """First ``width`` word ids of the suffixes at ``at``, as strings that sort like them.

    A 0 (the end of a text, or a word that no test has) ends a suffix.
    """
    rows = seq[at[:, None] + np.arange(width)]
    return as_keys(rows * np.logical_and.accumulate(rows > 0, axis=1))


class Shard:
    """Suffix array of a slice of training texts (its hashed words and their bounds), against a block of tests."""

    def __init__(self, h: np.ndarray, bounds: np.ndarray, tests: Tests):
        n = len(bounds) - 1
        self.tests, self.bounds = tests, bounds
        self.doc = np.repeat(np.arange(n), np.diff(bounds))
        at = np.arange(len(h)) + self.doc
        self.seq = np.zeros(len(h) + n + tests.width, np.uint32)
        self.seq[at] = tests.ids_of(h)
        self.word_of = np.zeros(len(self.seq), np.int64)
        self.word_of[at] = np.arange(len(h))
        at = at[tests.may_start(self.seq[at], self.seq[at + 1])] if len(at) else at
        k = keys(self.seq, at, tests.width)
        order = np.argsort(k, kind="stable")
        self.suffixes, self.keys = at[order], k[order]
        # every test suffix that can match here, and its place in the array
        self.asked = tests.present(self.seq[self.suffixes], self.seq[self.suffixes + 1]) if len(at) else np.zeros(0, np.int64)
        self.place = np.searchsorted(self.keys, tests.key[self.asked], "left")

    def hits(self) -> tuple[np.ndarray, np.ndarray]:
        """(window, first hit word) of each occurrence of a window."""
        t = self.tests
        i = np.searchsorted(self.asked, t.window)
        i[i == len(self.asked)] = 0
        w = np.flatnonzero(self.asked[i] == t.window) if len(self.asked) else np.zeros(0, np.int64)
        lo = self.place[i[w]]
        hi = np.searchsorted(self.keys, t.ends[w], "right")
        n = np.maximum(hi - lo, 0)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        return np.repeat(w, n), self.word_of[self.suffixes[at]]

    def common(self, test: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Words that the test suffixes at ``test`` (places in the tests' words) share with the training suffixes at ``place``."""
        size, live = np.zeros(len(test), np.int64), np.arange(len(test))
        while len(live):
            x = self.tests.seq[test[live] + size[live]]
            live = live[(x > 0) & (x == self.seq[place[live] + size[live]])]
            size[live] += 1
        return size

    def nearest(self) -> np.ndarray:
        """Of each training suffix: words, ``width`` at most, that it shares with any test suffix.

        The test suffixes that share most stand right before and after it.
        """
        t, n = self.tests, len(self.suffixes)
        best = np.zeros(n, np.int64)
        if not len(self.asked):
            return best
        after = np.searchsorted(self.place, np.arange(n), "right")
        for side in (after - 1, after):
            some = np.flatnonzero((side >= 0) & (side < len(self.asked)))
            size, live = np.zeros(len(some), np.int64), np.arange(len(some))
            test, own = t.at[self.asked[side[some]]], self.suffixes[some]
            for _ in range(t.width):
                x = t.seq[test[live] + size[live]]
                live = live[(x > 0) & (x == self.seq[own[live] + size[live]])]
                size[live] += 1
            best[some] = np.maximum(best[some], size)
        return best

    def longest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(test suffix, words of its longest match in this shard, first word of that match), for those that share two words."""
        t = self.tests
        asked = np.searchsorted(t.first, np.arange(len(t.item)), "right") - 1  # all suffixes, by the distinct one they are like
        i = np.searchsorted(self.asked, asked)
        i[i == len(self.asked)] = 0
        rows = np.flatnonzero(self.asked[i] == asked) if len(self.asked) else np.zeros(0, np.int64)
        lo = self.place[i[rows]]
        hi = np.searchsorted(self.keys, t.key[asked[rows]], "right")
        lo, hi = np.maximum(lo - 1, 0), np.minimum(hi + 1, len(self.keys))  # with the neighbours on both sides
        count = hi - lo
        which = np.repeat(np.arange(len(rows)), count)
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        b = self.suffixes[place]
        size = self.common(t.position[rows][which], b)
        order = np.lexsort((b, -size, which))
        pick = order[group_starts(which[order])]
        pick = pick[size[pick] > 0]
        return rows[which[pick]], size[pick], self.word_of[b[pick]]


_HELD: dict[str, Tests] = {}


def _built(block) -> Tests:
    """The arrays of a broadcast block; a worker keeps those of the last one."""
    name, items, width = block.value
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = Tests(items, width)
    return _HELD[name]


def blocks(tests: DataFrame, id_col: str, text_col: str, width: int) -> list:
    """Broadcast blocks of the tests' texts; the driver reads them row by row and holds one block."""
    sc = tests.sparkSession.sparkContext
    made, held, size = [], [], 0
    rows = tests.select(F.col(f"`{id_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").alias("t")).where("t <> ''")
    for i, t in rows.toLocalIterator(prefetchPartitions=True):
        n = len(t.encode())
        if held and size + n > BLOCK_BYTES:
            made.append(sc.broadcast((uuid.uuid4().hex, held, width)))
            held, size = [], 0
        held.append((i, t))
        size += n
    if held or not made:
        made.append(sc.broadcast((uuid.uuid4().hex, held, width)))
    return made


def _chunks(batches: Iterator[pa.RecordBatch], at: int, size: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in groups of at least ``size`` bytes of text (column ``at``)."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.column(at).nbytes
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def _slices(texts: Texts):
    """Per slice of texts: its first and last text, its hashed words and their bounds."""
    for a, b in texts.slices():
        words = Words(texts.part(a, b).lower(), NON_ALNUM)
        yield a, b, words.hashes(), words.bounds


_RANGES = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
_OUTPUTS = T.StructType([T.StructField("n_words", T.LongType(), False), T.StructField("hits", _RANGES), T.StructField("n_hit", T.LongType(), False), T.StructField("longest", T.LongType(), False), T.StructField("items", T.ArrayType(T.StringType()))])


class Found:
    """What the blocks have found in a batch of texts."""

    def __init__(self, n: int):
        self.n_words, self.longest = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.ranges: dict[int, list] = {}
        self.items: dict[int, set] = {}

    def add(self, first: int, shard: Shard) -> None:
        t, bounds = shard.tests, shard.bounds
        n = len(bounds) - 1
        self.n_words[first : first + n] = np.diff(bounds)
        near = shard.nearest()
        if len(near):
            best = np.zeros(n, np.int64)
            np.maximum.at(best, shard.doc[shard.word_of[shard.suffixes]], np.where((near > 1) | np.isin(shard.seq[shard.suffixes], t.alone), near, 0))
            self.longest[first : first + n] = np.maximum(self.longest[first : first + n], best)
        window, begin = shard.hits()
        if not len(window):
            return
        for d, w in np.unique(np.stack([shard.doc[begin], window]), axis=1).T.tolist():
            own = self.items.setdefault(first + d, set())
            own.update(t.names[i] for i in t.owners[t.owner_bounds[w] : t.owner_bounds[w + 1]].tolist())
        edge = np.zeros(len(shard.doc) + 1, np.int64)
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + t.span[window], -1)
        hit = np.cumsum(edge[:-1]) > 0
        new = np.ones(len(hit), bool)
        new[1:] = shard.doc[1:] != shard.doc[:-1]
        start = np.flatnonzero(hit & (new | ~np.concatenate(([False], hit[:-1]))))
        stop = np.flatnonzero(hit & (np.concatenate((new[1:], [True])) | ~np.concatenate((hit[1:], [False])))) + 1
        for d, x, y in zip(shard.doc[start].tolist(), start.tolist(), stop.tolist(), strict=True):
            o = int(bounds[d])
            self.ranges.setdefault(first + d, []).append((x - o, y - o))

    def columns(self) -> list[pa.Array]:
        n = len(self.n_words)
        n_hit = np.zeros(n, np.int64)
        hits: list[list] = [[] for _ in range(n)]
        for d, own in self.ranges.items():
            merged: list[list[int]] = []
            for x, y in sorted(own):  # those of several blocks may overlap
                if merged and x <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], y)
                else:
                    merged.append([x, y])
            hits[d] = [{"a": x, "b": y} for x, y in merged]
            n_hit[d] = sum(y - x for x, y in merged)
            self.longest[d] = max(self.longest[d], max(y - x for x, y in merged))
        items = [sorted(self.items.get(d, set()) - {None}) for d in range(n)]
        return [pa.array(self.n_words), pa.array(hits, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(n_hit), pa.array(self.longest), pa.array(items, pa.list_(pa.string()))]


def scan(docs: DataFrame, tests: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, percent: int = 5) -> DataFrame:
    """docs with n_words, hits (ranges of hit words), n_hit, longest, items (ids as strings, sorted) and contaminated.

    ``longest`` is the longest stretch of words that stands in the tests: the
    longest range of hit words, or the most words, up to ``width``, that a test
    suffix shares with the document, if those are more (0 below two words).  A
    document is contaminated if it has hits and at least ``percent`` of its words
    are hit.
    """
    tune(docs.sparkSession)
    own = [*_OUTPUTS.names, "contaminated"]
    if text_col.lower() in own:
        raise ValueError(f"{text_col} is both the text and an output")
    held = blocks(tests, item_id_col, item_text_col, width)
    out = without(docs, own)
    at = out.columns.index(text_col)
    schema = T.StructType([*out.schema.fields, *_OUTPUTS.fields])

    def run(batches):
        for chunk in _chunks(batches, at, CHUNK_BYTES if len(held) > 1 else 1):
            texts = [Texts.of(b.column(at)) for b in chunk]
            found = [Found(len(x)) for x in texts]
            cut = ([(f, *s) for f, x in zip(found, texts, strict=True) for s in _slices(x)]) if len(held) > 1 else ((f, *s) for f, x in zip(found, texts, strict=True) for s in _slices(x))
            for block in held:
                t = _built(block)
                for f, a, _, h, bounds in cut:
                    f.add(a, Shard(h, bounds, t))
            for b, f in zip(chunk, found, strict=True):
                yield pa.RecordBatch.from_arrays([*b.columns, *f.columns()], names=schema.names)

    out = out.mapInArrow(run, schema)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(100) * F.col("n_hit") >= F.lit(percent) * F.col("n_words")))


def decontaminate(docs: DataFrame, tests: DataFrame, percent: int = 0, **options) -> DataFrame:
    """The documents that no test touches, with the columns they came with.

    Affected is a document with any occurrence of a window, however long it is;
    with ``percent`` only one of whose words at least that share is hit.
    """
    names = docs.columns
    text_col = options.pop("text_col", "text")
    held = docs.select(*[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(names)])
    marked = scan(held, tests, text_col=f"own_{names.index(text_col)}", percent=percent, **options)
    return marked.where(~F.col("contaminated")).select([F.col(f"own_{i}").alias(c) for i, c in enumerate(names)])


def longest_matches(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Per test suffix that shares two words (or a whole one-word test) with a document: its longest verbatim match.

    Rows: item_id, item_word (place of the suffix), n_words of the match, and one
    location: the smallest document id that has it, with the word it begins at.
    Documents with a null id are left out, as they could not be told.
    """
    tune(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("doc_id is not null")
    schema = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("doc_id", kind), T.StructField("doc_word", T.LongType())])
    held = blocks(tests, item_id_col, item_text_col, width)

    def run(batches):
        for chunk in _chunks(batches, 1, CHUNK_BYTES if len(held) > 1 else 1):
            for block in held:
                t = _built(block)
                for batch in chunk:
                    for a, _, h, bounds in _slices(Texts.of(batch.column(1))):
                        shard = Shard(h, bounds, t)
                        s, size, first = shard.longest()
                        keep = (size > 1) | np.isin(t.seq[t.position[s]], t.alone)
                        s, size, first = s[keep], size[keep], first[keep]
                        doc = shard.doc[first]
                        yield pa.RecordBatch.from_arrays([pa.array([t.names[i] for i in t.item[s]], pa.string()), pa.array(t.place[s]), pa.array(size), batch.column(0).take(pa.array(doc + a)), pa.array(first - shard.bounds[doc])], names=schema.names)

    found = src.mapInArrow(run, schema)
    first = F.min(F.struct((-F.col("n_words")).alias("n"), "doc_id", "doc_word")).alias("m")
    return found.groupBy("item_id", "item_word").agg(first).select("item_id", "item_word", (-F.col("m.n")).alias("n_words"), "m.doc_id", "m.doc_word")
