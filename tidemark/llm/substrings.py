"""Exact substring deduplication by fixed-block anchors.

A passage of ``window`` words that occurs twice is found through anchors.  Every
text is cut into non-overlapping reference blocks of ``(window + 1) // 2``
words; those are the index.  Every rolling window of the block's length, at any
word, probes it.  Since each window of ``window`` words holds a whole block, two
equal passages always meet: the block within the one is found by the probe at
the same place of the other.  A block that some other place also has is a hit.

Hits are extended to maximal exact repeats: the windows around a hit block are
looked up one word further each time, and runs of windows that each start
somewhere else too make up the repeat.  Extension is by counting equal windows,
so a passage with many copies costs one entry per bucket of documents and no
pairs.

Both rounds go through ``exchange``.  Block probes use 32-bit fingerprints
within parts, whose number follows the input: a false hit only adds candidates.
Windows are counted by 64-bit hashes within parts; of n candidate windows about
n**2 / 2**64 pairs collide.

Words are runs of characters other than space and ``\\x09-\\x0D``, unchanged.  All
places of a repeat lose their words, the first included.  Null texts have no
words.  Repeated rows are documents like others, so their passages repeat.
Columns named like an output are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.exchange import Exchange, joined, member, pack_bits, part_of, ranges
from tidemark.llm.textcore import SPACE, Texts, Words, group_starts, pack_sorted, unpack_sorted, windows, without

BLOCKS, WINDOWS = 0, 1
_LOW = np.uint64(0xFFFFFFFF)


class Bucket:
    """The windows of one bucket of documents."""

    def __init__(self, column, window: int, parts: int):
        self.texts, self.window, self.parts = Texts.of(column), window, parts
        self.block = (window + 1) // 2
        self.slices = list(self.texts.slices())

    def words(self):
        for a, b in self.slices:
            w = Words(self.texts.part(a, b), SPACE)
            yield a, b, w, w.hashes()

    def _probes(self, w: Words, h: np.ndarray):
        at, x = windows(h, w.bounds, self.block)
        begin = np.repeat(w.bounds[:-1], w.counts)
        aligned = (at - begin[at]) % self.block == 0
        return at, (part_of(x, self.parts) << np.uint64(32)) | (x & _LOW), aligned

    def anchors(self):
        """Distinct block-length windows in ascending order: key, is a block somewhere, is there twice."""
        made = []
        for _, _, w, h in self.words():
            _, key, aligned = self._probes(w, h)
            made.append((key << np.uint64(1)) | aligned.astype(np.uint64))
        key = np.concatenate(made) if made else np.zeros(0, np.uint64)
        key.sort()
        base = key >> np.uint64(1)
        first = group_starts(base)
        last = np.append(first[1:], len(base)) - 1 if len(base) else first
        return base[first], (key[last] & np.uint64(1)).astype(bool), last > first

    def ask_blocks(self):
        key, aligned, twice = self.anchors()
        for p, a, b in ranges(key >> np.uint64(32), self.parts):
            yield p, pack_sorted(key[a:b] & _LOW), np.packbits(aligned[a:b]).tobytes() + np.packbits(twice[a:b]).tobytes()

    def candidates(self, hit: np.ndarray):
        """Per slice: range, words, starts and hashes of the windows around hit blocks."""
        key, aligned, _ = self.anchors()
        hits = key[aligned][hit]
        for a, b, w, h in self.words():
            at, key, aligned = self._probes(w, h)
            found = np.zeros(len(h) + 1, bool)
            found[at[aligned][member(key[aligned], hits)]] = True
            start, x = windows(h, w.bounds, self.window)
            begin = np.repeat(w.bounds[:-1], w.counts)[start]
            block = begin + (start - begin + self.block - 1) // self.block * self.block
            near = found[block]
            yield a, b, w, start[near], x[near]

    def ask_windows(self, hit: np.ndarray):
        x = np.concatenate([np.zeros(0, np.uint64), *(c[4] for c in self.candidates(hit))])
        key, n = np.unique(x, return_counts=True)
        for p, a, b in ranges(part_of(key, self.parts), self.parts):
            yield p, pack_sorted(key[a:b]), np.packbits(n[a:b] > 1).tobytes()


def _flags(b: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool)


def _decide(kind: int, part: int, keys: list[bytes], notes: list[bytes]) -> list[bytes]:
    own = [unpack_sorted(k) for k in keys]
    if kind == WINDOWS:
        x = np.concatenate([*own, *(k[_flags(n, len(k))] for k, n in zip(own, notes, strict=True))])
        x.sort()
        found = np.unique(x[1:][x[1:] == x[:-1]])
        return [pack_bits(member(k, found)) for k in own]
    half = [-(-len(k) // 8) for k in own]
    aligned = [_flags(n[:m], len(k)) for k, n, m in zip(own, notes, half, strict=True)]
    twice = [_flags(n[m:], len(k)) for k, n, m in zip(own, notes, half, strict=True)]
    x = np.concatenate([(k << np.uint64(2)) | (a.astype(np.uint64) << np.uint64(1)) | t for k, a, t in zip(own, aligned, twice, strict=True)])
    x.sort()
    base = x >> np.uint64(2)
    first = group_starts(base)
    flags = np.bitwise_or.reduceat(x & np.uint64(3), first)
    size = np.diff(np.append(first, len(base)))
    found = base[first][((flags & np.uint64(2)) > 0) & ((size > 1) | ((flags & np.uint64(1)) > 0))]
    return [pack_bits(member(k[a], found)) for k, a in zip(own, aligned, strict=True)]


def drop_repeats(df: DataFrame, text_col: str = "text", window: int = 35, out_col: str = "kept_text") -> DataFrame:
    """df with n_words, n_removed and ``out_col``: the words outside repeats of ``window`` words, joined by one space."""
    df = without(df, ["n_words", "n_removed", out_col])
    x = Exchange(df, text_col)
    parts, text, own_bucket = x.parts, x.text, x.key

    def ask_blocks(t):
        bucket = t.column(own_bucket)[0].as_py()
        for p, keys, notes in Bucket(t.column(text), window, parts).ask_blocks():
            yield BLOCKS, p, bucket, keys, notes

    def ask_windows(t, told):
        if not t.num_rows:
            return
        bucket = t.column(own_bucket)[0].as_py()
        for p, keys, notes in Bucket(t.column(text), window, parts).ask_windows(joined(told.get(BLOCKS, []))):
            yield WINDOWS, p, bucket, keys, notes

    def finish(t, told):
        b = Bucket(t.column(text), window, parts)
        found = list(b.candidates(joined(told.get(BLOCKS, [])))) if t.num_rows else []
        key = np.unique(np.concatenate([np.zeros(0, np.uint64), *(c[4] for c in found)]))
        repeats = key[joined(told.get(WINDOWS, []))] if len(key) else key
        n_words, n_removed, kept = [], [], []
        for a, e, w, start, h in found:
            edge = np.zeros(len(w) + 1, np.int64)
            s = start[member(h, repeats)]
            np.add.at(edge, s, 1)
            np.add.at(edge, s + window, -1)
            gone = np.cumsum(edge[:-1]) > 0
            lost = np.concatenate(([0], np.cumsum(gone)))
            lost = lost[w.bounds[1:]] - lost[w.bounds[:-1]]
            n_words.append(w.counts)
            n_removed.append(lost)
            for i in range(a, e):
                own = b.texts.bytes(i).split()
                if lost[i - a]:
                    out = gone[w.bounds[i - a] : w.bounds[i - a + 1]]
                    own = [own[j] for j in np.flatnonzero(~out).tolist()]
                kept.append(b" ".join(own))
        cat = lambda c: pa.array(np.concatenate([np.zeros(0, np.int64), *c]), pa.int64())
        made = [cat(n_words), cat(n_removed), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.Table.from_arrays([*t.drop_columns([own_bucket]).columns, *made], names=names)

    schema = T.StructType([*df.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField(out_col, T.StringType())])
    names = schema.names
    blocks = x.answer(x.ask(ask_blocks), _decide)
    repeats = x.answer(x.ask(ask_windows, blocks), _decide)
    return x.finish(x.deal(blocks.unionByName(repeats)), finish, schema)
