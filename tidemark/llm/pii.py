"""Personal data: fixed patterns, and a linear-chain conditional random field that adds to them.

Base spans are the leftmost non-overlapping matches of four patterns, checked
(address parts, checksum, number of digits) after matching.  The field labels
the words near digits and ``@`` signs by their shapes and neighbours, and finds
forms that the patterns miss: national phone numbers, social security numbers
and bank accounts.  It is trained from a small labelled table on the driver and
decoded by Viterbi in numpy, all segments of a batch at once.  Its spans never
touch base spans, which always stay.

Words are taken apart at signs that stand between a name and its value
(``iban:DE..``, ``phone=..``), and words of more than ``LONG`` bytes at all signs that
no number has; every piece is read whole.  Words without a digit can have no
label but "other".  So segments may be cut where two or more of them stand between
others: decoding the rest could not add a span.

Spans are code point ranges, end exclusive.  Null and empty texts have none, very
long ones are searched whole, repeated rows are rows like others, an empty table
gives none.  Columns named like an output are replaced.
"""

from __future__ import annotations

import functools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.textcore import SPACE, Texts, Words, _table, attach

#: Kinds in the order of reports: those of the base patterns first.
KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE = KINDS[:4]

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match fails or succeeds alike from any digit of a run, so only runs' starts are tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = []
    # E-mail: the local part of an @ is the run of its characters before it, back to the last match.
    last, sign = 0, text.find("@")
    while sign >= 0:
        before = text[last:sign]
        local = len(before) - len(before.rstrip(_LOCAL))
        m = _DOMAIN.match(text, sign + 1) if local else None
        last = sign + 1
        if m:
            out.append(("email", sign - local, m.end()))
            last = m.end()
        sign = text.find("@", last)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


# -- the field -----------------------------------------------------------------

LABELS = ["other", "phone", "iban", "ssn"]
SLOTS = 1 << 13
#: Words of more bytes are read in pieces.
LONG = 64

_RUNS = re.compile(r"[0-9]+|[A-Z]+|[a-z]+|[^\x00-\x7f]+|(.)\1*", re.S)
_TRIGGERS = {"tel", "phone", "call", "mobile", "fax", "ssn", "social", "security", "iban", "account", "konto", "number", "no", "nr", "contact"}


def core(word: str) -> tuple[int, int]:
    """The word without punctuation around it."""
    a, b = 0, len(word)
    while a < b and not (word[a].isalnum() or word[a] in "(+@"):
        a += 1
    while b > a and not (word[b - 1].isalnum() or word[b - 1] in ")@"):
        b -= 1
    return a, b


def shape(word: str) -> str:
    """Digits with their number (to 6), runs of letters as X or x, other signs as they are."""
    out = []
    for m in _RUNS.finditer(word):
        s, c = m.group(), m.group()[0]
        out.append(f"d{min(len(s), 6)}" if "0" <= c <= "9" else "X" if "A" <= c <= "Z" else "x" if "a" <= c <= "z" or c > "\x7f" else c)
    return "".join(out)


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % SLOTS


_NO_DIGIT = SLOTS  # a slot of its own for words without a digit


@functools.lru_cache(maxsize=200_000)
def _own(word: str) -> tuple[str, str, int]:
    a, b = core(word)
    s = shape(word[a:b])
    digits = sum("0" <= c <= "9" for c in word)
    low = word[a:b].lower()
    return s, low if low in _TRIGGERS else "", min(digits, 12)


def word_features(words: list[str]) -> list[list[int]]:
    """Feature slots of each word of a segment; those of long words are not kept in memory."""
    own = [_own(w) if len(w) <= LONG else _own.__wrapped__(w) for w in words]
    none = ("<>", "", 0)
    out = []
    for i, (s, t, d) in enumerate(own):
        b, a = own[i - 1] if i else none, own[i + 1] if i + 1 < len(own) else none
        bb = own[i - 2] if i > 1 else none
        out.append([_NO_DIGIT if not d else _slot("d" + str(d)), *(_slot(x) for x in ("1", "s" + s, "b" + b[0], "a" + a[0], "bs" + b[0] + "|" + s, "sa" + s + "|" + a[0], "t" + t, "bt" + (b[1] or bb[1]), "bts" + (b[1] or bb[1]) + "|" + s, "at" + a[1], "ats" + a[1] + "|" + s))])
    return out


def labelled_table(rows: int = 700, seed: int = 5) -> list[tuple[list[str], list[str]]]:
    """Small made-up table of segments, words with labels: invented numbers among words and harmless figures."""
    r = random.Random(seed)
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(["er", "th", "an", "on", "re", "the", "of", "ich", "eau", "que", "ción"]) for _ in range(r.randint(1, 4)))
    end = lambda: r.choice(["", "", "", ".", ",", "!!", "###", "***", "&&&", "$$$", "%%%", " |"]).strip()
    upper = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(k))
    phones = [lambda: [f"({n(3)})", f"{n(3)}-{n(4)}"], lambda: [f"{n(3)}-{n(3)}-{n(4)}"], lambda: [f"({n(3)}){n(3)}-{n(4)}"], lambda: [f"1-{n(3)}-{n(3)}-{n(4)}"]]
    after = [lambda: "tel", lambda: "Tel.", lambda: "(mobile)", lambda: "phone", lambda: "fax"]
    told = [lambda: [f"0{n(3)}", n(6)], lambda: [f"0{n(3)}", n(7)], lambda: [f"0{n(2)}", n(3), n(4)], lambda: [f"0{n(2)}/{n(7)}"], lambda: [f"{n(3)}.{n(3)}.{n(4)}"], lambda: [n(10)]]
    plain = [lambda: n(4), lambda: n(2), lambda: n(1), lambda: f"{n(1)}.{n(1)}.{n(1)}", lambda: f"{n(1)}.{n(2)}", lambda: f"20{n(2)}-{n(2)}-{n(2)}", lambda: f"{n(2)}/{n(2)}/20{n(2)}", lambda: f"{n(2)}:{n(2)}", lambda: f"{n(3)},{n(3)}", lambda: "%032x" % r.getrandbits(128), lambda: "%010x" % r.getrandbits(40), lambda: upper(2) + n(3), lambda: f"{n(3)}-{n(2)}", lambda: f"v{n(1)}", lambda: n(10), lambda: n(16), lambda: f"{n(4)}-{n(4)}", lambda: f"id={n(6)}", lambda: f"{word()}.{n(2)}@mail{n(1)}.example.com", lambda: f"{n(3)}.{n(2)}.{n(3)}.{n(2)}", lambda: "$" + n(3), lambda: n(3) + "%", lambda: f"({n(4)})", lambda: f"[{n(2)}]", lambda: f"+{n(2)}", lambda: f"{n(4)}.{n(4)}", lambda: upper(3) + "-" + n(4), lambda: word() + n(r.randint(1, 6)), lambda: word() + "_" + n(r.randint(1, 4)), lambda: word() + "-" + n(2)]
    out = []
    for _ in range(rows):
        words, labels = [], []

        def add(own, label, words=words, labels=labels):
            words.extend(own)
            labels.extend([label] * len(own))

        def add_named(names, value, label, words=words, labels=labels):
            """A name and its value in one word, which texts are read in two pieces of."""
            words.extend([r.choice(names), value])
            labels.extend(["other", label])

        add([word() for _ in range(r.randint(0, 2))], "other")
        for _ in range(r.randint(1, 2)):
            kind = r.random()
            if kind < 0.16:
                add(r.choice(phones)(), "phone")
            elif kind < 0.2:
                add(r.choice(phones + told)(), "phone")
                add([r.choice(after)()], "other")
            elif kind < 0.22:
                add_named(["phone", "tel", "Tel", "mobile", "fax"], "".join(r.choice(phones)()), "phone")
            elif kind < 0.24:
                add_named(["iban", "IBAN", "account"], f"{upper(2)}{n(r.choice([18, 20, 22]))}", "iban")
            elif kind < 0.26:
                add_named(["ssn", "SSN"], f"{n(3)}-{n(2)}-{n(4)}", "ssn")
            elif kind < 0.3:
                add([r.choice(["tel", "Tel.:", "phone", "call", "mobile", "fax", "Phone:"])], "other")
                add(r.choice(phones + told)(), "phone")
            elif kind < 0.38:
                add([r.choice(["ssn", "SSN:", "social", "security", word()])], "other")
                add([f"{n(3)}-{n(2)}-{n(4)}"], "ssn")
            elif kind < 0.46:
                add([r.choice(["iban", "IBAN:", "account", "konto", word()])], "other")
                add([f"{upper(2)}{n(2)}", *[n(4) for _ in range(r.randint(4, 5))], n(2)] if r.random() < 0.5 else [f"{upper(2)}{n(r.choice([18, 20, 22]))}"], "iban")
            else:
                for _ in range(r.choice([1, 1, 2, 3, 6])):
                    add([r.choice(plain)()], "other")
            if words:
                words[-1] += end()
            add([word() for _ in range(r.randint(1, 3))], "other")
        out.append(_cut(words, labels))
    return out


def _cut(words: list[str], labels: list[str]) -> tuple[list[str], list[str]]:
    """Labelled words in the pieces that texts are read in."""
    pieces = [[m.decode() for m in _VALUE.findall(w.encode())] if any("0" <= c <= "9" for c in w) else [] for w in words]
    pieces = [p or [w] for p, w in zip(pieces, words, strict=True)]
    return [x for p in pieces for x in p], [y for p, y in zip(pieces, labels, strict=True) for _ in p]


class Field:
    """Weights of a linear-chain conditional random field: (slot, label) and (label, label)."""

    def __init__(self, emission: np.ndarray, transition: np.ndarray):
        self.emission, self.transition = emission, transition

    def scores(self, segments: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """Padded scores (segment, word, label) and lengths."""
        size = np.array([len(s) for s in segments])
        out = np.zeros((len(segments), size.max(initial=1), self.emission.shape[1]))
        flat = np.array([f for s in segments for f in s])
        if len(flat):
            row = np.repeat(np.arange(len(segments)), size)
            col = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            out[row, col] = self.emission[flat].sum(1)
            plain = (flat == _NO_DIGIT).any(1)
            out[row[plain], col[plain], 1:] = -1e6
        return out, size

    def viterbi(self, segments: list[list[list[int]]]) -> list[np.ndarray]:
        """Best labels of each segment."""
        e, size = self.scores(segments)
        n, most, k = e.shape
        best, back = e[:, 0].copy(), np.zeros((n, most, k), np.int8)
        for i in range(1, most):
            step = best[:, :, None] + self.transition[None]
            back[:, i] = step.argmax(1)
            new = step.max(1) + e[:, i]
            live = (i < size)[:, None]
            best = np.where(live, new, best)
        label = best.argmax(1)
        out = np.zeros((n, most), np.int8)
        for i in range(most - 1, -1, -1):
            live = i < size
            out[live, i] = label[live]
            if i:
                label = np.where(live, back[np.arange(n), i, label], label)
        return [o[:s] for o, s in zip(out, size, strict=True)]


def _logsum(x, axis):
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def train(table: list[tuple[list[str], list[str]]], labels: list[str] = LABELS, steps: int = 120, rate: float = 0.1, decay: float = 0.02) -> Field:
    """Maximum likelihood by Adam, with forward-backward over all segments at once."""
    segments = [word_features(w) for w, _ in table]
    k = len(labels)
    field = Field(np.zeros((SLOTS + 1, k)), np.zeros((k, k)))
    size = np.array([len(s) for s in segments])
    most = size.max(initial=1)
    flat = np.array([f for s in segments for f in s])
    row = np.repeat(np.arange(len(segments)), size)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    gold = np.array([labels.index(x) for _, y in table for x in y])
    inside = np.arange(most)[None] < size[:, None]
    want_e = np.zeros_like(field.emission)
    np.add.at(want_e, (flat, gold[:, None]), 1)
    want_t = np.zeros((k, k))
    same = row[1:] == row[:-1]
    np.add.at(want_t, (gold[:-1][same], gold[1:][same]), 1)
    params, m, v = [field.emission, field.transition], [0, 0], [0, 0]
    for step in range(1, steps + 1):
        e, _ = field.scores(segments)
        f, b = np.zeros_like(e), np.zeros_like(e)
        f[:, 0] = e[:, 0]
        for i in range(1, most):
            f[:, i] = np.where(inside[:, i, None], _logsum(f[:, i - 1, :, None] + field.transition[None], 1) + e[:, i], f[:, i - 1])
        z = _logsum(f[:, -1], 1)
        for i in range(most - 2, -1, -1):
            b[:, i] = np.where(inside[:, i + 1, None], _logsum(field.transition[None] + (e[:, i + 1] + b[:, i + 1])[:, None], 2), 0)
        p = np.exp(f + b - z[:, None, None])[row, col]
        got_e = np.zeros_like(want_e)
        for j in range(k):
            got_e[:, j] = np.bincount(flat.ravel(), np.repeat(p[:, j], flat.shape[1]), minlength=SLOTS + 1)
        pair = np.exp(f[:, :-1, :, None] + field.transition[None, None] + (e[:, 1:] + b[:, 1:])[:, :, None] - z[:, None, None, None])
        got_t = (pair * inside[:, 1:, None, None]).sum((0, 1))
        for i, g in enumerate((want_e - got_e - decay * field.emission, want_t - got_t - decay * field.transition)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            params[i] += rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return field


@functools.lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled_table())


_ACTIVE = _table(b"0123456789@")


_PIECE = re.compile(rb"[0-9A-Za-z@().+-]+|[\x80-\xff]+")
_VALUE = re.compile(rb"[^:=;,<>|\"']+")
_PARTS = _table(b":=;,<>|\"'")


def _pieces(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words and the bounds of each text's own; words with digits are cut between names and values, long ones at signs that no number has, and where other scripts begin or end."""
    starts, ends = words.starts, words.ends
    n = np.ones(len(starts), np.int64)
    cut = {}
    some = np.unique(np.searchsorted(starts, np.flatnonzero(_PARTS[words.buf]), side="right") - 1)
    digits = np.concatenate(([0], np.cumsum(_ACTIVE[words.buf])))
    some = some[digits[ends[some]] > digits[starts[some]]]
    for i in np.union1d(some, np.flatnonzero(ends - starts > LONG)).tolist():
        pattern = _PIECE if ends[i] - starts[i] > LONG else _VALUE
        cut[i] = np.array([m.span() for m in pattern.finditer(words.buf[starts[i] : ends[i]].tobytes())] or [(0, ends[i] - starts[i])]) + starts[i]
        n[i] = len(cut[i])
    before = np.concatenate(([0], np.cumsum(n)))
    a, b = np.repeat(starts, n), np.repeat(ends, n)
    for i, own in cut.items():
        a[before[i] : before[i + 1]], b[before[i] : before[i + 1]] = own[:, 0], own[:, 1]
    return a, b, before[words.bounds]


def _active(texts: Texts, starts: np.ndarray) -> np.ndarray:
    """Words with a digit or @."""
    at = np.flatnonzero(_ACTIVE[texts.buf])
    return np.unique(np.searchsorted(starts, at, side="right") - 1)


def find(texts: Texts, field: Field) -> list[list[tuple[str, int, int]]]:
    """All spans of each text of a slice."""
    out: list[list] = [[] for _ in range(len(texts))]
    signs = np.concatenate(([0], np.cumsum(_ACTIVE[texts.buf] | (texts.buf == 43))))
    some = np.flatnonzero(signs[texts.offs[1:]] > signs[texts.offs[:-1]])
    for i in some.tolist():
        out[i] = base_spans(texts.bytes(i).decode())
    words = Words(texts, SPACE)
    starts, ends, bounds = _pieces(words)
    active = _active(texts, starts)
    if not len(active):
        return out
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    new = np.concatenate(([True], (doc[active[1:]] != doc[active[:-1]]) | (active[1:] - active[:-1] > 2)))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(active)) - 1
    a = np.maximum(active[first] - 2, bounds[doc[active[first]]])
    b = np.minimum(active[last] + 3, bounds[doc[active[first]] + 1])
    points = np.concatenate(([0], np.cumsum((texts.buf & 0xC0) != 0x80)))
    segments = [[words.buf[s:e].tobytes().decode() for s, e in zip(starts[x:y].tolist(), ends[x:y].tolist(), strict=True)] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    size = np.array([len(s) for s in segments])
    order = np.argsort(size, kind="stable")  # segments of like length share a batch
    k = 0
    while k < len(order):  # as many as fit into so many padded words, one at least
        most = size[order[k : k + 512]]
        n = max(1, int((most * np.arange(1, len(most) + 1) <= 50_000).sum()))
        batch, k = order[k : k + n], k + n
        for s, labels in zip(batch.tolist(), field.viterbi([word_features(segments[s]) for s in batch.tolist()]), strict=True):
            if not labels.any():
                continue
            i = int(doc[a[s]])
            for label, x, y in _runs(labels):
                head, tail = core(segments[s][x])[0], core(segments[s][y - 1])[1]
                lo, hi = starts[a[s] + x], starts[a[s] + y - 1]
                start = int(points[lo] - points[texts.offs[i]]) + head
                stop = int(points[hi] - points[texts.offs[i]]) + tail
                if stop > start and not any(start < e and stop > b for _, b, e in out[i]):
                    out[i].append((LABELS[label], start, stop))
    for i in some.tolist():
        out[i].sort(key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return out


def _runs(labels: np.ndarray):
    """(label, first, end) of runs of equal labels other than 0."""
    edge = np.flatnonzero(np.diff(labels, prepend=0, append=0) != 0)
    for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if labels[x]:
            yield int(labels[x]), x, y


_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def spans(df: DataFrame, text_col: str = "text", field: Field | None = None, masked_col: str | None = None) -> DataFrame:
    """df with base_spans and spans (all of them), by kind and start; on request the text with ``[KIND]`` in their place."""
    field = field or default_field()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    outputs = T.StructType([T.StructField("base_spans", _SPAN), T.StructField("spans", _SPAN)])
    if masked_col:
        outputs.add(masked_col, T.StringType())

    def work(batch, texts):
        found = [s for a, b in texts.slices() for s in find(texts.part(a, b), field)]
        base = [[s for s in base_spans(texts.bytes(i).decode())] if own else [] for i, own in enumerate(found)]
        rows = lambda each: pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in own] for own in each], kind)
        made = [rows(base), rows(found)]
        if masked_col:
            null = batch.column(batch.schema.get_field_index(text_col)).is_null().to_pylist()
            made.append(pa.array([None if null[i] else masked(texts.bytes(i).decode(), own) for i, own in enumerate(found)], pa.string()))
        return made

    return attach(df, text_col, outputs, work)


def masked(text: str, own: list[tuple[str, int, int]]) -> str:
    """Spans replaced by their kind; of overlapping ones the union, by the kind of the first."""
    out, at = [], 0
    for kind, a, b in sorted(own, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def listed(column: str):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def number_of(column: str, kind: str):
    return F.size(F.filter(column, lambda s: s["kind"] == kind)).cast("long")
