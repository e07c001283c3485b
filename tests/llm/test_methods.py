"""Each operator against brute force, an exact round trip or held-out accuracy."""

import collections
import gzip
import hashlib
import io
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from tidemark.llm import bpe, decontam, graph, minhash, pii, ppm, pu, queries, rules, secret_scan, substrings, warc
from tidemark.llm.textcore import NON_ALNUM, SPACE, Texts, Words, pack_counts, pack_sorted, unpack_counts, unpack_sorted, windows


@pytest.fixture(scope="module")
def docs(spark, data):
    return dict(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect())


def lower(b: bytes) -> bytes:
    return b.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))


# -- shared parts


@pytest.mark.parametrize("table,pattern", [(SPACE, r"[^\x20\x09-\x0D]+"), (NON_ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words_are_the_pattern(table, pattern):
    r = random.Random(1)
    texts = ["".join(r.choice(["a", "b1", "é", "😀", " ", "\n", "\t", ".", "\x1c", " ", "_", ""]) for _ in range(r.randint(0, 30))) for _ in range(400)]
    w = Words(Texts.of(pa.array(texts)), table)
    want = [[x.encode() for x in re.findall(pattern, t)] for t in texts]
    got = [[w.buf[s:e].tobytes() for s, e in zip(w.starts[a:b], w.ends[a:b], strict=True)] for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
    assert got == want
    flat = [x for t in want for x in t]
    h = w.hashes().tolist()
    assert len({*zip(flat, h, strict=True)}) == len(set(flat)) == len(set(h))
    at, x = windows(w.hashes(), w.bounds, 3)
    runs = [tuple(t[i : i + 3]) for t in want for i in range(len(t) - 2)]
    assert len(at) == len(runs) and len({*zip(runs, x.tolist(), strict=True)}) == len(set(runs)) == len(set(x.tolist()))


def test_sliced_and_null_columns():
    a = pa.array(["x", None, "yz", "", "w"]).slice(1, 3)
    t = Texts.of(a)
    assert [t.bytes(i) for i in range(3)] == [b"", b"yz", b""]
    assert len(Texts.of(pa.array([], pa.string()))) == 0 and len(Texts.of(pa.nulls(2))) == 2
    big = Texts.of(pa.array(["a" * 10, "b" * 500, "c", "d"]))
    assert list(big.slices(most=50)) == [(0, 1), (1, 2), (2, 4)]


def test_packing():
    a = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (unpack_sorted(pack_sorted(a)) == a).all() and len(unpack_sorted(pack_sorted(a[:0]))) == 0
    n = np.array([0, 1, 255, 1 << 31])
    assert unpack_counts(pack_counts(n)).tolist() == n.tolist()


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(30)] + [(r.randint(100, 160), r.randint(100, 160)) for _ in range(40)] + [(500, 500), (None, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {x.v: x.root for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in parent}


def test_components_forget_size_estimates(spark):
    ids = list(range(60))
    random.Random(4).shuffle(ids)
    out = graph.components(spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long"))
    assert {x.v: x.root for x in out.collect()} == dict.fromkeys(ids, 0)
    # a join multiplies the estimates of its sides: over rounds they had many thousand bits
    assert int(str(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())).bit_length() < 500


# -- 1


def test_bpe_is_the_library(docs):
    enc = bpe.codec(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN)
    r = random.Random(3)
    made = ["".join(r.choice(["ab", "a" * 3000, " " * r.randint(1, 5000), "\n\t " * r.randint(1, 1500), "é", "'s", " 12", "\x1c" * 2500, "　" * 2500, "x y " * 2000, "\x85", "<|endoftext|>"]) for _ in range(r.randint(1, 9))) for _ in range(60)]
    for text in [*docs.values(), *made]:
        got = bpe.encode_text(enc, text).tolist()
        assert got == enc.encode_ordinary(text) and enc.decode_bytes(got) == text.encode()


def test_bpe_query(spark, data, docs):
    enc = bpe.codec(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN)
    for row in queries.QUERIES["op1_bpe"](spark, data).collect():
        ids = enc.encode_ordinary(docs[row.doc_id])
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(docs[row.doc_id].encode()).hexdigest()


def test_bpe_decodes_raw_bytes(spark):
    df = spark.createDataFrame([([220, 247],), ([],), (None,), ([10**6],)], "ids array<int>")
    out = [r.decoded for r in bpe.decode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()]
    assert isinstance(out[0], (bytes, bytearray)) and out[1:] == [b"", None, None]


# -- 2


def test_ppm_is_the_trie(spark, data, docs):
    rows = queries.QUERIES["op2_ppm"](spark, data).collect()
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    words = lambda t: [*lower(t.encode()).split(), None]
    count, trie = collections.Counter(), ppm.Trie()
    for i, t in docs.items():
        if not held[i]:
            count.update(words(t))
            for context, symbol in trie.symbols(lower(t.encode())):
                trie.learn(context, symbol)
    n, v = sum(count.values()), len(count)
    assert {r.doc_id for r in rows} == set(docs)
    for r in rows:
        own = words(docs[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(count[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r.score, trie.score(lower(docs[r.doc_id].encode())), rel_tol=1e-11)


def test_ppm_is_a_distribution():
    trie = ppm.Trie(3)
    for t in (b"abracadabra", b"banana", b"abc"):
        for context, symbol in trie.symbols(t):
            trie.learn(context, symbol)
    for context in (b"abr", b"\xfe\xfe\xfe", b"zzz", b"zan"):
        total = sum(10 ** trie.log10(context, s) for s in range(256) if s != ppm.BEFORE)
        assert total == pytest.approx(1)


def test_ppm_adaptive_learns():
    t = ppm.Trie()
    assert t.score(b"abcabcabcabcabcabc" * 5, adapt=True) > 2 * ppm.Trie().score(b"abcabcabc" * 5, adapt=True) * 0.9
    assert ppm.Trie(3).score(b"") == pytest.approx(-math.log10(255))


# -- 3


def test_pu_held_out_accuracy(spark, data):
    out = queries.QUERIES["op3_quality_classifier"](spark, data)
    labels = spark.read.parquet(f"{data}/labels.parquet")
    told = out.join(labels, "doc_id").where("held_out").collect()
    assert out.count() == 200 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in told)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in told)
    right = sum(r.predicted == r.quality for r in told)
    assert right >= 0.9 * len(told) and any(r.predicted == r.quality == 0 for r in told) >= any(r.quality == 0 for r in told)


def test_prior_estimate():
    rng = np.random.default_rng(0)
    for n, slack in ((3000, 0.05), (120, 0.2)):  # unlabelled text of which three quarters are good, and positives apart from it
        text = np.concatenate([rng.normal(0, 1, (n, 4)), rng.normal(4, 1, (n // 3, 4))])
        model, prior = pu.fit_arrays(rng.normal(0, 1, (n // 4, 4)), text, steps=200)
        assert abs(prior - 0.75) < slack
        p = model.probability(text)
        assert (p[:n] > 0.5).mean() > 0.95 and (p[n:] < 0.5).mean() > 0.95


def test_risk_gradient_by_differences():
    rng = np.random.default_rng(1)
    for prior, shift in ((0.4, 0.0), (0.9, -6.0)):  # with the negative part above 0, and below it
        f = rng.normal(0, 1, 30)
        f[12:] += shift
        got = pu.pu_gradient(prior)(f, 12)
        plus, minus = pu.pu_risk(prior, f, 12)
        assert (minus >= 0) == (shift == 0)
        whole = lambda f: sum(pu.pu_risk(prior, f, 12)) if minus >= 0 else -pu.pu_risk(prior, f, 12)[1]  # noqa: B023, E731
        for i in range(30):
            step = np.zeros(30)
            step[i] = 1e-5
            assert math.isclose(got[i], (whole(f + step) - whole(f - step)) / 2e-5, rel_tol=1e-4, abs_tol=1e-8)


# -- 4


def brute_hits(text, items, width=13):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    own = word.findall(lower(text.encode()))
    hit, found = set(), set()
    for name, t in items:
        w = word.findall(lower(t.encode()))
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            for j in range(len(own) - n + 1):
                if own[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(str(name))
    return len(own), len(hit), sorted(found)


def test_decontamination_is_brute_force(spark):
    r = random.Random(4)
    text = lambda n: " ".join(r.choice(["a", "B", "c,", "É"]) for _ in range(n))
    items = [(i, text(r.choice([0, 1, 2, 3, 7, 8]))) for i in range(12)] + [(99, "a b c é a b c é a b c é")]
    rows = [(i, text(r.randint(0, 25))) for i in range(80)] + [(500, "x " + items[-1][1] + " y")]
    out = decontam.scan(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), width=4).collect()
    own = dict(rows)
    for x in out:
        n, hit, found = brute_hits(own[x.doc_id], items, 4)
        assert (x.n_words, x.n_hit, list(x["items"])) == (n, hit, found)
        assert x.contaminated == (hit > 0 and 20 * hit >= n)
        assert x.n_hit == sum(b - a for a, b in x.hits) and x.longest == brute_longest(own[x.doc_id], items, 4, x.hits)


def brute_longest(text, items, width, hits):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t.encode()).decode())
    w, best = split(text), max([b - a for a, b in hits], default=0)
    for t in (split(t) for _, t in items):
        for i in range(len(t)):
            for j in range(len(w)):
                n = 0
                while n < width and i + n < len(t) and j + n < len(w) and t[i + n] == w[j + n]:
                    n += 1
                if n > 1 or n == len(t):
                    best = max(best, n)
    return best


def test_decontamination_many_equal_items(spark, monkeypatch):
    items = [(i, "the") for i in range(300)] + [(300 + i, "one two") for i in range(300)] + [(900, "one two three")]
    docs = [(1, "the " * 2000 + "one two four"), (2, "x"), (3, "three one")]
    made = [spark.createDataFrame(x, f"{n} long, text string") for x, n in ((docs, "doc_id"), (items, "item_id"))]
    want = {1: (2002, 2000, 600), 2: (0, 0, 0), 3: (0, 0, 0)}
    for size in (1 << 20, 50):
        monkeypatch.setattr(decontam, "BLOCK_BYTES", size)
        got = {r.doc_id: (r.n_hit, r.longest, len(r["items"])) for r in decontam.scan(*made).collect()}
        assert {k: (v[0], v[2]) for k, v in got.items()} == {k: (v[0], v[2]) for k, v in want.items()}
        assert got[1][1] == 2002 and got[2][1] == got[3][1] == 0


def test_decontamination_removes_every_affected_document(spark):
    passage = " ".join(f"b{i}" for i in range(20))
    long = " ".join(f"w{i}" for i in range(5000))
    docs = spark.createDataFrame([(1, f"{long} {passage} {long}"), (2, long), (3, passage[:30]), (4, None)], "doc_id long, text string")
    tests = spark.createDataFrame([(7, f"a {passage} c")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontam.decontaminate(docs, tests).collect()) == [2, 3, 4]
    assert sorted(r.doc_id for r in decontam.decontaminate(docs, tests, percent=5).collect()) == [1, 2, 3, 4]


def test_decontamination_blocks(spark, monkeypatch):
    rows = [(i, f"p{i} q r s t") for i in range(30)]
    docs = spark.createDataFrame([(i, f"z p{i} q r s t z") for i in range(40)], "doc_id long, text string")
    tests = spark.createDataFrame(rows, "item_id long, text string")
    one = decontam.scan(docs, tests).collect()
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 100)
    many = decontam.scan(docs, tests).collect()
    assert one == many and sum(x.contaminated for x in many) == 30
    left = decontam.decontaminate(docs, tests)
    assert left.columns == docs.columns and {x.doc_id for x in left.collect()} == set(range(30, 40))


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, "u one two three four v"), (2, "one two three four five six w"), (3, "two three q")], "doc_id long, text string")
    tests = spark.createDataFrame([(7, "zero one two three four five")], "item_id long, text string")
    got = {x.item_word: (x.n_words, x.doc_id, x.doc_word) for x in decontam.longest_matches(docs, tests, width=3).collect()}
    assert got == {1: (5, 2, 0), 2: (4, 2, 1), 3: (3, 2, 2), 4: (2, 2, 3)}


# -- 5


def test_rule_counts(docs):
    texts = [*docs.values(), "a b c a b c", "x\nx\n\n x\nx", "# a <b> é|é", "", "one\n\n\n"]
    t = Texts.of(pa.array(texts))
    got = rules.count(t)
    for i, text in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen = collections.Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        repeat = {k for j in range(len(w) - 2) if seen[tuple(w[j : j + 3])] > 1 for k in (j, j + 1, j + 2)}
        lines, dup = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in lines
                lines.add(line)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeat))
        assert tuple(int(got[c][i]) for c in rules.COUNTS[:5]) == want


def test_rules_query(spark, data, docs):
    out = {r.doc_id: r for r in queries.QUERIES["op5_quality_rules"](spark, data).collect()}
    assert set(out) == set(docs)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed) for r in out.values())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect() if r.doc_id in out}
    fine = [i for i, q in labels.items() if q and not out[i].base_failed]
    junk = [i for i, q in labels.items() if not q]
    assert sum(out[i].kept for i in fine) >= 0.97 * len(fine) and sum(out[i].kept for i in junk) <= 0.5 * len(junk)


def test_forest_isolates():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (500, 3)), np.full((5, 3), 9.0)])
    s = rules.Forest(x[:500], x.min(0), x.max(0)).score(x)
    assert s[500:].min() > np.quantile(s[:500], 0.98) and len(rules.Forest(x[:0], np.zeros(3), np.zeros(3)).score(x)) == 505


# -- 6


def test_warc_splits(tmp_path):
    r = random.Random(6)
    payloads = [bytes(r.getrandbits(8) for _ in range(r.randint(0, 3000))) for _ in range(40)]
    payloads[5] = gzip.compress(b"WARC/1.1 but no record") + warc.MAGIC * 50
    data, starts = b"", []
    for i, p in enumerate(payloads):
        starts.append(len(data))
        data += warc.member(warc.record(str(i), "http://x/y z\r\n", p, None))
    for step in (1, 7, 997, len(data)):
        got = [x for a in range(0, len(data), step) for x in warc.records(io.BytesIO(data), len(data), a, min(a + step, len(data)))] if step > 1 else list(warc.records(io.BytesIO(data), len(data), 0, len(data)))
        assert [o for o, _ in got] == starts and [m["payload"] for _, m in got] == payloads
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 40
    assert [o for o, _ in warc.records(io.BytesIO(data[: starts[3] + 20]), starts[3] + 20, 0, starts[3] + 20)] == starts[:3]


# -- 7

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    fine = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 16 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), "phone": lambda s: 8 <= len(digits(s)) <= 15}
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text) if fine[k](m[0])]


def test_base_spans_are_the_patterns(docs):
    r = random.Random(7)
    made = ["".join(r.choice(["a", "b.", "@", "1", "23", "256", ".", "-", " ", "+", "(", ")", "4111", "1111", "é", "%", "@x.y", "0"]) for _ in range(r.randint(1, 40))) for _ in range(4000)]
    for text in [*docs.values(), *made]:
        assert pii.base_spans(text) == brute_spans(text)
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_field_held_out():
    field = pii.default_field()
    table = pii.labelled_table(300, seed=1234)
    got = field.viterbi([pii.word_features(w) for w, _ in table])
    pairs = [(y, pii.LABELS[p]) for (_, labels), o in zip(table, got, strict=True) for y, p in zip(labels, o.tolist(), strict=True)]
    named = [x for x in pairs if x[0] != "other"]
    assert sum(a == b for a, b in named) >= 0.95 * len(named)
    assert sum(a == b for a, b in pairs) >= 0.98 * len(pairs)


WRITTEN = [  # by hand, not by the generator of the training table: text, what the field should add
    ("Bitte zahlen Sie auf iban:DE44500105175407324931 bis Freitag", ["DE44500105175407324931"]),
    ("reach me under 0171 234567 tel after six", ["0171 234567"]),
    ("Call us: (415) 555-0132 today", ["(415) 555-0132"]),
    ("contact phone=415-555-0132;room=12", ["415-555-0132"]),
    ("his SSN is 078-05-1120 as far as I know", ["078-05-1120"]),
    ("ssn:219-09-9999, born 1950", ["219-09-9999"]),
    ("account GB82WEST12345698765432 is closed", []),
    ("mobile 555-867-5309 or fax (212) 555-0199", ["555-867-5309", "(212) 555-0199"]),
    ("Founded in 1987, it has 12 rooms and 3 halls", []),
    ("the meeting on 2024-03-17 at 10:30 in room 204", []),
    ("version 4.1.2 of 12/05/2021 fixes 117 bugs", []),
    ("It costs $300, or 25% less than 400 before", []),
    ("see order id=884213 and build 20240117", []),
    ("a ratio of 3.1415 and 2.7183 to 1", []),
]


def test_field_on_hand_written_lines():
    found = pii.find(Texts.of(pa.array([t for t, _ in WRITTEN])), pii.default_field())
    got = [[t[a:b] for k, a, b in own if k in ("phone", "iban", "ssn")] for (t, _), own in zip(WRITTEN, found, strict=True)]
    right = sum(g == w for g, (_, w) in zip(got, WRITTEN, strict=True))
    assert right >= 12 and all(not g for g, (_, w) in zip(got, WRITTEN, strict=True) if not w), got


def test_segments_add_what_whole_texts_add(docs):
    """Decoding every word of a text finds no more than the segments around digits."""
    field = pii.default_field()
    texts = [t for t in docs.values() if t][:120] + [t for t, _ in WRITTEN]
    batch = Texts.of(pa.array(texts))
    found = pii.find(batch, field)
    words = Words(batch, SPACE)
    starts, ends, bounds = pii._pieces(words)
    for i, t in enumerate(texts):
        own = [words.buf[s:e].tobytes().decode() for s, e in zip(starts[bounds[i] : bounds[i + 1]], ends[bounds[i] : bounds[i + 1]], strict=True)]
        labels = field.viterbi([pii.word_features(own)])[0] if own else np.zeros(0, np.int8)
        assert all(any("0" <= c <= "9" for c in w) for w, x in zip(own, labels, strict=True) if x)
        whole = []
        for label, x, y in pii._runs(labels):
            a, b = starts[bounds[i] + x], starts[bounds[i] + y - 1]
            head, tail = pii.core(own[x])[0], pii.core(own[y - 1])[1]
            at = lambda byte: len(batch.buf[batch.offs[i] : byte].tobytes().decode())  # noqa: B023, E731
            whole.append((pii.LABELS[label], at(a) + head, at(b) + tail))
        base = pii.base_spans(t)
        want = [s for s in whole if s[2] > s[1] and not any(s[1] < e and s[2] > b for _, b, e in base)]
        assert sorted(want) == sorted(s for s in found[i] if s not in base)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    field = pii.Field(rng.normal(0, 1, (pii.SLOTS, 3)), rng.normal(0, 1, (3, 3)))
    segments = [[[int(x) for x in rng.integers(0, pii.SLOTS, 10)] for _ in range(n)] for n in (1, 4, 3)]
    import itertools

    for s, got in zip(segments, field.viterbi(segments), strict=True):
        e = np.array([field.emission[f].sum(0) for f in s])
        best = max(itertools.product(range(3), repeat=len(s)), key=lambda y: sum(e[i, k] for i, k in enumerate(y)) + sum(field.transition[a, b] for a, b in zip(y, y[1:], strict=False)))
        assert got.tolist() == list(best)


def test_segments_of_any_length():
    field = pii.default_field()
    texts = Texts.of(pa.array(["12 " * 70_000, "call (706) 555-3138 now", "9" * 100_000 + "@"]))
    found = pii.find(texts, field)
    assert found[1] == [("phone", 5, 19)]
    assert found[2] == []


def test_pii_query_and_masks(spark, data, docs):
    for r in queries.QUERIES["op7_pii"](spark, data).collect():
        want = brute_spans(docs[r.doc_id])
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in want) for x in pii.BASE)
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))
    df = spark.createDataFrame([(1, "é call (706) 555-3138 now a@b.cc"), (2, "nothing 12 here"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.m, [(s.kind, s.start, s.end) for s in r.spans]) for r in pii.spans(df, masked_col="m").collect()}
    assert got[1] == ("é call [PHONE] now [EMAIL]", [("email", 26, 32), ("phone", 7, 21)])
    assert got[2] == ("nothing 12 here", []) and got[3] == (None, [])


# -- 8


def test_secret_forest_held_out(spark):
    all_ = secret_scan.labelled_findings(spark, 1500)
    model = secret_scan.train(all_.where("id % 3 <> 0"))
    told = model.transform(secret_scan.with_features(all_.where("id % 3 = 0"))).select("label", "_prediction").collect()
    assert sum(a == b for a, b in told) >= 0.93 * len(told)


def test_secret_candidates_and_features_are_brute_force(spark):
    r = random.Random(12)
    token = lambda n: "".join(r.choice("abcXYZ019_-/+=") for _ in range(n))
    texts = [" ".join(r.choice(["word", "x=", token(r.randint(8, 40)), token(14) + "," + token(20), '"' + token(16) + '"', "CamelCaseNames", "lowercaseonlyword"]) for _ in range(r.randint(0, 25))) for _ in range(40)]
    texts += ["k " * 3 + "aB3" * 4000 + " z", "tok1234567890 tok1234567890 a,tok1234567890,tok1234567890"]  # very long, and repeated within a word
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    words = ["word", "case", "names", "camel"]
    got = collections.defaultdict(list)
    for x in secret_scan.with_features(secret_scan.candidates(df), words).collect():
        got[x.i].append((x.word_no, x.run_no, x.candidate, x.before2, x.before, x.after, *(round(x[f], 9) for f in ("length", "digits", "distinct", "words"))))
    for i, t in enumerate(texts):
        own, want = re.split(r"[ \t\n\x0b\x0c\r]+", t), []
        at = lambda k: own[k] if 0 <= k < len(own) else ""  # noqa: B023, E731
        for n, w in enumerate(own):
            for k, c in enumerate(re.findall(r"[A-Za-z0-9+/_=-]{12,}", w)):
                if re.search("[0-9]|[a-z][A-Z]", c):
                    runs = [m.lower() for m in re.findall("[A-Z]?[a-z]+|[A-Z]+", c)]
                    want.append((n, k, c, at(n - 2), at(n - 1), at(n + 1), float(len(c)), round(sum(x.isdigit() for x in c) / len(c), 9), round(len(set(c)) / min(len(c), 67), 9), round(sum(len(x) for x in runs if x in words) / len(c), 9)))
        assert sorted(got[i]) == sorted(want)


def test_secret_forest_on_hand_written_lines(spark):
    words = secret_scan.vocabulary(P.path("word_bpe_49k.json"))
    lines = [
        ("aws_secret_access_key = wJalrXUtnFEMI/K7MDENG/bPxRfiCYz9qTkLmE4s", True),
        ('api_key: "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"', True),
        ("password=Xk29vLq8TzPw", True),
        ("export GITHUB_TOKEN=ghp_16C7e42F292c6912E7710c838347Ae178B4a", True),
        ("merge commit 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b into main", False),
        ("see docs/getting_started/example_config_2024", False),
        ("request uuid 123e4567-e89b-12d3-a456-426614174000 done", False),
        ("call getElementByIdHandler when it loads", False),
    ]
    model = secret_scan.train(secret_scan.labelled_findings(spark), words=words)
    found = secret_scan.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(lines)], "i long, text string"), model, words=words)
    told = {r.i: r.s for r in found.selectExpr("i", "secret as s").groupBy("i").agg({"s": "max"}).toDF("i", "s").collect()}
    assert sum(told.get(i, False) == w for i, (_, w) in enumerate(lines)) >= 7, told


def test_secret_scan_is_native(spark, data):
    out = queries.QUERIES["op8_secret_scan"](spark, data)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    docs = spark.createDataFrame([(1, 'x token = "1eb9c654e721b4f812088970e66a6345cee33dd6"'), (2, "commit 1eb9c654e721b4f812088970e66a6345cee33dd6 done"), (3, "see https://e.org/example_token_placeholder_1234"), (4, "no candidates here")], "doc_id long, text string")
    model = secret_scan.train(secret_scan.labelled_findings(spark))
    assert {r.doc_id: r.secret for r in secret_scan.scan(docs, model).collect()} == {1: True, 2: False, 3: False}


# -- 9


@pytest.mark.parametrize("window", [1, 2, 5, 6, 35])
def test_substrings_are_brute_force(spark, window):
    r = random.Random(window)
    rows = [(i, " ".join(r.choice("abcde") * r.randint(1, 2) for _ in range(r.randint(0, 40)))) for i in range(40)]
    passage = " ".join(f"w{i}" for i in range(60))
    rows += [(100, f"x {passage} y"), (101, f"{passage[:150]}  {passage}"), (102, passage), (103, "only once " * 3)]
    words = {i: t.split() for i, t in rows}
    seen = collections.Counter(tuple(w[j : j + window]) for w in words.values() for j in range(len(w) - window + 1))
    for x in substrings.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=window).collect():
        w = words[x.doc_id]
        gone = {k for j in range(len(w) - window + 1) if seen[tuple(w[j : j + window])] > 1 for k in range(j, j + window)}
        assert (x.n_words, x.n_removed, x.kept_text) == (len(w), len(gone), " ".join(v for k, v in enumerate(w) if k not in gone))


# -- 10


def brute_classes(rows, percent):
    sets = {}
    for i, t in rows:
        w = lower(t.encode()).split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("group,most", [(2_000_000, 1000), (300, 64), (2_000_000, 4)])
def test_near_duplicates_are_brute_force(spark, group, most):
    r = random.Random(10)
    rows, base = [], [f"w{r.randint(0, 300)}" for _ in range(200)]
    for i in range(90):
        w = list(base) if i % 3 else [f"v{r.randint(0, 9)}" for _ in range(r.randint(0, 8))]
        for _ in range(r.randint(0, 5)):
            if w:
                w[r.randrange(len(w))] = f"n{r.randint(0, 9)}"
        base = w if i % 3 == 1 and r.random() < 0.3 else base
        rows.append((i, " ".join(w)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string"), group_shingles=group, group_rows=most).collect()}
    want = brute_classes(rows, 85)
    assert got == want and 5 < len({c for _, c in want.values()}) < 90


def test_estimate_is_near_the_truth():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.6, 0.85, 0.95):
        common = rng.integers(0, 1 << 63, int(3000 * share), dtype=np.uint64)
        sets = [np.sort(np.concatenate([common, rng.integers(0, 1 << 63, (3000 - len(common)) // 2, dtype=np.uint64)])) for _ in range(2)]
        s = minhash.pack(minhash.minima(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])])))
        truth = len(common) / (len(sets[0]) + len(sets[1]) - len(common))
        assert abs(minhash.estimate(s[0], s[1:])[0] - truth) < 0.17


def test_texts_of_one_id_are_one_vertex(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(100)) for x in "abc")
    df = spark.createDataFrame([(5, a), (3, b), (5, b + " x"), (7, c), (7, a + " y"), (9, c), (9, c)], "doc_id long, text string")
    got = {(x.doc_id, x.component_id) for x in minhash.mark(df).collect()}
    assert got == {(i, 3) for i in (3, 5, 7, 9)}
    kept = minhash.keep_one(df.unionByName(df.where("doc_id = 3"))).collect()
    assert [(r.doc_id, r.text) for r in kept] == [(3, b)]


def test_keep_one(spark):
    t = " ".join(f"w{i}" for i in range(300))
    df = spark.createDataFrame([(3, t, "x"), (2, t + " more", "y"), (9, "else", "z"), (None, t, "n")], "doc_id long, text string, _gone string")
    out = minhash.keep_one(df)
    assert out.columns == df.columns and sorted(r["_gone"] for r in out.collect()) == ["n", "y", "z"]


# -- the pipeline


def test_pipeline(spark, data):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    at = docs
    for name, stage in pipeline.STAGES[:-1]:
        before, at = at, stage(spark, at, data)
        assert at.columns == docs.columns, name
        kept = {r.doc_id for r in at.select("doc_id").collect()}
        assert kept <= {r.doc_id for r in before.select("doc_id").collect()} and len(kept) > 100
    last = pipeline.STAGES[-1][1](spark, at, data)
    assert last.where("round_trip").count() == last.count() == at.count() == pipeline.run(spark, data).count()
    assert 4 <= len(pipeline.STAGES) <= 5
