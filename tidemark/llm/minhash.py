"""Near-duplicate classes by b-bit MinHash, confirmed on full shingle sets.

A document's set holds the hashes of its distinct runs of ``SHINGLE`` words (of
all its words, if it has fewer) with A-Z lower-cased.  Two documents are linked
if the Jaccard similarity of their sets is at least ``percent`` / 100; classes are
the connected components of links.

1. Documents with equal sets are represented by the least id.
2. Each set gets ``HASHES`` minima.  Bands of ``ROWS`` whole minima give the
   candidates; the lowest ``BITS`` bits of all minima are packed as the signature.
3. Sets that share a band, directly or through others, form a candidate group
   (found with one edge per set and band, to the least id of the band's bucket).
   A link of similarity s shares no band with probability (1 - s**4)**32, below
   1e-10 at 0.85 and 5e-8 at 0.80.
4. Within a group, classes grow from one set at a time: sets not yet reached
   are pre-selected by similarity estimated from equal signature fields, corrected for fields
   that agree by chance (``estimate``), and confirmed on the full sets.  Reached
   sets are not compared again, so copies cost no pairs among themselves.  The
   estimate must be within ``SLACK`` of the threshold, six standard deviations
   at 0.85 and five at 0.80.
5. A group of more than ``GROUP_ROWS`` sets or ``GROUP_SHINGLES`` is dealt into
   blocks of at most that.  Each block meets the first one only, which holds
   members of every large family, so each set is copied once.  What links are
   left undone can only be within buckets that now hold sets of different
   classes; their sets make new, mostly small groups.  Of one that is still
   large the sets outside its largest class, dealt into blocks too, meet all
   blocks.  No task holds a whole large group.

Sets use 64-bit hashes.  Texts without words (null, empty) link with nothing.
Null ids are never linked: component_id is null and kept is true.  Rows with the
same id are one vertex, whatever their texts: what one of them links to, all do.
Very long texts are whole sets like others, ties are broken by the least id, an
empty table gives no rows.  Columns named like an output are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.graph import components, kept
from tidemark.llm.textcore import SPACE, Texts, Words, group_starts, mix, shared_dir, tune, windows

SHINGLE = 5
HASHES, ROWS, BITS = 128, 4, 4
SLACK = 0.2
GROUP_SHINGLES, GROUP_ROWS = 2_000_000, 20_000
#: Blocks that the sets outside the largest class are copied to, where they need not be more.
COPIES = 16

_rng = np.random.default_rng(20)
_XOR = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_MULTIPLY = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(texts: Texts, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a slice in order of text and hash, and the bounds of each text's own."""
    words = Words(texts.lower(), SPACE)
    h, doc = words.hashes(), words.doc()
    at, x = windows(h, words.bounds, size)
    key, own = [x], [doc[at]]
    for k in range(1, size):
        few = np.flatnonzero(words.counts == k)
        if len(few):
            at, x = windows(h, words.bounds, k)
            pick = np.isin(doc[at], few)
            key.append(x[pick])
            own.append(doc[at][pick])
    x, d = np.concatenate(key), np.concatenate(own)
    order = np.argsort(x)
    order = order[np.argsort(d[order].astype(np.uint16), kind="stable")]
    x, d = x[order], d[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (d[1:] != d[:-1])
    x, d = x[new], d[new]
    return x, np.searchsorted(d, np.arange(len(texts) + 1))


def minima(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """HASHES minima of each set that has members."""
    first = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(first), HASHES), np.uint64)
    if len(first):
        for i in range(HASHES):
            out[:, i] = np.minimum.reduceat((x ^ _XOR[i]) * _MULTIPLY[i], first)
    return mix(out)


def bands(m: np.ndarray) -> np.ndarray:
    n = HASHES // ROWS
    key = np.zeros((len(m), n), np.uint64)
    for j in range(ROWS):
        key = mix(key * np.uint64(3) + m[:, j::ROWS])
    return mix(key + np.arange(n, dtype=np.uint64))


def pack(m: np.ndarray) -> np.ndarray:
    """Signatures: the lowest BITS bits of each minimum, in 64-bit words."""
    per = 64 // BITS
    low = (m & np.uint64((1 << BITS) - 1)).reshape(len(m), -1, per)
    return np.bitwise_or.reduce(low << (np.arange(per, dtype=np.uint64) * np.uint64(BITS)), axis=2)


_FIELD = np.uint64(sum(1 << (BITS * i) for i in range(64 // BITS)))


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of a signature with others, by the bit count of unequal fields and corrected for chance agreement."""
    differ = a[None, :] ^ b
    any_bit = differ.copy()
    for k in range(1, BITS):
        any_bit |= differ >> np.uint64(k)
    equal = 1 - np.bitwise_count(any_bit & _FIELD).sum(1) / HASHES
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def digests(x: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """128 bits that stand for each set; None for an empty one."""
    out: list[bytes | None] = [None] * (len(bounds) - 1)
    some = np.flatnonzero(np.diff(bounds) > 0)
    if len(some):
        sums = np.stack([np.add.reduceat(mix(x + np.uint64(s)), bounds[:-1][some]) for s in (1, 2)], axis=1)
        for k, i in enumerate(some.tolist()):
            out[i] = sums[k].tobytes()
    return out


def signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, digest of the set, bands, signature) of each document."""
    tune(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([src.schema[0], *T.StructType.fromDDL("n_shingles long, digest binary, bands array<long>, signature binary")])

    def run(batches):
        for batch in batches:
            texts = Texts.of(batch.column(1))
            for a, b in texts.slices():
                x, bounds = shingles(texts.part(a, b))
                n = np.diff(bounds)
                some = np.flatnonzero(n > 0)
                m = minima(x, bounds)
                digest, key, sig = digests(x, bounds), [None] * (b - a), [None] * (b - a)
                if len(some):
                    all_keys, all_sigs = bands(m).view(np.int64).tolist(), pack(m)
                    for k, i in enumerate(some.tolist()):
                        key[i], sig[i] = all_keys[k], all_sigs[k].tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(digest, pa.binary()), pa.array(key, pa.list_(pa.int64())), pa.array(sig, pa.binary())], names=schema.names)

    return src.mapInArrow(run, schema)


def resolve(ids: np.ndarray, sets: list[np.ndarray], signatures: np.ndarray, percent: int, label: np.ndarray | None = None) -> np.ndarray:
    """Root (least id) of each member of a group, by links within the group; members of equal label are linked beforehand."""
    order = np.argsort(ids, kind="stable")
    ids, sets, signatures = ids[order], [sets[i] for i in order], signatures[order]
    label = ids if label is None else label[order]
    size = np.array([len(s) for s in sets])
    _, local = np.unique(np.concatenate(sets), return_inverse=True)
    end = np.cumsum(size)
    begin = end - size
    marked = np.zeros(int(local.max(initial=0)) + 1, bool)
    root = np.full(len(ids), -1)
    left = np.arange(len(ids))
    while len(left):
        seed = left[0]
        linked = left[label[left] == label[seed]]
        reached: list[int] = []
        while True:
            root[linked] = seed
            reached += linked.tolist()
            left = left[root[left] < 0]
            if not reached or not len(left):
                break
            u = reached.pop()
            low, high = np.minimum(size[left], size[u]), np.maximum(size[left], size[u])
            near = left[100 * low >= percent * high]
            near = near[estimate(signatures[u], signatures[near]) >= percent / 100 - SLACK]
            linked = near[:0]
            if not len(near):
                continue
            own = local[begin[u] : end[u]]
            marked[own] = True
            n = size[near]
            stop = np.cumsum(n)
            at = np.arange(stop[-1]) - np.repeat(stop - n, n) + np.repeat(begin[near], n)
            common = np.add.reduceat(marked[local[at]].astype(np.int64), stop - n)
            marked[own] = False
            linked = near[100 * common >= percent * (size[u] + n - common)]
            if len(linked):
                linked = left[np.isin(label[left], label[linked])]
    out = np.empty(len(ids), ids.dtype)
    out[order] = ids[root]
    return out


def _stars(probes: DataFrame, buckets: DataFrame) -> DataFrame:
    """Edges of the sets of each bucket (key, least) to its least one."""
    return probes.join(buckets, "key").select(F.col("rep").alias("a"), F.col("least").alias("b"))


def _links(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(rep, root, split, own) of the links found among members (grp, split, label, rep, digest, signature, first, and the tasks i, j they meet in).

    root is the least of the ``first`` members that rep is linked with in the task,
    or the least member where there is none; own marks tasks (0, j) for rep's block j.
    """
    id_type = dict(texts.dtypes)["rep"]

    def run(t: pa.Table) -> pa.Table:
        ids, label = t.column("rep").to_numpy(), t.column("label").to_numpy()
        own = [np.frombuffer(s, np.uint64) for s in t.column("set").to_pylist()]
        sigs = np.stack([np.frombuffer(s, np.uint64) for s in t.column("signature").to_pylist()])
        digest, early = t.column("digest").to_pylist(), np.asarray(t.column("first")).astype(bool)
        pick = list({x: i for i, x in enumerate(zip(ids.tolist(), digest, strict=True))}.values())  # one may have come as both sides
        ids, early = ids[pick], early[pick]
        root = resolve(ids, [own[i] for i in pick], sigs[pick], percent, label[pick])
        if early.any():
            order = np.lexsort((ids, ~early, root))  # of each class a member of the first block, the least one
            at = group_starts(root[order])
            root = np.repeat(ids[order][at], np.diff(np.append(at, len(ids))))[np.argsort(order, kind="stable")]
        mine = ~early if t.column("j")[0].as_py() else np.ones(len(ids), bool)
        return pa.Table.from_arrays([pa.array(ids), pa.array(root), pa.array(np.full(len(ids), t.column("split")[0].as_py(), bool)), pa.array(mine)], names=["rep", "root", "split", "own"])

    tasks = members.groupBy("rep", "digest").agg(F.any_value("signature").alias("signature"), F.collect_list(F.struct("grp", "i", "j", "split", "label", "first")).alias("tasks"))
    dealt = _with_sets(texts.join(tasks, "rep")).select("rep", "digest", "signature", "set", F.inline("tasks"))
    return dealt.groupBy("grp", "i", "j").applyInArrow(run, f"rep {id_type}, root {id_type}, split boolean, own boolean").where("rep <> root")


def _once(texts: DataFrame, per: DataFrame) -> DataFrame:
    """texts (rep, text), of which equal rows of an id that is there twice (per id: n) are one."""
    again = per.where("n > 1").select(F.col("id").alias("rep"))
    return texts.join(again, "rep", "left_semi").distinct().unionByName(texts.join(again, "rep", "left_anti"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, group_shingles: int = GROUP_SHINGLES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(id, n_shingles, component_id) of each document; ids are integers."""
    shared_dir(docs.sparkSession)
    told = signed(docs, id_col, text_col).checkpoint()
    known = told.where("digest is not null and id is not null")
    sets = known.groupBy("digest", "n_shingles").agg(F.min("id").alias("rep"), F.any_value("bands").alias("bands"), F.any_value("signature").alias("signature")).checkpoint()
    by_digest = sets.select("digest", "n_shingles", "rep")
    per = known.groupBy("id").agg(F.count("*").alias("n"), F.min("digest").alias("x"), F.max("digest").alias("y"))
    most, differ = per.agg(F.max("n"), F.count_if(F.col("x") != F.col("y"))).first()
    free = _several_texts(known, by_digest, per) if differ else None
    probes = sets.select("rep", F.explode("bands").alias("key"))
    buckets = probes.groupBy("key").agg(F.min("rep").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least")
    stars = _stars(probes, buckets)
    groups = components(stars if free is None else stars.unionByName(free))
    member = groups.join(sets, groups.v == F.col("rep")).select("rep", F.col("root").alias("grp"), "n_shingles", "digest", "signature")
    blocks = member.groupBy("grp").agg(F.ceil(F.greatest(F.lit(1), F.sum("n_shingles") / group_shingles, F.count("*") / group_rows)).cast("int").alias("blocks"))
    member = member.join(blocks, "grp").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    member, n_split = kept(member, F.count_if(F.col("blocks") > 1))
    texts = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")).where("rep is not null")
    if (most or 0) > 1:
        texts = _once(texts, per)
    # each block meets the first one
    with_first = F.explode(F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block")))
    dealt = member.select("grp", F.lit(0).alias("i"), with_first.alias("j"), (F.col("blocks") > 1).alias("split"), F.col("rep").alias("label"), "rep", "digest", "signature", (F.col("block") == 0).alias("first"))
    links = _links(dealt, texts, percent).checkpoint()
    roots = links.where("not split").select("rep", "root")
    edges = None
    if n_split:
        edges = links.where("split").select(F.col("rep").alias("a"), F.col("root").alias("b"))
        more = _undone(links.where("split and own"), member.where("blocks > 1"), sets, texts, percent, group_shingles, group_rows)
        edges = edges if more is None else edges.unionByName(more.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    if free is not None:  # may join any two groups' sets
        own = roots.select(F.col("rep").alias("a"), F.col("root").alias("b")).unionByName(free)
        edges, roots = own if edges is None else edges.unionByName(own), roots.limit(0)
    if edges is not None:
        roots = roots.unionByName(components(edges).select(F.col("v").alias("rep"), "root").where("rep <> root"))
    by_set = by_digest.join(roots, "rep", "left").select("digest", "n_shingles", F.coalesce("root", "rep").alias("component_id"))
    out = told.select("id", "n_shingles", "digest").join(by_set, ["digest", "n_shingles"], "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", own.alias("component_id"))


def _several_texts(known: DataFrame, by_digest: DataFrame, per: DataFrame) -> DataFrame:
    """Edges from ids with several texts, which are one vertex, to the representatives of those."""
    several = per.where("x <> y").select("id")
    held = known.join(several, "id", "left_semi").select("id", "digest", "n_shingles").join(by_digest, ["digest", "n_shingles"])
    return held.select(F.col("id").alias("a"), F.col("rep").alias("b")).where("a <> b")


def _undone(links: DataFrame, member: DataFrame, sets: DataFrame, texts: DataFrame, percent: int, group_shingles: int, group_rows: int) -> DataFrame | None:
    """The links that split groups may lack: among the sets of buckets with different classes.

    Classes are told by what each set is linked to in its own block's task, and that
    in the first block's: of one class are only sets that are linked, though two
    classes may be one.
    """
    at_first = links.select(F.col("rep").alias("root"), F.col("root").alias("then"))
    label = links.join(at_first, "root", "left").select(F.col("rep").alias("v"), F.coalesce("then", "root").alias("label"))
    named = member.select("rep", "digest", "n_shingles", "signature").join(label, F.col("v") == F.col("rep"), "left").select("rep", "digest", "n_shingles", "signature", F.coalesce("label", "rep").alias("label"))
    named = named.join(sets.select("digest", "n_shingles", "bands"), ["digest", "n_shingles"]).checkpoint()
    probes = named.select("rep", "label", F.explode("bands").alias("key"))
    mixed = probes.groupBy("key").agg(F.min("rep").alias("least"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key", "least")
    groups = components(_stars(probes.select("rep", "key"), mixed))
    if groups.isEmpty():
        return None
    again = named.drop("bands").join(groups, F.col("v") == F.col("rep")).select(F.col("root").alias("grp"), "rep", "digest", "n_shingles", "signature", "label")
    classes_ = again.groupBy("grp", "label").agg(F.sum("n_shingles").alias("s"), F.count("*").alias("n"))
    per = classes_.groupBy("grp").agg(F.max_by("label", F.struct("s", "label")).alias("top"), F.sum("s").alias("s"), F.sum("n").alias("n"), F.max("s").alias("top_s"))
    all_ = F.greatest(F.col("s") / group_shingles, F.least(F.lit(COPIES), F.col("n") / group_rows))
    rest = (F.col("s") - F.col("top_s")) / group_shingles
    per = per.select("grp", "top", F.ceil(F.greatest(F.lit(1), all_)).cast("int").alias("blocks"), F.ceil(F.greatest(F.lit(1), rest)).cast("int").alias("others"))
    at = lambda salt, n: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int")
    again = again.join(per, "grp").withColumn("block", at(1, "blocks")).withColumn("other", at(2, "others"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # the sets outside the largest class meet all blocks, so they stand in every block's task as well
    outside = F.col("label") != F.col("top")
    pairs = F.when(~outside, F.transform(upto("others"), lambda i: F.struct(i.alias("i"), F.col("block").alias("j")))).otherwise(F.array_union(F.transform(upto("others"), lambda i: F.struct(i.alias("i"), F.col("block").alias("j"))), F.transform(upto("blocks"), lambda j: F.struct(F.col("other").alias("i"), j.alias("j")))))
    met = again.select("grp", F.explode(pairs).alias("at"), "label", "rep", "digest", "signature")
    return _links(met.select("grp", "at.i", "at.j", F.lit(True).alias("split"), "label", "rep", "digest", "signature", F.lit(False).alias("first")), texts, percent).checkpoint()


def _with_sets(df: DataFrame) -> DataFrame:
    """df (text, digest and others) with the set of text (as bytes) in its place, where that has the digest."""
    names = [c for c in df.columns if c != "text"]
    at, want = df.columns.index("text"), df.columns.index("digest")
    keep = [df.columns.index(c) for c in names]
    schema = T.StructType([*[df.schema[c] for c in names], T.StructField("set", T.BinaryType())])

    def run(batches):
        for batch in batches:
            texts, told = Texts.of(batch.column(at)), batch.column(want).to_pylist()
            for a, b in texts.slices():
                x, bounds = shingles(texts.part(a, b))
                rows = [i for i, d in enumerate(digests(x, bounds)) if d is not None and d == told[a + i]]
                own = [x[bounds[i] : bounds[i + 1]].tobytes() for i in rows]
                pick = pa.array([a + i for i in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pick) for k in keep), pa.array(own, pa.binary())], names=schema.names)

    return df.mapInArrow(run, schema)


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """(id, n_shingles, component_id, kept) of each document; kept is true for one id of each class."""
    return classes(docs, id_col, text_col, percent).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """The documents that represent their class, with the columns they came with.

    Links are from similarity 0.80 on; the 0.85 of ``mark`` is that of op10 alone.

    Rows with a null id stay.  Of rows that repeat the id of a representative one
    stays, whichever comes first.
    """
    told = mark(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "id", "text", percent)
    own = docs.columns
    held = docs.select(*[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(own)])
    at = f"own_{own.index(id_col)}"
    gone = told.where("not kept").select("id").distinct()
    left = held.join(gone, F.col(at) == F.col("id"), "left_anti")
    again = held.where(F.col(at).isNotNull()).groupBy(F.col(at).alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id")
    if again.isEmpty():
        once = left
    else:
        once = left.join(again, F.col(at) == F.col("id"), "left_semi").dropDuplicates([at]).unionByName(left.join(again, F.col(at) == F.col("id"), "left_anti"))
    return once.select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(own)])
