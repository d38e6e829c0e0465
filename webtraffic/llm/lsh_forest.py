"""N-gram Jaccard join: a MinHash LSH forest with exact verification.

Words are maximal runs of bytes other than ASCII white space, with A-Z lower-cased; a document is
the set of its runs of five words (of all its words, if it has fewer). Two documents are linked if
the Jaccard similarity of their sets is 0.8 or more. Documents of equal text form one class and
are compared once.

1. Each document gets a signature of ``trees * depth`` minima (one permutation, empty bins filled
   from other bins), read as ``trees`` sequences. A forest keeps these sequences sorted; two
   documents are candidates if they share a prefix in any tree. ``forest_depth`` starts from the
   longest prefix and shortens it until a pair at the threshold is found with the target recall.
   One sort by (tree, prefix) finds all trie nodes with more than one document.
2. Candidates are dealt into blocks of similar documents (by the smallest shingle of all that share
   a trie node with them, split by hash beyond ``BLOCK``). Two blocks that meet in a trie node are one unit of work; every document goes
   once to each unit of its block.
3. A unit verifies all its candidate pairs exactly, by set sizes and shared shingles. Each pair of
   documents belongs to one unit, so links are counted where they are found and no table of pairs
   is built; a unit returns counts and the edges of a spanning forest.
4. Connected components of these edges give the classes of near duplicates.

Null and empty texts have no shingles: they are linked to nothing but their exact copies. Repeated
rows are copies. Rows with null doc_id take part; class ids are the smallest doc_id that is there,
null if a class has none.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtraffic.llm.common import U64, Roller, as_long, buffers, chunks, documents_of, mix, staged
from webtraffic.llm.components import connected_components
from webtraffic.llm.suffix_repeats import packed

WORDS = 5
THRESHOLD = 0.8
TREES = 32
MAX_DEPTH = 10
RECALL = 0.9999    #: of a pair exactly at the threshold
BLOCK = 256        #: documents of a block, about

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = [U64(pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64)) for i in range(64)]


def forest_depth(threshold: float, trees: int, recall: float, longest: int = MAX_DEPTH) -> int:
    """The longest shared prefix that still finds a pair at ``threshold`` with the target recall."""
    depth = longest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def word_hashes(data: np.ndarray, offsets: np.ndarray, roller: Roller) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the texts in ``data``, and the number of its text."""
    data = _LOWER[data]
    h = roller.prefix(data)
    inside = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    s = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    e = np.flatnonzero(inside & (~after | cut[1:])) + 1
    text = np.searchsorted(offsets, s, side="right") - 1
    return mix(roller.spans(h, s, e) + (e - s).astype(U64)), text


def shingles(words: np.ndarray, text: np.ndarray, k: int, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``k`` words within a text (all words of a shorter one), and its text."""
    count = np.bincount(text, minlength=n_texts)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    runs = np.maximum(count - k + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(n_texts), runs)
    at = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(runs)])[:-1], runs) + first[owner]
    out = np.zeros(len(owner), U64)
    if len(owner):
        end = first[owner] + count[owner]
        for j in range(k):
            i = at + j
            ok = i < end
            out += np.where(ok, words[np.minimum(i, len(words) - 1)] * _STEP[j], U64(0))
    return mix(out), owner


def signatures(sh: np.ndarray, owner: np.ndarray, n_texts: int, bins: int) -> np.ndarray:
    """One-permutation minima: each shingle falls into a bin; empty bins copy another bin's minimum.

    The bin that is copied depends on the empty bin and the attempt alone, so equal sets agree in
    every bin, and a bin agrees with about the probability of the Jaccard similarity.
    """
    top = U64(0xFFFFFFFFFFFFFFFF)
    sig = np.full(n_texts * bins, top, U64)
    b = ((sh >> U64(32)) * U64(bins)) >> U64(32)
    np.minimum.at(sig, owner * bins + b.astype(np.int64), mix(sh))
    sig = sig.reshape(n_texts, bins)
    full = sig != top
    out, todo = sig.copy(), np.flatnonzero(full.any(axis=1) & ~full.all(axis=1))
    rng = np.random.default_rng(20)
    for _ in range(16 * bins):
        if not len(todo):
            break
        other = rng.integers(0, bins, bins)
        o = out[todo]
        take = (o == top) & full[todo][:, other]
        o[take] = sig[todo][:, other][take]
        out[todo] = o
        todo = todo[(o == top).any(axis=1)]
    return out


_ROW = "rid long, tag int, doc_id long, key binary, low long, trees array<long>"


def _rows(batches, trees: int, depth: int, words: int):
    roller = Roller()
    bins = trees * depth
    weight = np.array([pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) for i in range(depth)], U64)
    tree = mix(np.arange(1, trees + 1, dtype=U64))
    for b in batches:
        off, data = buffers(b.column("text"))
        n = len(off) - 1
        keys = [hashlib.md5(data[off[i] : off[i + 1]]).digest() for i in range(n)]
        prefix, low, has = np.zeros((n, trees), U64), np.zeros(n, U64), np.zeros(n, bool)
        for i, j in chunks(off):
            base = off[i]
            w, t = word_hashes(data[base : off[j]], off[i : j + 1] - base, roller)
            sh, owner = shingles(w, t, words, j - i)
            sig = signatures(sh, owner, j - i, bins)
            prefix[i:j] = mix((sig.reshape(j - i, trees, depth) * weight).sum(axis=2, dtype=U64) + tree)
            has[i + owner] = True
            low[i:j] = sig.min(axis=1)
        value = pa.array(as_long(prefix).ravel())
        ends = np.concatenate([[0], np.cumsum(np.where(has, trees, 0))]).astype(np.int32)
        value = value.filter(pa.array(np.repeat(has, trees)))
        yield pa.RecordBatch.from_arrays(
            [b.column("rid"), b.column("tag"), b.column("doc_id").cast(pa.int64()), pa.array(keys, pa.binary()),
             pa.array(as_long(low)), pa.ListArray.from_arrays(pa.array(ends), value)],
            names=["rid", "tag", "doc_id", "key", "low", "trees"],
        )


def signed(docs: DataFrame, trees: int, depth: int, words: int = WORDS) -> DataFrame:
    """Rows (rid, tag, doc_id, key, low, trees): text digest, smallest minimum, hashed prefixes."""
    return documents_of(docs).mapInArrow(lambda it: _rows(it, trees, depth, words), _ROW)


def _shared(batches):
    """Keys of trie nodes that hold two documents or more; rows come sorted by ``v``."""
    before = None
    for b in batches:
        v, key = b.column("v").to_numpy(), b.column("key")
        same = np.zeros(len(v), bool)
        same[1:] = v[1:] == v[:-1]
        take = same.copy()
        take[:-1] |= same[1:]
        out = key.filter(pa.array(take)).to_pylist()
        if before is not None and len(v) and before[0] == v[0]:
            out += [before[1], key[0].as_py()]
        out = list(set(out))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["key"])
        if len(v):
            before = (v[-1], key[-1].as_py())


def _lowest(batches):
    """For each document of a trie node, the node's lowest minimum; rows come sorted by (v, low)."""
    before = None
    for b in batches:
        v, low = b.column("v").to_numpy(), b.column("low").to_numpy()
        if not len(v):
            continue
        new = np.r_[True, v[1:] != v[:-1]]
        first = low[new]
        if before is not None and before[0] == v[0]:
            first[0] = before[1]
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(first[np.cumsum(new) - 1])], names=["key", "label"])
        before = (v[-1], first[-1])


def _meetings(batches):
    """Pairs of blocks that share a trie node; rows come sorted by (v, block).

    Of a node, only its distinct blocks are held.
    """
    node, seen, out = None, [], set()
    for b in batches:
        for v, block, n in zip(b.column("v").to_pylist(), b.column("block").to_pylist(), b.column("n").to_pylist(), strict=True):
            if v != node:
                node, seen = v, []
            if n > 1:
                out.add((block, block))
            for other in seen:
                out.add((other, block))
            seen.append(block)
        if len(out) > 100_000:
            yield _pairs(out)
            out = set()
    if out:
        yield _pairs(out)


def _pairs(out):
    i, j = zip(*out, strict=True)
    return pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int64()), "j": pa.array(j, pa.int64())})


def _sets(batches, words: int):
    roller, z = Roller(), zstandard.ZstdDecompressor()
    for b in batches:
        out = []
        for packed_text in b.column("z").to_pylist():
            data = np.frombuffer(z.decompress(packed_text), np.uint8)
            w, t = word_hashes(data, np.array([0, len(data)]), roller)
            out.append(np.unique(shingles(w, t, words, 1)[0]).tobytes())
        names = ["key", "block", "copies", "trees"]
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names), pa.array(out, pa.binary())], names=[*names, "grams"])


def shared_counts(x: list[np.ndarray], y: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of the intersections of each set of ``x`` with each of ``y`` (sorted arrays)."""
    out = np.zeros((len(x), len(y)), np.float32)
    both = np.intersect1d(np.unique(np.concatenate(x)), np.unique(np.concatenate(y)), assume_unique=True)
    for a in range(0, len(both), width):
        part = both[a : a + width]
        m = []
        for side in (x, y):
            hit = np.zeros((len(side), len(part)), np.float32)
            for i, s in enumerate(side):
                s = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], side="right")]
                at = np.searchsorted(part, s)
                hit[i, at[part[np.minimum(at, len(part) - 1)] == s]] = 1
            m.append(hit)
        out += m[0] @ m[1].T
    return out


def verified(x: list[np.ndarray], y: list[np.ndarray], tx: np.ndarray, ty: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs share a prefix in any tree and reach the threshold: a boolean matrix."""
    near = np.zeros((len(x), len(y)), bool)
    for t in range(tx.shape[1]):
        near |= tx[:, t, None] == ty[None, :, t]
    nx, ny = (np.array([len(s) for s in side], np.int64) for side in (x, y))
    near &= (np.minimum(nx[:, None], ny) >= threshold * np.maximum(nx[:, None], ny) - 1e-9)
    rows, cols = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    if not len(rows):
        return near
    n = shared_counts([x[i] for i in rows], [y[i] for i in cols])
    union = nx[rows][:, None] + ny[cols] - n
    near[np.ix_(rows, cols)] &= n >= threshold * union - 1e-9
    return near


def spanning(link: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what ``link`` (square, symmetric) connects, none with a large degree."""
    n = len(link)
    label = np.arange(n)
    while True:
        low = np.minimum(label, np.where(link, label[None, :], n).min(axis=1, initial=n))
        if (low == label).all():
            break
        label = low
    out = []
    for root in np.unique(label):
        m = np.flatnonzero(label == root)
        out += [(int(m[i]), int(m[(i - 1) // 2])) for i in range(1, len(m))]
    return out


_FOUND = "key binary, other binary, links long, copies long"


def _unit(key: tuple, table: pa.Table, threshold: float) -> pa.Table:
    """Links within one unit: counts per document (other null) and spanning edges (links null)."""
    i, j = key[0].as_py(), key[1].as_py()
    block = table.column("block").to_numpy()
    name = table.column("key").to_pylist()
    copies = table.column("copies").to_numpy()
    grams = [np.frombuffer(g, U64) for g in table.column("grams").to_pylist()]
    trees = np.array(table.column("trees").to_pylist(), np.int64)
    out = {"key": [], "other": [], "links": [], "copies": []}
    a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
    link = np.zeros((len(name), len(name)), bool)
    if len(a) and len(b):
        near = verified([grams[k] for k in a], [grams[k] for k in b], trees[a], trees[b], threshold)
        link[np.ix_(a, b)] = near
    link |= link.T
    np.fill_diagonal(link, False)
    for k in np.flatnonzero(link.any(axis=1)):
        out["key"].append(name[k])
        out["other"].append(None)
        out["links"].append(int(link[k].sum()))
        out["copies"].append(int(copies[link[k]].sum()))
    for p, q in spanning(link):
        out["key"].append(name[p])
        out["other"].append(name[q])
        out["links"].append(None)
        out["copies"].append(None)
    return pa.table(out, schema=pa.schema([("key", pa.binary()), ("other", pa.binary()), ("links", pa.int64()), ("copies", pa.int64())]))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, trees: int = TREES, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per document: (rid, tag, doc_id, class_id, copy_id, n_links, n_text_links, keeper).

    ``class_id`` is the smallest doc_id of its class of near duplicates, ``copy_id`` of its exact
    copies; ``n_links`` counts the other documents, ``n_text_links`` the other texts it is linked
    to; ``keeper`` marks the rows with the (rid, tag) that stands for the class.
    """
    depth = forest_depth(threshold, trees, recall)
    rows = staged(signed(docs, trees, depth, words), "signed")
    texts = staged(
        rows.groupBy("key").agg(
            F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"),
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "rid", "tag")).alias("at"), F.any_value("low").alias("low"),
            F.any_value("trees").alias("trees"),
        ),
        "texts",
    )
    shared = staged(
        texts.select(F.explode("trees").alias("v"), "key").repartition("v").sortWithinPartitions("v")
        .mapInArrow(_shared, "key binary").distinct(),
        "shared",
    )
    cand = staged(texts.join(shared, "key").select("key", "low", "copies", "at.rid", "at.tag", "trees"), "shared_texts")
    labels = (
        cand.select(F.explode("trees").alias("v"), "low", "key").repartition("v").sortWithinPartitions("v", "low")
        .mapInArrow(_lowest, "key binary, label long").groupBy("key").agg(F.min("label").alias("label"))
    )
    labels = staged(labels, "labels")
    sizes = staged(labels.groupBy("label").agg(F.ceil(F.count("*") / block).alias("parts")), "sizes")
    blocks = labels.join(sizes, "label").select(
        "key", F.xxhash64("label", F.pmod(F.xxhash64("key"), F.col("parts"))).alias("block")
    )
    cand = staged(cand.drop("low").join(staged(blocks, "blocks"), "key"), "candidates")
    units = staged(
        cand.select(F.explode("trees").alias("v"), "block").groupBy("v", "block").agg(F.count("*").alias("n"))
        .repartition("v").sortWithinPartitions("v", "block").mapInArrow(_meetings, "i long, j long").distinct(),
        "units",
    )
    grams = staged(
        packed(docs).drop("doc_id").join(cand, ["rid", "tag"]).select("key", "block", "copies", "trees", "z")
        .mapInArrow(lambda it: _sets(it, words), "key binary, block long, copies long, trees array<long>, grams binary")
        .dropDuplicates(["key"]),
        "grams",
    )
    sides = units.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    found = staged(
        grams.join(sides, "block").groupBy("i", "j").applyInArrow(
            lambda k, t: _unit(k, t, threshold), _FOUND
        ),
        "found",
    )
    edges = found.where(F.col("other").isNotNull())
    roots = connected_components(edges, "key", "other")
    counts = found.where(F.col("other").isNull()).groupBy("key").agg(F.sum("links").alias("links"), F.sum("copies").alias("linked"))
    member = (
        texts.select("key", "copies", "doc_id", "at")
        .join(roots.withColumnRenamed("node", "key"), "key", "left")
        .join(counts, "key", "left")
        .withColumn("root", F.coalesce("root", "key"))
    )
    member = staged(member, "member")
    heads = staged(member.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.min("at").alias("head")), "heads")
    of_text = staged(
        member.join(heads, "root").select(
            "key", "class_id", F.col("doc_id").alias("copy_id"), "head",
            (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("links", F.lit(0)).cast("long").alias("n_text_links"),
        ),
        "of_text",
    )
    return rows.select("rid", "tag", "doc_id", "key").join(of_text, "key").select(
        "rid", "tag", "doc_id", "class_id", "copy_id", "n_links", "n_text_links",
        ((F.col("rid") == F.col("head.rid")) & (F.col("tag") == F.col("head.tag"))).alias("keeper"),
    )


def one_per_class(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class of near duplicates: of the smallest doc_id that is there."""
    heads = near_duplicates(docs).where("keeper").select("rid", "tag").distinct()
    rid = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))))
    tag = F.hash(F.coalesce(F.col("text"), F.lit("")))
    keyed = docs.withColumn("__rid", rid).withColumn("__tag", tag)
    heads = heads.select(F.col("rid").alias("__rid"), F.col("tag").alias("__tag"))
    return keyed.join(heads, ["__rid", "__tag"]).dropDuplicates(["__rid", "__tag"]).select(*docs.columns)
