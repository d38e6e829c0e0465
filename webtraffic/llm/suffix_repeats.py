"""Suffix-array dedup: maximal repeats of at least ``min_bytes`` bytes, with all occurrences.

A suffix array over every byte of a corpus is many times the corpus. This one is sparse: it
holds the suffixes that start at *anchors*. The anchor of a window of ``min_bytes`` bytes is the
leftmost smallest hashed k-gram in it, so equal windows have their anchors at equal places, and
two windows can only be equal if their anchors' k-grams are. About one byte in ninety is an
anchor, and each window start belongs to exactly one.

1. ``anchor_runs``: one row per anchor: its k-gram hash h, the run of window starts that it
   owns, and a fingerprint of the text which that run covers.
2. Rows equal in (h, fingerprint) are one *variant*. A variant seen twice is repeated as a whole,
   so copies, however many, are settled by a count.
3. Only variants seen once whose k-gram has other variants need their text. Sorted by the text to
   the right of the anchor they form the enhanced suffix array of that k-gram; a stack scan over
   the common prefix lengths yields its interval tree (``lcp_intervals``), and for each interval
   the text to the left decides how far each suffix extends and with which others: where left
   extensions differ the interval splits into groups. Each (interval, left group) is a maximal
   repeat within the anchor's window, reported with all its occurrences.
4. A k-gram with more than ``max_scan`` variants is split before it is scanned: into its windows that start in the
   nearer and in the farther half before the anchor. All windows of a half share a longer text than
   the k-gram, so the variants of a half part into smaller groups by that text, and windows are equal only
   within them. Variants that agree in all bytes of a half's windows are settled by a count, and one of them
   goes on for the others. Groups still too large are halved again; a single window start has none left,
   as its shared text is the window. A variant stays in the halves whose edge its differences touch, so
   it has a few rows for each halving, not one for each window.

Hashes of shared texts have 64 bits each and are compared only beside an equal 64-bit k-gram hash.

Null texts are empty and have no repeat. A text shorter than ``min_bytes`` has none. Repeated rows
repeat each other, so their whole text (if long enough) is a repeat. Rows with equal or null
doc_id are told apart by their text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from webtraffic.llm.common import Roller, U64, as_long, buffers, chunks, documents_of, mix, staged

GRAM = 40          #: bytes of an anchor's k-gram
MAX_SCAN = 1024    #: variants that one scan takes; larger groups are split first
FLUSH = 400_000    #: anchors that a task combines before it hands them to the shuffle

_RUN = "h long, f long, n int, o int, c long, rid long, tag int, s int"


def window_minima(v: np.ndarray, w: int) -> np.ndarray:
    """Smallest value of every window of ``w`` values, by doubling."""
    span, m = 1, v
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    rest = w - span
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, roller: Roller):
    """Anchor runs of the texts in ``data``: (text number, first start, starts, anchor, h, f).

    Places count from the beginning of ``data``. Each run is a maximal stretch of window starts in
    one text with the same anchor.
    """
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, U64),) * 2
    if len(data) < length:
        return none
    h = roller.prefix(data)
    g = roller.windows(h, gram)
    order = ((g * U64(0xC2B2AE3D27D4EB4F)) >> U64(32)).astype(np.uint32)
    w = length - gram + 1
    low = window_minima(order, w)
    first, last = offsets[:-1], offsets[1:] - length
    ok = last >= first
    text, first, last = np.flatnonzero(ok), first[ok], last[ok]
    if not len(text):
        return none
    # runs of equal minima, cut where a text ends
    change = np.flatnonzero(low[1:] != low[:-1]) + 1
    s = np.unique(np.concatenate([change, first, last + 1]))
    s = s[s < len(low)]
    e = np.append(s[1:], len(low)) - 1
    t = np.searchsorted(first, s, side="right") - 1
    keep = (t >= 0) & (s <= last[t])
    s, e, t = s[keep], e[keep], t[keep]
    e = np.minimum(e, last[t])
    step, at = np.arange(w), []
    todo = [(s, e, t)]
    while todo:  # a run that outlives its first smallest k-gram goes on with the next one
        s, e, t = todo.pop()
        a = np.empty(len(s), np.int64)
        for i in range(0, len(s), 4096):
            a[i : i + 4096] = s[i : i + 4096] + order[s[i : i + 4096, None] + step].argmin(axis=1)
        at.append((t, s, np.minimum(e, a), a))
        more = e > a
        if more.any():
            todo.append((a[more] + 1, e[more], t[more]))
    t, s, e, a = (np.concatenate(x) for x in zip(*at, strict=True))
    f = roller.spans(h, s, e + length)
    f = mix(f + ((a - s).astype(U64) << U64(20)) + ((e - s).astype(U64) << U64(40)))
    return text[t], s, e - s + 1, a, mix(g[a]), f


def _runs(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Anchor rows (rid, tag, s, n, o, h, f) of each batch; s counts within the document."""
    roller = Roller()
    for b in batches:
        off, data = buffers(b.column("text"))
        rid, tag = b.column("rid").to_numpy(), b.column("tag").to_numpy()
        for i, j in chunks(off):
            base = off[i]
            t, s, n, a, h, f = anchors(data[base : off[j]], off[i : j + 1] - base, length, gram, roller)
            if len(t):
                yield {
                    "h": as_long(h), "f": as_long(f), "n": n.astype(np.int32),
                    "o": (a - s).astype(np.int32), "rid": rid[i + t], "tag": tag[i + t],
                    "s": (s - (off[i + t] - base)).astype(np.int32),
                }


def anchor_runs(docs: DataFrame, length: int, gram: int, combine: bool) -> DataFrame:
    """Anchor rows of all documents (one per anchor, or one per variant and task if ``combine``)."""

    def run(batches):
        held, size = [], 0

        def flush():
            x = {k: np.concatenate([p[k] for p in held]) for k in held[0]}
            x["c"] = np.ones(len(x["h"]), np.int64)
            if combine:
                o = np.lexsort((x["f"], x["h"]))
                x = {k: v[o] for k, v in x.items()}
                new = np.flatnonzero(np.r_[True, (x["h"][1:] != x["h"][:-1]) | (x["f"][1:] != x["f"][:-1])])
                c = np.diff(np.append(new, len(o)))
                x = {k: v[new] for k, v in x.items()} | {"c": c}
            for i in range(0, len(x["h"]), 100_000):
                yield pa.RecordBatch.from_pydict({k: pa.array(x[k][i : i + 100_000]) for k in ("h", "f", "n", "o", "c", "rid", "tag", "s")})

        for x in _runs(batches, length, gram):
            held.append(x)
            size += len(x["h"])
            if size >= (FLUSH if combine else 50_000):
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return documents_of(docs).select("rid", "tag", "text").mapInArrow(run, _RUN)


def lcp_intervals(lcp: np.ndarray) -> list[tuple[int, int, int]]:
    """Interval tree of an enhanced suffix array by one stack scan: (value, first, last).

    ``lcp[i]`` is the common prefix length of suffixes i-1 and i; ``lcp[0]`` is ignored. Every
    interval of two or more suffixes with a positive common prefix is reported, inner ones first.
    """
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = [(0, 0)]
    n = len(lcp)
    for i, value in enumerate(lcp[1:].tolist() + [0], start=1):
        left = i - 1
        while stack[-1][0] > value:
            v, left = stack.pop()
            out.append((v, left, i - 1))
        if stack[-1][0] < value:
            stack.append((value, left))
    return out if n else []


def _padded(texts: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(texts), width), np.uint8)
    for i, x in enumerate(texts):
        out[i, : len(x)] = np.frombuffer(x, np.uint8)
    return out


def _common(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Common prefix lengths of the rows of two padded matrices with these row lengths."""
    differ = a != b
    d = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(d, np.minimum(na, nb))


def scan_groups(h: np.ndarray, right: list[bytes], left: list[bytes], length: int):
    """Maximal repeats among suffixes sorted by (h, right): (member, low, high, repeat).

    ``right`` is the text from the anchor on, ``left`` the text before it, reversed. A row says that
    the member's windows that start ``low`` to ``high`` bytes before its anchor are repeated by the
    other members of the group with the number ``repeat``.
    """
    m = len(h)
    rn, ln = (np.fromiter(map(len, x), np.int64, m) for x in (right, left))
    rm, lm = _padded(right, max(1, int(rn.max(initial=0)))), _padded(left, max(1, int(ln.max(initial=0))))
    lcp = np.zeros(m, np.int64)
    lcp[1:] = np.where(h[1:] == h[:-1], _common(rm[1:], rm[:-1], rn[1:], rn[:-1]), 0)
    rank = np.empty(m, np.int64)
    rank[np.array(sorted(range(m), key=left.__getitem__), np.int64)] = np.arange(m)
    nodes = lcp_intervals(lcp)
    who, low, high, rep = [], [], [], []
    for number, (value, lo, hi) in enumerate(nodes):
        need = length - value
        x = np.arange(lo, hi + 1)
        x = x[ln[x] >= need]
        if len(x) < 2:
            continue
        x = x[np.argsort(rank[x])]
        same = _common(lm[x[1:]], lm[x[:-1]], ln[x[1:]], ln[x[:-1]])
        near = np.maximum(np.append(same, 0), np.insert(same, 0, 0))
        group = np.cumsum(np.insert(same < need, 0, False))  # left extensions differ: another group
        ok = near >= need
        if ok.any():
            who.append(x[ok])
            low.append(np.full(ok.sum(), max(0, need)))
            high.append(near[ok])
            rep.append(number * 4096 + group[ok])
    if not who:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(v) for v in (who, low, high, rep))


_CONTEXT = "h long, f long, big boolean, once boolean, rid long, tag int, a int, left binary, right binary"
_PART = "g long, u long, t0 int, t1 int, s int, e int, h long, f long, once boolean, rid long, tag int, a int, left binary, right binary"
_SPAN = "rid long, tag int, s int, e int, repeat long, h long, f long, once boolean, run int"


def _pack(batches):
    z = zstandard.ZstdCompressor(level=3)
    for b in batches:
        text = b.column("text").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [b.column("rid"), b.column("tag"), b.column("doc_id").cast(pa.int64()), pa.array([z.compress(x.encode()) for x in text], pa.binary())],
            names=["rid", "tag", "doc_id", "z"],
        )


def packed(docs: DataFrame) -> DataFrame:
    """Documents with their text as compressed bytes, for joins that shuffle it."""
    return documents_of(docs).mapInArrow(_pack, "rid long, tag int, doc_id long, z binary")


def _contexts(variants: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """The text around the anchor of each variant, from the document that stands for it."""
    per_doc = variants.groupBy("rid", "tag").agg(
        F.collect_list(F.struct("h", "f", "c", "big", "s", "n", "o")).alias("v")
    )

    def cut(batches):
        z = zstandard.ZstdDecompressor()
        for b in batches:
            out, size = {k: [] for k in ("h", "f", "big", "once", "rid", "tag", "a", "left", "right")}, 0
            for rid, tag, text, vs in zip(b.column("rid").to_pylist(), b.column("tag").to_pylist(), b.column("z").to_pylist(), b.column("v").to_pylist(), strict=True):
                text = z.decompress(text)
                for v in vs:
                    s, a = v["s"], v["s"] + v["o"]
                    row = (v["h"], v["f"], v["big"], v["c"] == 1, rid, tag, a, text[s:a][::-1], text[a : s + v["n"] - 1 + length])
                    for k, x in zip(out, row, strict=True):
                        out[k].append(x)
                    size += 1
                if size >= 20_000:
                    yield _batch(out, _CONTEXT)
                    out, size = {k: [] for k in out}, 0
            if size:
                yield _batch(out, _CONTEXT)

    joined = packed(docs).drop("doc_id").join(per_doc, ["rid", "tag"])
    return joined.select("rid", "tag", "z", "v").mapInArrow(cut, _CONTEXT)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64()}


def _batch(cols: dict, schema: str) -> pa.RecordBatch:
    kinds = dict(x.split() for x in schema.split(", "))
    return pa.RecordBatch.from_arrays([pa.array(cols[k], _KINDS[kinds[k]]) for k in kinds], names=list(kinds))


def _scan(batches, length: int, every: bool):
    """Scan whole groups (g) of the sorted rows, some thousand rows at a time: k-grams, or parts of them
    with only the windows that start ``t0`` to ``t1`` bytes before the anchor.

    Variants seen twice give rows only if ``every`` occurrence is asked for: their bytes are settled.
    """
    held: dict[str, list] = {}

    def work(x):
        g, h = np.array(x["g"], np.int64), np.array(x["h"], np.int64)
        once, a = np.array(x["once"]), np.array(x["a"], np.int64)
        who, low, high, rep = scan_groups(g, x["right"], x["left"], length)
        low, high = np.maximum(low, np.array(x["t0"], np.int64)[who]), np.minimum(high, np.array(x["t1"], np.int64)[who])
        keep = (once[who] | every) & (low <= high)
        who, low, high, rep = who[keep], low[keep], high[keep], rep[keep]
        if len(who):
            rid, tag = np.array(x["rid"], np.int64), np.array(x["tag"], np.int32)
            run = a - np.fromiter(map(len, x["left"]), np.int64, len(a))
            number = as_long(mix(g[who].astype(U64) + rep.astype(U64)))
            yield pa.RecordBatch.from_pydict({
                "rid": rid[who], "tag": tag[who], "s": (a[who] - high).astype(np.int32),
                "e": (a[who] - low + length).astype(np.int32), "repeat": number,
                "h": h[who], "f": np.array(x["f"], np.int64)[who], "once": once[who], "run": run[who].astype(np.int32),
            })

    for b in batches:
        for k in ("g", "t0", "t1", "h", "f", "once", "rid", "tag", "a", "left", "right"):
            held.setdefault(k, []).extend(b.column(k).to_pylist())
        if len(held["g"]) >= 8192:
            g, cut = held["g"], len(held["g"])
            while cut and g[cut - 1] == g[-1]:  # the last group may go on
                cut -= 1
            if cut:
                yield from work({k: v[:cut] for k, v in held.items()})
                held = {k: v[cut:] for k, v in held.items()}
    if held.get("g"):
        yield from work(held)


def _halves(batches, length: int):
    """Each variant in the two halves of its range of window starts, ``t0`` to ``t1`` bytes before the anchor: ``g`` names
    the half and the text that all its windows share, ``u`` that and all bytes of the variant's windows there."""
    name = lambda *x: int.from_bytes(hashlib.blake2b(b"".join(x), digest_size=8).digest(), "little", signed=True)
    number = lambda x: x.to_bytes(8, "little", signed=True)
    kinds = [k.split()[0] for k in _PART.split(", ")]
    for b in batches:
        out, size = {k: [] for k in kinds}, 0
        for r in b.to_pylist():
            text, at = r["left"][::-1] + r["right"], len(r["left"])
            least = length - len(r["right"])  # the nearest window start of the variant
            mid = (r["t0"] + r["t1"]) // 2
            for t0, t1 in ((r["t0"], mid), (mid + 1, r["t1"])):
                low, high = max(t0, least), min(t1, at)
                if low > high:
                    continue
                g = name(number(r["h"]), number(t0), number(t1), text[at - t0 : at - t1 + length])
                u = name(number(g), number(low), number(high), text[at - high : at - low + length])
                row = r | {"g": g, "u": u, "t0": t0, "t1": t1, "s": r["a"] - high, "e": r["a"] - low + length}
                for k in kinds:
                    out[k].append(row[k])
                size += 1
            if size >= 20_000:
                yield _batch(out, _PART)
                out, size = {k: [] for k in kinds}, 0
        if size:
            yield _batch(out, _PART)


def _split(hot: DataFrame, length: int, max_scan: int, every: bool) -> tuple[list[DataFrame], list[DataFrame]]:
    """Spans of the settled variants of very common k-grams, and groups of at most ``max_scan`` variants to scan."""
    spans, small = [], []
    while not hot.isEmpty():
        parts = staged(hot.mapInArrow(lambda it: _halves(it, length), _PART), "halves")
        equal = staged(parts.groupBy("g", "u").agg(F.count(F.lit(1)).alias("c"), F.min("f").alias("first")), "equal")
        sizes = equal.groupBy("g").agg(F.count(F.lit(1)).alias("texts"), F.sum("c").alias("rows")).where("texts > 1")
        settled = parts.join(equal.where("c > 1").select("g", "u"), ["g", "u"], "left_semi")
        if not every:
            settled = settled.where("once")  # copies of a whole variant are settled with it
        spans.append(settled.select("rid", "tag", "s", "e", F.col("u").alias("repeat"), "h", "f", "once", (F.col("a") - F.length("left")).alias("run")))
        # where occurrences count, equal texts go on together; else one of them does
        going = equal.join(sizes.select("g", F.col("rows" if every else "texts").alias("size")), "g")
        left = parts.join(going.select("g", "u", "first", "size"), ["g", "u"])
        if not every:
            left = left.where("f = first")
        left = staged(left.drop("u", "s", "e", "first"), "split")
        small.append(left.where(F.col("size") <= max_scan).drop("size"))
        hot = left.where(F.col("size") > max_scan).drop("g", "size")
    return spans, small


def maximal_repeats(docs: DataFrame, min_bytes: int = 200, gram: int = GRAM, max_scan: int = MAX_SCAN) -> DataFrame:
    """Every occurrence of every repeat: rows (rid, tag, s, e, repeat).

    Bytes s to e (exclusive) of the row's text stand elsewhere too; occurrences of the same repeat
    share ``repeat``, those in copies of one variant too. Repeats are cut to the window of one anchor; neighbouring ones overlap, so
    the union of a document's spans is exactly its bytes in repeated strings of ``min_bytes``.
    (rid, tag) are those of ``common.documents_of``.
    """
    return _repeats(docs, min_bytes, gram, max_scan, every=True)


def _repeats(docs: DataFrame, min_bytes: int, gram: int, max_scan: int, every: bool) -> DataFrame:
    """Rows of ``maximal_repeats``; unless ``every``, only as many as cover all repeated bytes."""
    if not 8 <= gram < min_bytes:
        raise ValueError("gram must be at least 8 and below min_bytes")
    by_gram = Window.partitionBy("h")
    variants = (
        anchor_runs(docs, min_bytes, gram, combine=True)
        .repartition("h")
        .groupBy("h", "f", "n", "o")
        .agg(F.sum("c").alias("c"), F.min(F.struct("rid", "tag", "s")).alias("at"))
        .withColumn("nv", F.count(F.lit(1)).over(by_gram))
        .where("c > 1 or nv > 1")
        .select("h", "f", "n", "o", "c", "nv", "at.*")
    )
    variants = staged(variants, "variants")

    whole = variants.where("c > 1").select("h", "f")
    runs = anchor_runs(docs, min_bytes, gram, combine=False).select(
        "h", "f", "rid", "tag", "s", "n"
    )
    settled = runs.join(whole, ["h", "f"], "left_semi").select(
        "rid", "tag", "s", (F.col("s") + F.col("n") - 1 + min_bytes).alias("e"),
        F.xxhash64("h", "f").alias("repeat"),
    )

    several = variants.where("nv > 1").withColumn("big", F.col("nv") > max_scan)
    ctx = _contexts(several, docs, min_bytes)
    ctx = staged(ctx, "contexts")
    wide = ctx.withColumns({"g": F.col("h"), "t0": F.lit(0), "t1": F.lit(min_bytes - gram)})
    spans, small = _split(wide.where("big").drop("g", "big"), min_bytes, max_scan, every)
    groups = reduce(DataFrame.unionByName, small, wide.where("not big").drop("big"))
    scanned = (
        groups.repartition("g")
        .sortWithinPartitions("g", "right")
        .mapInArrow(lambda it: _scan(it, min_bytes, every), _SPAN)
    )
    span = ["rid", "tag", "s", "e", "repeat"]
    found = reduce(DataFrame.unionByName, spans, scanned)
    if not every:
        return settled.unionByName(found.select(*span))
    found = staged(found, "found")
    # a variant seen twice stands for all its runs: its rows, from the run's start, go to each of them
    of_variant = found.where(~F.col("once")).select(
        "h", "f", "repeat", (F.col("s") - F.col("run")).alias("from"), (F.col("e") - F.col("run")).alias("to")
    )
    copies = runs.join(of_variant, ["h", "f"]).select(
        "rid", "tag", (F.col("s") + F.col("from")).alias("s"), (F.col("s") + F.col("to")).alias("e"), "repeat"
    )
    return settled.unionByName(found.where("once").select(*span)).unionByName(copies).distinct()


def _merge(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in (() if spans is None else spans)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _spans_by_row(docs: DataFrame, min_bytes: int, gram: int, max_scan: int) -> DataFrame:
    spans = _repeats(docs, min_bytes, gram, max_scan, every=False)
    return spans.groupBy("rid", "tag").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def remove_repeats(docs: DataFrame, min_bytes: int = 200, gram: int = GRAM, max_scan: int = MAX_SCAN) -> DataFrame:
    """Documents without their repeated bytes: (rid, tag, doc_id, n_bytes, spans, kept).

    ``kept`` is what is left, as bytes; ``spans`` the maximal removed runs as (s, e) pairs.
    """
    per_doc = _spans_by_row(docs, min_bytes, gram, max_scan)

    def cut(batches):
        z = zstandard.ZstdDecompressor()
        for b in batches:
            cols = [b.column(k).to_pylist() for k in ("rid", "tag", "doc_id", "z", "spans")]
            n, done, kept = [], [], []
            for packed_text, spans in zip(cols[3], cols[4], strict=True):
                text = z.decompress(packed_text)
                gone = _merge(spans)
                edge = [0, *(x for p in gone for x in p), len(text)]
                n.append(len(text))
                done.append(gone)
                kept.append(b"".join(text[edge[i] : edge[i + 1]] for i in range(0, len(edge), 2)) if gone else text)
            yield pa.RecordBatch.from_arrays(
                [b.column("rid"), b.column("tag"), b.column("doc_id"), pa.array(n, pa.int64()),
                 pa.array([[{"s": s, "e": e} for s, e in x] for x in done], pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))),
                 pa.array(kept, pa.binary())],
                names=["rid", "tag", "doc_id", "n_bytes", "spans", "kept"],
            )

    joined = packed(docs).join(per_doc, ["rid", "tag"], "left").select("rid", "tag", "doc_id", "z", "spans")
    return joined.mapInArrow(
        cut, "rid long, tag int, doc_id long, n_bytes long, spans array<struct<s:int,e:int>>, kept binary"
    )


def digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return _digest(remove_repeats(docs))


def _digest(removed: DataFrame) -> DataFrame:
    return removed.select(
        "doc_id", "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def _without(text: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for t, sp in zip(text, spans, strict=True):
        if sp is None or not len(sp):
            out.append(t)
            continue
        data = (t or "").encode()
        gone = _merge(sp)
        edge = [0, *(x for p in gone for x in p), len(data)]
        out.append(b"".join(data[edge[i] : edge[i + 1]] for i in range(0, len(edge), 2)).decode("utf-8", "ignore"))
    return pd.Series(out, dtype=object)


def cleaned(docs: DataFrame, min_bytes: int = 200) -> DataFrame:
    """``docs`` with the repeated bytes gone from ``text`` and ``n_chars`` (if there) counted anew.

    A character that loses some of its bytes goes with them. Every row stays.
    """
    per_doc = _spans_by_row(docs, min_bytes, GRAM, MAX_SCAN)
    per_doc = per_doc.select(F.col("rid").alias("__rid"), F.col("tag").alias("__tag"), F.col("spans").alias("__spans"))
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumns({"__rid": F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)), "__tag": F.hash(text)})
    out = keyed.join(per_doc, ["__rid", "__tag"], "left").withColumn("text", F.pandas_udf(_without, StringType())("text", "__spans"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(kind)))
    return out.select(*docs.columns)
