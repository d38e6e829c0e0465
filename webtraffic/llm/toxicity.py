"""Toxicity by class-conditional Kneser-Ney models.

Expressions are words; a word is spelled by the bytes of its lower-case form (A-Z only) between a
start and an end mark. One model for each class gives the probability of a byte after the four
before it. Both discount their own counts and back off to one shared Kneser-Ney model, whose
counts are gathered from all documents: rare spellings get the same probability from both and so
no evidence, while a spelling that the toxic class knows and the ordinary class has had every
chance to show gets much.

A text's log-likelihoods under the two models are compared by length: per byte over the whole
text, and for the expressions that differ most, as a sum and per byte. A logistic curve turns
these comparisons into a score; it is fitted on at most ``FIT_ROWS`` labelled rows of one half of
the training rows, scored by models whose class counts come from the other half. Everything else
covers all rows.

Every n-gram counts, whatever the corpus. Up to ``2**SLOT_BITS`` of them, the most frequent, are held
by every worker; a word that has others is completed by a join with the table of evidence. Those
are rare by their choice, so few places are joined and no key of the join is hot.

Null and empty texts have no words: their comparisons are 0. Labels that are null or belong to no
document are ignored, several labels of one document count as toxic if one is. With only one class
among the training rows every score is that class's smoothed share. Repeated rows are scored alike.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtraffic.llm.common import U64, buffers, chunks, mix, staged

ORDER = 5          #: bytes of an n-gram; 8 * ORDER bits are its key
DISCOUNT = 0.75
SLOT_BITS = 22     #: 2 to this power n-grams at most are held by every worker; others are joined
FIT_ROWS = 20_000
CUT = 0.7
HELD_OUT = 1       #: crc32(doc_id) mod 3 of rows whose labels are not used

_END = 1
_WORD = np.zeros(256, bool)
_WORD[128:] = _WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_BYTE = np.arange(256, dtype=np.uint64)
_BYTE[65:91] += U64(32)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3; 0 where the id is null."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)), F.lit(0))


def spelled(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-gram keys of all words in the texts of ``data``: (keys, first key of each word, its text).

    A key packs the ORDER - 1 bytes before a byte and the byte itself; before a word's first byte
    stand zeros, after its last byte the end mark.
    """
    inside = _WORD[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    prev = np.zeros(n, bool)
    prev[1:] = inside[:-1]
    start = inside & (~prev | edge[:-1])
    s = np.flatnonzero(start)
    if not len(s):
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    # words one after another, each followed by its end mark
    at = np.flatnonzero(inside)
    word = np.cumsum(start[at]) - 1
    place = np.arange(len(at)) + word
    seq = np.full(len(at) + len(s), _END, U64)
    seq[place] = _BYTE[data[at]]
    first = place[np.flatnonzero(start[at])]
    since = np.arange(len(seq)) - np.repeat(first, np.diff(np.append(first, len(seq))))
    key = seq.copy()
    for k in range(1, ORDER):
        key[k:] |= np.where(since[k:] >= k, seq[:-k] << U64(8 * k), U64(0))
    return key, first, np.searchsorted(offsets, s, side="right") - 1


def _counted(batches, columns: list[str]):
    """Counts of n-grams; a row counts in the column that its ``column`` names."""
    held: list[list[np.ndarray]] = [[] for _ in columns]
    size = 0

    def flush():
        for c, parts in enumerate(held):
            if parts:
                keys, n = _summed(parts)
                for i in range(0, len(keys), 100_000):
                    part = {"key": pa.array(keys[i : i + 100_000].view(np.int64))}
                    for j, name in enumerate(columns):
                        part[name] = pa.array(n[i : i + 100_000] if j == c else np.zeros(len(part["key"]), np.int64))
                    yield pa.RecordBatch.from_pydict(part)

    for b in batches:
        off, data = buffers(b.column("text"))
        column = b.column("column").to_numpy()
        for i, j in chunks(off, 1 << 20, 4096):
            for c in np.unique(column[i:j]).tolist():
                rows = np.flatnonzero(column[i:j] == c) + i
                if len(rows) == j - i:
                    part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                else:
                    part = np.concatenate([data[off[r] : off[r + 1]] for r in rows])
                    o = np.concatenate([[0], np.cumsum(off[rows + 1] - off[rows])])
                keys = spelled(part, o)[0]
                if len(keys):
                    held[c].append(np.stack(np.unique(keys, return_counts=True)).astype(U64))
                    size += held[c][-1].shape[1]
        if size > 3_000_000:
            merged = [[np.stack(_summed(p)).astype(U64)] if p else [] for p in held]
            if sum(p[0].shape[1] for p in merged if p) > 1_500_000:
                held = merged
                yield from flush()
                held, size = [[] for _ in columns], 0
            else:
                held, size = merged, sum(p[0].shape[1] for p in merged if p)
    yield from flush()


def _summed(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    both = np.concatenate(parts, axis=1)
    o = np.argsort(both[0], kind="stable")
    keys = both[0][o]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[new], np.add.reduceat(both[1][o], new).astype(np.int64)


def gram_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, n, n0a, n1a, n0b, n1b): counts in all documents, and by class in each training half."""
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    names = ["n", "n0a", "n1a", "n0b", "n1b"]
    schema = "key long, " + ", ".join(f"{c} long" for c in names)
    everything = docs.select(text, F.lit(0).alias("column"))
    known = (
        labels.where(F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
        .groupBy("doc_id").agg(F.max("toxic").alias("__toxic")).hint("merge")  # labels grow with documents
    )
    train = docs.where(fold(F.col("doc_id")) != HELD_OUT).select("doc_id", text).join(known, "doc_id")
    half = F.when(fold(F.col("doc_id")) == 0, 1).otherwise(3)
    train = train.select("text", (half + F.col("__toxic")).cast("int").alias("column"))

    def count(it):
        return _counted(it, names)

    both = everything.mapInArrow(count, schema).unionByName(train.mapInArrow(count, schema))
    return staged(both.groupBy("key").agg(*(F.sum(c).alias(c) for c in names)), "grams")


def shared_model(grams: DataFrame, order: int = ORDER, discount: float = DISCOUNT) -> DataFrame:
    """(key, p): interpolated Kneser-Ney probability of each n-gram's last byte after the others.

    The longest n-grams count occurrences, shorter ones the different bytes before them.
    """
    low = lambda k: F.lit((1 << 8 * k) - 1)
    level = {order: grams.select("key", F.col("n").alias("c"))}
    for k in range(order - 1, 0, -1):
        level[k] = level[k + 1].groupBy(F.col("key").bitwiseAND(low(k)).alias("key")).agg(F.count("*").alias("c"))
    p = None
    for k in range(1, order + 1):
        t = level[k].withColumn("ctx", F.shiftright("key", 8))
        t = t.join(t.groupBy("ctx").agg(F.sum("c").alias("total"), F.count("*").alias("kinds")), "ctx")
        below = F.lit(1 / 256)
        if p is not None:
            t = t.withColumn("short", F.col("key").bitwiseAND(low(k - 1)))
            t = t.join(p.select(F.col("key").alias("short"), F.col("p").alias("below")), "short")
            below = F.col("below")
        own = F.greatest(F.col("c") - discount, F.lit(0.0)) / F.col("total")
        p = t.select("key", (own + discount * F.col("kinds") / F.col("total") * below).alias("p"))
    return staged(p, "shared")


def class_evidence(grams: DataFrame, shared: DataFrame, discount: float = DISCOUNT) -> DataFrame:
    """(key, n, full, half): log-likelihood ratios of all n-grams under the models of both halves and
    of the first half, and their counts in all documents.

    An n-gram that neither class has seen has, in both models, the shared probability times what the
    context leaves to backoff, so only those shares remain of the ratio: 0 if the context is new too.
    """
    models = {"full": (F.col("n0a") + F.col("n0b"), F.col("n1a") + F.col("n1b")), "half": (F.col("n0a"), F.col("n1a"))}
    columns = [n.alias(f"{m}_n{y}") for m, pair in models.items() for y, n in enumerate(pair)]
    t = grams.select("key", "n", F.shiftright("key", 8).alias("ctx"), *columns)
    sums = []
    for m in models:
        for y in (0, 1):
            sums += [F.sum(f"{m}_n{y}").alias(f"{m}_s{y}"), F.sum((F.col(f"{m}_n{y}") > 0).cast("long")).alias(f"{m}_k{y}")]
    ctx = t.where("full_n0 + full_n1 > 0").groupBy("ctx").agg(*sums)

    def rest(m, y):
        return F.when(F.col(f"{m}_s{y}") > 0, discount * F.col(f"{m}_k{y}") / F.col(f"{m}_s{y}")).otherwise(1.0)

    def log_p(m, y):
        own = F.greatest(F.col(f"{m}_n{y}") - discount, F.lit(0.0)) / F.col(f"{m}_s{y}")
        return F.log(F.when(F.col(f"{m}_s{y}") > 0, own).otherwise(0.0) + rest(m, y) * F.col("p"))

    def ratio(m):
        seen = F.col(f"{m}_n0") + F.col(f"{m}_n1") > 0
        return F.when(seen, log_p(m, 1) - log_p(m, 0)).otherwise(F.log(rest(m, 1)) - F.log(rest(m, 0))).cast("float").alias(m)

    return staged(t.join(ctx, "ctx", "left").join(shared, "key").select("key", "n", ratio("full"), ratio("half")), "evidence")


def held_and_rest(evidence: DataFrame, bits: int = SLOT_BITS) -> tuple[DataFrame, DataFrame | None]:
    """The n-grams that every worker holds, and those to be joined (None: there are none).

    At most ``2**bits`` are held. If there is more evidence, they are the most frequent, so that
    each of the others has a share of less than ``2 / 2**bits`` of all places.
    """
    useful = evidence.where("full != 0 or half != 0")
    if useful.count() <= 1 << bits:
        return useful, None  # what is not held has ratio 0
    size = F.length(F.bin("n"))
    least, room = 65, 1 << bits
    for r in evidence.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():  # 64 rows at most
        room -= r["count"]
        if room < 0:
            break
        least = r["size"]
    return evidence.where(size >= least), useful.where(size < least)


class Scorer:
    """Log-likelihood ratios of n-gram keys under two models, from an open-addressed table.

    Keys stand there whole, so none is taken for another; 0 is no key.
    """

    def __init__(self, key: np.ndarray, ratios: list[np.ndarray], whole: bool = True):
        bits = max(4, (2 * len(key)).bit_length())
        self.whole, self.shift, self.last = whole, U64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, U64)
        self.values = [np.zeros(1 << bits, np.float32) for _ in ratios]
        todo, slot = np.arange(len(key)), self._slot(key)
        while len(todo):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = key[todo[free]]  # of several for one slot the last
            won = self.keys[slot] == key[todo]
            for table, ratio in zip(self.values, ratios, strict=True):
                table[slot[won]] = ratio[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & self.last

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (mix(key) >> self.shift).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The slot of each key, a free one where it is not held."""
        slot = self._slot(key)
        there = self.keys[slot]
        todo = np.flatnonzero((there != key) & (there != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.last
            there = self.keys[slot[todo]]
            todo = todo[(there != key[todo]) & (there != 0)]
        return slot

    def compare(self, data: np.ndarray, offsets: np.ndarray):
        """Per text: bytes and number of its words, and for each model the sum of the words' ratios,
        the two largest, and the largest per byte (0 at least).

        Words with n-grams that are not held take no part in these; they come as (text, bytes of the
        word, sums of what is held, n-grams that are not held), empty if all evidence is held.
        """
        n = len(offsets) - 1
        size, words, out = np.zeros(n, np.int64), np.zeros(n, np.int64), [np.zeros((n, 4)) for _ in self.values]
        key, first, text = spelled(data, offsets)
        if not len(first):
            return size, words, out, []
        slot = self.find(key)
        length = np.diff(np.append(first, len(key)))
        begin = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        owner = text[begin]
        many = np.diff(np.append(begin, len(text)))
        size[owner], words[owner] = np.add.reduceat(length, begin), many
        sums = [np.add.reduceat(table[slot].astype(np.float64), first) for table in self.values]
        rest = []
        if not self.whole:
            missing = self.keys[slot] != key
            open_ = np.flatnonzero(np.logical_or.reduceat(missing, first))
            for w in open_.tolist():
                at = slice(first[w], first[w] + length[w])
                rest.append((int(text[w]), int(length[w]), [float(x[w]) for x in sums], key[at][missing[at]].tolist()))
            for x in sums:
                x[open_] = 0
        for x, o in zip(sums, out, strict=True):
            o[owner, 0] = np.add.reduceat(x, begin)
            top = np.maximum.reduceat(x, begin)
            o[owner, 1] = np.maximum(top, 0)
            again = x.copy()
            peak = np.flatnonzero(x == np.repeat(top, many))
            _, once = np.unique(np.repeat(np.arange(len(begin)), many)[peak], return_index=True)
            again[peak[once]] = 0
            o[owner, 2] = np.maximum(np.maximum.reduceat(again, begin), 0)
            o[owner, 3] = np.maximum(np.maximum.reduceat(x / length, begin), 0)
        return size, words, out, rest


_NAMES = ["c0", "c1", "c2", "c3", "c4"]
_PARTS = ["sum", "top", "second", "peak"]
_MODELS = ["full", "half"]
_COMPARED = (
    "row long, doc_id long, place long, probe boolean, size long, words long, "
    + ", ".join(f"{m}_{p} double" for m in _MODELS for p in _PARTS)
    + ", open array<struct<size:int,full:double,half:double,keys:array<long>>>"
)
_OPEN = pa.list_(pa.struct([("size", pa.int32()), ("full", pa.float64()), ("half", pa.float64()), ("keys", pa.list_(pa.int64()))]))


_scorers: dict[str, Scorer] = {}  # of one run, kept by a worker between its tasks


def _compared(batches, run: str, held, whole: bool):
    if run not in _scorers:
        _scorers.clear()
        _scorers[run] = Scorer(held.value[0], held.value[1:], whole)
    scorer, row = _scorers[run], TaskContext.get().partitionId() << 36
    for b in batches:
        off, data = buffers(b.column("text"))
        for i, j in chunks(off, 1 << 18, 4096):
            size, words, out, rest = scorer.compare(data[off[i] : off[j]], off[i : j + 1] - off[i])
            open_ = [[] for _ in range(j - i)]
            for t, length, (full, half), keys in rest:
                open_[t].append({"size": length, "full": full, "half": half, "keys": keys})
            part = b.slice(i, j - i)
            columns = {"row": pa.array(np.arange(row, row + j - i)), "doc_id": part.column("doc_id"), "place": part.column("place"), "probe": part.column("probe")}
            columns |= {"size": pa.array(size), "words": pa.array(words)}
            columns |= {f"{m}_{p}": pa.array(out[x][:, y]) for x, m in enumerate(_MODELS) for y, p in enumerate(_PARTS)}
            yield pa.RecordBatch.from_pydict(columns | {"open": pa.array(open_, _OPEN)})
            row += j - i


def with_rest(compared: DataFrame, rest: DataFrame) -> DataFrame:
    """``compared`` with the words that need n-grams of ``rest`` brought in."""
    words = compared.where(F.size("open") > 0).select("row", F.posexplode("open").alias("word", "o")).select("row", "word", "o.*")
    grams = words.select("row", "word", "size", *(F.col(m).alias(f"held_{m}") for m in _MODELS), F.explode("keys").alias("key"))
    whole = grams.join(rest.select("key", *_MODELS), "key", "left").groupBy("row", "word").agg(
        F.first("size").alias("length"),
        *((F.first(f"held_{m}") + F.sum(F.coalesce(F.col(m).cast("double"), F.lit(0.0)))).alias(m) for m in _MODELS),
    )
    more = []
    for m in _MODELS:
        best = F.slice(F.sort_array(F.collect_list(m), asc=False), 1, 2)
        more += [F.sum(m).alias(f"more_{m}"), best.alias(f"best_{m}"), F.max(F.col(m) / F.col("length")).alias(f"ratio_{m}")]
    both = compared.join(whole.groupBy("row").agg(*more), "row", "left")
    columns = {}
    for m in _MODELS:
        top = F.sort_array(F.concat(F.array(f"{m}_top", f"{m}_second"), F.coalesce(f"best_{m}", F.array().cast("array<double>"))), asc=False)
        columns |= {
            f"{m}_sum": F.col(f"{m}_sum") + F.coalesce(f"more_{m}", F.lit(0.0)),
            f"{m}_top": top[0], f"{m}_second": top[1],
            f"{m}_peak": F.greatest(f"{m}_peak", f"ratio_{m}"),
        }
    return both.withColumns(columns).select(*compared.columns)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights (bias last) of a logistic curve by Newton steps; columns are scaled inside."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    flat = np.append(np.zeros(x.shape[1]), math.log(share / (1 - share)))
    if y.min(initial=1) == y.max(initial=0) or not len(y):
        return flat
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    a = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    w[-1] = flat[-1]
    hold = np.full(a.shape[1], ridge)
    hold[-1] = 0
    loss = lambda v: np.logaddexp(0, np.where(y == 1, -(a @ v), a @ v)).sum() + 0.5 * (hold * v * v).sum()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + hold * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(hold + 1e-9), grad)
        t, now = 1.0, loss(w)
        while loss(w - t * step) > now and t > 1e-4:
            t /= 2
        w = w - t * step
        if np.abs(t * step).max() < 1e-6:
            break
    return np.append(w[:-1] / scale, w[-1])


def scored(docs: DataFrame, labels: DataFrame, bits: int = SLOT_BITS) -> DataFrame:
    """One row per document: (doc_id, place, held_out, score, predicted).

    ``place`` is a hash of id and text, for joins back to ``docs``.
    """
    spark = docs.sparkSession
    grams = gram_counts(docs, labels)
    shared = shared_model(grams)
    held, rest = held_and_rest(class_evidence(grams, shared), bits)
    table = held.select("key", *_MODELS).toArrow()  # 2**bits rows at most
    key, full, half = (table.column(c).to_numpy() for c in ("key", *_MODELS))
    model = spark.sparkContext.broadcast((key.astype(U64), full.astype(np.float32), half.astype(np.float32)))
    whole = rest is None
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text).alias("place"),
        (fold(F.col("doc_id")) == 2).alias("probe"), text.alias("text"),
    )
    run = uuid.uuid4().hex
    compared = staged(rows.mapInArrow(lambda it: _compared(it, run, model, whole), _COMPARED), "compared")
    if rest is not None:
        compared = staged(with_rest(compared, rest), "complete")
    figures = []
    for m, start in zip(_MODELS, ("", "h"), strict=True):
        share = F.when(F.col("size") > 0, F.col(f"{m}_sum") / F.col("size")).otherwise(0.0)
        parts = [share, F.col(f"{m}_top"), F.col(f"{m}_second"), F.col(f"{m}_peak"), F.log1p("words")]
        figures += [x.alias(f"{start}{c}") for x, c in zip(parts, _NAMES, strict=True)]
    compared = compared.select("doc_id", "place", "probe", *figures)
    known = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    fit = (
        compared.where("probe").join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "place").limit(FIT_ROWS)
        .select("toxic", *(f"h{c}" for c in _NAMES)).toArrow()
    )  # a bounded sample, as documented
    x = np.column_stack([fit.column(f"h{c}").to_numpy() for c in _NAMES])
    w = fit_logistic(x, fit.column("toxic").to_numpy().astype(float))
    z = F.lit(float(w[-1]))
    for c, weight in zip(_NAMES, w[:-1].tolist(), strict=True):
        z = z + F.col(c) * weight
    score = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
    return compared.select("doc_id", "place", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= CUT).cast("int")
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted toxic."""
    bad = scored(docs, labels).where("predicted = 1").select(F.col("place").alias("__place")).distinct()
    place = F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit("")))
    return docs.withColumn("__place", place).join(bad, "__place", "left_anti").drop("__place")
