"""Cross-tokenizer alignment by merge-path partitioning.

Two tokenizers cut the same bytes into tokens A and B. Merging the two sorted lists of token ends gives every
stretch of bytes on which one A and one B token overlap; ends that both have cut the text into groups.

The lists of all documents of a batch are one long merge, since documents stand behind one another.
``diagonals`` cuts it into pieces of equal work, whatever the documents' lengths: a binary search on each diagonal finds how many
ends of either list come first. Pieces are merged independently and emit their overlaps; a group that
crosses pieces is stitched by numbering cuts on from the pieces before.

``aligned`` writes one row for each document: its counts, the digest of its groups, and its links (the pairs
of tokens that end together) as packed pair numbers. ``pair_counts`` adds links up over all documents, first
within tasks. The ``TABLE`` most frequent pairs are sent to the tasks that sum up the documents' counts, 24 bytes
each; links of rarer pairs, if there are any, are joined with the counts instead.

A null or empty text, and one that a tokenizer does not give back byte for byte, has no tokens: zeros
and no digest. Null ids stay null, and repeated rows are aligned and counted each. Columns other than doc_id and text
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webtraffic.llm.common import buffers, chunks, staged

A = "byte_bpe_50k"             #: rank file of the byte-level BPE; the tokenizer file has the same vocabulary
B = "piece_bpe_32k.model"
WORK = 1 << 13                 #: ends merged by one piece
TABLE = 1 << 20                #: most frequent pairs sent to all tasks
BYTES = 1 << 18                #: text bytes merged at once
LINKS = 1 << 22                #: bytes of packed links looked at at once


class Encoded(NamedTuple):
    """Two token sequences of several documents, and the places where documents begin in both."""

    a: np.ndarray
    b: np.ndarray
    a_end: np.ndarray
    b_end: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray


class Pair:
    """Both tokenizers with the bytes of each token. Built once a worker."""

    def __init__(self, a: str, b: str):
        import public_tokenizers as P
        import sentencepiece
        import tiktoken

        with open(P.path(f"{a}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        self.enc_a = tiktoken.Encoding("a", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.enc_b = sentencepiece.SentencePieceProcessor(model_file=P.path(b))
        self.bytes_a = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
        n = self.enc_b.get_piece_size()
        self.bytes_b = [self._piece(i) for i in range(n)]
        self.len_a, self.len_b = (np.array([len(t) for t in x]) for x in (self.bytes_a, self.bytes_b))
        # a token's number with what follows it in a digest: , within a side, | between sides, ; between groups
        numbers = range(max(len(self.bytes_a), n))
        self.size = len(numbers)
        self.text = [f"{i}{s}" for s in ",|;" for i in numbers]

    def _piece(self, i: int) -> bytes:
        if self.enc_b.is_byte(i):
            return bytes([int(self.enc_b.id_to_piece(i)[3:-1], 16)])
        return self.enc_b.id_to_piece(i).replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """A's and B's ids of each text; none where a side's bytes are not a space and the text."""
        for text, b in zip(texts, self.enc_b.encode(texts, num_threads=1), strict=True):
            a = self.enc_a.encode_ordinary(" " + text) if text else []
            raw = b" " + text.encode()
            same = all(b"".join(map(of.__getitem__, ids)) == raw for of, ids in ((self.bytes_a, a), (self.bytes_b, b)))
            yield (a, b) if same else ([], [])

    def encoded(self, texts: list[str]) -> Encoded:
        ids = list(self.encode(texts))
        flat = [np.array([i for d in ids for i in d[side]], np.int64) for side in (0, 1)]
        at = [np.cumsum([0] + [len(d[side]) for d in ids]) for side in (0, 1)]
        return Encoded(*flat, np.cumsum(self.len_a[flat[0]]), np.cumsum(self.len_b[flat[1]]), *at)


@lru_cache(maxsize=2)
def pair(a: str = A, b: str = B) -> Pair:
    return Pair(a, b)


def diagonals(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut the merge of two increasing lists into pieces of ``work`` steps: how many of ``a`` and of ``b`` stand before
    each cut. On diagonal d, i of ``a`` and d - i of ``b`` come first; the smallest i for which the
    next of ``a`` is behind the last of ``b`` is found by binary search, for all diagonals at once. Two equal
    values stay together."""
    d = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    lo, hi = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        first = np.zeros(len(d), bool)
        first[open_] = a[mid[open_]] <= b[d[open_] - 1 - mid[open_]]
        lo, hi = np.where(open_ & first, mid + 1, lo), np.where(open_ & ~first, mid, hi)
    i, j = lo, d - lo
    tied = (i > 0) & (j < len(b))
    tied[tied] = a[i[tied] - 1] == b[j[tied]]
    return i, j + tied


class Overlaps(NamedTuple):
    """Overlaps in order: the byte where each ends, its A and its B token, and whether both end there."""

    end: np.ndarray
    a: np.ndarray
    b: np.ndarray
    cut: np.ndarray


def merge_piece(a_end: np.ndarray, b_end: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> Overlaps:
    """The overlaps that end at one of ``a_end[i0:i1]`` or ``b_end[j0:j1]``."""
    mine_a, mine_b = a_end[i0:i1], b_end[j0:j1]
    end = np.union1d(mine_a, mine_b)
    a, b = i0 + np.searchsorted(mine_a, end), j0 + np.searchsorted(mine_b, end)
    both = np.isin(end, mine_a, assume_unique=True) & np.isin(end, mine_b, assume_unique=True)
    return Overlaps(end, a, b, both)


def overlaps(a_end: np.ndarray, b_end: np.ndarray, work: int = WORK) -> Overlaps:
    """All overlaps, piece by piece. A token that ends behind its piece is the first of the next one."""
    i, j = diagonals(a_end, b_end, work)
    pieces = [merge_piece(a_end, b_end, *i[k : k + 2], *j[k : k + 2]) for k in range(len(i) - 1)]
    return Overlaps(*(np.concatenate(c) for c in zip(*pieces, strict=True))) if pieces else Overlaps(*[np.zeros(0, np.int64)] * 3, np.zeros(0, bool))


def stitched(a_end: np.ndarray, b_end: np.ndarray, found: Overlaps) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A and of each B token: the number of cuts before its end."""
    cuts = found.end[found.cut]
    return np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)


def _digests(p: Pair, e: Encoded, group_a: np.ndarray, group_b: np.ndarray) -> list[str]:
    """Each document's groups as text, hashed; empty without tokens."""
    key = np.concatenate([2 * group_a, 2 * group_b + 1])
    order = np.argsort(key, kind="stable")
    key, ids = key[order], np.concatenate([e.a, e.b])[order]
    after = np.append(key[1:], -1)
    mark = np.where(after == key, 0, np.where((after == key + 1) & (key % 2 == 0), 1, 2))
    parts = list(map(p.text.__getitem__, (ids + mark * p.size).tolist()))
    at = (e.a_at + e.b_at).tolist()
    return [hashlib.sha256("".join(parts[s:t])[:-1].encode()).hexdigest() if t > s else "" for s, t in zip(at, at[1:], strict=False)]


_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"


def _by_bytes(batches, names: tuple[str, ...]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of about ``BYTES`` of text."""
    for b in batches:
        for i, j in chunks(buffers(b.column("text"))[0], BYTES, 4096):
            part = b.slice(i, j - i)
            yield part.select(names), part.column("text").to_pylist()


def _align(batches, a: str, b: str, work: int):
    p = pair(a, b)
    for rows, texts in _by_bytes(batches, ("doc_id",)):
        e = p.encoded(texts)
        found = overlaps(e.a_end, e.b_end, work)
        groups = stitched(e.a_end, e.b_end, found)
        end, ia, ib = (x[found.cut] for x in found[:3])  # links: overlaps whose tokens end together
        key = e.a[ia] * len(p.bytes_b) + e.b[ib]
        at = np.searchsorted(ia, e.a_at)  # a document's first link is at or behind its first token
        n = np.diff(at)
        links = [key[s:t].tobytes() for s, t in zip(at, at[1:], strict=False)]
        cols = [rows.column("doc_id"), *(pa.array(x, pa.int64()) for x in (np.diff(e.a_at), np.diff(e.b_at), n, n)), pa.array(_digests(p, e, *groups)), pa.array(links, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def aligned(docs: DataFrame, a: str = A, b: str = B, work: int = WORK) -> DataFrame:
    """One written row for each document, with a number ``row`` of its own."""
    rows = _rows(docs).mapInArrow(lambda it: _align(it, a, b, work), _ALIGNED)
    return staged(rows.withColumn("row", F.monotonically_increasing_id()), "aligned")


_GROUP = "doc_id long, group_no long, byte_from long, byte_to long, a_ids array<long>, b_ids array<long>"


def groups(docs: DataFrame, a: str = A, b: str = B, work: int = WORK) -> DataFrame:
    """The groups themselves: (doc_id, group_no, byte_from, byte_to, a_ids, b_ids), bytes of a space and the text."""

    def emit(batches):
        p = pair(a, b)
        for rows, texts in _by_bytes(batches, ("doc_id",)):
            e = p.encoded(texts)
            found = overlaps(e.a_end, e.b_end, work)
            to = np.append(0, found.end[found.cut])
            lists = [
                pa.ListArray.from_arrays(pa.array(np.searchsorted(g, np.arange(len(to))), pa.int32()), pa.array(ids))
                for g, ids in zip(stitched(e.a_end, e.b_end, found), (e.a, e.b), strict=True)
            ]
            first = np.searchsorted(found.a[found.cut], e.a_at)
            n, base = np.diff(first), np.append(0, e.a_end)[e.a_at[:-1]]
            doc = np.repeat(np.arange(len(texts)), n)
            cols = [rows.column("doc_id").take(pa.array(doc)), pa.array(np.arange(len(doc)) - first[:-1][doc]), pa.array(to[:-1] - base[doc]), pa.array(to[1:] - base[doc]), *lists]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in _GROUP.split(", ")])

    return _rows(docs).mapInArrow(emit, _GROUP)


def _links(batches, size: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(slice of rows, pair numbers of these rows, where each row's begin); about ``size`` bytes of links a slice, and one row
    at least."""
    for b in batches:
        at, data = buffers(b.column("links"))
        for i, j in chunks(at, size or LINKS, 1 << 14):
            yield b.slice(i, j - i), data[at[i] : at[j]].view(np.int64), (at[i : j + 1] - at[i]) // 8


def pair_counts(rows: DataFrame, n_b: int) -> DataFrame:
    """(key, n, best): links of each pair over all documents, and whether no pair of its B token has more."""

    def count(batches):
        for _, links, _ in _links(batches):
            key, n = np.unique(links, return_counts=True)
            yield pa.RecordBatch.from_pydict({"key": key, "n": n})

    summed = rows.select("links").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    same_b = Window.partitionBy("b")  # as many rows as A has tokens, at most
    ranked = summed.withColumn("b", F.col("key") % n_b).withColumn("most", F.max("n").over(same_b))
    return staged(ranked.select("key", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def link_sums(rows: DataFrame, counts: DataFrame, table: int = TABLE) -> DataFrame:
    """(row, n_best, count_sum): over each document's links, how many are their B token's most frequent ones, and the sum of
    the counts."""
    frequent = counts.orderBy(F.desc("n"), "key").limit(table).orderBy("key").toArrow()
    keys, n, best = (frequent.column(c).to_numpy() for c in ("key", "n", "best"))
    sent = rows.sparkSession.sparkContext.broadcast((keys, n.astype(np.int64), best.astype(np.int64)))

    def look_up(links):
        keys, n, best = sent.value
        at = np.searchsorted(keys, links)
        at[at == len(keys)] = 0
        known = keys[at] == links if len(keys) else np.zeros(len(links), bool)
        return known, at, n, best

    def sums(batches):
        for b, links, begin in _links(batches):
            known, at, n, best = look_up(links)
            out = {"row": b.column("row")}
            for name, x in (("n_best", best), ("count_sum", n)):
                total = np.append(0, np.cumsum(np.where(known, x[at], 0) if len(x) else np.zeros(len(links), np.int64)))
                out[name] = pa.array(total[begin[1:]] - total[begin[:-1]])
            yield pa.RecordBatch.from_pydict(out)

    here = rows.select("row", "links").mapInArrow(sums, "row long, n_best long, count_sum long")
    if len(keys) < table:  # the table holds every pair
        return here

    def rare(batches):
        for b, links, begin in _links(batches):
            row = np.repeat(b.column("row").to_numpy(), np.diff(begin))
            left = ~look_up(links)[0]
            yield pa.RecordBatch.from_pydict({"row": row[left], "key": links[left]})

    left = rows.select("row", "links").mapInArrow(rare, "row long, key long").groupBy("row", "key").agg(F.count("*").alias("times"))
    met = left.join(counts, "key").select("row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("n") * F.col("times")).alias("count_sum"))
    both = here.unionByName(met).groupBy("row")
    return both.agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignment_report(docs: DataFrame, a: str = A, b: str = B, work: int = WORK, table: int = TABLE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of ``docs``."""
    rows = aligned(docs, a, b, work)
    sums = link_sums(rows, pair_counts(rows, len(pair(a, b).bytes_b)), table)
    whole = rows.drop("links").join(sums, "row")
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
