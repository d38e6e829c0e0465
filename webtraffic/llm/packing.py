"""Best-fit packing of documents into token sequences, in bulk-synchronous rounds.

``token_pieces`` encodes each text (byte-level BPE, then id 0) and cuts documents longer than the
capacity into full pieces; the first piece keeps the remainder. ``pack`` places the pieces:

1. Pieces that no open gap can take open sequences: all above half the capacity, and the largest
   others as far as the open gaps cannot hold what is left.
2. Pieces and gaps are range-sorted together by size, pieces before gaps of equal size. A sweep in
   ascending order gives each gap the largest piece that is still free below it, like matching
   brackets. Each range partition sweeps its own part; gaps and pieces left over are matched across
   partitions by their nesting level, which is their rank against all that came before, so two
   gaps never take one piece.
3. Gaps shrink, matched pieces leave, and the next round begins; where no gap fits any piece, the
   largest pieces open new sequences first. After the sweeps that leave at most ``TAIL`` pieces,
   one task places these by sequential best fit, into as many of the largest gaps or new sequences.

Only histograms by size (at most the capacity) and one number for each partition reach the driver.
Runs of very small pieces are tied into bundles of an eighth of the capacity first if there are
many of them for each sequence, which bounds the number of rounds.

Null texts are empty: one piece of one token (id 0). Repeated rows are packed each. An empty table
gives an empty result.
"""

from __future__ import annotations

import bisect
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webtraffic.llm.common import documents_of, staged

CAPACITY = 2048
TAIL = 2_000       #: last pieces that one task places
VOCABULARY = "byte_bpe_50k"


@lru_cache(maxsize=1)
def encoder(vocabulary: str = VOCABULARY):
    """text -> packed little-endian 32-bit ids of the vocabulary's tokenizer file. Built once a worker.

    The ranks file holds the same vocabulary as the tokenizer file and encodes several times
    faster; a text with the special token's string takes the special id, as the tokenizer does.
    """
    import base64
    import sys

    import public_tokenizers as P
    import tiktoken

    with open(P.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {"<|endoftext|>": 50256}
    enc = tiktoken.Encoding("pieces", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> bytes:
        ids = enc.encode(text, allowed_special="all") if "<|" in text else enc.encode_ordinary(text)
        out = array("I", ids)
        out.append(0)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    return encode


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: full ones, the first with the remainder."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(batches, capacity: int, vocabulary: str):
    encode = encoder(vocabulary)
    for b in batches:
        out = [[] for _ in range(5)]
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            ids = encode(text)
            for k, (s, n) in enumerate(cuts(len(ids) // 4, capacity)):
                for col, x in zip(out, (doc_id, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])), strict=True):
                    col.append(x)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
            names=["doc_id", "piece", "start", "length", "ids_crc32"],
        )


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece, with a number ``item`` of its own; written, so that numbers stay."""
    rows = documents_of(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = rows.mapInArrow(lambda it: _pieces(it, capacity, vocabulary), _PIECE)
    return staged(pieces.withColumn("item", F.monotonically_increasing_id()), "pieces")


_WALK = "part int, state string, item long, size long, bin long, gap long, level long"


def _walk(batches):
    """Sweep one sorted range: matched pairs ('m'), gaps ('g') and pieces ('p') left over, and last
    how much deeper the range ends than it began ('n').

    ``level`` of what is left is its nesting depth relative to the start of the range.
    """
    free: list[tuple[int, int]] = []
    out: list[tuple] = []
    part, closed = None, 0
    for b in batches:
        part = b.column("part")[0].as_py() if b.num_rows else part
        for kind, size, item in zip(b.column("kind").to_pylist(), b.column("size").to_pylist(), b.column("item").to_pylist(), strict=True):
            if kind == 0:
                free.append((item, size))
            elif free:
                doc, n = free.pop()
                out.append((part, "m", doc, n, item, size, None))
            else:
                out.append((part, "g", None, None, item, size, -closed))
                closed += 1
        if len(out) >= 50_000:
            yield _rows(out)
            out = []
    out += [(part, "p", item, size, None, None, k + 1 - closed) for k, (item, size) in enumerate(free)]
    if part is not None:
        out.append((part, "n", None, None, None, None, len(free) - closed))
    for i in range(0, len(out), 50_000):
        yield _rows(out[i : i + 50_000])


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.string(), *[pa.int64()] * 5]
    names = ["part", "state", "item", "size", "bin", "gap", "level"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def sweep(pieces: DataFrame, gaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Match pieces (item, size) with gaps (bin, gap): rows by state 'm', 'g', 'p', in two tables."""
    spark = pieces.sparkSession
    points = pieces.select("size", F.lit(0).alias("kind"), "item").unionByName(
        gaps.select(F.col("gap").alias("size"), F.lit(1).alias("kind"), F.col("bin").alias("item"))
    )
    order = ["size", "kind", "item"]
    walk = staged(
        points.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id()).mapInArrow(_walk, _WALK),
        "walk",
    )
    # one row per range partition
    parts = sorted(walk.where("state = 'n'").select("part", F.col("level").alias("net")).collect())
    base = np.cumsum([0] + [r.net for r in parts]).tolist()
    bases = spark.createDataFrame([(r.part, b) for r, b in zip(parts, base, strict=False)], "part int, base long")
    # the depth at which a partition begins: the sum of those before it (bounded by the partitions)
    left = walk.where("state in ('p', 'g')").join(F.broadcast(bases), "part")
    w = Window.partitionBy(F.col("level") + F.col("base")).orderBy("part", "state")
    # at one nesting level pieces and gaps take turns: a gap closes the piece just before it
    left = left.select(
        "*",
        F.lag(F.struct("state", "item", "size")).over(w).alias("piece"),
        F.lead("state").over(w).alias("next"),
    ).where("not (state = 'p' and coalesce(next, '') = 'g')")
    met = F.col("piece.state") == "p"
    is_gap = F.col("state") == "g"
    cross = left.select(
        F.when(is_gap & met, F.lit("m")).otherwise(F.col("state")).alias("state"),
        F.when(is_gap, F.when(met, F.col("piece.item"))).otherwise(F.col("item")).alias("item"),
        F.when(is_gap, F.when(met, F.col("piece.size"))).otherwise(F.col("size")).alias("size"),
        "bin", "gap",
    )
    return walk.where("state = 'm'").select("state", "item", "size", "bin", "gap"), staged(cross, "cross")


def best_fit(sizes: list[int], capacity: int, gaps: list[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """(number of sequence, offset) for each size, given in descending order.

    ``gaps`` are open (gap, number) pairs with numbers below 0; new sequences count from 0.
    """
    free = sorted(gaps)
    out, opened = [], 0
    for n in sizes:
        i = bisect.bisect_left(free, (n, -(1 << 62)))
        if i == len(free):
            gap, k = capacity, opened
            opened += 1
        else:
            gap, k = free.pop(i)
        out.append((k, capacity - gap))
        bisect.insort(free, (gap - n, k))
    return out


def _finish(table: pa.Table, capacity: int) -> pa.Table:
    """Best fit of the last pieces (kind 0) into open gaps (kind 1) and new sequences."""
    rows = list(zip(*(table.column(c).to_pylist() for c in ("kind", "size", "item")), strict=True))
    pieces = sorted(((n, item) for kind, n, item in rows if kind == 0), reverse=True)
    bins = sorted(item for kind, _, item in rows if kind == 1)
    number = {b: -1 - i for i, b in enumerate(bins)}
    at = best_fit([n for n, _ in pieces], capacity, [(n, number[b]) for kind, n, b in rows if kind == 1])
    first: dict[int, int] = {}
    where = [bins[-1 - k] if k < 0 else first.setdefault(k, item) for (_, item), (k, _) in zip(pieces, at, strict=True)]
    return pa.table({"item": pa.array([i for _, i in pieces], pa.int64()), "bin": pa.array(where, pa.int64()), "offset": pa.array([o for _, o in at], pa.int64())})


def _openers(counts: dict[int, int], wanted: int) -> tuple[int, float]:
    """(size above which all pieces open a sequence, share of the pieces of that size that do)."""
    seen = 0
    for size in sorted(counts, reverse=True):
        if seen + counts[size] >= wanted:
            return size, (wanted - seen) / counts[size]
        seen += counts[size]
    return 0, 1.0


def _bundled(pieces: DataFrame, small: int, most: int) -> DataFrame:
    """Neighbours among small pieces in size order tied together: (item, bundle, inner, size)."""

    def tie(batches):
        bundle, inner = None, 0
        for b in batches:
            out = [], [], [], []
            for item, n in zip(b.column("item").to_pylist(), b.column("size").to_pylist(), strict=True):
                if bundle is None or inner + n > most:
                    bundle, inner = item, 0
                for col, x in zip(out, (item, bundle, inner, n), strict=True):
                    col.append(x)
                inner += n
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["item", "bundle", "inner", "size"])

    few = pieces.where(F.col("size") <= small).select("item", "size")
    return staged(
        few.repartitionByRange("size", "item").sortWithinPartitions("size", "item")
        .mapInArrow(tie, "item long, bundle long, inner long, size long"),
        "bundles",
    )


def pack(items: DataFrame, capacity: int = CAPACITY, tail: int = TAIL) -> DataFrame:
    """Place (item, size) pieces of at most ``capacity``: (item, bin, offset).

    ``bin`` is the item that opened the sequence; places in a sequence leave no gap between them.
    """
    spark = items.sparkSession
    done = [items.where(F.col("size") >= capacity).select("item", F.col("item").alias("bin"), F.lit(0).cast("long").alias("offset"))]
    pieces = items.where(F.col("size") < capacity).select("item", "size")
    gaps = spark.createDataFrame([], "bin long, gap long")

    def histograms(pieces: DataFrame, gaps: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
        """Counts by size of pieces and gaps: at most ``capacity`` rows each."""
        both = pieces.select("size", F.lit(0).alias("kind")).unionByName(gaps.select(F.col("gap").alias("size"), F.lit(1).alias("kind")))
        out = {}, {}
        for r in both.groupBy("kind", "size").count().collect():
            out[r[0]][r[1]] = r[2]
        return out

    counts, room = histograms(pieces, gaps)[0], 0
    total = sum(s * n for s, n in counts.items())
    small, bundles = capacity // 32, None
    if sum(n for s, n in counts.items() if s <= small) > 16 * (total // capacity + 1):
        bundles = _bundled(pieces, small, capacity // 8)
        tied = bundles.groupBy("bundle").agg(F.sum("size").alias("size")).withColumnRenamed("bundle", "item")
        pieces = staged(pieces.where(F.col("size") > small).unionByName(tied), "tied")
        counts = histograms(pieces, gaps)[0]
    stuck, turn = False, 0
    while counts:
        turn += 1
        total, number = sum(s * n for s, n in counts.items()), sum(counts.values())
        if turn > 1 and number <= tail:  # as many gaps as pieces are enough, the largest ones
            few = gaps.orderBy(F.desc("gap"), "bin").limit(number)
            last = pieces.select(F.lit(0).alias("kind"), "size", "item").unionByName(
                few.select(F.lit(1).alias("kind"), F.col("gap").alias("size"), F.col("bin").alias("item"))
            )
            done.append(staged(last.groupBy(F.lit("tail")).applyInArrow(lambda t: _finish(t, capacity), "item long, bin long, offset long"), "tail"))
            break
        large = sum(n for s, n in counts.items() if s > capacity // 2)
        missing = -(-(total if stuck else max(0, total - room)) // capacity)
        if wanted := max(large, missing):
            above, share = _openers(counts, wanted)
            lot = F.pmod(F.xxhash64("item", F.lit(turn)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))
            opens = (F.col("size") > above) | ((F.col("size") == above) & lot)
            opened = pieces.where(opens)
            done.append(opened.select("item", F.col("item").alias("bin"), F.lit(0).cast("long").alias("offset")))
            gaps = gaps.unionByName(opened.select(F.col("item").alias("bin"), (capacity - F.col("size")).alias("gap")))
            pieces = pieces.where(~opens)
        near, cross = sweep(pieces, gaps)
        met = near.unionByName(cross.where("state = 'm'"))
        done.append(met.select("item", "bin", (F.lit(capacity) - F.col("gap")).alias("offset")))
        pieces = cross.where("state = 'p'").select("item", "size")
        gaps = met.select("bin", (F.col("gap") - F.col("size")).alias("gap")).unionByName(
            cross.where("state = 'g'").select("bin", "gap")
        ).where("gap > 0")
        counts, open_ = histograms(pieces, gaps)
        least = min(counts, default=1)
        gaps = gaps.where(F.col("gap") >= least)
        room = sum(s * n for s, n in open_.items() if s >= least)
        stuck = room == 0
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    if bundles is not None:
        inner = bundles.select("item", "bundle", "inner")
        out = (
            out.withColumnRenamed("item", "bundle").join(inner, "bundle", "left")
            .select(F.coalesce("item", "bundle").alias("item"), "bin", (F.col("offset") + F.coalesce("inner", F.lit(0))).alias("offset"))
        )
    return out


def packed_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = token_pieces(docs, capacity, vocabulary)
    at = pack(pieces.select("item", F.col("length").alias("size")), capacity)
    return pieces.join(at, "item").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset"
    )
