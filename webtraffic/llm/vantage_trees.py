"""Approximate nearest neighbours: a vantage-point tree per shard.

Rows are dealt into shards of about ``SHARD`` by hash of their id, and each shard is laid out as a
vantage-point tree: a node's first row is its vantage point, the nearer half of the rest stands
before the farther half, and the node keeps the largest distance of the one and the smallest of
the other. The query set goes to all shards in blocks. A half is searched if the triangle
inequality allows it a distance below ``1 / factor`` times the current k-th best one: factor 1
searches exactly, larger ones give up halves that would hardly hold a neighbour.

Every row is indexed. The first thresholds come from a sample (``vectors.SAMPLE`` rows), whose best rows are
candidates, too: where relaxed pruning gives up a neighbour, the k sampled ones that set the threshold stand in, so
each query gets k rows if there are as many. Scores are inner products of the original vectors in double precision,
each added up in the order of the components: matrix products, whose last bits vary, only tell which to compute.
See ``vectors`` for the rows that take no part; zero vectors take none here. Fewer candidates than k give fewer rows,
an empty table none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtraffic.llm.common import staged
from webtraffic.llm.vectors import Best, floors, matrix, measures, merged, sample, usable

SHARD = 4096
LEAF = 256
QUERIES = 8192     #: queries of a block; a shard is sent once for each block
SLACK = 1e-12      #: error of a matrix product, relative to the norms
FACTOR = 6.0       #: recall 0.98 on the test embeddings (README); 1 is exact


def tree(x: np.ndarray, largest: float, seed: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, near, far): rows in tree order, and at each node's first row the largest distance of
    its nearer half and the smallest of its farther half.

    The node of rows [lo, hi) has its halves at [lo + 1, mid) and [mid, hi), see ``middle``.
    """
    norm = (x * x).sum(axis=1)
    more = np.sqrt(np.maximum(largest - norm, 0))
    order, rng = np.arange(len(x)), np.random.default_rng(seed)
    near, far = np.zeros(len(x)), np.zeros(len(x))
    todo = [(0, len(x))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= LEAF:
            continue
        pick = lo + int(rng.integers(hi - lo))
        order[lo], order[pick] = order[pick], order[lo]
        p, rest = order[lo], order[lo + 1 : hi]
        d2 = norm[rest] + norm[p] - 2 * (x[rest] @ x[p]) + (more[rest] - more[p]) ** 2
        d = np.sqrt(np.maximum(d2, 0))
        o = np.argsort(d, kind="stable")
        order[lo + 1 : hi] = rest[o]
        mid = middle(lo, hi)
        near[lo], far[lo] = d[o[mid - lo - 2]], d[o[mid - lo - 1]]
        todo += [(lo + 1, mid), (mid, hi)]
    return order, near, far


def middle(lo: int, hi: int) -> int:
    return (lo + 2 + hi) // 2


def exact(queries: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products row by row, which do not depend on what stands in the other rows."""
    return (queries * x).sum(axis=1)


def offered(best: Best, q: np.ndarray, score: np.ndarray, queries: np.ndarray, x: np.ndarray, ids: np.ndarray, slack: np.ndarray) -> None:
    """Offer rows ``x`` to queries ``q`` with exact scores where ``score`` may reach the k best so far."""
    near = score >= (best.least(q) - slack[q])[:, None]
    if near.any():
        r, c = np.nonzero(near)
        score = np.full(score.shape, -np.inf)
        score[r, c] = exact(queries[q[r]], x[c])
        best.offer(q, score, ids)


def search(x, ids, near, far, largest, queries, best: Best, factor: float) -> int:
    """Search a tree-ordered shard for all queries; returns the number of scores computed."""
    norms = (queries * queries).sum(axis=1)
    qq, slack = norms + largest, SLACK * np.sqrt(norms * largest)
    computed = 0

    def reach(q):
        least = best.least(q)
        d = np.sqrt(np.maximum(qq[q] - 2 * least, 0))
        return np.where(np.isinf(least), np.inf, d) / factor + 1e-9

    def visit(lo, hi, q):
        nonlocal computed
        if not len(q):
            return
        if hi - lo <= LEAF:
            computed += len(q) * (hi - lo)
            for i in range(0, len(q), 1024):
                part = q[i : i + 1024]
                offered(best, part, queries[part] @ x[lo:hi].T, queries, x[lo:hi], ids[lo:hi], slack)
            return
        s = queries[q] @ x[lo]
        computed += len(q)
        offered(best, q, s[:, None], queries, x[lo : lo + 1], ids[lo : lo + 1], slack)
        d, mid = np.sqrt(np.maximum(qq[q] - 2 * s, 0)), middle(lo, hi)
        inner = d - near[lo] <= far[lo] - d
        in_gap, out_gap = d - near[lo], far[lo] - d
        for half, gap, first in (((lo + 1, mid), in_gap, inner), ((mid, hi), out_gap, ~inner)):
            go = first & (gap <= reach(q))
            visit(*half, q[go])
        for half, gap, first in (((mid, hi), out_gap, inner), ((lo + 1, mid), in_gap, ~inner)):
            go = first & (gap <= reach(q))
            visit(*half, q[go])

    visit(0, len(x), np.arange(len(queries)))
    return computed


_SHARD = "shard long, ids binary, x binary, near binary, far binary"
_BLOCK = "block long, own binary, q binary, floor binary"
_FOUND = "query_id long, vec_id long, score double"


def _table(ddl: str, **cols) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return pa.table({n: pa.array([cols[n]], kinds[k]) for n, k in (c.split() for c in ddl.split(", "))})


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, factor: float = FACTOR, shard: int = SHARD) -> DataFrame:
    """The k nearest found of each row whose vec_id is divisible by ``every``:
    (query_id, rank, vec_id, score)."""
    if factor < 1:
        raise ValueError("factor must be at least 1")
    rows = usable(vectors).where(F.exists("x", lambda v: v != 0))
    count, width, largest = measures(rows)
    sample_ids, sampled = sample(rows, width)
    shards, blocks = max(1, -(-count // shard)), max(1, -(-count // every // QUERIES))

    def plant(key, t):
        ids, x = t.column("vec_id").to_numpy(), matrix(t.column("x"), width)
        order, near, far = tree(x, largest)
        return _table(_SHARD, shard=key[0].as_py(), ids=ids[order].tobytes(), x=x[order].tobytes(), near=near.tobytes(), far=far.tobytes())

    def gather(key, t):
        ids, x = t.column("vec_id").to_numpy(), matrix(t.column("x"), width)
        floor = floors(x, ids, sample_ids, sampled, k) - SLACK * np.sqrt((x * x).sum(axis=1) * largest)
        return _table(_BLOCK, block=key[0].as_py(), own=ids.tobytes(), q=x.tobytes(), floor=floor.tobytes())

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    trees = staged(dealt.groupBy("shard").applyInArrow(plant, _SHARD), "trees")
    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    asked = asked.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(blocks)))
    queries = staged(asked.groupBy("block").applyInArrow(gather, _BLOCK), "queries")

    def answer(batches):
        for b in batches:
            for r in range(b.num_rows):
                get = lambda c, kind=np.float64: np.frombuffer(b.column(c)[r].as_py(), kind)  # noqa: B023, E731
                own, ids = get("own", np.int64), get("ids", np.int64)
                best = Best(own, k, get("floor"))
                search(get("x").reshape(len(ids), width), ids, get("near"), get("far"), largest, get("q").reshape(len(own), width), best, factor)
                q, i, s = best.rows()
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(q), "vec_id": pa.array(i), "score": pa.array(s)})

    def sampled_best(batches):
        for b in batches:
            for r in range(b.num_rows):
                own, floor = (np.frombuffer(b.column(c)[r].as_py(), t) for c, t in (("own", np.int64), ("floor", np.float64)))
                q = np.frombuffer(b.column("q")[r].as_py(), np.float64).reshape(len(own), width)
                best, slack = Best(own, k, floor), SLACK * np.sqrt((q * q).sum(axis=1) * largest)
                for i in range(0, len(own), 512):
                    part = np.arange(i, min(i + 512, len(own)))
                    offered(best, part, q[part] @ sampled.T, q, sampled, sample_ids, slack)
                o, i, s = best.rows()
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(o), "vec_id": pa.array(i), "score": pa.array(s)})

    # the stated query set, in blocks, against every shard
    everywhere = queries.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    pairs = trees.join(everywhere, "shard").repartition("shard", "block")
    found = pairs.mapInArrow(answer, _FOUND).unionByName(queries.mapInArrow(sampled_best, _FOUND))
    # a sampled row is found twice, with one score
    return merged(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k)
