"""Exact top-k search: a pivot-distance index.

Vectors are rounded to integers, floor(256 * x); the score is their inner product. Each vector is
keyed by its nearest pivot and its distance to it (see ``vectors`` for the distance that orders by
inner product). Sorted by this key, vectors are packed into blocks; a block is an annulus around
its pivot.

A query knows a score that its k-th best cannot be below, first from a sample, and so a radius: by
the triangle inequality a vector within it has a pivot distance within that radius of the query's
own. Blocks whose annulus no query of a block of queries reaches are never joined; within a block,
annuli of ``RING`` vectors are expanded outwards from the query's distance and the expansion stops
at the radius, which shrinks with every better score. What the bounds leave out cannot be among
the k best, so the result is exact.

Pivots are chosen from a bounded sample (``vectors.SAMPLE`` rows); every row is indexed. Scores are
exact while sums stay below 2**53. See ``vectors`` for the rows that take no part. Fewer candidates
than k give fewer rows, an empty table none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtraffic.llm.common import staged
from webtraffic.llm.vectors import Best, floors, matrix, measures, merged, sample, usable

PIVOTS = 32
BLOCK = 2048
QUERIES = 256
RING = 256
SCALE = 256


def choose_pivots(x: np.ndarray, largest: float, n: int = PIVOTS) -> np.ndarray:
    """Sampled vectors that lie far from each other, chosen one by one; extended vectors."""
    e = extended(x, largest)
    if not len(e):
        return e
    out, far = [0], np.full(len(e), np.inf)
    while len(out) < min(n, len(e)):
        far = np.minimum(far, ((e - e[out[-1]]) ** 2).sum(axis=1))
        if far.max() <= 0:
            break
        out.append(int(far.argmax()))
    return e[out]


def extended(x: np.ndarray, largest: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(largest - (x * x).sum(axis=1), 0))])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d2 = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(d2, 0))


def radius(q: np.ndarray, largest: float, least: np.ndarray) -> np.ndarray:
    """The distance within which a score of at least ``least`` lies, with room for rounding."""
    d2 = (q * q).sum(axis=1) + largest - 2 * least
    return np.where(np.isinf(least), np.inf, np.sqrt(np.maximum(d2, 0))) * (1 + 1e-9) + 1e-3


def expand(x, ids, dist, q, from_pivot, largest, best: Best, ring: int = RING) -> int:
    """Expand the sorted annuli of one block for all queries; returns the number of scores computed."""
    starts = np.arange(0, len(ids), ring)
    lo, hi = dist[starts], dist[np.minimum(starts + ring, len(ids)) - 1]
    computed = 0
    gap = np.maximum(0, np.maximum(lo[None, :] - from_pivot[:, None], from_pivot[:, None] - hi[None, :]))
    order = np.argsort(gap, axis=1, kind="stable")  # outwards from each query's own distance
    alive = np.arange(len(q))
    for turn in range(len(starts)):
        r = order[alive, turn]
        go = gap[alive, r] <= radius(q[alive], largest, best.least(alive))
        alive, r = alive[go], r[go]  # annuli further out are out of reach too
        if not len(alive):
            break
        for ring_no in np.unique(r):
            who = alive[r == ring_no]
            s = slice(starts[ring_no], starts[ring_no] + ring)
            computed += len(who) * len(ids[s])
            best.offer(who, q[who] @ x[s].T, ids[s])
    return computed


def _pack(batches, width: int, size: int, names: tuple[str, ...]):
    """Sorted rows (pivot, dist, vec_id, x) packed into blocks of one pivot."""
    held: list[pa.RecordBatch] = []

    def flush():
        t = pa.Table.from_batches(held)
        pivot = t.column("pivot").to_numpy()
        cut = [0, *(np.flatnonzero(np.diff(pivot)) + 1).tolist(), len(pivot)]
        for a, b in zip(cut, cut[1:], strict=False):
            for i in range(a, b, size):
                j = min(b, i + size)
                d = t.column("dist").slice(i, j - i).to_numpy()
                ids = t.column("vec_id").slice(i, j - i).to_numpy()
                x = matrix(t.column("x").slice(i, j - i), width)
                yield pa.RecordBatch.from_pydict({
                    "pivot": pa.array([int(pivot[i])], pa.int64()), "lo": pa.array([d.min()]), "hi": pa.array([d.max()]),
                    names[0]: pa.array([ids.tobytes()], pa.binary()), names[1]: pa.array([x.tobytes()], pa.binary()), names[2]: pa.array([d.tobytes()], pa.binary()),
                })

    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= 8 * size:
            yield from flush()
            held, rows = [], 0
    if held:
        yield from flush()


_FOUND = "query_id long, vec_id long, score long"


def top_scores(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The k highest scores of each row whose vec_id is divisible by ``every``:
    (query_id, rank, vec_id, score)."""
    whole = F.transform("x", lambda v: F.floor(v * SCALE).cast("double"))
    rows = usable(vectors).select("vec_id", whole.alias("x"))
    _, width, largest = measures(rows)
    sample_ids, sampled = sample(rows, width)
    pivots = choose_pivots(sampled, largest)
    if not len(pivots):
        return rows.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))

    def keyed(batches):
        for b in batches:
            if b.num_rows:
                d = distances(extended(matrix(b.column("x"), width), largest), pivots)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), b.column("x"), pa.array(near), pa.array(d[np.arange(len(d)), near])],
                    names=["vec_id", "x", "pivot", "dist"],
                )

    key = rows.mapInArrow(keyed, "vec_id long, x array<double>, pivot long, dist double")
    order = ["pivot", "dist", "vec_id"]
    layout = "pivot long, lo double, hi double, {0} binary, {1} binary, {2} binary"
    blocks = staged(
        key.repartitionByRange(*order).sortWithinPartitions(*order)
        .mapInArrow(lambda it: _pack(it, width, BLOCK, ("ids", "x", "dist")), layout.format("ids", "x", "dist")),
        "annuli",
    )

    def asked(batches):
        for b in _pack(batches, width, QUERIES, ("own", "q", "unused")):
            own = np.frombuffer(b.column("own")[0].as_py(), np.int64)
            q = np.frombuffer(b.column("q")[0].as_py()).reshape(len(own), width)
            floor = floors(q, own, sample_ids, sampled, k)
            flat = np.column_stack([q, np.zeros(len(q))])
            d, r = distances(flat, pivots), radius(q, largest, floor)
            n = len(pivots)
            col = lambda v: pa.array([v.tobytes()] * n, pa.binary())
            yield pa.RecordBatch.from_pydict({
                "pivot": pa.array(np.arange(n)), "low": pa.array((d - r[:, None]).min(axis=0)), "high": pa.array((d + r[:, None]).max(axis=0)),
                "own": col(own), "q": col(q), "floor": col(floor),
                "from_pivot": pa.array([d[:, p].tobytes() for p in range(n)], pa.binary()),
            })

    queries = staged(
        key.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]).repartitionByRange(*order).sortWithinPartitions(*order)
        .mapInArrow(asked, "pivot long, low double, high double, own binary, q binary, floor binary, from_pivot binary"),
        "queries",
    )

    def answer(batches):
        for b in batches:
            for r in range(b.num_rows):
                get = lambda c, kind=np.float64: np.frombuffer(b.column(c)[r].as_py(), kind)  # noqa: B023, E731
                own, ids = get("own", np.int64), get("ids", np.int64)
                best = Best(own, k, get("floor"))
                expand(get("x").reshape(len(ids), width), ids, get("dist"), get("q").reshape(len(own), width), get("from_pivot"), largest, best)
                q, i, s = best.rows()
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(q), "vec_id": pa.array(i), "score": pa.array(s.astype(np.int64))})

    # annuli that some query of the block reaches
    reached = blocks.join(queries, "pivot").where("hi >= low and lo <= high").select("ids", "x", "dist", "own", "q", "floor", "from_pivot")
    return merged(reached.repartition(F.xxhash64("ids", "own")).mapInArrow(answer, _FOUND), k)


def top_scores_sql(every: int = 50, k: int = 5) -> str:
    """DuckDB statement for ``top_scores`` over ``embeddings`` (distinct vec_id)."""
    return f"""
with v as (
    select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as x from embeddings
    where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
    select q.vec_id as query_id, v.vec_id, list_sum(list_transform(list_zip(q.x, v.x), lambda p: p[1] * p[2]))::bigint as score
    from v as q join v on v.vec_id <> q.vec_id where q.vec_id % {every} = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= {k}
"""
