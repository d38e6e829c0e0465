"""Vector rows for the two searches: which take part, packed blocks of them, and the last merge.

Largest inner product becomes nearest distance by one more component: with M the largest squared
norm, a vector x gets sqrt(M - |x|**2) and a query q gets 0, and their squared distance is
|q|**2 + M - 2 <q, x>. Triangle inequalities hold among vectors so extended and queries alike.

Rows whose id is null, or whose vector is null or holds null or non-finite components, take no
part. Shorter vectors count as filled up with zeros. Rows that repeat a query's id are its own;
queries that repeat are answered once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 2048      #: rows from which pivots and first thresholds come, by hash of the id


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): rows that take part, components as doubles."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
        .where(F.col("vec_id").isNotNull() & F.col("x").isNotNull())
        .where(~F.coalesce(bad, F.lit(True)))
    )


def measures(rows: DataFrame) -> tuple[int, int, float]:
    """(rows, longest vector, largest squared norm)."""
    norm = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    r = rows.agg(F.count("*"), F.max(F.size("x")), F.max(norm)).first()
    return r[0], r[1] or 0, r[2] or 0.0


def matrix(x: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of ``width`` doubles, filled up with zeros."""
    if isinstance(x, pa.ChunkedArray):
        x = x.combine_chunks()
    length = np.diff(x.offsets.to_numpy()) if len(x) else np.zeros(0, int)
    flat = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(length) and (length == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(length), width))
    out[np.repeat(np.arange(len(length)), length), np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    return out


def sample(rows: DataFrame, width: int, size: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of at most ``size`` rows with the smallest hash of their id."""
    t = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(size).toArrow()
    return t.column("vec_id").to_numpy(), matrix(t.column("x"), width)


class Best:
    """The k best (score, id) so far of each query, ties to smaller ids."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray):
        self.own, self.k = ids, k
        self.score = np.full((len(ids), k), -np.inf)
        self.id = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.floor = floor  # a score that each query's k-th best cannot be below

    def least(self, q: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[q, -1], self.floor[q])

    def offer(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Offer candidates ``ids`` with ``score`` (queries by candidates) to queries ``q``."""
        score = np.where(ids[None, :] == self.own[q][:, None], -np.inf, score)
        hit = score.max(axis=1, initial=-np.inf) >= self.least(q)
        if not hit.any():
            return
        q, score = q[hit], score[hit]
        if score.shape[1] > 4 * self.k:  # ties at the edge stay
            edge = np.partition(score, -self.k, axis=1)[:, -self.k]
            keep = (score >= np.maximum(edge, self.least(q))[:, None]).any(axis=0)
            score, ids = score[:, keep], ids[keep]
        s = np.concatenate([self.score[q], score], axis=1)
        i = np.concatenate([self.id[q], np.broadcast_to(ids, score.shape)], axis=1)
        o = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[q], self.id[q] = np.take_along_axis(s, o, 1), np.take_along_axis(i, o, 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, candidate id, score) of what was found at or above the floor."""
        ok = (self.score > -np.inf) & (self.score >= self.floor[:, None])
        return np.repeat(self.own, ok.sum(axis=1)), self.id[ok], self.score[ok]


def floors(queries: np.ndarray, own: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query among sampled vectors: a lower bound of its k-th best."""
    s = np.where(ids[None, :] == own[:, None], -np.inf, queries @ x.T)
    return np.partition(s, -k, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(own), -np.inf)


def merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query: (query_id, rank, vec_id, score)."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
