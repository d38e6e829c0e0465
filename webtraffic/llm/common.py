"""Helpers shared by the operators of this subpackage.

* ``staged``   cut lineage at a written table in the shared folder
* ``row_key``  identify a document row whose ``doc_id`` may be null or repeated
* ``text_views`` / ``buffers``  look at an Arrow text column as bytes, without per-row copies
* ``Roller``   rolling polynomial hashes of byte windows
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtraffic.session import scratch_path

U64 = np.uint64
MASK64 = (1 << 64) - 1


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    The written table survives lost executors, is computed once, and gives later joins a size
    from file statistics.
    """
    path = scratch_path(df.sparkSession, "llm", name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents_of(docs: DataFrame) -> DataFrame:
    """Rows as (rid, tag, doc_id, text): text null becomes empty; other columns are dropped.

    (rid, tag) names a row: rid is doc_id, or a text hash where doc_id is null, and tag a second
    text hash, so rows that share an id but not their text stay apart. Rows equal in both are
    equal rows and get equal answers.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)).alias("rid"),
        F.hash(text).alias("tag"),
        F.col("doc_id"),
        text.alias("text"),
    )


def spread_salt(n: int, *cols: Column | str) -> Column:
    """A stable number below ``n`` from the row's own content."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n+1, int64) and the bytes of a string or binary column without nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    _, off, data = col.buffers()
    n = len(col)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    o = np.frombuffer(off, kind)[col.offset : col.offset + n + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return o, d


def chunks(offsets: np.ndarray, target: int = 1 << 18, most: int = 512) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of at most ``most`` rows whose bytes add up to about ``target`` (one row at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + target, side="right")) - 1)
        j = min(j, i + most)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all their bits."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


class Roller:
    """Polynomial hashes modulo 2**64 of any window of a byte buffer, from one prefix sum.

    With prefix sums H[i] = sum of (byte_j + 1) * B**j for j < i, the window [s, e) has
    (H[e] - H[s]) * B**-s, which does not depend on where the window stands.
    """

    def __init__(self, base: int = 0x9E3779B97F4A7C15):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self._n = 0

    def _grow(self, n: int) -> None:
        if n <= self._n:
            return
        size = 1 << max(16, (n - 1).bit_length())
        self._pow, self._inv = (self._powers(size, b) for b in (self.base, self.inverse))
        self._n = size

    @staticmethod
    def _powers(n: int, b: int) -> np.ndarray:
        out = np.empty(n, U64)
        out[0] = 1
        done = 1
        while done < n:
            m = min(done, n - done)
            out[done : done + m] = out[:m] * U64(pow(b, done, 1 << 64))
            done += m
        return out

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        h = np.empty(len(data) + 1, U64)
        h[0] = 0
        x = data.astype(U64)
        x += U64(1)
        x *= self._pow[: len(data)]
        np.cumsum(x, out=h[1:])
        return h

    def windows(self, h: np.ndarray, k: int) -> np.ndarray:
        """Hash of every window of ``k`` bytes, not mixed."""
        out = h[k:] - h[:-k]
        out *= self._inv[: len(out)]
        return out

    def spans(self, h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Hash of each span [s, e), not mixed."""
        return (h[e] - h[s]) * self._inv[s]


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == U64 else x.astype(np.int64)
