"""Vector code compression with per-dimension value dictionaries.

Components become integers, floor(scale * x). A vector is cut into ``PARTS`` equal parts, and each part is replaced
by the index of the nearest entry of its position's codebook, which a fixed number of rounds adapts.

Vectors are stored once, in blocks: for each dimension the sorted distinct integers of the block (its value dictionary)
and one 16-bit dictionary code for each row. A round tabulates the squared differences of every
dictionary value to all codebook entries; a part's distances are then sums of table rows gathered by the
codes, and the new entries are sums of dictionary values gathered by the same codes. All is integer arithmetic,
so rounds give the same entries however rows are dealt.

Each task returns one sum for each entry component, added up by Spark; only the codebooks (parts x entries x
part width integers) pass through the driver. Blocks hold at most ``BLOCK`` rows, of one input partition.

Rows whose vector is null or holds null or non-finite components are dropped. Null ids stay, as the largest.
Rows that repeat an id are ordered by their vectors for the first entries, and are coded each. Fewer rows
than entries give as many entries as rows. Shorter vectors are filled up with zeros, and all to a multiple of the
parts. Integers beyond 2**27 raise an error, as sums would leave 64 bits. Other columns than vec_id,
embedding and label are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtraffic.llm.common import staged
from webtraffic.llm.vectors import matrix

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096.0
BLOCK = 1 << 15    #: rows of a block; their codes fit 16 bits
MOST = 1 << 27     #: largest integer


def kept_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, x) of the rows that take part, components as doubles."""
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", x.alias("x"))
    return rows.where(F.col("x").isNotNull() & ~F.coalesce(bad, F.lit(False)))


def integers(x: pa.Array, width: int, scale: float) -> np.ndarray:
    """Rows of integers, filled up with zeros."""
    v = np.floor(scale * matrix(x, width))
    if v.size and np.abs(v).max() > MOST:
        raise ValueError(f"a component is beyond {MOST / scale}")
    return v.astype(np.int64)


def dictionary_codes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dictionary values of all dimensions, their number by dimension, codes by dimension and row)."""
    values, sizes = [], np.empty(v.shape[1], np.int64)
    codes = np.empty((v.shape[1], len(v)), np.uint16)
    for d in range(v.shape[1]):
        found, codes[d] = np.unique(v[:, d], return_inverse=True)
        values.append(found)
        sizes[d] = len(found)
    return np.concatenate(values), sizes, codes


class Block:
    """A stored block read back."""

    def __init__(self, values: bytes, sizes: bytes, codes: bytes):
        ends = np.cumsum(np.frombuffer(sizes, np.int64))
        self.values = np.split(np.frombuffer(values, np.int64), ends[:-1])
        self.codes = np.frombuffer(codes, np.uint16).reshape(len(ends), -1)

    def nearest(self, book: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
        """(nearest entry, squared distance) of every row's part; ``book`` is (entries, part width)."""
        width = book.shape[1]
        far = np.zeros((self.codes.shape[1], len(book)), np.int64)
        for i in range(width):
            d = part * width + i
            table = self.values[d][:, None] - book[None, :, i]
            far += (table * table)[self.codes[d]]
        best = far.argmin(axis=1)  # the first of equal ones
        return best, far[np.arange(len(far)), best]

    def totals(self, best: np.ndarray, entries: int, part: int, width: int) -> np.ndarray:
        """Sums by entry and component; a block's are far below 2**53."""
        out = np.empty((entries, width), np.int64)
        for i in range(width):
            d = part * width + i
            out[:, i] = np.bincount(best, weights=self.values[d][self.codes[d]], minlength=entries)
        return out


def blocks_of(rows: DataFrame, width: int, scale: float, size: int) -> DataFrame:
    """Rows packed into blocks, without a shuffle."""
    label = rows.schema["label"].dataType.simpleString()
    schema = f"ids array<long>, labels array<{label}>, dictionary binary, sizes binary, codes binary"

    def pack(t: pa.Table) -> pa.RecordBatch:
        values, sizes, codes = dictionary_codes(integers(t.column("x"), width, scale))
        whole = lambda c: pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), t.column(c).combine_chunks())
        raw = [pa.array([a.tobytes()], pa.binary()) for a in (values, sizes, codes)]
        return pa.RecordBatch.from_arrays([whole("vec_id"), whole("label"), *raw], names=["ids", "labels", "dictionary", "sizes", "codes"])

    def dealt(batches):
        held, n = [], 0
        for b in batches:
            while b.num_rows:
                part, b = b.slice(0, size - n), b.slice(size - n)
                held.append(part)
                n += part.num_rows
                if n == size:
                    yield pack(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield pack(pa.Table.from_batches(held))

    return staged(rows.mapInArrow(dealt, schema), "vector_blocks")


def _read(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1), Block(*(b.column(c)[i].as_py() for c in ("dictionary", "sizes", "codes")))


def adapted(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: entries become the componentwise floor of their parts' means; unused ones stay."""
    parts, entries, width = books.shape

    def sums(batches):
        total, n = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for _, block in _read(batches):
            for p in range(parts):
                best, _far = block.nearest(books[p], p)
                n[p] += np.bincount(best, minlength=entries)
                total[p] += block.totals(best, entries, p, width)
        yield pa.RecordBatch.from_pydict({"slot": np.arange(books.size), "n": np.repeat(n.ravel(), width), "total": total.ravel()})

    found = blocks.mapInArrow(sums, "slot long, n long, total long").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    new = books.copy().ravel()
    for slot, n, total in found.where("n > 0").collect():  # one row for each component of the codebooks
        new[slot] = total // n
    return new.reshape(books.shape)


def _hex(codes: np.ndarray) -> pa.Array:
    """Two hex digits for each part, joined by row."""
    digits = np.frombuffer(b"0123456789abcdef", np.uint8)
    text = np.ascontiguousarray(digits[np.stack([codes >> 4, codes & 15], axis=2)].reshape(len(codes), -1))
    offsets = np.arange(len(codes) + 1, dtype=np.int32) * text.shape[1]
    return pa.Array.from_buffers(pa.string(), len(codes), [None, pa.py_buffer(offsets), pa.py_buffer(text)])


def codes_of(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every row under the given codebooks."""
    label = blocks.schema["labels"].dataType.elementType.simpleString()

    def code(batches):
        for b, block in _read(batches):
            found = [block.nearest(book, p) for p, book in enumerate(books)]
            codes, error = np.stack([f[0] for f in found], axis=1), sum(f[1] for f in found)
            cols = [b.column("ids").flatten(), b.column("labels").flatten(), _hex(codes), pa.array(error)]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(code, f"vec_id long, label {label}, code string, error long")


def compressed(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE, block: int = BLOCK
) -> tuple[DataFrame, np.ndarray]:
    """Codes (vec_id, label, code, error) of ``vectors`` and the codebooks (parts, entries, part width)."""
    if not 1 <= entries <= 256 or not 1 <= block <= 1 << 16:
        raise ValueError("codes take two hex digits, dictionary codes 16 bits")
    rows = kept_rows(vectors)
    longest = rows.agg(F.max(F.size("x"))).first()[0] or 0
    width = max(1, -(-longest // parts)) * parts
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).select("x").toArrow()
    books = integers(first.column("x"), width, scale).reshape(-1, parts, width // parts).transpose(1, 0, 2)
    blocks = blocks_of(rows, width, scale, block)
    for _ in range(rounds if books.size else 0):
        books = adapted(blocks, books)
    return staged(codes_of(blocks, books), "vector_codes"), books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def code_report(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): codes with the errors summed over equal labels."""
    rows, books = compressed(vectors)
    # one row a label; Spark broadcasts it where its written size allows, and splits hot labels elsewhere
    sums = staged(rows.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error")), "label_errors")
    whole = rows.join(sums, F.col("label").eqNullSafe(F.col("same")))
    return whole.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def code_report_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = int(SCALE)) -> str:
    """The report by all distances between parts and entries, for vectors of one length divisible by the parts."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
        a{i} AS MATERIALIZED (
            SELECT r, part, k, far FROM (
                SELECT r, part, k, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS far
                FROM x JOIN c{i} c USING (d) GROUP BY r, part, k)
            QUALIFY row_number() OVER (PARTITION BY r, part ORDER BY far, k) = 1)""")
        if i < rounds:
            steps.append(f"""
        s{i} AS (SELECT d, k, sum(v)::BIGINT AS s, count(*) AS n FROM x JOIN a{i} USING (r, part) GROUP BY d, k),
        c{i + 1} AS MATERIALIZED (
            SELECT c.d, c.k, CASE WHEN n IS NULL THEN c.v ELSE (s - ((s % n) + n) % n) // n END AS v
            FROM c{i} c LEFT JOIN s{i} USING (d, k))""")
    return f"""
    WITH kept AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
        cells AS (SELECT r, unnest(e) AS v, generate_subscripts(e, 1) - 1 AS d, len(e) // {parts} AS w FROM kept),
        x AS MATERIALIZED (SELECT r, d, d // w AS part, floor({scale} * v::DOUBLE)::BIGINT AS v FROM cells),
        c0 AS MATERIALIZED (SELECT d, r - 1 AS k, v FROM x WHERE r <= {entries}),
        {",".join(steps)},
        coded AS (
            SELECT r, string_agg(printf('%02x', k), '' ORDER BY part) AS code, sum(far)::BIGINT AS error
            FROM a{rounds} GROUP BY r)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
        (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, k, d))
            FROM c{rounds} JOIN (SELECT DISTINCT d, part FROM x) USING (d)) AS codebooks_sha256
    FROM coded JOIN kept USING (r)
    """
