import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from webtraffic.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Codes by Python integers, one part and entry at a time."""
    kept = [(i, lab, x) for i, x, lab in rows if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = max(1, -(-max((len(x) for *_, x in kept), default=0) // parts)) * parts
    v = [[math.floor(scale * c) for c in [*x, *[0.0] * (width - len(x))]] for *_, x in kept]
    w = width // parts
    part = [[r[p * w : (p + 1) * w] for p in range(parts)] for r in v]
    books = [[r[p] for r in part[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = defaultdict(list)
            for r in part:
                mine[near(r[p], books[p])[1]].append(r[p])
            for k, xs in mine.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    found = [[near(r[p], books[p]) for p in range(parts)] for r in part]
    errors = [sum(e for e, _ in f) for f in found]
    by = defaultdict(int)
    for (_, lab, _x), e in zip(kept, errors, strict=True):
        by[lab] += e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(
        ((i, "".join(f"{k:02x}" for _, k in f), e, by[lab], sha) for (i, lab, _), f, e in zip(kept, found, errors, strict=True)), key=str
    )


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as error", "'y' as code", "2 as same", "3 as x").repartition(3)


def corpus(seed, n=260, dim=16):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim)) * 0.2
    x[: n // 3] = x[0]  # one very common vector
    x[n // 2] = x[n // 2 + 1]
    ids = r.permutation(n)
    rows = [(int(i), [float(c) for c in v], [None, 1, 2, 7][k % 4] if k > n // 2 else 3) for k, (i, v) in enumerate(zip(ids, x, strict=True))]
    rows += [(n, None, 1), (n + 1, [float("nan")] * dim, 1), (n + 2, [None, *[0.1] * (dim - 1)], 1), (n + 3, [float("inf")] * dim, 1)]
    return rows + [(None, [0.25] * dim, None), (5, [0.5] * dim, 1), (5, [0.5] * dim, 1), (n + 4, [0.1] * 3, 1), (n + 5, [], 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_report_against_brute_force(spark, seed):
    rows = corpus(seed)
    assert sorted(map(tuple, V.code_report(table(spark, rows)).collect()), key=str) == brute(rows)


def test_blocks_do_not_matter(spark):
    rows = corpus(4)
    one, books = V.compressed(table(spark, rows))
    many, same = V.compressed(table(spark, rows).coalesce(1), block=7)
    assert (books == same).all()
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_other_widths(spark):
    rows = [(i, [math.sin(i * j + j) for j in range(11)], i % 3) for i in range(40)]
    assert sorted(map(tuple, V.code_report(table(spark, rows)).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 5, 16])
def test_few_rows(spark, n):
    rows = [(i, [0.01 * i * j for j in range(8)], None) for i in range(n)]
    out = V.code_report(table(spark, rows))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows)


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        V.code_report(table(spark, [(1, [1e9] * 8, 1)])).collect()
