import numpy as np
import pytest

from webtraffic.llm import pivot_annuli as A
from webtraffic.llm import vantage_trees as T
from webtraffic.llm import vectors as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, k, scale=None):
    ok = [(i, np.array(x, np.float32).astype(np.float64)) for i, x in rows if i is not None and x is not None and all(v is not None and np.isfinite(v) for v in x)]
    if scale:
        ok = [(i, np.floor(scale * x)) for i, x in ok]
    else:
        ok = [(i, x) for i, x in ok if x.any()]
    out = set()
    for q, x in {i: x for i, x in ok if i % every == 0}.items():
        best = sorted((-float(x @ y), j) for j, y in ok if j != q)[:k]
        out |= {(q, n + 1, j, round(-s, 4)) for n, (s, j) in enumerate(best)}
    return out


def got(df):
    return {(r.query_id, r["rank"], r.vec_id, round(r.score, 4)) for r in df.collect()}


def corpus(seed, n=900, dim=8):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, dim))
    x = centre[rng.integers(12, size=n)] + 0.3 * rng.normal(size=(n, dim))
    x *= rng.uniform(0.2, 2, size=(n, 1))
    x[: n // 3] = np.round(x[0], 2)  # one very common vector
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(n, None), (n + 20, [float("nan")] * dim), (n + 40, [0.0] * dim), (None, [1.0] * dim), (n + 60, [None, *[1.0] * (dim - 1)]), (n + 80, [float("inf")] * dim)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, x, 0) for i, x in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_pivot_annuli_are_exact(spark, seed):
    rows = corpus(seed)
    assert got(A.top_scores(table(spark, rows), every=50, k=5)) == brute(rows, 50, 5, 256)


@pytest.mark.parametrize("seed", [1, 2])
def test_factor_one_is_exact(spark, seed):
    rows = corpus(seed)
    assert got(T.nearest(table(spark, rows), factor=1, shard=300)) == brute(rows, 20, 20)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_every_query_gets_its_rows(spark, sf):
    """The production factor gives min(k, candidates) rows, factor 1 the rows of all scores."""
    import pyarrow.parquet as pq

    t = pq.read_table(f"/root/testdata/{sf}/embeddings.parquet")
    ids, x = t.column("vec_id").to_numpy(), np.array(t.column("embedding").to_pylist(), np.float32).astype(np.float64)
    data = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    want = {}
    for i in np.flatnonzero(ids % 20 == 0):
        score = T.exact(np.broadcast_to(x[i], x.shape), x)
        order = [j for j in np.lexsort((ids, -score)) if j != i][:20]
        want[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    for factor in (T.FACTOR, 1.0):
        out = {}
        for r in sorted(T.nearest(data, factor=factor).collect(), key=lambda r: r["rank"]):
            out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert {q: len(v) for q, v in out.items()} == {q: len(v) for q, v in want.items()}
    assert out == want


@pytest.mark.parametrize("factor", [1.0, 50.0])
def test_full_rows_with_a_small_sample_and_copies(spark, monkeypatch, factor):
    rows = corpus(6, 1500)
    monkeypatch.setattr(T, "sample", lambda rows, width: V.sample(rows, width, 40))
    out = [(r.query_id, r["rank"]) for r in T.nearest(table(spark, rows), factor=factor, shard=200).collect()]
    queries = {i for i, x in rows if i is not None and i < 1500 and i % 20 == 0}
    assert sorted(out) == [(q, n) for q in sorted(queries) for n in range(1, 21)]


def test_relaxed_pruning_computes_less_and_finds_most(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 16)) + 3 * rng.normal(size=(40, 16))[rng.integers(40, size=4000)]
    x /= np.linalg.norm(x, axis=1)[:, None]
    order, near, far = T.tree(x, 1.0)
    ids, q = np.arange(4000)[order], x[::20]
    done, found = {}, {}
    for factor in (1.0, 2.0, 4.0):
        best = T.Best(np.arange(4000)[::20], 20, np.full(len(q), -np.inf))
        done[factor] = T.search(x[order], ids, near, far, 1.0, q, best, factor)
        found[factor] = [set(r) for r in best.id.tolist()]
    recall = lambda f: np.mean([len(a & b) / 20 for a, b in zip(found[f], found[1.0], strict=True)])
    assert done[1.0] > done[2.0] > done[4.0]
    assert recall(2.0) >= 0.9 and recall(2.0) >= recall(4.0)


def test_recall_of_the_production_factor(spark):
    import glob

    import pyarrow.parquet as pq

    t = pq.read_table(glob.glob("/root/testdata/sf0.1/embeddings.parquet")[0])
    rows = list(zip(t.column("vec_id").to_pylist(), t.column("embedding").to_pylist(), strict=True))
    want = {(q, j) for q, _, j, _ in brute(rows, 20, 20)}
    have = {(r.query_id, r.vec_id) for r in T.nearest(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")).collect()}
    print("recall", len(want & have) / len(want))
    assert len(want & have) >= 0.95 * len(want)


def test_rings_that_are_out_of_reach_are_not_scored():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(3000, 2)) * 200)
    largest = (x * x).sum(axis=1).max()
    e = A.extended(x, largest)
    pivot = e[:1]
    d = A.distances(e, pivot)[:, 0]
    o = np.argsort(d, kind="stable")
    q, own = x[:50], np.arange(50)
    best = A.Best(own, 5, np.full(50, -np.inf))
    fq = A.distances(np.column_stack([q, np.zeros(50)]), pivot)[:, 0]
    n = A.expand(x[o], np.arange(3000)[o], d[o], q, fq, largest, best, ring=64)
    assert n < 50 * 3000
    want = brute([(i, v) for i, v in enumerate(x)], 1, 5)
    assert {(i, j) for i in range(50) for j in best.id[i].tolist()} == {(a, b) for a, _, b, _ in want if a < 50}


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0])], [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (100, [2.0]), (3, [])]])
def test_few_rows(spark, rows):
    for f in (T.nearest, A.top_scores):
        out = f(spark.createDataFrame([(i, x, 0) for i, x in rows], SCHEMA)).collect()
        assert all(r.query_id != r.vec_id for r in out)
    if len(rows) > 1:
        out = A.top_scores(spark.createDataFrame([(i, x, 0) for i, x in rows], SCHEMA)).collect()
        assert {(r.query_id, r.vec_id, r.score) for r in out} == {(0, 100, 256 * 512), (0, 3, 0), (100, 0, 256 * 512), (100, 3, 0)}
