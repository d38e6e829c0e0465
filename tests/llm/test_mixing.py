import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from webtraffic.llm import mixing as M


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def targets(sizes):
    """{source: target} by sharing out again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: M.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total >= 2 * sizes[s]]
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = 2 * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


def corpus(seed, n=400):
    r = random.Random(seed)
    out = []
    for i in range(n):
        s = r.choice(["b", "a", "é", "", None, "zz", "hot", "hot", "hot"])
        t = None if r.random() < 0.02 else r.choice([" ", "\n"]).join("w" for _ in range(r.choice([0, 1, 7, 7, 40, r.randrange(300)])))
        out.append((i, t, "en", s, 0))
    return out + out[:9]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_taken_words(spark, docs_of, seed):
    rows = corpus(seed)
    got = M.mix_report(docs_of(rows).repartition(4)).collect()
    again = M.mix_report(docs_of(rows)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert len(got) == len(rows)
    src, per = {r[0]: r[3] for r in rows}, {}
    for i, t, _, s, _ in rows:
        per[s] = per.get(s, 0) + size(t)
    want, taken = targets(per), dict.fromkeys(per, 0)
    for r in got:
        s = src[r.doc_id]
        assert r.source_size == per[s]
        assert r.target == pytest.approx(want[s])
        assert r["size"] == size(rows[r.doc_id][1])
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[s] += r.taken
    for s in per:
        assert abs(taken[s] - want[s]) <= 1, (s, taken[s], want[s])


def test_rows_of_the_mix_are_repeated_or_left_out(spark, docs_of):
    rows = corpus(5)
    docs = docs_of(rows)
    taken = {}
    for r in M.mix_report(docs).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + (r.taken // r["size"] if r["size"] else 0)
    got = {}
    m = M.mix(docs)
    assert m.columns == docs.columns
    for r in m.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in taken.items() if v}


def test_clashing_names_and_empty_table(spark, docs_of):
    d = spark.createDataFrame([(1, "a b", "s", 5, 6)], "doc_id long, text string, source string, mix int, size int")
    assert [tuple(r) for r in M.mix(d).collect()] in ([(1, "a b", "s", 5, 6)], [])
    assert M.mix_report(docs_of([])).collect() == []
    assert M.mix_report(docs_of([(1, "", "en", "s", 0), (2, None, "en", None, 0)])).count() == 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(1, 4)), min_size=1, max_size=6), st.integers(0, 200))
def test_bounded_subset_is_the_best(items, budget):
    sizes, counts = zip(*items, strict=True)
    sums = {0}
    for s, c in items:
        sums = {x + k * s for x in sums for k in range(c + 1) if x + k * s <= budget}
    n = M.bounded_subset(list(sizes), list(counts), budget)
    assert all(0 <= a <= c for a, c in zip(n, counts, strict=True))
    assert sum(a * s for a, s in zip(n, sizes, strict=True)) == max(sums)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3000), min_size=1, max_size=40, unique=True), st.integers(0, 10**6), st.randoms())
def test_fit_never_takes_more_than_there_is(sizes, words, r):
    counts = [r.randint(1, 50) for _ in sizes]
    t = M.fit_budget(np.array(sizes), np.array(counts), words)
    assert (t >= 0).all() and (t <= np.array(counts)).all()
    assert (t * np.array(sizes)).sum() <= words
