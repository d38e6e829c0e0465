import random

import numpy as np
import pytest

from webtraffic.llm import lsh_forest as L


def grams(t):
    w = (t or "").encode().lower().split()  # bytes: ASCII case and white space
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    """{doc_id: (class_id, copy_id, n_links, n_text_links)} over all pairs."""
    texts = {}
    for i, t in docs:
        texts.setdefault(t or "", []).append(i)
    keys = list(texts)
    sets = [grams(t) for t in keys]
    near = {k: set() for k in range(len(keys))}
    for a in range(len(keys)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
                near[a].add(b)
                near[b].add(a)
    out, done = {}, set()
    for a in range(len(keys)):
        if a in done:
            continue
        group, todo = set(), [a]
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += near[x]
        done |= group
        low = min(i for x in group for i in texts[keys[x]])
        for x in group:
            linked = sum(len(texts[keys[y]]) for y in near[x])
            for i in texts[keys[x]]:
                out[i] = (low, min(texts[keys[x]]), linked + len(texts[keys[x]]) - 1, len(near[x]))
    return out


def corpus(seed):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(300)] + ["É", "été", "A"]
    base = [[r.choice(words) for _ in range(r.choice([3, 8, 30, 120, 400]))] for _ in range(25)]
    docs = ["", None, "  ", "one", "One", "one two three four", "ONE two three four"]
    for b in base:
        docs.append(" ".join(b))
        for _ in range(r.randint(0, 8)):
            c = list(b)
            for _ in range(r.randint(0, max(1, len(c) // 25))):
                c[r.randrange(len(c))] = r.choice(words)
            docs.append(("\n" if r.random() < 0.3 else " ").join(c))
    docs += r.choices(docs, k=30)
    r.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize(("seed", "block"), [(1, 128), (2, 128), (3, 2)])
def test_links_and_classes_equal_brute_force(spark, docs_of, seed, block):
    docs = corpus(seed)
    rows = L.near_duplicates(docs_of(docs).repartition(3), block=block).collect()
    got = {r.doc_id: (r.class_id, r.copy_id, r.n_links, r.n_text_links) for r in rows}
    assert got == brute(docs)
    assert sum(r.keeper for r in rows) == len({r.class_id for r in rows})


def test_a_large_group_of_near_copies(spark, docs_of):
    r = random.Random(7)
    base = ["t%d" % r.randrange(500) for _ in range(150)]
    docs = []
    for i in range(400):
        c = list(base)
        for _ in range(r.randint(0, 5)):
            c[r.randrange(150)] = "x%d" % r.randrange(50)
        docs.append((i, " ".join(c)))
    rows = L.near_duplicates(docs_of(docs), block=32).collect()
    got = {r.doc_id: (r.class_id, r.copy_id, r.n_links, r.n_text_links) for r in rows}
    assert got == brute(docs)


def test_null_ids_repeated_rows_and_clashing_columns(spark):
    long = " ".join("a%d" % i for i in range(40))
    rows = [(None, long, 1), (7, long, 2), (7, long, 2), (3, long + " end", 3), (None, "other", 4), (None, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int")
    got = {(r.doc_id, r.class_id, r.n_links) for r in L.near_duplicates(docs).collect()}
    assert got == {(None, 3, 3), (7, 3, 3), (3, 3, 3), (None, None, 0)}
    kept = L.one_per_class(docs)
    assert kept.columns == ["doc_id", "text", "key"]
    assert sorted((r.doc_id is None, r.doc_id, r.key) for r in kept.collect() if r.doc_id) == [(False, 3, 3)]
    assert kept.count() == 3


def test_empty_table(docs_of):
    assert L.near_duplicates(docs_of([])).collect() == []


def test_depth_shortens_until_the_recall():
    assert L.forest_depth(0.8, 32, 0.9999) == 6
    assert L.forest_depth(0.8, 32, 0.5) > L.forest_depth(0.8, 32, 0.99) > L.forest_depth(0.8, 4, 0.99)


def test_spanning_edges_connect_and_stay_sparse():
    link = np.zeros((9, 9), bool)
    for a, b in [(0, 4), (4, 8), (2, 3), (5, 6), (6, 7), (7, 5)]:
        link[a, b] = link[b, a] = True
    assert len(L.spanning(link)) == 2 + 1 + 2
