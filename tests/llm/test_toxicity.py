import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from webtraffic.llm import toxicity as T


def keys(text):
    """n-gram keys of one text, by hand."""
    out, word = [], b""
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    for c in low + b" ":
        if c >= 128 or chr(c).isalnum():
            word += bytes([c])
        elif word:
            full = bytes(4) + word + b"\1"
            out += [int.from_bytes(full[i : i + 5], "big") for i in range(len(full) - 4)]
            word = b""
    return out


def test_keys_of_words():
    texts = ["Ab c", "", "é, the\nthe", "!!", "x"]
    data = b"".join(t.encode() for t in texts)
    off = np.cumsum([0] + [len(t.encode()) for t in texts])
    k, first, text = T.spelled(np.frombuffer(data, np.uint8), off)
    assert k.tolist() == [x for t in texts for x in keys(t)]
    assert text.tolist() == [0, 0, 2, 2, 2, 4]
    assert len(first) == 6


def test_shared_model_is_a_distribution(spark, docs_of):
    docs = docs_of([(i, t) for i, t in enumerate(["the cat sat", "the dog sat", None, "a cat"])])
    labels = spark.createDataFrame([(0, 1)], "doc_id long, toxic int")
    g = T.gram_counts(docs, labels)
    n = {r.key: r.n for r in g.collect()}
    want = {}
    for t in ["the cat sat", "the dog sat", "a cat"]:
        for k in keys(t):
            want[k] = want.get(k, 0) + 1
    assert n == want
    by = T.shared_model(g).groupBy(F.shiftright("key", 8).alias("ctx")).agg(F.sum("p").alias("p")).collect()
    assert all(0 < r.p <= 1 + 1e-9 for r in by)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = T.scored(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    hit = sum(r.predicted for r in held if r.toxic)
    false = sum(r.predicted for r in held if not r.toxic)
    print("held out", len(held), "toxic", sum(r.toxic for r in held), "found", hit, "false", false)
    assert hit >= 0.7 * sum(r.toxic for r in held) and false <= 0.01 * len(held)


def test_labels_of_held_out_rows_do_not_matter(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    wrong = labels.withColumn("toxic", F.when(T.fold(F.col("doc_id")) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({tuple(r) for r in T.scored(docs, x).collect()} for x in (labels, wrong))
    assert a == b


@pytest.mark.parametrize("toxic", [[], [(1, 0), (3, 0)], [(1, None)]])
def test_edges(spark, docs_of, toxic):
    docs = docs_of([(1, "a"), (1, "a"), (None, None), (3, ""), (4, "b " * 30000)])
    labels = spark.createDataFrame(toxic, "doc_id long, toxic int")
    rows = T.scored(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert T.without_toxic(docs, labels).columns == docs.columns
    assert T.scored(docs_of([]), labels).collect() == []


def test_logistic_fit_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 5))
    y = (x[:, 1] > 1).astype(float)
    w = T.fit_logistic(x, y)
    assert ((x @ w[:-1] + w[-1] > 0) == y).mean() > 0.97


@pytest.mark.parametrize("bits", [0, 6, 11])
def test_scores_do_not_depend_on_how_many_ngrams_a_worker_holds(spark, bits):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    docs = docs.unionByName(docs.limit(3))  # repeated rows are scored alike
    want, got = (sorted((r.place, r.score, r.predicted) for r in T.scored(docs, labels, b).collect()) for b in (22, bits))
    assert [(p, x) for p, _, x in got] == [(p, x) for p, _, x in want]
    assert np.allclose([s for _, s, _ in got], [s for _, s, _ in want], rtol=1e-9, atol=1e-12)


def test_every_ngram_keeps_its_own_ratio():
    key = np.unique(np.random.default_rng(1).integers(1, 1 << 40, 200_000).astype(np.uint64))
    ratio = np.arange(len(key), dtype=np.float32) + 1
    s = T.Scorer(key, [ratio, -ratio])
    assert (s.values[0][s.find(key)] == ratio).all() and (s.values[1][s.find(key)] == -ratio).all()
    other = np.setdiff1d(key + np.uint64(1), key)
    assert (s.values[0][s.find(other)] == 0).all()
