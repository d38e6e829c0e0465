import random

import pytest

import corpus_pipeline as P
from webtraffic.llm import suffix_repeats as S

from . import test_lsh_forest, test_suffix_repeats

NAMES = ["toxicity", "ngram_jaccard", "suffix_repeats", "mixing", "packing"]


@pytest.fixture()
def sf(spark, tmp_path):
    """A small folder of tables with toxic documents, near copies and a shared passage."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    lexicon = [word() for _ in range(800)]
    prose = lambda n: [r.choice(lexicon) for _ in range(n)]
    passage = " ".join(prose(70))
    docs, toxic = [], set()
    for i in range(360):
        w = prose(r.randint(20, 160))
        if i % 9 == 0:
            toxic.add(i)
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(["zzxqvil", "zzxqfoul", "zzxqrot"])
        elif i % 30 == 1:
            w[10:10] = [passage]
        docs.append((i, " ".join(w), "en", r.choice(["a", "b", None]), 0))
    for i in range(360, 380):
        docs.append((i, docs[i - 350 - i % 3][1] + " end", "en", "a", 0))
    docs.append((380, None, "en", "a", None))
    labels = [(i, 1, int(i in toxic)) for i in range(0, 360) if i % 5]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), {d[0]: d for d in docs}, toxic


def test_stages_do_their_work_in_order(spark, sf):
    folder, docs, toxic = sf
    assert [n for n, _ in P.STAGES] == NAMES
    rows, at = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in P.STAGES:
        stage(spark, rows, folder).write.parquet(f"{folder}/{name}")
        rows = spark.read.parquet(f"{folder}/{name}")
        at[name] = rows.collect()
        if name != "packing":
            assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {r.doc_id for r in at["toxicity"]}
    near_toxic = {i for i in range(360, 380) if (i - 350 - i % 3) in toxic}
    assert not kept & toxic and len(kept) >= 381 - len(toxic) - len(near_toxic) - 2

    left = [(r.doc_id, r.text) for r in at["toxicity"]]
    classes = {v[0] for v in test_lsh_forest.brute(left).values()}
    assert sorted(r.doc_id for r in at["ngram_jaccard"]) == sorted(classes)

    before = {r.doc_id: r.text for r in at["ngram_jaccard"]}
    order = sorted(before)
    want = test_suffix_repeats.brute([before[i] for i in order], 200)
    got = {r.doc_id: r for r in at["suffix_repeats"]}
    assert sorted(got) == order
    assert any(x[1] for x in want)
    for i, (n, gone, _, _) in zip(order, want, strict=True):
        assert len((got[i].text or "").encode()) == n - gone

    taken = {}
    for r in at["mixing"]:
        assert r.text == got[r.doc_id].text and r.text
        taken[r.doc_id] = taken.get(r.doc_id, 0) + 1
    assert set(taken.values()) <= {1, 2}
    pieces = {}
    for r in at["packing"]:
        pieces[r.doc_id] = pieces.get(r.doc_id, 0) + (r.piece == 0)
    assert pieces == taken


def test_run_equals_the_stages(spark, sf):
    folder, docs, _ = sf
    a = sorted((r.doc_id, r.piece, r.ids_crc32) for r in P.run(spark, folder).collect())
    b = sorted((r.doc_id, r.piece, r.ids_crc32) for r in P.run(spark, folder).collect())
    assert a == b and a


def test_cleaned_keeps_other_columns(spark):
    t = "x" * 50 + "ab" * 150
    docs = spark.createDataFrame([(1, t, 9), (2, None, 8)], "doc_id long, text string, spans int")
    out = {r.doc_id: r for r in S.cleaned(docs).collect()}
    assert out[2].text is None and out[2].spans == 8 and len(out[1].text) < len(t)


def test_an_empty_table_goes_through_all_stages(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert P.run(spark, str(tmp_path)).collect() == []
