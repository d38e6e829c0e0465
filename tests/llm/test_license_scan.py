import random
import re

import pytest

from webtraffic.llm import license_scan as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(t):
    words = WORD.findall(low(t))
    base = []
    for p, label in L.PHRASES.items():
        p = p.split()
        base += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    labels, best = {x for _, x in base}, 0.0
    for label, text in L.TEMPLATES:
        seq = text.split()
        want, n = set(seq), len(seq)
        long = n + -(-n // 4) if n >= 8 else n
        for i in range(max(1, len(words) - long + 1)):
            have = words[i : i + long]
            share = len(want & set(have)) / len(want)
            if (have == seq) if n < 8 else (share >= L.CONTAINED - 1e-12 and want & L.TELLING <= set(have)):
                labels.add(label)
                best = max(best, share)
    return (
        len(words), len(base), min(base)[0] if base else None, max(base)[0] if base else None,
        ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), 1.0 if base else best,
    )


def corpus(seed):
    r = random.Random(seed)
    lines = [t for _, t in L.TEMPLATES] + list(L.PHRASES) + ["Licensed under CC BY-NC 4.0.", "ALL RIGHTS reserved", "MIT\nLicense", "mit  license, MIT-License"]
    vocabulary = [w for t in lines for w in t.split()] + ["été", "É", "x1", "_", "the"]
    out = [None, "", "mit", "mit license", "license mit license", "日本 MIT license日", "a" * 5000]
    for _ in range(150):
        t = []
        for _ in range(r.randint(0, 6)):
            w = r.choice(lines).split(" ") if r.random() < 0.6 else r.choices(vocabulary, k=r.randint(1, 25))
            for _ in range(r.randint(0, 4)):
                w.insert(r.randint(0, len(w)), r.choice(vocabulary))
            if r.random() < 0.4:
                del w[r.randrange(len(w))]
            t.append(r.choice([" ", " ", ", "]).join(w))
        out.append(r.choice(["\n", " ", "\r\n"]).join(t))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_comparing_all_blocks_with_all_templates(spark, docs_of, seed):
    texts = corpus(seed)
    rows = L.scan(docs_of([(i, t) for i, t in enumerate(texts)]).repartition(3)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == {i: brute(t) for i, t in enumerate(texts)}


def test_prefix_filter_orders_by_corpus_frequency(spark, docs_of):
    docs = docs_of([(1, "the the the license license mit"), (2, "under the"), (2, "under the")])
    n = L.template_counts(docs, [("x", "the mit license under rare")])
    assert [n[L.word_hash(w)] for w in ("the", "license", "mit", "under", "rare")] == [5, 2, 1, 2, 0]
    (_, order), = L.frequency_order(n, [("x", "the mit license under rare")])
    assert order[:2] == [L.word_hash("rare"), L.word_hash("mit")] and order[-1] == L.word_hash("the")


def test_null_ids_repeated_rows_extra_columns_empty(spark, docs_of):
    docs = spark.createDataFrame([(None, "MIT License", 1.0)] * 2, "doc_id long, text string, score double")
    assert [tuple(r) for r in L.scan(docs).collect()] == [(None, 2, 1, 0, 0, "mit", "mit", 1.0)] * 2
    assert L.scan(docs_of([])).collect() == []


def _labels(spark, docs_of, text):
    (r,) = L.scan(docs_of([(1, text)])).collect()
    return r.labels, r.score


def test_notices_over_line_ends(spark, docs_of):
    bsd = "Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided"
    mit = "Permission is hereby granted, free of\ncharge, to any person\nobtaining a copy of this software and"
    assert _labels(spark, docs_of, "x y\n" + bsd) == ("bsd", 1.0)
    assert _labels(spark, docs_of, mit) == ("mit", 1.0)
    assert _labels(spark, docs_of, "All rights\nreserved.") == ("all-rights-reserved", 1.0)


def test_words_alone_are_no_license(spark, docs_of):
    assert _labels(spark, docs_of, "Released under the Apache License") == ("apache", 1.0)
    assert _labels(spark, docs_of, "The rights of all readers are reserved") == ("", 0.0)
    assert _labels(spark, docs_of, "license the version 2 0 under licensed") == ("", 0.0)
    # the words of a notice, spread over a long line
    spread = " ".join(w + " and so on" for w in "permission is hereby granted free of charge to any person obtaining a copy of this software".split())
    assert _labels(spark, docs_of, spread) == ("", 0.0)


def test_sql_gives_the_same_rows(spark, docs_of):
    import duckdb

    texts = corpus(3)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    want = con.execute("select doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score from (" + L.scan_sql() + ")").fetchall()
    assert sorted(map(tuple, L.scan(docs_of(list(enumerate(texts)))).collect())) == sorted(want)
