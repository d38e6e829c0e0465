import hashlib
import random

import pytest

from webtraffic.llm import suffix_repeats as S


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for t in data:
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(r.randint(20, 80)) for _ in range(4)]
    texts = [None, "", "short", "ab" * 300, "x" * 700]
    for _ in range(60):
        t = prose(r.randint(1, 60))
        for _ in range(r.randint(0, 3)):
            p = r.choice(shared)
            a = r.randint(0, len(p) // 2)
            t += " " + p[a : a + r.randint(40, len(p))] + " " + prose(r.randint(0, 9))
        texts.append(t)
    near = list(prose(150))
    for _ in range(12):
        near[r.randrange(len(near))] = "#"
        texts.append("".join(near))
    texts += texts[5:9]
    return texts


def got(rows):
    return sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)


@pytest.mark.parametrize(("seed", "max_scan"), [(1, 1024), (2, 1024), (3, 3), (4, 1)])
def test_removes_exactly_the_repeated_bytes(spark, docs_of, seed, max_scan, monkeypatch):
    monkeypatch.setattr(S.remove_repeats, "__defaults__", (200, S.GRAM, max_scan))
    texts = corpus(seed)
    docs = docs_of([(i if i % 7 else None, t) for i, t in enumerate(texts)])
    assert got(S.digests(docs.repartition(3)).collect()) == sorted(brute(texts, 200))


def test_same_id_with_other_text_and_clashing_columns(spark):
    texts = ["a" * 150 + "b" * 150, "c" * 90, "a" * 150 + "b" * 150]
    docs = spark.createDataFrame(
        [(1, t, 0, 0, 0) for t in texts], "doc_id long, text string, s int, spans int, tag int"
    )
    assert got(S.digests(docs).collect()) == sorted(brute(texts, 200))


def test_empty_table(docs_of):
    assert S.digests(docs_of([])).collect() == []


def test_intervals_of_a_small_array():
    # suffixes of banana: a, ana, anana, banana, na, nana with common prefixes 1, 3, 0, 0, 2
    import numpy as np

    got = S.lcp_intervals(np.array([0, 1, 3, 0, 0, 2]))
    assert sorted(got) == [(1, 0, 2), (2, 4, 5), (3, 1, 2)]


def test_all_occurrences_of_a_repeat_share_its_number(spark, docs_of):
    passage = "".join(chr(97 + (i * i) % 26) for i in range(260))
    docs = docs_of([(i, f"{chr(65 + i) * 90}{passage}{chr(75 + i) * 90}") for i in range(5)])
    rows = S.maximal_repeats(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r["repeat"], set()).add(r["rid"])
    assert any(len(v) == 5 for v in by.values())


@pytest.mark.parametrize("max_scan", [1024, 1])
def test_copies_share_the_repeats_of_other_texts(spark, docs_of, max_scan):
    r = random.Random(5)
    text = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    passage, a = text(600), [text(300), text(300)]
    copies = [(i, a[0] + passage + a[1]) for i in range(6)]
    whole = dict(copies + [(6, text(300) + passage + text(300))])
    rows = S.maximal_repeats(docs_of(list(whole.items())), 200, S.GRAM, max_scan).collect()
    by = {}
    for x in rows:
        by.setdefault(x["repeat"], []).append((x["rid"], whole[x["rid"]][x["s"] : x["e"]]))
    # whatever group the seventh text is in, all copies are in it, with the same bytes
    for group in by.values():
        own = {t for i, t in group if i == 6}
        if own:
            assert {i for i, t in group if t in own} == set(range(7))
    spans = sorted((x["s"], x["e"]) for x in rows if x["rid"] == 6)
    assert spans[0][0] == 300 and max(e for _, e in spans) == 900


@pytest.mark.parametrize("max_scan", [1024, 20, 1])
def test_near_copies_give_a_few_rows_each(spark, docs_of, max_scan):
    """Splitting a common k-gram costs rows in proportion to the variants, not to their window starts."""
    r = random.Random(9)
    base = [r.choice("abcdefghijklmnop") for _ in range(420)]
    texts = []
    for _ in range(300):
        t = list(base)
        t[r.randrange(len(t))] = r.choice("0123456789") + "#"
        texts.append("".join(t))
    docs = docs_of(list(enumerate(texts)))
    rows = S._repeats(docs, 200, S.GRAM, max_scan, every=False)
    assert rows.count() <= 25 * rows.select("rid", "tag").distinct().count()
    assert got(S.remove_repeats(docs, 200, S.GRAM, max_scan).transform(S._digest).collect()) == sorted(brute(texts, 200))
