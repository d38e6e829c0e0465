import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from webtraffic.llm import packing as P


def check(placed, sizes, capacity):
    """Every piece once, sequences gapless from 0 and within the capacity; their number."""
    assert sorted(r[0] for r in placed) == sorted(sizes)
    by = {}
    for item, b, offset in placed:
        by.setdefault(b, []).append((offset, sizes[item]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by)


KINDS = {
    "mixed": lambda r: min(2048, int(np.exp(r.gauss(6.5, 1.1))) + 1),
    "tiny": lambda r: r.randint(1, 40),
    "same": lambda r: 700,
    "two": lambda r: r.choice([30, 900]),
    "full": lambda r: 2048,
}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("tail", [P.TAIL, 0])
def test_packs_all_pieces_as_tightly_as_best_fit(spark, kind, tail):
    r = random.Random(kind)
    sizes = {i: KINDS[kind](r) for i in range(3000)}
    items = spark.createDataFrame(list(sizes.items()), "item long, size long").repartition(5)
    used = check([tuple(x) for x in P.pack(items, tail=tail).collect()], sizes, 2048)
    best = 1 + max(k for k, _ in P.best_fit(sorted(sizes.values(), reverse=True), 2048))
    assert used <= best * 1.01 + 2


def test_sweep_equals_one_bracket_matching(spark):
    r = random.Random(4)
    pieces = [(i, r.randint(1, 60)) for i in range(500)]
    gaps = [(i, r.randint(1, 60)) for i in range(300)]
    near, cross = P.sweep(
        spark.createDataFrame(pieces, "item long, size long").repartition(4),
        spark.createDataFrame(gaps, "bin long, gap long"),
    )
    got = {(x.item, x.bin) for x in near.collect()} | {(x.item, x.bin) for x in cross.where("state = 'm'").collect()}
    free, want = [], set()
    for _, kind, i in sorted([(s, 0, i) for i, s in pieces] + [(g, 1, i) for i, g in gaps]):
        if kind == 0:
            free.append(i)
        elif free:
            want.add((free.pop(), i))
    assert got == want
    rest = cross.where("state <> 'm'").collect()
    assert {x.item for x in rest if x.state == "p"} == set(free)
    assert len(rest) == 800 - 2 * len(want)


def test_ids_are_the_tokenizers(spark, docs_of):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(3)
    odd = ["", None, "a", "don't  stop\n\n x", "<|endoftext|> a<|endoftext|>", "<|x|>", "é日本   x\x1cy\x85z", " \t\n ", "ab" * 3000]
    texts = odd + ["".join(r.choice(" \n\tabcXYZ019.,'é 日\x1f<|>") for _ in range(r.randint(1, 400))) for _ in range(60)]
    texts.append(" ".join("word%d" % r.randrange(900) for _ in range(4000)))
    docs = docs_of(list(enumerate(texts)))
    rows = P.packed_pieces(docs.repartition(3)).collect()
    by = {}
    for x in rows:
        by.setdefault(x.doc_id, []).append(x)
    assert len(by) == len(texts)
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want = []
        for k, (s, n) in enumerate(P.cuts(len(ids), 2048)):
            want.append((k, s, n, zlib.crc32(ids[s : s + n].tobytes())))
        assert sorted((x.piece, x.start, x.length, x.ids_crc32) for x in by[i]) == want
    sizes = {(x.doc_id, x.piece): x.length for x in rows}
    check([((x.doc_id, x.piece), x.sequence_id, x.offset) for x in rows], sizes, 2048)


def test_repeated_rows_null_ids_and_empty_table(spark, docs_of):
    docs = spark.createDataFrame([(None, "a b", 1), (1, "a b", 2), (1, "a b", 2)], "doc_id long, text string, item int")
    assert len(P.packed_pieces(docs).collect()) == 3
    assert P.packed_pieces(docs_of([])).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 40), st.integers(2, 9))
def test_cuts_are_full_but_the_first(n, capacity):
    c = P.cuts(n, capacity)
    assert [s for s, _ in c] == [sum(k for _, k in c[:i]) for i in range(len(c))]
    assert sum(k for _, k in c) == n and all(k == capacity for _, k in c[1:])
    assert len(c) == max(1, -(-n // capacity))
