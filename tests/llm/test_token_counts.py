import random

import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from webtraffic.llm import token_counts as T

ODD = "aaabcdeeersstlv'' \n\tÀÉİΣςé́ǅ日本語1٣²½😂😂🇺🇸.,!?-_ 　​\u0085ß"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(P.path(T.VOCABULARY))
    return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def counter():
    return T.Counter()


def odd_texts(seed, n, length=60):
    r = random.Random(seed)
    out = ["".join(r.choices(ODD, k=r.randint(0, length))) for _ in range(n)]
    return [t.replace(".", "<|endoftext|>").replace("!", "<|startoftext|>") if k % 4 == 0 else t for k, t in enumerate(out)]


def test_all_documents_as_the_library(counter, library):
    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist() if t]
    assert [counter.count(t) for t in texts] == library(texts)


def test_odd_texts_as_the_library(counter, library):
    texts = odd_texts(3, 3000) + ["'ll've're'd's'S'RE 'r 've", "''s", "?'s", "<|endoftext|", "<|<|endoftext|>|>", "x" * 5000, "ab" * 3000 + "1", "😂" * 300]
    assert [counter.count(t) for t in texts] == library(texts)


def test_every_tenth_code_point(counter, library):
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)}" for c in range(1, 0x110000, 10) if not 0xD800 <= c < 0xE000]
    assert [counter.count(t) for t in texts] == library(texts)


def test_dropping_states_changes_nothing(library):
    texts = odd_texts(5, 200)
    small = T.Counter(states=300)
    assert [small.count(t) for t in texts] == library(texts)
    assert len(small.states) <= 310


def test_maps_compose_in_any_grouping(counter):
    r = random.Random(8)
    for text in odd_texts(9, 60, 200):
        pieces, specials = counter.parts(text)
        text = " ".join(pieces)
        cuts = sorted(r.choices(range(len(text) + 1), k=6))
        maps = [counter.chunk_map(text[i:j]) for i, j in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        left = counter.compose([counter.compose(maps[:3]), counter.compose(maps[3:5]), *maps[5:]])
        assert counter.total(left) == counter.total(counter.compose(maps)) == counter.run(text)


@pytest.mark.parametrize("chunk", [7, 1 << 16])
def test_rows(spark, library, docs_of, chunk):
    texts = [*odd_texts(11, 60), "", "word " * 3000, "nospaceatall" * 40]
    rows = [*enumerate(texts), (None, "some text"), (5, texts[5]), (900, None)]
    docs = docs_of(rows).selectExpr("*", "1 as n_tokens", "2 as row", "'x' as chunk", "3 as n_bytes").repartition(3)
    out = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in T.token_counts(docs, chunk=chunk).collect()), key=str)
    n = library([t or "" for _, t in rows])
    assert out == sorted(((i, len((t or "").encode()), k, k > 2048) for (i, t), k in zip(rows, n, strict=True)), key=str)


def test_empty_table(spark, docs_of):
    assert T.token_counts(docs_of([])).collect() == []
