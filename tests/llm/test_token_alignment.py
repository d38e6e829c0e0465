import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from webtraffic.llm import token_alignment as T


@pytest.fixture(scope="module")
def side_a():
    """The named tokenizer file itself."""
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(" " + text, add_special_tokens=False).ids


def ends(ids, of):
    out, n = [], 0
    for i in ids:
        n += len(of[i])
        out.append(n)
    return out


def brute(texts, side_a):
    """Rows from sets of ends, one document at a time."""
    p = T.pair()
    docs = []
    for text in texts:
        text = text or ""
        a, b = (side_a(text), p.enc_b.encode(text)) if text else ([], [])
        if b"".join(p.bytes_b[i] for i in b) != b" " + text.encode():
            a, b = [], []
        ea, eb = ends(a, p.bytes_a), ends(b, p.bytes_b)
        cuts = sorted(set(ea) & set(eb))
        groups = [([i for i, e in zip(a, ea, strict=True) if s < e <= t], [i for i, e in zip(b, eb, strict=True) if s < e <= t]) for s, t in zip([0, *cuts], cuts, strict=False)]
        docs.append((a, b, groups, [(a[ea.index(c)], b[eb.index(c)]) for c in cuts]))
    count = Counter(x for d in docs for x in d[3])
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    join = lambda x: ",".join(map(str, x))
    return [
        (len(a), len(b), len(g), len(k), sum(count[x] == most[x[1]] for x in k), sum(count[x] for x in k),
         hashlib.sha256(";".join(f"{join(x)}|{join(y)}" for x, y in g).encode()).hexdigest() if a else "")
        for a, b, g, k in docs
    ]


def texts_of(seed, n):
    r = random.Random(seed)
    some = [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist() if t]
    cut = lambda t: t[(i := r.randrange(len(t))) : i + r.randint(1, 300)]
    odd = ["", None, " ", "  two  spaces ", "a▁b", "<|endoftext|>", "<s> </s><unk><0x41>", "\x00\n\r\t", "日本語🇺🇸é́", "x" * 700, "ﬁ ½ ǅ İ"]
    return [*(cut(r.choice(some)) for _ in range(n)), *odd, "the same text", "the same text"]


@pytest.mark.parametrize("work,table", [(T.WORK, T.TABLE), (3, 20), (17, 0)])
def test_report_against_brute_force(spark, docs_of, side_a, work, table):
    texts = texts_of(1, 60)
    docs = docs_of([(i if i != 3 else None, t) for i, t in enumerate(texts)])
    docs = docs.selectExpr("*", "1 as links", "2 as row", "3 as n_a", "4 as key").repartition(3)
    out = T.alignment_report(docs, work=work, table=table).collect()
    got = {r.doc_id: tuple(r)[1:] for r in out}
    want = brute(texts, side_a)
    assert len(out) == len(texts)
    assert got == {i if i != 3 else None: w for i, w in enumerate(want)}


def test_all_documents_in_whole(spark, side_a):
    """Both sides of every document as their own libraries give them, and every digest."""
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    want = brute(t.column("text").to_pylist(), side_a)
    out = {r.doc_id: tuple(r)[1:] for r in T.alignment_report(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()}
    assert out == dict(zip(t.column("doc_id").to_pylist(), want, strict=True))


def test_ranks_file_encodes_as_the_tokenizer_file(side_a):
    p = T.pair()
    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist() if t]
    assert all(p.enc_a.encode_ordinary(" " + t) == side_a(t) for t in texts)


@pytest.mark.parametrize("seed", range(5))
def test_diagonals_and_pieces(seed):
    r = np.random.default_rng(seed)
    a, b = (np.unique(r.integers(1, 400, size=n)) for n in (150, 90))
    a, b = np.append(a, 400), np.append(b, 400)
    for work in (1, 2, 7, 50, 1000):
        i, j = T.diagonals(a, b, work)
        assert (i[0], j[0], i[-1], j[-1]) == (0, 0, len(a), len(b))
        assert (np.diff(i + j) <= work + 1).all() and (np.diff(i) >= 0).all() and (np.diff(j) >= 0).all()
        found = T.overlaps(a, b, work)
        assert found.end.tolist() == sorted({*a.tolist(), *b.tolist()})
        start = np.append(0, found.end[:-1])
        # each stretch lies in the two tokens named
        for x, e in ((found.a, a), (found.b, b)):
            assert (np.append(0, e)[x] <= start).all() and (found.end <= e[x]).all()
        assert found.end[found.cut].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_groups_cover_each_text(spark, docs_of):
    texts = texts_of(2, 20)
    rows = T.groups(docs_of(list(enumerate(texts))), work=5).collect()
    p = T.pair()
    for i, text in enumerate(texts):
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.group_no)
        assert [r.group_no for r in mine] == list(range(len(mine)))
        whole = (" " + (text or "")).encode()
        if mine:
            assert mine[-1].byte_to == len(whole)
        for r in mine:
            part = whole[r.byte_from : r.byte_to]
            assert b"".join(p.bytes_a[x] for x in r.a_ids) == part == b"".join(p.bytes_b[x] for x in r.b_ids)


def test_empty_table(spark, docs_of):
    assert T.alignment_report(docs_of([])).collect() == []
    assert T.groups(docs_of([])).collect() == []


def test_links_are_looked_at_in_slices_of_bounded_size():
    rows = [np.arange(n, dtype=np.int64) for n in (5, 0, 300, 1, 7, 0, 40)]
    batch = pa.RecordBatch.from_pydict({"row": list(range(7)), "links": pa.array([x.tobytes() for x in rows], pa.binary())})
    parts = list(T._links([batch.slice(1), batch], size=100))
    assert all(len(links) * 8 <= 100 or b.num_rows == 1 for b, links, _ in parts)
    got = [(b.column("row")[k].as_py(), links[s:t].tolist()) for b, links, begin in parts for k, (s, t) in enumerate(zip(begin, begin[1:], strict=False))]
    assert got == [(i, x.tolist()) for i, x in [*list(enumerate(rows))[1:], *enumerate(rows)]]
