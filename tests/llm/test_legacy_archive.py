import base64
import gzip
import hashlib
import random

import pytest

from webtraffic.llm import legacy_archive as A


def brute(pages):
    """(page_id, bytes, digest, type, refers_to) of each page, sorted."""
    out, first = [], {}
    for page_id, _, html in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0)):
        data = (html or "").encode()
        name = base64.b32encode(hashlib.sha1(data).digest()).decode()
        kind, to = ("revisit", first[name]) if name in first else ("response", None)
        first.setdefault(name, page_id)
        out.append((page_id, len(data), name, kind, to))
    return sorted(out, key=str)


def pages_of(seed):
    r = random.Random(seed)
    html = ["", None, "<p>é日本\r\n\r\nWARC/1.0\r\nfiledesc://x 1\n</p>", "x" * 300_000, "HTTP/1.1 200 OK\r\n\r\nbody", "a\n\nb", "\x00\x1f"]
    html += ["<p>%s</p>" % r.random() for _ in range(40)]
    rows = [(i, r.choice(["http://a.example/x y", "http://b.example/é", None, "https://c.example/\n"]), r.choice(html)) for i in range(300)]
    return rows + rows[:5] + [(None, "http://n.example", "only here"), (None, None, html[8])]


@pytest.mark.parametrize(("seed", "per_file"), [(1, 4096), (2, 7)])
def test_round_trip(spark, tmp_path, seed, per_file):
    rows = pages_of(seed)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    arc, warc = f"{tmp_path}/arc", f"{tmp_path}/warc"
    A.write_arc(pages, arc, per_file=per_file)
    records = A.read_arc(spark, arc)
    assert records.count() == len(rows)
    types = A.record_types(A.read_arc(spark, arc, bodies=False))
    A.to_warc(records.join(types, ["file", "number"]), warc, per_file=per_file)
    got = A.read_warc(spark, warc).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == brute(rows)
    assert len({r.record_id for r in got}) == len(rows)
    assert {r.date for r in got} == {"2000-01-01T00:00:00Z"}


def test_query_rows_with_clashing_columns_and_empty_table(spark):
    rows = [(2, "u", "same", 1), (1, "u", "same", 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, number int")
    got = sorted(tuple(r)[:5] for r in A.archived(pages).collect())
    assert got == brute([r[:3] for r in rows])
    assert A.archived(pages.limit(0)).collect() == []


@pytest.mark.parametrize("version", [1, 2])
def test_header_fields_of_each_version(version):
    body = b"HTTP/1.1 200 OK\r\n\r\nhello"
    extra = b"" if version == 1 else b" 200 abc - 0 f.arc"
    line = b"http://h.example/ 1.2.3.4 19970101123456 text/html%s %d\n" % (extra, len(body))
    plain = A.arc_version_block(version, "f.arc") + b"\n" + line + body + b"\n\n" + line + body + b"\n"
    for data in (plain, gzip.compress(plain), gzip.compress(plain[:40]) + gzip.compress(plain[40:])):
        records = list(A.arc_records(data))
        assert [r[0] for r in records] == [0, 1]
        assert records[0][1]["Archive-date"] == "19970101123456" and records[1][2] == body
        assert ("Result-code" in records[0][1]) == (version == 2)


def test_a_short_record_or_a_wrong_header_raises():
    head = A.arc_version_block(1, "f.arc") + b"\n"
    with pytest.raises(ValueError, match="declared"):
        list(A.arc_records(head + b"http://h/ 1.2.3.4 19970101 text/html 99\nabc\n"))
    with pytest.raises(ValueError, match="fields"):
        list(A.arc_records(head + b"http://h/ 1.2.3.4 19970101 text/html 200 - - 0 f 3\nabc\n"))
    with pytest.raises(ValueError, match="version block"):
        list(A.arc_records(b"http://h/ 1.2.3.4 19970101 text/html 3\nabc\n"))


def test_types_and_dates():
    assert A.warc_type("dns:h.example", b"x")[0] == "resource"
    assert A.warc_type("http://h", b"HTTP/1.0 200 OK\r\n\r\n")[0] == "response"
    assert A.warc_date("199701011234") == "1997-01-01T12:34:00Z"
