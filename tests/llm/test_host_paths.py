import html
import re

import pytest

from webtraffic.llm import host_paths as H


def texts(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in H.main_text(pages.repartition(3)).collect()}


def page(body, menu="<nav><a href='/'>Home</a></nav>"):
    return f"<html><head><title>T</title><style>p{{}}</style></head><body>{menu}{body}<footer>foot &copy;</footer></body></html>"


def test_pieces_of_a_page():
    p = page(
        "<!-- <p>no</p> --><div class='ad-box'>buy</div><script>var t='</p><p>x';</script>"
        "<article><h1>Head &amp; line</h1><p>one\n  two<br>three<p><b>four &lt;b&gt; <i>five</i><ul><li>six<li>seven</ul>"
        "<form>f<input></form><aside>side</aside><div id=comments><p>reader</p></div><blockquote>eight</blockquote></article>"
        "<section class=\"cookieNotice\">we use cookies</section>"
    )
    assert H.extract(p, []) == "Head & line\none two three\nfour <b> five\nsix\nseven\neight"


@pytest.mark.parametrize(
    ("cut", "want"),
    [("<p>a &am", "a &am"), ("<p>a<", "a<"), ("<p>a</", "a"), ("<p>a<b cla", "a"), ("<p>a<!-- b", "a"), ("<p>2 < 3 <4", "2 < 3 <4"), ('<p title="x>a', "a"), ("", ""), ("plain", "plain")],
)
def test_broken_pages(cut, want):
    assert H.extract(cut, []) == want


def test_an_open_menu_ends_where_the_article_begins():
    assert H.extract("<body><nav><ul><li>Home<article><p>text</article>", []) == "text"


STORY = "<div class='story s%d'><p>%s</p></div><div class='more'><p>%s</p></div>"
LINKS = "<a href=/a>one more page</a> <a href=/b>another page</a>"


def test_an_odd_page_follows_its_host(spark):
    """Its own best container is the body; the host's path holds over half of that."""
    rows = [(i, "http://www.h.example/%d" % i, page(STORY % (i, "long text " * 30, LINKS))) for i in range(9)]
    rows.append((9, "https://h.example/odd", page(STORY % (9, "a text " * 30, "what others wrote " * 8))))
    rows.append((10, "https://other.example/odd", page(STORY % (9, "a text " * 30, "what others wrote " * 8))))
    got = texts(spark, rows)
    assert got[3] == " ".join(["long text"] * 30) and got[9] == " ".join(["a text"] * 30)
    assert got[10].endswith("what others wrote")


def test_a_teaser_does_not_replace_an_article(spark):
    """A host's path with one line gives way to the page's own."""
    rows = [(i, "http://h.example/%d" % i, page(STORY % (i, "long text " * 30, LINKS))) for i in range(9)]
    rows.append((9, "http://h.example/9", page("<div class='story s9'><p>A teaser</p></div><div class=other><p>%s</p></div>" % ("article " * 300))))
    got = texts(spark, rows)
    assert got[9].endswith(" ".join(["article"] * 300))


def test_parts_of_a_post_stay(spark):
    post = "<div class=post><div class=intro><p>Intro here</p></div><div class=text><p>%s</p></div><div class=tail><p>The tail</p></div></div><ul><li><a href=/x>Elsewhere</a></ul>"
    rows = [(i, f"http://h.example/{i}", page(post % ("word " * n))) for i, n in enumerate([2, 40, 3000])]
    got = texts(spark, rows)
    for i, n in enumerate([2, 40, 3000]):
        assert got[i] == "Intro here\n" + " ".join(["word"] * n) + "\nThe tail"


def test_every_template_of_a_mixed_host_is_read(spark):
    rows = []
    for i in range(60):
        t = "abcdef"[i % 6]
        rows.append((i, f"http://h.example/{i}", page(f"<div class=t{t}><div class=in{t}><p>text {i} {'more ' * 50}</p></div></div><div class=list><p>{LINKS}</p></div>")))
    got = texts(spark, rows)
    assert all(got[i] == f"text {i} " + " ".join(["more"] * 50) for i in range(60))


def test_a_doubtful_name_does_not_decide_alone():
    long = " ".join(["word"] * 100)
    assert H.extract(page(f"<div class=share-story><p>{long}</p></div>"), []) == long
    assert H.extract(page(f"<div class=share-story><p>{long}</p></div><div>Imprint</div><div class=story-share>Share it</div>"), []).startswith(long)
    assert H.extract(page(f"<div class=text><p>{long}</p></div><div class=story-share><p>Share this</p></div>"), []) == long
    assert H.extract(page("<div class=text><p>short</p></div><div id=reader-comments><p>%s</p></div>" % long), []) == "short"
    twice = f"<div class=my-widget><h1>Title</h1></div><div class=my-widget><p>{long}</p></div><div class=ad-slot>buy</div>"
    assert H.extract(page(twice), []) == "Title\n" + long


def test_boilerplate_paragraphs_end_with_the_next_block():
    assert H.extract(page("<article><p class=ad>buy<p>one<ul><li class=promo>buy<li>two</ul></article>"), []) == "one\ntwo"


def test_host_paths_against_a_count_of_all_votes(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    odd = [(-i, "http://odd.example/", page(f"<div class={'xyz'[i % 3] if i < 90 else 'rare' + 'abcdefghij'[i - 90]}>text here</div>")) for i in range(100)]
    pages = pages.unionByName(spark.createDataFrame(odd, "page_id long, url string, html string"))
    votes = {}
    for r in pages.select(H.host_of(pages.url).alias("host"), "html").collect():
        path = H.own_path(*H.parse(r.html or ""))
        if path is not None:
            votes.setdefault(r.host, []).append(path)
    want = {}
    for host, v in votes.items():
        n = {p: v.count(p) for p in v}
        if kept := sorted((p for p in n if n[p] >= 2 and n[p] * H.SHARE >= len(v)), key=lambda p: (-n[p], p)):
            want[host] = kept
    assert {r.host: r.paths for r in H.host_paths(pages.repartition(4)).collect()} == want
    assert len(want["odd.example"]) >= 1


def test_edges(spark):
    rows = [(1, None, None), (None, "x", ""), (3, "http://h", "<article>" + "<div>" * 30_000 + "</section>" * 30_000 + "deep"), (3, "http://h", "x"), (4, "http://h", "<p>" + "w " * 300_000)]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = H.main_text(pages).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 0), (3, 1), (3, 4), (4, 599_999)]
    assert H.main_text(pages.limit(0)).collect() == []


def test_generated_pages_give_their_article(spark):
    d = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{d}/pages.parquet")
    want = {}
    for r in pages.collect():
        body = re.sub(r"<!--.*?-->|<script.*?</script>", "", r.html, flags=re.S)
        body = body[body.index("<article>") + 9 :].split("</article>")[0]
        blocks = re.split(r"</?(?:p|h1)\b[^>]*>", re.sub(r"<br>", " ", body))
        blocks = [" ".join(html.unescape(re.sub(r"</?[a-z]\w*[^>]*(?:>|\Z)", "", b)).split()) for b in blocks]
        want[r.page_id] = "\n".join(b for b in blocks if b)
    got = {r.page_id: r.text for r in H.main_text(pages).collect()}
    assert got == want


@pytest.mark.parametrize("words", [1, 30, 3000])
def test_headline_and_lead_stay_whatever_the_length(spark, words):
    body = "<div class=page><h1>Title</h1><p>Lead</p><div class=wrap><div class=text><p>%s</p></div></div></div><ul><li><a href=/x>More to read elsewhere</a></ul>"
    long = " ".join(["word"] * words)
    rows = [(i, f"http://h.example/{i}", page(body % long)) for i in range(3)] + [(3, "http://h.example/3", page(body % "word"))]
    got = texts(spark, rows)
    assert got[0] == "Title\nLead\n" + long and got[3] == "Title\nLead\nword"


def test_a_headline_in_its_own_container_stays():
    p = page("<div class=page><div class=top><h1>Title</h1></div><div class=text><p>%s</p></div></div>" % ("word " * 300))
    assert H.extract(p, []).startswith("Title\nword")


def test_deep_pages_take_linear_time():
    p = "<div>" * 20_000 + "<p>" + "word " * 300 + "</p>" + "</div>" * 20_000
    assert H.extract(p, []) == " ".join(["word"] * 300)
