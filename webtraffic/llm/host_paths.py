"""HTML main text by consensus host paths.

1. Each page's containers are scored: characters of text outside boilerplate, links counting
   against them. A page votes for one path: the article around the deepest container that holds
   nearly all of the best score, or else the container around it up to where only link lists
   are added. A path lists tags with their classes from the root, with digits generalised,
   so that pages of one template agree.
2. Votes are added up per host in Spark, in part before the shuffle. A path wins on a host with two
   votes or more that are at least one in ``SHARE`` of the host's; there is no cap on templates.
3. Every page is extracted again. A page whose own path is among its host's winners keeps it; an odd page
   takes the winning path with most votes that covers ``COVER`` of what its own path scores; a
   page that none covers uses its own path, so no article gives way to a teaser.

Boilerplate is known by tag, role, or the words of class or id: menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, reader comments. Where such words stand beside others
(``share-story``) the container is only in doubt: its score is divided by ``DOUBT``, and it is boilerplate unless
that is still the page's best. Then it counts as text, as do those named like it. The text of a block is
decoded, its white space (by ``str.split``) made one space; ``<br>`` is white space. Blocks are joined by one line end.

Null html is empty and gives empty text. Null or hostless urls vote as one host. Broken markup (open
tags, cut pages, stray ends) is read as far as it goes. Repeated rows get equal rows.
"""

from __future__ import annotations

import hashlib
import html as references
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtraffic.llm.common import staged

SHARE = 50         #: a winning path has at least one in so many of its host's votes
COVER = 0.5        #: of its own path's score that a host's path must hold on an odd page
DOUBT = 4          #: what the score of a container with a doubtful name is divided by
NEARLY = 0.9       #: of the best score that the voted container holds
LINK_COST = 2      #: characters that one character of link text takes from a score

# Elements by their role in a page.
BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 "
    "hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article blockquote body center div html main section table tbody td tr".split())
BOILERPLATE = frozenset(
    "aside audio button canvas dialog embed footer form head header iframe math menu nav noscript object select svg "
    "template title video".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RAW = frozenset("script style textarea xmp".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
WORDS = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice pagination popup promo "
    "related reply respond share sharing sidebar signup social sponsor sponsored subscribe topbar widget".split()
)
COMMENTS = frozenset("comment comments disqus reply respond".split())
LAYOUT = frozenset(
    "area bar block bottom box center col column container global group holder inner item items left list outer panel right "
    "row section site slot space top unit wrap wrapper".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*(?:>|\Z))"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """An open element that matters: a container, or the root of boilerplate."""

    __slots__ = ("tag", "step", "key", "depth", "parent", "skip", "doubt", "zone")

    def __init__(self, tag: str, step: str, key: int, depth: int, parent: int, skip: bool, doubt: str = "", zone: int = 0):
        self.tag, self.step, self.key, self.depth, self.parent, self.skip = tag, step, key, depth, parent, skip
        self.doubt, self.zone = doubt, zone  # a doubtful name; the nearest node with one, from the node itself upwards


def _key(parent: int, step: str) -> int:
    """The number of a path, from its parent's number and its last step."""
    return int.from_bytes(hashlib.blake2b(step.encode("utf-8", "surrogatepass"), digest_size=8, salt=parent.to_bytes(8, "little")).digest(), "little")


def key_of(path: str) -> int:
    key = 0
    for step in path.split(">")[1:]:
        key = _key(key, step)
    return key


def spelled(nodes: list[Node], n: int) -> str:
    steps = []
    while n > 0:
        steps.append(nodes[n].step)
        n = nodes[n].parent
    return "".join(f">{s}" for s in reversed(steps))


def _attributes(rest: str) -> dict[str, str]:
    if "=" not in rest:
        return {}
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)}


def _boilerplate(tag: str, attributes: dict[str, str]) -> tuple[bool, bool]:
    """(boilerplate for sure, in doubt)."""
    if tag in BOILERPLATE or attributes.get("role", "").lower() in ROLES:
        return True, False
    if tag in ("html", "body", "article", "main"):  # often carry layout classes
        return False, False
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    parts = {p.lower() for p in _PART.findall(names)} if names != " " else set()
    if not parts & WORDS:
        return False, False
    sure = bool(parts & COMMENTS) or parts <= WORDS | LAYOUT
    return sure, not sure


def _step(tag: str, attributes: dict[str, str]) -> str:
    classes = sorted({re.sub(r"[^\w#-]+", "_", re.sub(r"\d+", "#", c.lower())) for c in attributes.get("class", "").split()})
    return ".".join([tag, *classes])


def parse(page: str) -> tuple[list[Node], list[tuple[int, str, int, bool]]]:
    """(nodes, blocks): each block is (its node, text, characters of link text, whether it is a heading);
    boilerplate has none."""
    nodes = [Node("", "", 0, 0, -1, False)]
    opened: Counter[str] = Counter()
    blocks: list[tuple[int, str, int, bool]] = []
    open_, parts, at, links, linked, skipped, heading = [0], [], 0, 0, 0, 0, False

    def text(s: str) -> None:
        nonlocal linked
        if s and not skipped:
            s = references.unescape(s) if "&" in s else s
            parts.append(s)
            if links:
                linked += len(s)

    def flush() -> None:
        nonlocal parts, linked, heading
        if parts:
            block = " ".join("".join(parts).split())
            if block:
                blocks.append((open_[-1], block, min(linked, len(block)), heading))
            parts, linked = [], 0
        heading = False

    def close(depth: int) -> None:
        nonlocal skipped, links
        flush()
        for n in open_[depth:]:
            skipped -= nodes[n].skip
            opened[nodes[n].tag] -= 1
        del open_[depth:]
        links = 0

    pos, end = 0, len(page)
    while pos < end:
        m = _TOKEN.search(page, pos)
        if m is None:
            text(page[pos:])
            break
        text(page[pos : m.start()])
        pos = m.end()
        tag = m["tag"]
        if tag is None:  # a comment, a declaration
            continue
        tag = tag.lower()
        if m["end"]:
            if tag == "a":
                links = max(0, links - 1)
            elif opened[tag]:
                depth = len(open_) - 1
                while nodes[open_[depth]].tag != tag:
                    depth -= 1
                close(depth)
            elif tag in BLOCKS:
                flush()
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, pos)
            pos = stop.end() if stop else end
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            links += 1
            continue
        closed = m["rest"].endswith("/>")
        attributes = _attributes(m["rest"])
        skip, doubtful = _boilerplate(tag, attributes)
        if tag in ("article", "main", "body") and opened["head"] + opened["nav"] + opened["header"]:  # end a menu or header that was left open
            for depth in range(1, len(open_)):
                if nodes[open_[depth]].tag in ("head", "nav", "header"):
                    close(depth)
                    break
        if tag in BLOCKS and nodes[open_[-1]].tag == "p" or tag == "li" and nodes[open_[-1]].tag == "li":
            close(len(open_) - 1)  # their end tags may be left out
        if tag in BLOCKS or skip or doubtful:
            flush()
            heading = tag in HEADINGS
        if (tag in CONTAINERS or skip or doubtful) and not closed and tag not in ("input", "hr", "img", "embed"):
            parent = open_[-1]
            step = _step(re.sub(r"[^\w#-]+", "_", tag), attributes)
            name = f"{step} {re.sub(r'[0-9]+', '#', attributes.get('id', '').lower())}" if doubtful else ""
            zone = len(nodes) if doubtful else nodes[parent].zone
            nodes.append(Node(tag, step, _key(nodes[parent].key, step), nodes[parent].depth + 1, parent, skip, name, zone))
            skipped += skip
            opened[tag] += 1
            open_.append(len(nodes) - 1)
    flush()
    return nodes, without_doubtful(nodes, blocks)


def without_doubtful(nodes: list[Node], blocks: list[tuple[int, str, int, bool]]) -> list[tuple[int, str, int, bool]]:
    """Blocks outside containers with doubtful names, or with those inside that hold the page's text."""
    level = {0: 0}
    for n, node in enumerate(nodes):
        if node.doubt:
            level[n] = level[nodes[node.parent].zone] + 1
    if len(level) == 1:
        return blocks
    score: Counter[int] = Counter()
    for n, block, linked, _ in blocks:
        score[nodes[n].zone] += max(0, len(block) - LINK_COST * linked)
    scored = [z for z in score if score[z] > 0]
    best = max(scored, key=lambda z: (math.log(score[z]) - level[z] * math.log(DOUBT), -z), default=0)
    names = set()
    while best:
        names.add(nodes[best].doubt)
        best = nodes[nodes[best].parent].zone
    text = {0: True}
    for n in level:  # parents come before their children
        if n:
            text[n] = text[nodes[nodes[n].parent].zone] and nodes[n].doubt in names
    return [b for b in blocks if text[nodes[b[0]].zone]]


def own_path(nodes: list[Node], blocks: list[tuple[int, str, int, bool]]) -> str | None:
    """The path that a page votes for; None without text."""
    score = [0.0] * len(nodes)
    for n, block, linked, _ in blocks:
        score[n] += max(0, len(block) - LINK_COST * linked)
    for n in range(len(nodes) - 1, 0, -1):  # children come after their parents
        score[nodes[n].parent] += score[n]
    if score[0] <= 0:
        return "" if blocks else None
    best = max((n for n in range(len(nodes)) if score[n] >= NEARLY * score[0]), key=lambda n: (nodes[n].depth, n))
    up = best
    while up > 0:
        if nodes[up].tag in ("article", "main"):
            best = up
            if nodes[up].tag == "article":
                break
        up = nodes[up].parent
    if nodes[best].tag not in ("article", "main"):
        best = with_sides(nodes, blocks, best)
    return spelled(nodes, best)


def with_sides(nodes: list[Node], blocks: list[tuple[int, str, int, bool]], best: int) -> int:
    """The container around ``best`` that adds its headline, lead, further parts and tail. Sides that are
    mostly links end the search."""
    last_of = list(range(len(nodes)))  # a container's descendants follow it without a gap
    for n in range(len(nodes) - 1, 0, -1):
        last_of[nodes[n].parent] = max(last_of[nodes[n].parent], last_of[n])
    at = [i for i, b in enumerate(blocks) if best <= b[0] <= last_of[best]]
    if not at:
        return best
    first, last = at[0], at[-1]
    up = best
    while up > 0:
        up = nodes[up].parent
        i, j = first, last  # a container's blocks stand together
        while i > 0 and up <= blocks[i - 1][0] <= last_of[up]:
            i -= 1
        while j + 1 < len(blocks) and up <= blocks[j + 1][0] <= last_of[up]:
            j += 1
        more = blocks[i:first] + blocks[last + 1 : j + 1]
        if not more:
            continue
        if LINK_COST * sum(linked for _, _, linked, _ in more) >= sum(len(b) for _, b, _, _ in more):
            break
        best, first, last = up, i, j
    return best


def chosen(nodes: list[Node], blocks: list[tuple[int, str, int, bool]], path: str) -> list[tuple[int, str, int, bool]]:
    """Blocks within the containers of a path."""
    inside = [False] * len(nodes)
    key = key_of(path)
    for n, node in enumerate(nodes):
        inside[n] = node.key == key or (n > 0 and inside[node.parent])
    return [b for b in blocks if inside[b[0]]]


def extract(page: str, paths: list[str]) -> str:
    """The page's text by its own path if that is one of its host's, by the first of these that covers it, or by its own."""
    nodes, blocks = parse(page)
    own = own_path(nodes, blocks)
    if own is None:
        return ""
    mine = chosen(nodes, blocks, own)
    if own not in paths:
        keys = {n.key for n in nodes}
        need = COVER * _score(mine)
        mine_at = {id(b) for b in mine}
        for path in paths:
            if key_of(path) in keys:
                found = chosen(nodes, blocks, path)
                if found and _score(b for b in found if id(b) in mine_at) >= need:
                    mine = found
                    break
    return "\n".join(b[1] for b in mine)


def _score(blocks) -> int:
    return sum(max(0, len(b) - LINK_COST * linked) for _, b, linked, _ in blocks)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)
    return F.regexp_replace(host, r"^www\.", "")


def _votes(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n: dict[tuple[str, str], int] = {}
        for host, page in zip(b.column("host").to_pylist(), b.column("html"), strict=True):
            path = own_path(*parse(page.as_py()))
            if path is not None:
                n[host, path] = n.get((host, path), 0) + 1
        if n:
            hosts, paths = zip(*n, strict=True)
            yield pa.RecordBatch.from_pydict({"host": pa.array(hosts, pa.string()), "path": pa.array(paths, pa.string()), "n": pa.array(list(n.values()), pa.int64())})


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, paths): each host's winning paths, ``SHARE`` at most by their definition, first by votes, then by path."""
    rows = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    votes = rows.mapInArrow(_votes, "host string, path string, n long").groupBy("host", "path").agg(F.sum("n").alias("n"))
    votes = staged(votes, "host_votes")
    winners = votes.where("n >= 2").join(votes.groupBy("host").agg(F.sum("n").alias("all")), "host").where(F.col("n") * SHARE >= F.col("all"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "path")))
    return winners.groupBy("host").agg(F.transform(ranked, lambda x: x["path"]).alias("paths"))


_TEXT = "page_id long, url string, text string, n_chars long"


def _texts(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            out = [extract(p, q or []) for p, q in zip(part.column("html").to_pylist(), part.column("paths").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )


def main_text(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    paths = staged(host_paths(pages), "host_paths")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host")
    )
    return rows.join(paths, "host", "left").select("page_id", "url", "html", "paths").mapInArrow(_texts, _TEXT)
