"""License scan: exact set-similarity join of text blocks with license templates.

Words are lower-cased (A-Z) runs of digits, letters and non-ASCII characters. A template's blocks are all runs of
consecutive words of a text, a quarter longer than the template itself, across line ends (the whole text, if it is
shorter). A block meets a template if it holds at least ``CONTAINED`` of the template's distinct words, and all of those
that tell licenses apart (``TELLING``). Templates of under ``SHORT`` words say too little as sets: their blocks are of
their own length and hold all their words in order. Instead of comparing every block with every template:

* all template words are counted over the whole corpus, and each template's words put in ascending
  order of that count (``frequency_order``);
* a block can be moved to start with a template word, so only these blocks are looked at;
* prefix filter: with m words, of which o must be there, a block that meets the template holds one
  of its m - o + 1 rarest; only blocks that hold such a word are looked at;
* length filter: the block must have o words;
* positional filter: words are compared rarest first, and a block is left as soon as the words that
  remain cannot make up what is missing.

Templates are a fixed list, so every task holds the index of their prefixes. Besides, places where
the words of a base phrase stand consecutively are found in the same pass.

Null and empty texts have no words: counts 0, no places, empty labels, score 0. Repeated rows get
equal rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtraffic.llm.common import U64, Roller, buffers, chunks, mix

CONTAINED = 0.8

# Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices and customary lines of public licenses, and their labels.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "all rights reserved"),
]

# Words that tell one license from another; a block must hold those of the template.
TELLING = frozenset(["affero", "apache", "attribution", "cc", "commons", "gnu", "lesser", "mit", "mozilla", "nc", "unencumbered"])

# Templates of fewer words must stand as they are.
SHORT = 8

_WORD = np.zeros(256, bool)
_WORD[128:] = _WORD[48:58] = _WORD[97:123] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def hashed_words(data: np.ndarray, offsets: np.ndarray, roller: Roller):
    """(hash, text number) of each word."""
    data = _LOWER[data]
    h = roller.prefix(data)
    inside = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    prev = np.zeros(len(data), bool)
    prev[1:] = inside[:-1]
    then = np.zeros(len(data), bool)
    then[:-1] = inside[1:]
    s = np.flatnonzero(inside & (~prev | edge[:-1]))
    e = np.flatnonzero(inside & (~then | edge[1:])) + 1
    return mix(roller.spans(h, s, e) + (e - s).astype(U64)), np.searchsorted(offsets, s, side="right") - 1


def word_hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(hashed_words(data, np.array([0, len(data)]), Roller())[0][0])


def needed(template: str, contained: float = CONTAINED) -> int:
    """Distinct words of a template that a block must hold."""
    m = len(set(template.split()))
    return m if len(template.split()) < SHORT else math.ceil(contained * m - 1e-9)


def span(template: str) -> int:
    """Words of a template's blocks."""
    n = len(template.split())
    return n if n < SHORT else n + math.ceil(n / 4)


def template_counts(docs: DataFrame, templates=TEMPLATES) -> dict[int, int]:
    """Places of each template word in all documents; at most one row per template word."""
    vocabulary = np.array(sorted({word_hash(w) for _, t in templates for w in t.split()}), U64)

    def count(batches):
        roller, n = Roller(), np.zeros(len(vocabulary), np.int64)
        for b in batches:
            off, data = buffers(b.column("text"))
            for i, j in chunks(off, 1 << 19, 8192):
                h = hashed_words(data[off[i] : off[j]], off[i : j + 1] - off[i], roller)[0]
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                n += np.bincount(at[vocabulary[at] == h], minlength=len(vocabulary))
        yield pa.RecordBatch.from_pydict({"word": pa.array(vocabulary.view(np.int64)), "n": pa.array(n)})

    text = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    rows = text.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r.word & (1 << 64) - 1: r.n for r in rows}


def frequency_order(counts: dict[int, int], templates=TEMPLATES) -> list[tuple[str, list[int]]]:
    """(label, distinct word hashes, rarest first) of each template."""
    out = []
    for label, text in templates:
        words = {word_hash(w) for w in text.split()}
        out.append((label, sorted(words, key=lambda w: (counts.get(w, 0), w))))
    return out


def _next(places: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The first of the ascending places at or after each of ``s``; a number beyond all where none is."""
    return np.append(places, np.iinfo(np.int64).max)[np.searchsorted(places, s)]


class Scanner:
    def __init__(self, ordered: list[tuple[str, list[int]]], templates=TEMPLATES, phrases=PHRASES, contained: float = CONTAINED):
        self.ordered, self.roller = ordered, Roller()
        self.vocabulary = np.array(sorted({w for _, words in ordered for w in words}), U64)
        number = {int(w): i for i, w in enumerate(self.vocabulary)}
        self.words = [[number[w] for w in words] for _, words in ordered]
        self.spans = [span(t) for _, t in templates]
        self.needs = [needed(t, contained) for _, t in templates]
        self.telling = [{number[word_hash(w)] for w in t.split() if w in TELLING} for _, t in templates]
        self.in_order = [[word_hash(w) for w in t.split()] if len(t.split()) < SHORT else None for _, t in templates]
        self.phrases = [(label, [word_hash(w) for w in p.split()]) for p, label in phrases.items()]

    def blocks(self, h: np.ndarray, text: np.ndarray):
        """(text number, template, largest share) where a block of a text meets a template."""
        if not len(h) or not len(self.vocabulary):
            return
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        known = np.flatnonzero(self.vocabulary[at] == h)
        known = known[np.argsort(at[known], kind="stable")]
        cut = np.searchsorted(at[known], np.arange(len(self.vocabulary) + 1))
        places = [known[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]  # ascending, by word
        text_end = np.searchsorted(text, text, side="right")
        for k, words in enumerate(self.words):
            m, need = len(words), self.needs[k]
            hits = np.sort(np.concatenate([places[w] for w in words[: m - need + 1]]))
            if not len(hits):
                continue
            s = np.sort(np.concatenate([places[w] for w in words]))
            e = np.minimum(s + self.spans[k], text_end[s])
            live = (_next(hits, s) < e) & (e - s >= need)
            s, e = s[live], e[live]
            share = np.zeros(len(s), np.int64)
            for i, w in enumerate(words):
                there = _next(places[w], s) < e
                share += there
                live = share + (m - i - 1) >= need
                if w in self.telling[k]:
                    live &= there
                s, e, share = s[live], e[live], share[live]
                if not len(s):
                    break
            if self.in_order[k] is not None:
                for i, w in enumerate(self.in_order[k]):
                    live = h[s + i] == U64(w)
                    s, share = s[live], share[live]
            if len(s):
                first = np.flatnonzero(np.diff(text[s], prepend=-1))
                for t, n in zip(text[s[first]].tolist(), np.maximum.reduceat(share, first).tolist(), strict=True):
                    yield t, k, n / m

    def places(self, h: np.ndarray, text: np.ndarray):
        """(word, label) of each place of a base phrase within a text."""
        for label, words in self.phrases:
            at = np.flatnonzero(h[: len(h) - len(words) + 1] == U64(words[0])) if len(h) >= len(words) else np.zeros(0, int)
            for i, w in enumerate(words[1:], 1):
                at = at[(h[at + i] == U64(w)) & (text[at + i] == text[at])]
            for p in at.tolist():
                yield p, label


_SCAN = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, contained: float = CONTAINED) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is 1 where a base phrase stands, else the largest share of a template that a block
    holds, 0 where none reaches the threshold.
    """
    ordered = frequency_order(template_counts(docs, templates), templates)

    def run(batches):
        scanner = Scanner(ordered, templates, phrases, contained)
        for b in batches:
            off, data = buffers(b.column("text"))
            n = len(off) - 1
            words, base, labels, score = np.zeros(n, np.int64), [[] for _ in range(n)], [set() for _ in range(n)], np.zeros(n)
            for i, j in chunks(off, 1 << 19, 8192):
                h, text = hashed_words(data[off[i] : off[j]], off[i : j + 1] - off[i], scanner.roller)
                count = np.bincount(text, minlength=j - i)
                words[i:j] = count
                first = np.cumsum(count) - count
                for p, label in scanner.places(h, text):
                    base[i + text[p]].append((p - int(first[text[p]]), label))
                for t, k, share in scanner.blocks(h, text):
                    labels[i + t].add(ordered[k][0])
                    score[i + t] = max(score[i + t], share)
            found = [sorted({x for _, x in p}) for p in base]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").cast(pa.int64()), pa.array(words), pa.array([len(p) for p in base], pa.int64()),
                    pa.array([min(p)[0] if p else None for p in base], pa.int64()),
                    pa.array([max(p)[0] if p else None for p in base], pa.int64()),
                    pa.array([",".join(x) for x in found], pa.string()),
                    pa.array([",".join(sorted(y.union(x))) for x, y in zip(found, labels, strict=True)], pa.string()),
                    pa.array([1.0 if p else s for p, s in zip(base, score.tolist(), strict=True)], pa.float64()),
                ],
                names=[c.split()[0] for c in _SCAN.split(", ")],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, _SCAN)


def scan_sql(templates=TEMPLATES, phrases=PHRASES, contained: float = CONTAINED) -> str:
    """DuckDB statement for ``scan`` over ``documents`` (distinct doc_id)."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    parts = [
        f"select doc_id, i - 1 as pos, '{label}' as label from place where "
        + " and ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(p.split()))
        for p, label in phrases.items()
    ]
    rows = ", ".join(
        f"('{label}', '{t}', {sorted(set(t.split()))!r}, {sorted(set(t.split()) & TELLING)!r}::varchar[], "
        f"{needed(t, contained)}, {span(t)}, {len(t.split()) < SHORT})"
        for label, t in templates
    )
    return f"""
with d as (select doc_id, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') as t from documents),
w as (select doc_id, regexp_extract_all(t, '{word}') as ws from d),
place as (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from w),
base as ({' union all '.join(parts)}),
bases as (
    select doc_id, count(*) as n_base, min(pos) as first_word, max(pos) as last_word, list(distinct label) as labels
    from base group by doc_id),
tpl(label, words, ws, telling, need, span, short) as (values {rows}),
spot as (select doc_id, ws, i, ws[i] as word from place where ws[i] in (select unnest(ws) from tpl)),
block as (
    select doc_id, label, words, short, need, telling, tpl.ws as want, spot.ws[i:i + span - 1] as have
    from spot join (select unnest(ws) as word, * from tpl) tpl using (word)),
met as (
    select doc_id, label, len(list_intersect(list_distinct(have), want)) / len(want) as share
    from block where len(list_intersect(list_distinct(have), want)) >= need and list_has_all(have, telling)
    and (not short or array_to_string(have, ' ') = words)),
mets as (select doc_id, list(distinct label) as labels, max(share) as share from met group by doc_id)
select w.doc_id, len(w.ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base,
    first_word::bigint as first_word, last_word::bigint as last_word,
    coalesce(array_to_string(list_sort(bases.labels), ','), '') as base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bases.labels, []), coalesce(mets.labels, [])))), ','), '') as labels,
    case when n_base > 0 then 1.0::double else coalesce(share, 0)::double end as score
from w left join bases on bases.doc_id is not distinct from w.doc_id
left join mets on mets.doc_id is not distinct from w.doc_id
"""
