"""Token counts by a compiled transducer.

The tokenizer (composed characters, lower case, a split into words, BPE with word-end symbols) is compiled
into one deterministic transducer over characters. Each transition carries the number of tokens that it
adds to what the text read so far would have if it ended there; the count of a text is the sum along
its path. Lower-casing, the word pattern and the merges are all inside the transitions.

* ``Words`` is the transducer of a single word over byte symbols. By the merges' greedy order, every prefix
  has exactly one last token whose pair with the token before it stays two tokens when encoded alone. A
  state therefore is what later symbols can ask for: the suffixes of the prefix that begin some
  longer token, the last token before each, and how the counts there differ.
* ``Counter`` adds the word pattern (letters, single digits, other runs, contractions) around it. States
  are compiled when first reached, and all are dropped and compiled anew once there are ``STATES`` of them,
  which bounds memory and changes no count. Counts of stretches between white space, from the state that it
  resets to, are kept likewise.

Texts of up to ``CHUNK`` characters are run in place. Longer ones are cut into chunks that go to other tasks.
A chunk's state map leads every state through the chunk; white space resets the transducer, so behind
the first white space the map is constant. It is kept as the characters before that (``head``), the count from
there to the last white space, and the characters pending behind it (``tail``). Maps compose associatively,
by running what the left one leaves pending into the right one's head. ``FAN`` neighbours at a time
are composed in rounds, the up-sweep of a prefix scan, until each document has one.

Null texts are empty and have no tokens. Null ids stay null; repeated rows are counted each. Columns other
than doc_id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtraffic.llm.common import staged

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
CHUNK = 1 << 16    #: characters
FAN = 64           #: chunk maps composed by one group
STATES = 400_000   #: compiled states kept by a worker
KEPT = 200_000     #: counts of short stretches between white space kept by a worker
PAIRS = 200_000    #: tests of neighbouring tokens kept by a worker
END = "</w>"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class _Prefix(NamedTuple):
    """A state of ``Words``: ``suffix`` holds the longest live suffix; ``live`` has (length, last token before it or
    None at the word's start, its count less the prefix's); ``over`` is how many tokens the word has more
    if it ends here than the prefix has."""

    suffix: str
    live: tuple[tuple[int, str | None, int], ...]
    over: int


class Words:
    """BPE of one word as a transducer over byte symbols."""

    def __init__(self, vocab, merges):
        self.rank = {tuple(m): r for r, m in enumerate(merges)}
        self.halves = {a + b: (a, b, r) for (a, b), r in self.rank.items()}
        late = (t in self.halves and self.halves[t][2] >= r for a, b, r in self.halves.values() for t in (a, b))
        if len(self.halves) < len(self.rank) or any(late):
            raise ValueError("a token must have one merge, after those of its halves")
        self.vocab = vocab
        self.whole: dict[str, bool] = {}
        bare = [t.removesuffix(END) for t in vocab]
        self.begins = {t[:k] for t in bare for k in range(1, len(t))}
        self.clear()

    def clear(self) -> None:
        self.states: dict[_Prefix, _Prefix] = {}
        self.pairs: dict[tuple, bool] = {}
        self.start = _Prefix("", ((0, None, 0),), 0)

    def encode(self, symbols: list[str]) -> list[str]:
        """Merge by rank, leftmost first."""
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: self.rank.get((symbols[i], symbols[i + 1]), 1 << 30))
            if (symbols[best], symbols[best + 1]) not in self.rank:
                break
            symbols = [*symbols[:best], symbols[best] + symbols[best + 1], *symbols[best + 2 :]]
        return symbols

    @staticmethod
    def symbols(token: str) -> list[str]:
        bare = token.removesuffix(END)
        return [*bare] if bare == token else [*bare[:-1], bare[-1] + END]

    def is_whole(self, token: str) -> bool:
        """Whether the symbols of ``token`` are encoded as this token."""
        if token not in self.whole:
            self.whole[token] = token in self.vocab and self.encode(self.symbols(token)) == [token]
        return self.whole[token]

    def follows(self, last: str | None, token: str) -> bool:
        """Whether ``token`` can stand behind ``last`` in an encoding: no merge joins the right edge of the one, while it
        grows, to the left edge of the other before both are whole. Of equal merges the left one is first."""
        if last is None:
            return True
        found = self.pairs.get((last, token))
        if found is not None:
            return found
        left, right, never = last, token, 1 << 60
        left_until = right_until = never  # the ranks at which the edges are taken up into longer tokens
        found = True
        while True:
            rank = self.rank.get((left, right), never)
            if rank < left_until and rank <= right_until and rank < never:
                found = False
                break
            a, b = self.halves.get(left), self.halves.get(right)
            if a is None and b is None:
                break
            if b is None or (a is not None and a[2] > b[2]):
                left, left_until = a[1], a[2]
            else:
                right, right_until = b[0], b[2]
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[(last, token)] = found
        return found

    def _last(self, at: _Prefix, ending: str) -> tuple[str, int]:
        """The one last token of the prefix that ``ending`` prolongs, and its count, less the prefix's."""
        for length, last, count in at.live:
            token = at.suffix[len(at.suffix) - length :] + ending
            if self.is_whole(token) and self.follows(last, token):
                return token, count + 1
        raise ValueError(f"no token ends in {ending!r}")

    def step(self, at: _Prefix, symbol: str) -> tuple[_Prefix, int]:
        """(next state, tokens that the word gains if it ends there instead of here)."""
        _, whole = self._last(at, symbol + END)
        token, count = self._last(at, symbol)
        grown = at.suffix + symbol
        live = [(0, token, 0)] + [(n + 1, last, c - count) for n, last, c in at.live if grown[len(grown) - n - 1 :] in self.begins]
        suffix = grown[len(grown) - max(n for n, _, _ in live) :]
        new = _Prefix(suffix, tuple(live), whole - count)
        return self.states.setdefault(new, new), whole - at.over


class _State(dict):
    """A state of ``Counter``: next states by character, compiled on demand. ``gain`` is what the transition into
    it emits; ``kind`` says how the word pattern stands, ``at`` how the word does."""

    __slots__ = ("owner", "kind", "at", "gain")

    def __missing__(self, char: str):
        return self.owner.compile(self, char)


class _Counts(dict):
    """Counts of stretches without white space, run when first met; at most ``most``, then all are dropped."""

    def __init__(self, run, most: int):
        self.run, self.most = run, most

    def __missing__(self, text: str) -> int:
        n = self.run(text)
        if len(text) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[text] = n
        return n


class Counter:
    """The whole tokenizer, compiled from its file."""

    def __init__(self, vocabulary: str = VOCABULARY, states: int = STATES, kept: int = KEPT):
        import public_tokenizers as P
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Lowercase

        with open(P.path(vocabulary), encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or model["continuing_subword_prefix"]:
            raise ValueError(f"{vocabulary} is not a BPE with word ends")
        self.words = Words(model["vocab"], model["merges"])
        self.split = Tokenizer.from_file(P.path(vocabulary)).pre_tokenizer.pre_tokenize_str
        self.lower = Lowercase().normalize_str
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.bytes, self.most = byte_symbols(), states
        self.classes: dict[str, str] = {}
        self.kept = _Counts(self.run, kept)
        self.contraction = {c: self._word(c) - self._word("'") for c in ("'s", "'t", "'m", "'d", "'re", "'ve", "'ll")}
        self.clear()

    def clear(self) -> None:
        self.words.clear()
        self.states: dict[tuple, _State] = {}
        self.start = self._state("space", None, 0)

    def _state(self, kind: str, at: _Prefix | None, gain: int) -> _State:
        key = (kind, id(at), gain)  # states of words are kept alive by ``words`` until both are cleared
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = _State()
            found.owner, found.kind, found.at, found.gain = self, kind, at, gain
        return found

    def _class(self, char: str) -> str:
        """letter, digit, other or space, as the tokenizer's own split has it."""
        found = self.classes.get(char)
        if found is None:
            pieces = [len(self.split(f"{x}{char}{x}")) for x in "a!"]
            # one piece: the character joins letters or marks; two: it stands nowhere
            found = "letter" if pieces[0] == 1 else "other" if pieces[1] == 1 else "space" if pieces[0] == 2 else "digit"
            self.classes[char] = found
        return found

    def _feed(self, at: _Prefix, char: str) -> tuple[_Prefix, int]:
        gain = 0
        for b in char.encode():
            at, g = self.words.step(at, self.bytes[b])
            gain += g
        return at, gain

    def _word(self, word: str) -> int:
        return self._feed(self.words.start, word)[1]

    def _move(self, kind: str, at, char: str) -> tuple[str, _Prefix | None, int]:
        """One lower-case character: (kind, word state, tokens gained). Kinds: space, letter, other, mark (an
        apostrophe that may begin a contraction), and r, v, l (an apostrophe and that letter)."""
        of = self._class(char)
        if of == "space":
            return "space", None, 0
        if of == "digit":
            return "space", None, self._word(char)
        if of == "letter":
            if kind == "mark" and f"'{char}" in self.contraction:
                return "space", None, self.contraction[f"'{char}"]
            if kind in ("r", "v", "l") and f"'{kind}{char}" in self.contraction:
                return "space", None, self.contraction[f"'{kind}{char}"] - self._word(kind)
            inside = kind in ("letter", "r", "v", "l")
            now, gain = self._feed(at if inside else self.words.start, char)
            return char if kind == "mark" and char in ("r", "v", "l") else "letter", now, gain
        inside = kind in ("other", "mark")
        now, gain = self._feed(at if inside else self.words.start, char)
        return "other" if inside or char != "'" else "mark", now, gain

    def compile(self, state: _State, char: str) -> _State:
        if len(self.states) + len(self.words.states) > self.most:
            self.clear()
        kind, at, gain = state.kind, state.at, 0
        for c in self.lower(char):
            kind, at, g = self._move(kind, at, c)
            gain += g
        new = self._state(kind, at, gain)
        state[char] = new
        return new

    def run(self, text: str) -> int:
        """Tokens of a normalised text without special tokens."""
        state, n = self.start, 0
        for c in text:
            state = state[c]
            n += state.gain
        return n

    def parts(self, text: str) -> tuple[list[str], int]:
        """Composed texts between special tokens, and the number of these."""
        pieces = self.special.split(text) if "<|" in text else [text]
        if not text.isascii():
            pieces = [unicodedata.normalize("NFC", p) for p in pieces]
        return pieces, len(pieces) - 1

    def plain(self, text: str) -> int:
        """As ``run``; spaces and line ends reset, so stretches between them add up."""
        return sum(map(self.kept.__getitem__, text.replace("\n", " ").split(" ")))

    def count(self, text: str) -> int:
        pieces, n = self.parts(text)
        return n + sum(map(self.plain, pieces))

    # maps: (head, count, tail); count None where no white space resets

    @staticmethod
    def _reset(text: str, at: int, step: int) -> int:
        while 0 <= at < len(text) and text[at] not in " \n\t\r":
            at += step
        return at

    def chunk_map(self, text: str) -> tuple[str, int | None, str]:
        first, last = self._reset(text, 0, 1), self._reset(text, len(text) - 1, -1)
        if last < 0:
            return text, None, ""
        return text[:first], self.plain(text[first:last]), text[last:]

    def compose(self, maps: list[tuple[str, int | None, str]]) -> tuple[str, int | None, str]:
        head, count, pending = [], None, []
        for h, n, t in maps:
            if n is None:
                pending.append(h)
                continue
            if count is None:
                head, count = [*pending, h], 0
            else:
                count += self.run("".join(pending) + h)
            count += n
            pending = [t]
        if count is None:
            return "".join(pending), None, ""
        return "".join(head), count, "".join(pending)

    def total(self, one: tuple[str, int | None, str]) -> int:
        return self.run(one[0]) + (one[1] or 0) + self.run(one[2])


@lru_cache(maxsize=2)
def counter(vocabulary: str = VOCABULARY) -> Counter:
    """Compiled once a worker."""
    return Counter(vocabulary)


_COUNTED = "doc_id long, n_bytes long, n_tokens long"
_CHUNK = "row long, doc_id long, n_bytes long, specials long, place long, chunk string"
_MAP = "row long, place long, head string, count long, tail string"


def _batch(ddl: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    names, types = zip(*(c.split() for c in ddl.split(", ")), strict=True)
    cols = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(cols, types, strict=True)], names=list(names))


def _counts(batches, vocabulary: str):
    count = counter(vocabulary).count
    for b in batches:
        n = [count(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])


def _cut(batches, vocabulary: str, size: int):
    parts = counter(vocabulary).parts
    for b in batches:
        for r in b.to_pylist():
            pieces, specials = parts(r["text"])
            text = " ".join(pieces)  # white space resets as a special token does, and counts nothing
            for k, i in enumerate(range(0, len(text), size)):
                yield _batch(_CHUNK, [(r["row"], r["doc_id"], r["n_bytes"], specials, k, text[i : i + size])])


def _maps(batches, vocabulary: str):
    c = counter(vocabulary)
    for b in batches:
        rows = zip(b.column("row").to_pylist(), b.column("place").to_pylist(), b.column("chunk").to_pylist(), strict=True)
        yield _batch(_MAP, [(row, place, *c.chunk_map(text)) for row, place, text in rows])


def chunk_totals(chunks: DataFrame, vocabulary: str = VOCABULARY, fan: int = FAN) -> DataFrame:
    """(row, n): tokens of each row's chunks (row, place, chunk) in the order of ``place`` from 0."""
    maps = staged(chunks.select("row", "place", "chunk").repartition("row", "place").mapInArrow(lambda it: _maps(it, vocabulary), _MAP), "maps")

    def compose(key, t):
        rows = sorted(zip(t.column("place").to_pylist(), *(t.column(c).to_pylist() for c in ("head", "count", "tail")), strict=True))
        return pa.Table.from_batches([_batch(_MAP, [(key[0].as_py(), key[1].as_py(), *counter(vocabulary).compose([r[1:] for r in rows]))])])

    last = maps.agg(F.max("place")).first()[0] or 0
    while last > 0:
        near = maps.withColumn("group", F.floor(F.col("place") / fan))
        maps = staged(near.groupBy("row", "group").applyInArrow(compose, _MAP), "maps")
        last //= fan

    def finish(batches):
        for b in batches:
            n = [counter(vocabulary).total((r["head"], r["count"], r["tail"])) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(n, pa.int64())], names=["row", "n"])

    return maps.mapInArrow(finish, "row long, n long")


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of ``docs`` (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    short = rows.where(F.length("text") <= chunk).mapInArrow(lambda it: _counts(it, vocabulary), _COUNTED)
    long = rows.where(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id())
    cut = staged(long.mapInArrow(lambda it: _cut(it, vocabulary, chunk), _CHUNK), "chunks")
    whole = cut.where("place = 0").join(chunk_totals(cut, vocabulary), "row")
    counted = short.unionByName(whole.select("doc_id", "n_bytes", (F.col("n") + F.col("specials")).alias("n_tokens")))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
