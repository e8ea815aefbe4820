"""Benchmark decontamination with a generalised suffix automaton of the test items.

The words of every item (A-Z lower-cased, ASCII letters and digits and any
non-ASCII character) go into one automaton.  A document's words are streamed
through it, keeping the longest match that ends at each word; where it reaches
``WINDOW`` words, or a whole item of fewer words ends, those words are hit.

Scale: documents are read once, where they lie, without a shuffle.  The items
are the stated query set: they are taken off the cluster block by block
(``BLOCK_WORDS`` words each, broadcast), and a pass holds at most
``PASS_WORDS`` words of automata in a Python worker; larger benchmarks take more
passes, with the rows written to the shared folder in between.  No item is left out.

Defined results: null texts and items have no words; an item without words
never occurs; repeated items or ids count once an id, a null id as 'null';
without items nothing is hit.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, stored

WINDOW = 10
BLOCK_WORDS = 100_000
PASS_WORDS = 1_000_000
HITS = "__llm_words long, __llm_spans array<struct<start:int,stop:int>>, __llm_items array<string>"

_IS_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_BLANKED = bytes(b if _IS_WORD.match(bytes([b])) else 32 for b in bytes(range(256)).lower())


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_BLANKED).split()


class Automaton:
    """Generalised suffix automaton over word numbers, with the windows' items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.numbers: dict[bytes, int] = {}
        self.go: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.numbers.setdefault(w, len(self.numbers)) for w in words]) for name, words in items if words]
        for _, seq in coded:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        # state of a whole window -> its items; short items by the state they end in
        self.windows: dict[int, set[str]] = {}
        self.short: dict[int, dict[int, set[str]]] = {}
        self.least = min([window, *(len(seq) for _, seq in coded)])
        for name, seq in coded:
            state = 0
            for i, w in enumerate(seq):
                state = self.go[state][w]
                if i >= window - 1:
                    while self.length[self.link[state]] >= window:
                        state = self.link[state]
                    self.windows.setdefault(state, set()).add(name)
            if len(seq) < window:
                self.short.setdefault(state, {}).setdefault(len(seq), set()).add(name)
        # nearest state on the way up the links, itself included, where a short item ends
        self.nearest = [-1] * len(self.go)
        for s in sorted(range(1, len(self.go)), key=self.length.__getitem__):
            self.nearest[s] = s if s in self.short else self.nearest[self.link[s]]

    def _split(self, p: int, w: int, q: int) -> int:
        """The state of what ``p`` spells and then ``w``, parted from the longer strings of ``q``."""
        if self.length[q] == self.length[p] + 1:
            return q
        part = self._state(self.length[p] + 1, dict(self.go[q]), self.link[q])
        self.link[q] = part
        while p >= 0 and self.go[p].get(w) == q:
            self.go[p][w] = part
            p = self.link[p]
        return part

    def _state(self, length: int, go: dict, link: int) -> int:
        self.go.append(go)
        self.length.append(length)
        self.link.append(link)
        return len(self.go) - 1

    def _extend(self, last: int, w: int) -> int:
        if w in self.go[last]:
            return self._split(last, w, self.go[last][w])
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in self.go[p]:
            self.go[p][w] = new
            p = self.link[p]
        self.link[new] = 0 if p < 0 else self._split(p, w, self.go[p][w])
        return new

    def hits(self, words: list[bytes]) -> Iterator[tuple[int, int, set[str]]]:
        """(start, stop, items) of every window or short item, by its end."""
        numbers = self.numbers
        seq = [numbers.get(w, -1) for w in words]
        go, link, length, window = self.go, self.link, self.length, self.window
        state = matched = 0
        for i, w in enumerate(seq):
            if w < 0:
                state = matched = 0
                continue
            while state and w not in go[state]:
                state = link[state]
                matched = length[state]
            if w in go[state]:
                state = go[state][w]
                matched += 1
            if matched < self.least:
                continue
            if matched >= window:
                s = state
                while length[link[s]] >= window:
                    s = link[s]
                yield i + 1 - window, i + 1, self.windows[s]
            s = self.nearest[state]
            while s > 0:
                for n, names in self.short.get(s, {}).items():
                    if n <= matched:
                        yield i + 1 - n, i + 1, names
                s = self.nearest[link[s]]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def _blocks(items: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """Items block by block: the driver holds one block at a time."""
    block, size = [], 0
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("id"), "text").where("text is not null")
    for row in named.toLocalIterator():
        block.append((row.id, row.text))
        size += len(words_of(row.text))
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    yield block


def _pass(docs: DataFrame, blocks: list, window: int, first: bool) -> DataFrame:
    made: list[Automaton] = []

    def run(texts, counts=None, spans=None, found=None):
        if not made:
            made.extend(Automaton([(name, words_of(text)) for name, text in b.value], window) for b in blocks)
        out = []
        for k, text in enumerate(texts):
            words = words_of(text)
            at = [] if first else [(s["start"], s["stop"]) for s in spans[k]]
            names = set() if first else set(found[k])
            for a in made:
                for start, stop, items in a.hits(words):
                    at.append((start, stop))
                    names |= items
            out.append((len(words), [{"start": s, "stop": e} for s, e in _merged(at)], sorted(names)))
        return out
    if first:
        return append_columns(docs, HITS, run, "text")
    own = [c for c in docs.columns if c not in ("__llm_words", "__llm_spans", "__llm_items")]
    old = docs.withColumnsRenamed({"__llm_words": "__llm_words0", "__llm_spans": "__llm_spans0", "__llm_items": "__llm_items0"})
    more = append_columns(old, HITS, run, "text", "__llm_words0", "__llm_spans0", "__llm_items0")
    return more.select(*own, "__llm_words", "__llm_spans", "__llm_items")


def with_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with __llm_words (count), __llm_spans (hit word ranges, merged) and __llm_items (ids as text, sorted)."""
    sc = docs.sparkSession.sparkContext
    blocks = [sc.broadcast(b) for b in _blocks(benchmark)]
    per_pass = max(1, PASS_WORDS // BLOCK_WORDS)
    out = docs
    for at in range(0, len(blocks), per_pass):
        out = _pass(out if at == 0 else stored(out, "hits"), blocks[at:at + per_pass], window, at == 0)
    return out


def hit_words():
    return F.aggregate("__llm_spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's digest of every document."""
    hits = with_hits(docs.select("doc_id", "text"), benchmark)
    return hits.select("doc_id", F.col("__llm_words").alias("n_words"), hit_words().alias("n_hit"),
                       F.size("__llm_items").cast("long").alias("n_items"), F.sha2(F.array_join("__llm_items", ","), 256).alias("items_sha256"),
                       (F.size("__llm_spans") > 0).alias("contaminated"))


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between them."""
    data = text.encode("utf-8", "replace")
    places = [m.span() for m in _IS_WORD.finditer(data.lower())]
    kept, at = [], 0
    for start, stop in spans:
        kept.append(data[at:places[start][0]])
        at = places[stop - 1][1]
    return b"".join([*kept, data[at:]]).decode("utf-8", "replace")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_span: int = 1, max_coverage: float = 0.0) -> DataFrame:
    """``docs`` without documents of which more than ``max_coverage`` of the words are hit; in the others, spans
    of at least ``least_span`` words are cut out of the text (n_chars, if there, follows)."""
    hits = with_hits(docs, benchmark, window)
    kept = hits.where(hit_words() <= F.lit(float(max_coverage)) * F.col("__llm_words"))
    if max_coverage <= 0:  # what is kept has no span
        return kept.select(*docs.columns)

    def cut(texts, spans):
        return [(t if t is None else _without(t, [(s["start"], s["stop"]) for s in ss if s["stop"] - s["start"] >= least_span]),)
                for t, ss in zip(texts, spans, strict=True)]
    clean = append_columns(kept, "__llm_text string", cut, "text", "__llm_spans")
    values = {"text": F.col("__llm_text")}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(F.col("__llm_text") == F.col("text"), F.col("n_chars")) \
            .otherwise(F.length("__llm_text").cast(docs.schema["n_chars"].dataType))
    return clean.withColumns(values).select(*docs.columns)


def digest(names: list[str]) -> str:
    """items_sha256 of a set of item ids."""
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
