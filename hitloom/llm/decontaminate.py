"""Benchmark decontamination with a generalised suffix automaton.

All normalised test items go into one automaton.  The words of a document stream through it;
the length of the longest match that ends at each word tells at once whether the last
``width`` words stand in an item.  A word inside such a window is hit.  An item of fewer
words than ``width`` is one window of its own.

Results: null or empty texts have no words and no hits; items without id, text or words take
no part; items of one id count once; repeated documents get the same result each; without
items nothing is hit; other columns pass through.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitloom.llm.store import on_workers, saved
from hitloom.llm.words import alnum_words

WIDTH = 10
MAX_COVERAGE = 0.5
AUTOMATON_BYTES = 16 << 20

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class SuffixAutomaton:
    """Automaton of all word sequences that stand in one of the items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int):
        self.width = width
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(item, [self.ids.setdefault(w, len(self.ids)) for w in words]) for item, words in items if words]
        for _, words in coded:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self.shortest = min([min(len(words), width) for _, words in coded], default=0)
        self._mark(coded)

    def _extend(self, last: int, word: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if word in nxt[last]:  # an earlier item has this prefix
            q = nxt[last][word]
            return q if length[q] == length[last] + 1 else self._clone(last, word, q)
        state = self._new({}, length[last] + 1)
        p = last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = state
            p = link[p]
        if p < 0:
            link[state] = 0
        else:
            q = nxt[p][word]
            link[state] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
        return state

    def _new(self, edges: dict[int, int], length: int) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, word: int, q: int) -> int:
        copy = self._new(dict(self.next[q]), self.length[p] + 1)
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _mark(self, coded: list[tuple[str, list[int]]]) -> None:
        """For each state: the items that hold its words, and the whole short items it ends with."""
        n = len(self.next)
        self.items: list[set[str]] = [set() for _ in range(n)]
        short: list[set[tuple[int, str]]] = [set() for _ in range(n)]
        for item, words in coded:
            v = 0
            for word in words:
                v = self.next[v][word]
                u = v
                while u > 0 and item not in self.items[u]:
                    self.items[u].add(item)
                    u = self.link[u]
            if len(words) < self.width:
                short[v].add((len(words), item))
        #: the state of the last ``width`` words, and the short items of all shorter endings
        self.window, self.endings = [0] * n, [()] * n
        for v in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[v]
            self.window[v] = self.window[up] if self.length[up] >= self.width else v
            self.endings[v] = (*self.endings[up], *sorted(short[v]))

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and the items whose windows occur."""
        hit, found = np.zeros(len(words), bool), set()
        if not self.shortest or len(words) < self.shortest:
            return hit, found
        get = self.ids.get
        codes = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([False], codes >= 0, [False])).astype(np.int8)))
        nxt, link, length, width = self.next, self.link, self.length, self.width
        for start, stop in known.reshape(-1, 2).tolist():  # a window has known words only
            if stop - start < self.shortest:
                continue
            v = matched = 0
            for i, word in enumerate(codes[start:stop].tolist(), start):
                while v and word not in nxt[v]:
                    v = link[v]
                    matched = length[v]
                if word in nxt[v]:
                    v = nxt[v][word]
                    matched += 1
                if matched >= width:
                    hit[i - width + 1 : i + 1] = True
                    found |= self.items[self.window[v]]
                for size, item in self.endings[v]:
                    if size <= matched:
                        hit[i - size + 1 : i + 1] = True
                        found.add(item)
        return hit, found


def spans_of(hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words as (first, end exclusive)."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    return [tuple(pair) for pair in edges.reshape(-1, 2).tolist()]


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text less the given runs of words, from the first letter of a run to its last."""
    raw = text.encode()
    places = [m.span() for m in _WORD.finditer(raw)] if spans else []
    kept, at = [], 0
    for first, end in spans:
        kept.append(raw[at : places[first][0]])
        at = places[end - 1][1]
    return b"".join([*kept, raw[at:]]).decode()


_MATCH = "struct<n_words:bigint,spans:array<struct<first:int,end:int>>,items:array<string>,rest:string>"


def _automaton(sent) -> SuffixAutomaton:
    return SuffixAutomaton([(item, alnum_words(text)) for item, text in sent[0]], sent[1])


def _match_part(
    df: DataFrame, text: Column, items: list, width: int, into: str, before: Column, with_rest: bool
) -> DataFrame:
    automaton = on_workers(df.sparkSession, (items, width), _automaton)

    @F.arrow_udf(_MATCH)
    def match(texts: pa.Array, earlier: pa.Array) -> pa.Array:
        own, rows = automaton(), []
        for value, old in zip(texts, earlier):
            words = alnum_words(value.as_py())
            hit, found = own.scan(words)
            if old := old.as_py():
                found |= set(old["items"])
                for span in old["spans"]:
                    hit[span["first"] : span["end"]] = True
            spans = [{"first": a, "end": b} for a, b in spans_of(hit)] if hit.any() else []
            rest = value.as_py() if with_rest else None
            if spans and with_rest:
                rest = without(rest, [(x["first"], x["end"]) for x in spans])
            rows.append({"n_words": len(words), "spans": spans, "items": sorted(found), "rest": rest})
        kind = pa.struct(
            [
                ("n_words", pa.int64()),
                ("spans", pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))),
                ("items", pa.list_(pa.string())),
                ("rest", pa.string()),
            ]
        )
        return pa.array(rows, kind)

    # Filters on the result are not to run it a second time.
    return df.withColumn(into, match.asNondeterministic()(text, before))


def match_items(
    df: DataFrame,
    text: Column,
    benchmark: DataFrame,
    width: int = WIDTH,
    into: str = "match",
    automaton_bytes: int = AUTOMATON_BYTES,
    with_rest: bool = False,
) -> DataFrame:
    """``df`` with the number of words, the hit word ranges and the items found in each text.

    ``with_rest`` adds the text less the hit ranges.

    The items are broadcast while their texts fit in ``automaton_bytes``; larger sets are
    dealt into parts of that size, and one pass per part adds to the result.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("body")).dropna()
    size = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    parts = size // automaton_bytes + 1
    before = F.lit(None).cast(_MATCH)
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("item", "body"), F.lit(parts)) == part)
        rows = [tuple(row) for row in own.collect()]
        df = _match_part(df, text, rows, width, into, before, with_rest)
        before = F.col(into)
        if parts > 1:
            df = saved(df, "match")
    return df


def removed(match: Column) -> Column:
    """Number of hit words."""
    lengths = F.transform(match["spans"], lambda s: (s["end"] - s["first"]).cast("long"))
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, n: a + n)


def decontaminate(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    width: int = WIDTH,
    max_coverage: float = MAX_COVERAGE,
) -> DataFrame:
    """``df`` with the hit spans cut out of ``text``.

    A document more of which is hit than ``max_coverage`` goes as a whole; all others stay,
    and a text without hits stays as it is.
    """
    name = "_match"
    while name in df.columns:
        name += "_"
    matched = match_items(df, F.col(text), benchmark, width, name, with_rest=True)
    match = F.col(name)
    kept = matched.where(removed(match) <= match["n_words"] * max_coverage)
    return kept.withColumn(text, match["rest"]).drop(name)
