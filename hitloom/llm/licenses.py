"""License scans: templates with optional and replaceable regions as token automata.

A template is plain text with markup: ``<<beginOptional>>`` ... ``<<endOptional>>`` around
words that may be missing (it nests), and ``<<var;name=...;match=...>>`` for words that may be
any, as many as ``match`` says: ``.+`` one or more, ``.*`` any number, ``.{a,b}`` from a to b.
It compiles into an automaton over words; a passage is accepted when all mandatory wording
stands there, in order and with nothing else between.

Results: a null text has no words, labels or places, and score 0; a passage is found wherever
it stands in a text; of passages of one template that start at one word the shortest counts;
repeated rows get the same result each; other columns pass through.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitloom.llm.store import on_workers
from hitloom.llm.words import alnum_words

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Wording of public licenses, (label, template).
TEMPLATES = [
    ("mit", "under the <<beginOptional>>terms of the<<endOptional>> MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of"
        " <<var;name=object;match=.{1,8}>> and associated documentation files (the <<var;name=defined;match=.{1,3}>>),"
        " to deal in the <<var;name=named;match=.{1,3}>> without restriction",
    ),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 <<beginOptional>>(the License); you may not use"
        " <<var;name=object;match=.{1,8}>> except in compliance with the License<<endOptional>>",
    ),
    (
        "gpl-3.0",
        "under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License"
        " <<beginOptional>>as published by the Free Software Foundation, either<<endOptional>> version 3"
        " <<beginOptional>>of the License<<endOptional>>",
    ),
    (
        "gpl-2.0",
        "under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License"
        " <<beginOptional>>as published by the Free Software Foundation; either<<endOptional>> version 2"
        " <<beginOptional>>of the License<<endOptional>>",
    ),
    ("cc-by-nc", "<<beginOptional>>Licensed under<<endOptional>> CC BY-NC <<beginOptional>>4.0<<endOptional>>"),
    ("cc-by-sa", "<<beginOptional>>Licensed under<<endOptional>> CC BY-SA <<beginOptional>>4.0<<endOptional>>"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted"
        " provided that the following conditions are met",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose"
        " with or without fee is hereby granted",
    ),
    (
        "mpl-2.0",
        "subject to the terms of the Mozilla Public License, <<var;name=version;match=.{1}>> 2.0",
    ),
]

_MARK = re.compile(r"<<(.*?)>>", re.DOTALL)
_REPEAT = re.compile(r"^\.(?:(\+)|(\*)|\{(\d+)(?:,(\d+))?\})$")


class Automaton:
    """Token automaton of one template.

    State numbers grow along the wording.  ``words[s]`` is the mandatory or optional word that
    leads from s to s + 1, ``free[s]`` says that any word leads on to s + 1, ``loops[s]`` that
    any word leads back to s, and ``skips[s]`` holds states reached without a word.
    """

    def __init__(self, template: str):
        self.words: list[bytes | None] = []
        self.free: list[bool] = []
        self.loops: set[int] = set()
        self.skips: dict[int, list[int]] = {}
        self.mandatory: list[bytes] = []
        opened: list[int] = []
        for i, part in enumerate(_MARK.split(template)):
            if i % 2 == 0:
                for word in alnum_words(part):
                    self._step(word, False)
                    if not opened:
                        self.mandatory.append(word)
            elif part == "beginOptional":
                opened.append(len(self.words))
            elif part == "endOptional":
                self.skips.setdefault(opened.pop(), []).append(len(self.words))
            elif part.startswith("var;"):
                self._var(dict(field.split("=", 1) for field in part.split(";")[1:])["match"])
            else:
                raise ValueError(f"unknown markup: {part}")
        if opened or not self.mandatory:
            raise ValueError("a region is open, or nothing is mandatory")
        self.last = len(self.words)
        self.closed = [self._closure(s) for s in range(self.last + 1)]
        self.anchor = max(self.mandatory, key=len)

    def _step(self, word: bytes | None, free: bool) -> None:
        self.words.append(word)
        self.free.append(free)

    def _var(self, match: str) -> None:
        found = _REPEAT.match(match)
        if not found:
            raise ValueError(f"unknown match: {match}")
        plus, star, low, high = found.groups()
        least = 1 if plus else 0 if star else int(low)
        for _ in range(least):
            self._step(None, True)
        if plus or star:
            self.loops.add(len(self.words))
        else:
            most = int(high or low)
            for k in range(most - least):
                self.skips.setdefault(len(self.words), []).append(len(self.words) + most - least - k)
                self._step(None, True)

    def _closure(self, state: int) -> tuple[int, ...]:
        found, stack = set(), [state]
        while stack:
            s = stack.pop()
            if s not in found:
                found.add(s)
                stack += self.skips.get(s, [])
        return tuple(sorted(found))

    def _next(self, states: set[int], word: bytes) -> set[int]:
        after: set[int] = set()
        for s in states:
            if s in self.loops:
                after.add(s)
            if s < self.last and (self.free[s] or self.words[s] == word):
                after.update(self.closed[s + 1])
        return after

    def passages(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(first word, end) of the shortest accepted passage from each start."""
        first = {self.words[s] for s in self.closed[0] if s < self.last and not self.free[s]}
        anywhere = any(self.free[s] for s in self.closed[0] if s < self.last) or 0 in self.loops
        found = []
        for start, word in enumerate(words):
            if not anywhere and word not in first:
                continue
            states, at = set(self.closed[0]), start
            while states and at < len(words):
                states = self._next(states, words[at])
                at += 1
                if self.last in states:
                    found.append((start, at))
                    break
        return found


class Scanner:
    """All phrases and templates; texts without a word that each of them needs are left at once."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        self.templates = [(label, Automaton(text)) for label, text in templates]
        self.phrases = [(alnum_words(phrase), label) for phrase, label in phrases.items()]
        longest = [max(words, key=len) for words, _ in self.phrases]
        self.anchors = frozenset(longest + [a.anchor for _, a in self.templates])

    def scan(self, text: str | None) -> dict:
        words = alnum_words(text)
        own = set(words)
        row = {"n_words": len(words), "starts": [], "base": [], "labels": [], "score": 0.0}
        if own.isdisjoint(self.anchors):
            return row
        base, more, covered = [], set(), bytearray(len(words))
        for phrase, label in self.phrases:
            if own.issuperset(phrase):
                for i in range(len(words) - len(phrase) + 1):
                    if words[i] == phrase[0] and words[i : i + len(phrase)] == phrase:
                        base.append((i, label))
                        covered[i : i + len(phrase)] = b"\1" * len(phrase)
        for label, automaton in self.templates:
            if own.issuperset(automaton.mandatory):
                for start, end in automaton.passages(words):
                    more.add(label)
                    covered[start:end] = b"\1" * (end - start)
        names = {label for _, label in base}
        row["starts"] = sorted(i for i, _ in base)
        row["base"], row["labels"] = sorted(names), sorted(names | more)
        row["score"] = sum(covered) / len(words)
        return row


_FOUND = "struct<n_words:bigint,starts:array<bigint>,base:array<string>,labels:array<string>,score:double>"


def _scanner(sent) -> Scanner:
    return Scanner(*sent)


def scan(
    df: DataFrame,
    text: Column,
    into: str = "license",
    templates: list[tuple[str, str]] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
) -> DataFrame:
    """``df`` with words, places of the phrases, labels, and the share of words inside license wording."""
    scanner = on_workers(df.sparkSession, (templates, phrases), _scanner)
    kind = pa.struct(
        [
            ("n_words", pa.int64()),
            ("starts", pa.list_(pa.int64())),
            ("base", pa.list_(pa.string())),
            ("labels", pa.list_(pa.string())),
            ("score", pa.float64()),
        ]
    )

    @F.arrow_udf(_FOUND)
    def found(texts: pa.Array) -> pa.Array:
        own = scanner()
        return pa.array([own.scan(t.as_py()) for t in texts], kind)

    return df.withColumn(into, found(text))
