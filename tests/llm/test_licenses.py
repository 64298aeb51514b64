import random
import re

import pytest
from pyspark.sql import functions as F

from hitloom.llm import licenses
from hitloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def places(text):
    own = words(text)
    out = []
    for phrase, label in licenses.PHRASES.items():
        target = phrase.split()
        out += [(i, label) for i in range(len(own)) if own[i : i + len(target)] == target]
    return sorted(out)


def as_regex(template):
    """The same template as a regular expression over words that each end with a space."""
    out = ""
    for i, part in enumerate(re.split(r"<<(.*?)>>", template)):
        if i % 2 == 0:
            out += "".join(re.escape(w) + " " for w in words(part))
        elif part == "beginOptional":
            out += "(?:"
        elif part == "endOptional":
            out += ")?"
        else:
            out += r"(?:\S+ )" + part.split("match=.")[1]
    return out


@pytest.mark.parametrize("seed", range(30))
def test_automata_against_regular_expressions(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choices("abc", k=n))
    template = (
        f"{text(1)} <<beginOptional>>{text(2)} <<beginOptional>>{text(1)}<<endOptional>><<endOptional>>"
        f" <<var;name=x;match={rng.choice(['.+', '.*', '.{1,3}', '.{2}', '.{0,2}'])}>> {text(1)}"
        f" <<beginOptional>>{text(1)}<<endOptional>> {text(1)}"
    )
    automaton, rule = licenses.Automaton(template), re.compile(as_regex(template))
    for _ in range(60):
        own = rng.choices("abcd", k=rng.randrange(0, 14))
        got = automaton.passages([w.encode() for w in own])
        joined = [w + " " for w in own]
        want = []
        for i in range(len(own)):
            ends = [j for j in range(i + 1, len(own) + 1) if rule.fullmatch("".join(joined[i:j]))]
            if ends:
                want.append((i, ends[0]))
        assert got == want, (template, own)


def test_odd_rows(spark):
    texts = [None, "", "...", "MIT License mit license", "Licensed under CC BY-NC 4.0.", "gnu general public licence",
             "Released under the terms of the MIT License", "released under the terms of MIT License", "é mit license", "mit license " * 3000,
             "Licensed under the Apache License, Version 2.0.", "mit license", "mit license"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, score int")
    got = {r.doc_id: r.license for r in licenses.scan(df, F.col("text")).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert got[i].n_words == len(words(text)) and 0 <= got[i].score <= 1
        assert got[i].starts == [p for p, _ in places(text)]
        assert got[i].base == sorted({label for _, label in places(text)}) and set(got[i].base) <= set(got[i]["labels"])
    assert got[4]["labels"] == ["cc-by", "cc-by-nc"] and got[4].score == 5 / 7
    assert got[6]["labels"] == ["mit"] and got[6].score == 7 / 8 and got[7].score == 2 / 7
    assert got[10]["labels"] == ["apache", "apache-2.0"]
    assert licenses.scan(df.limit(0), F.col("text")).count() == 0


def test_templates_accept_their_own_wording():
    for label, template in licenses.TEMPLATES:
        whole = re.sub("<<(begin|end)Optional>>", " ", re.sub("<<var.*?>>", " some ", template))
        least = template
        while "<<begin" in least:
            least = re.sub("<<beginOptional>>((?!<<begin).)*?<<endOptional>>", " ", least)
        for text in (whole, re.sub("<<var.*?>>", " some ", least)):
            assert label in licenses.Scanner().scan("before " + text + " after")["labels"]


def test_bad_markup():
    for template in ("a <<beginOptional>> b", "<<var;name=x;match=[a-z]>> a", "<<other>> a", "<<beginOptional>>a<<endOptional>>"):
        with pytest.raises(ValueError):
            licenses.Automaton(template)


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op7_licenses"](spark, SF).collect():
        want = places(docs[r.doc_id])
        assert (r.n_words, r.n_base) == (len(words(docs[r.doc_id])), len(want))
        assert (r.first_word, r.last_word) == ((want[0][0], want[-1][0]) if want else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in want}))
