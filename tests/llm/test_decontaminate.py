import random
import re

import pytest
from pyspark.sql import functions as F

from hitloom.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, width=10):
    own, hit, found = words(text), set(), set()
    for item, body in items:
        target = words(body)
        size = min(width, len(target))
        windows = {tuple(target[i : i + size]) for i in range(len(target) - size + 1)} if target else set()
        for i in range(len(own) - size + 1 if windows else 0):
            if tuple(own[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                found.add(str(item))
    return len(own), sorted(hit), sorted(found)


def made(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(6)] + ["É", "ß9"]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, text(rng.choice([1, 2, 3, 6, 8, 12, 30]) if seed % 2 else rng.choice([3, 5, 14, 40]))) for i in range(rng.randrange(1, 7))]
    items += [(items[0][0], text(12)), (90, ""), (None, text(11)), (91, None), (92, items[-1][1])]
    docs = [None, "", "W0, w1!"]
    for _ in range(30):
        parts = [text(rng.randrange(0, 30)), rng.choice(items)[1] or "", text(rng.randrange(0, 20)).upper()]
        docs.append("\n".join(parts))
    return docs, items


@pytest.mark.parametrize("seed", range(6))
def test_automaton_against_brute_force(seed):
    docs, items = made(seed)
    width = 10 if seed < 3 else 4
    known = [(i, b) for i, b in items if i is not None and b]
    automaton = dc.SuffixAutomaton([(str(i), [w.encode() for w in words(b)]) for i, b in known], width)
    for text in docs:
        hit, found = automaton.scan([w.encode() for w in words(text)])
        assert (len(hit), hit.nonzero()[0].tolist(), sorted(found)) == brute(text, known, width)


def test_operator(spark):
    docs, items = made(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, n_words int")
    known = [(i, b) for i, b in items if i is not None and b]
    for size in (dc.AUTOMATON_BYTES, 100):  # one automaton, then one for each part of the items
        got = dc.match_items(df, F.col("text"), bench, automaton_bytes=size).collect()
        assert len(got) == len(docs)
        for row in got:
            hit = [i for s in row.match.spans for i in range(s["first"], s["end"])]
            assert (row.match.n_words, hit, row.match["items"]) == brute(row.text, known)
    assert dc.match_items(df.limit(0), F.col("text"), bench).count() == 0
    assert not any(r.match.spans for r in dc.match_items(df, F.col("text"), bench.limit(0)).collect())


def test_cut(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda."
    around = "One two three four five six seven eight nine ten eleven twelve "
    docs = [(1, around + item + " END."), (2, item), (3, around), (4, None), (5, ""), (3, around)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: r.text for r in dc.decontaminate(df, bench).collect()}
    assert got == {1: around + ". END.", 3: around, 4: None, 5: ""}
    assert dc.decontaminate(df, bench).count() == 5
