import math
import random
import re
from collections import Counter

import numpy as np

from hitloom.llm import lexical_search as ls

SCHEMA = "doc_id long, text string, key string, items string, rank int"


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, count):
    """docs: (doc_id, text) rows; items: (item_id, text) rows."""
    counts = [(doc_id, Counter(words(text))) for doc_id, text in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    found = []
    for item_id, text in dict.fromkeys(items):
        scores = []
        for doc_id, c in counts:
            m, score = 0, 0
            for term in words(text):
                if term in c:
                    m = 100 - 25 + (25 * sum(c.values()) * n_docs) // n_terms
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += w * ((10**9 * c[term]) // (1000 * c[term] + 12 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        scores.sort()
        found += [(item_id, i + 1, None if a else d, -s) for i, (s, a, d) in enumerate(scores[:count])]
    return sorted(found, key=str)


def got(spark, docs, items, count, **more):
    df = spark.createDataFrame([(*d, "k", "i", 3) for d in docs], SCHEMA)
    asked = spark.createDataFrame(items, "item_id long, text string")
    out = ls.search(df, asked, count, **more)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def corpus():
    rng = random.Random(3)
    terms = [f"t{i}" for i in range(300)] + ["É", "straße", "日本語"]
    weights = [1 / (i + 1) for i in range(len(terms))]
    docs = [(i, " ".join(rng.choices(terms, weights, k=rng.choice([1, 5, 40, 200])))) for i in range(300)]
    docs += [(400, "x " * 5000 + "T1 t2, t250"), (401, None), (402, ""), (403, " ..!"), (None, "t1 t200"), (404, "t299 " * 70)]
    docs += [(500 - i, "t7 t250 t9") for i in range(40)] + [(3, docs[3][1])] * 2
    items = [(i, " ".join(rng.choices(terms, k=rng.randrange(1, 30)))) for i in range(25)]
    items += [(30, None), (31, ""), (32, "unseen words"), (33, "T7 t250;t9 t7"), (33, "T7 t250;t9 t7"), (None, "t1"), (34, "x t299")]
    return docs, items


def test_against_brute_force(spark):
    docs, items = corpus()
    assert got(spark, docs, items, 20) == brute(docs, items, 20)


def test_items_in_parts_and_small_blocks(spark, monkeypatch):
    docs, items = corpus()
    monkeypatch.setattr(ls, "FIRST", 3)
    assert got(spark, docs, items, 5, item_bytes=400) == brute(docs, items, 5)


def test_empty_tables(spark):
    docs, items = corpus()
    assert got(spark, docs[:0], items, 5) == [] and got(spark, docs, items[:0], 5) == []
    assert got(spark, [(1, None), (2, "")], items, 5) == []


def test_bounds_never_below_scores():
    docs, items = corpus()
    counts = [Counter(w.encode() for w in words(text)) for _, text in docs if words(text)]
    terms = sorted({w.encode() for _, text in items for w in words(text)})
    number = {t: i for i, t in enumerate(terms)}
    own = [{number[w.encode()]: n for w, n in Counter(words(text)).items()} for _, text in items]
    total = sum(sum(c.values()) for c in counts)
    queries = ls.Queries((terms, [ls.weight(len(counts), sum(t in c for c in counts)) for t in terms], own, len(counts), total))
    tight = 0
    for width in {ls.width_of(len(ls._signature(c, {}))) for c in counts}:
        block = ls._Block(width)
        held = [c for c in counts if ls.width_of(len(ls._signature(c, {}))) == width]
        for i, c in enumerate(held):
            block.keys.append(i)
            block.lengths.append(sum(c.values()))
            block.codes.append(ls._signature(c, {}))
        record = block.record()
        lengths = np.array(record["lengths"])
        bounds = queries.bounds(width, lengths, np.frombuffer(record["slices"], np.uint8).reshape(width, -1))
        for d, c in enumerate(held):
            known = Counter({number[t]: n for t, n in c.items() if t in number})
            m = ls.length_norm(int(lengths[d]), len(counts), total)
            for i in range(len(items)):
                score = queries.score(i, known, m)
                assert bounds[i, d] >= score
                tight += bounds[i, d] == score
    assert tight > len(items) * len(counts) / 2


def test_values_and_widths():
    assert [ls.value(1, 100), ls.value(3, 75), ls.value(0, 100)] == [454545, 769230, 0]
    assert ls.width_of(1) == 64 and ls.width_of(5) == 96 and ls.width_of(100) == 2048 and ls.width_of(90) == 1536
