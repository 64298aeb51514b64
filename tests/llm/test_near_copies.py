import random
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from hitloom.llm import near_copies
from hitloom.llm.components import components

SF = "/root/testdata/sf0.001"


def plain_shingles(text, size=5):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return frozenset()
    return frozenset(" ".join(words[i : i + size]) for i in range(len(words) - size + 1)) or frozenset([" ".join(words)])


def plain_near_copies(texts):
    """texts: {doc_id: text}; every pair is compared."""
    sets = {d: plain_shingles(t) for d, t in texts.items()}
    least = {d: d for d in texts}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    return {d: root(d) for d in ids}


def test_shingles():
    for text in [None, "", " \t", "One", "a b c d", "a b c d e", "a B c d e f", "x " * 30, "é Ünï ß " * 40]:
        whole = near_copies.shingles(text)
        assert len(whole) == len(plain_shingles(text)) and np.array_equal(whole, near_copies.shingles(text, block=7))


def test_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text rlike '[a-zA-Z]'")
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    want = plain_near_copies({r.doc_id: r.text for r in docs.collect()})
    assert got == set(want.values())


def test_planted_edits_in_blocks(spark, monkeypatch):
    """Copies with one to four edits, around the bound; also with clumps dealt out by two sets."""
    rng = random.Random(5)
    texts = [None, "", "one two", "One  two", "a b c"]
    for _ in range(15):
        base = rng.choices([f"w{i}" for i in range(500)], k=150)
        for _ in range(rng.randrange(1, 7)):
            copy = list(base)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(150)] = f"new{rng.random()}"
            texts.append(" ".join(copy))
    want = plain_near_copies(dict(enumerate(texts)))
    assert len(set(want.values())) < len(texts) - 10
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block_sets in (near_copies.BLOCK_SETS, 2):
        monkeypatch.setattr(near_copies.links, "__defaults__", (block_sets,))
        assert {r.doc_id: r.component_id for r in near_copies.near_copies(df).collect()} == want


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(None, text), (5, text + " x"), (5, "p q"), (7, text + " x y"), (None, "p q"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in near_copies.near_copies(df).collect())
    assert got == [(-1, 5), (-1, 5), (5, 5), (5, 5), (7, 5), (9, 9)]
    assert near_copies.near_copies(df.limit(0)).count() == 0


def test_tries_propose_without_bands(spark):
    """Where no bucket is shared, SimHash tries propose, and only similar sets are linked."""
    rng = random.Random(8)
    texts = []
    for _ in range(40):
        base = rng.choices([f"w{i}" for i in range(900)], k=400)
        texts += [" ".join(base), " ".join([*base, "more"]), " ".join([*base[:200], "other", *base[201:]])]
    texts += [None, "", "one two", "one three"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, _t string")
    rows = near_copies.with_prints(docs, F.col("_t")).drop("_t").withColumn("bands", F.array().cast("array<bigint>")).cache()
    name = {r.doc_id: r.fp for r in rows.collect()}
    sets = {name[i]: plain_shingles(t) for i, t in enumerate(texts)}
    prints = {r.fp: r.sim for r in rows.collect()}
    differ = lambda a, b: ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count()
    similar = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    near = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and differ(a, b) <= near_copies.BUDGET and similar(a, b)]
    assert sum(differ(a, b) > 2 for a, b in near) > 5
    root = {r.node: r.root for r in components(near_copies.links(docs, rows)).collect()}
    assert all(root.get(a, a) == root.get(b, b) for a, b in near)
    assert all(similar(r.u, r.v) for r in near_copies.links(docs, rows).collect())
