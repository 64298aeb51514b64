import random
import re
import tracemalloc

import numpy as np
import xxhash
from pyspark.sql import functions as F

from hitloom.llm import simhash
from hitloom.llm.components import components


def plain_print(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(prints):
    """prints: {doc_id: fp}; every pair is compared."""
    least = {d: d for d in prints}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                least[y] = x
    return {d: root(d) for d in ids}


TEXTS = [None, "", " \t\r\n", "One", "one two", "a b c", "A  B\tC", "x " * 9, "é Ünï ß " * 40, "one two three four " * 300, "a b c"]


def test_fingerprints():
    for text in TEXTS:
        assert simhash.fingerprint(text) == plain_print(text)
        assert simhash.fingerprint(text, block=7) == plain_print(text)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def family(seed, n):
    """Fingerprints in clusters, with chains of small steps."""
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        fp = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 5, 30])):
            out.append(fp)
            for _ in range(rng.choice([0, 1, 2, 2, 3])):
                fp ^= 1 << rng.randrange(64)
    return out[:n]


def test_links_join_what_brute_force_joins(spark):
    for trie_rows in (simhash.TRIE_ROWS, 2):
        prints = sorted(set(family(7, 900)))
        df = spark.createDataFrame([(signed(fp),) for fp in prints], "fp long")
        found = components(simhash.links(df, trie_rows=trie_rows)).collect()
        got = {fp: fp for fp in prints} | {r.node % (1 << 64): r.root % (1 << 64) for r in found}
        want = plain_components({signed(fp): fp for fp in prints})
        assert len({(got[fp], want[signed(fp)]) for fp in prints}) == len(set(got.values())) == len(set(want.values()))


def test_dense_trie():
    """All fingerprints within 2 bits of a centre: many links, one set."""
    rest = np.array(sorted({0} | {1 << a | 1 << b for a in range(32) for b in range(32)}), np.int64)
    label = simhash.join_tries(rest, [(0, len(rest), 0, len(rest), 0)], 32, 2)
    assert not label.any()


def many_tries(seed, n, tries, mask):
    """``n`` sorted rows of 44 bits (those of ``mask``) in about ``tries`` tries, each paired with itself."""
    rng = np.random.default_rng(seed)
    rows = np.sort(rng.integers(0, tries, n) << 44 | rng.integers(0, 1 << 44, n) & mask)
    starts = np.flatnonzero(np.append(True, np.diff(rows >> 44) > 0))
    ends = np.append(starts[1:], n)
    return rows & (1 << 44) - 1, [(a, b, a, b, 0) for a, b in zip(starts.tolist(), ends.tolist()) if b - a > 1]


def test_join_in_parts(monkeypatch):
    rest, pairs = many_tries(1, 6000, 40, 0x0F10F10F10F1)
    whole = simhash.join_tries(rest, pairs, 44, 4)
    a, b, *_ = pairs[0]
    differ = np.array([[(x ^ y).bit_count() for y in rest[a:b].tolist()] for x in rest[a:b].tolist()])
    near = [(int(i), int(j)) for i, j in np.argwhere(differ <= 4) if i < j]
    want = np.arange(b - a)
    while any(want[i] != want[j] for i, j in near):
        for i, j in near:
            want[[i, j]] = min(want[i], want[j])
    assert (whole[a:b] - a).tolist() == want.tolist() and len(near)
    monkeypatch.setattr(simhash, "FRONTIER", 50)  # levels are left and come back
    assert simhash.join_tries(rest, pairs, 44, 4).tolist() == whole.tolist()


def test_join_takes_little_memory():
    rest, pairs = many_tries(2, 200_000, 20_000, 0x0FF0FF0FF0FF)
    tracemalloc.start()
    simhash.join_tries(rest, pairs, 44, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6  # two of them run in an executor


def test_near_duplicates(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    texts = list(TEXTS)
    for _ in range(12):
        base = rng.choices(words, k=120)
        for _ in range(rng.randrange(1, 5)):
            copy = list(base)
            if rng.random() < 0.6:
                copy[rng.randrange(120)] = "new"
            texts.append(" ".join(copy))
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int, component_id string")
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    prints = {i: plain_print(t) for i, t in enumerate(texts)}
    want = plain_components(prints)
    assert {d: r.component_id for d, r in got.items()} == want
    assert all(got[d].fp % (1 << 64) == fp for d, fp in prints.items())
    kept = simhash.one_per_component(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_odd_rows(spark):
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "p q r s"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(df).collect())
    assert got == [(-1, -1), (-1, 5), (5, 5), (5, 5), (9, 9)]
    kept = simhash.one_per_component(df).collect()
    assert sorted(r.doc_id or -1 for r in kept) == [-1, -1, 5, 9]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_long_chains_settle(spark):
    n = 400
    df = spark.range(n - 1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.root for r in components(df).collect()} == {0}
    star = spark.range(1, 500).select(F.lit(700).cast("long").alias("u"), F.col("id").alias("v"))
    got = {(r.node, r.root) for r in components(star).collect()}
    assert got == {(i, 1) for i in [*range(2, 500), 700]}


def test_set_fingerprint():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 9, 20_000):
        hashes = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
        ones = [int((hashes >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)]
        assert simhash.set_fingerprint(hashes) == sum(1 << b for b in range(64) if ones[b] * 2 > n)


def test_wider_budgets(spark):
    """Distances up to 4, also with tries dealt out, against all pairs."""
    rng = random.Random(11)
    prints = []
    for _ in range(60):
        fp = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 8])):
            prints.append(fp)
            for bit in rng.sample(range(64), rng.randrange(1, 7)):
                fp ^= 1 << bit
    df = spark.createDataFrame([(signed(x),) for x in sorted(set(prints))], "fp long")
    for budget, trie_rows in ((3, 10), (4, simhash.TRIE_ROWS), (4, 1)):
        linked = simhash.links(df, budget, trie_rows=trie_rows)
        got = {signed(x): signed(x) for x in prints} | {r.node: r.root for r in components(linked).collect()}
        for i, a in enumerate(prints):
            for b in prints[:i]:
                assert (a ^ b).bit_count() > budget or got[signed(a)] == got[signed(b)]
        mask = 2**64 - 1
        groups = {}
        for x in set(prints):
            groups.setdefault(got[signed(x)], []).append(x & mask)
        for own in groups.values():  # nothing farther away is joined: each group hangs together by near pairs
            seen, todo = {own[0]}, [own[0]]
            while todo:
                x = todo.pop()
                near = [y for y in own if y not in seen and (x ^ y).bit_count() <= budget]
                seen.update(near)
                todo += near
            assert seen == set(own)
