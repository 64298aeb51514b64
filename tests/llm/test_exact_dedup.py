import hashlib
import random
import re
from collections import defaultdict

import pytest

from hitloom.llm import exact_dedup as ed

ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "a b"), (5, "ab"), (6, "a  b"), (7, "A b"), (8, "a b"), (9, "é é"),
    (10, "éé"), (None, "ab  "), (None, "only"), (11, "x y" * 40_000), (12, "xy" * 40_000), (13, "xy" * 40_000 + "z"),
    (14, "twice"), (14, "twice"), (15, "t wice"), (15, "twi ce"), (16, "\U0001f600 "), (17, "\U0001f600"),
]


def brute(rows):
    groups = defaultdict(list)
    for row, (doc_id, text) in enumerate(rows):
        content = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups[content].append((-len(text or ""), doc_id is None, doc_id or 0, row, doc_id))
    found = []
    for content, own in groups.items():
        own.sort()
        digest = hashlib.sha256(content.encode()).hexdigest()
        found += [(x[4], own[0][4], len(own), i == 0, digest) for i, x in enumerate(own)]
    return sorted(found, key=str)


def got(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, b"d", "b") for r in rows], "doc_id long, text string, row int, digest binary, bucket string")
    out = ed.exact_duplicates(df.repartition(5), **more)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def many():
    rng = random.Random(1)
    base = ["".join(rng.choices("abcde \n", k=rng.randrange(1, 400))) for _ in range(60)]
    rows = [(i, rng.choice(base)) for i in range(400)] + [(1000 + i, "the hot text") for i in range(300)]
    return rows + [(2000 + i, " ".join(rng.choice(base))) for i in range(100)]


def test_against_brute_force(spark):
    assert got(spark, ODD) == brute(ODD)
    assert got(spark, many()) == brute(many())


@pytest.mark.parametrize("fit_bytes", [300])
def test_overfull_buckets_are_dealt_again(spark, monkeypatch, fit_bytes):
    levels = []
    real = ed._dealt
    monkeypatch.setattr(ed, "_dealt", lambda read, level, buckets, fit: levels.append(buckets) or real(read, level, buckets, fit))
    monkeypatch.setattr(ed, "MAX_FILES", 4)
    rows = ODD[:10] + many()[:150]
    assert got(spark, rows, fit_bytes=fit_bytes) == brute(rows)
    assert len(levels) > 1 and levels[-1] < levels[0]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("spill")]


def test_empty_table(spark):
    assert got(spark, []) == []


def test_table_compares_contents(monkeypatch):
    """Contents of equal codes stay apart, also after growth."""
    monkeypatch.setattr(ed.xxhash, "xxh64_intdigest", lambda content, seed=0: len(content) % 3)
    table = ed.ContentTable(4)
    contents = [f"{i}-".encode() * (1 + i % 4) for i in range(200)]
    numbers = [table.entry(c) for c in contents]
    assert numbers == [(i, True) for i in range(len(contents))]
    assert [table.entry(c) for c in contents] == [(i, False) for i in range(len(contents))]
    assert table.bytes == sum(map(len, contents)) and len(table.places) >= 2 * len(contents)


def test_buckets_are_read_without_a_shuffle(spark):
    docs = spark.createDataFrame(many(), "doc_id long, text string").selectExpr("doc_id", "text", "length(text) as points")
    spec = f"bucket long, code long, size long, content binary, {ed._BEST}"
    spill = ed.Spill(docs.mapInArrow(ed._dealt(ed._documents, 0, 8, 10**6), spec), 8, "spill")
    settled = spill.rows.groupBy("bucket").applyInArrow(ed._settled, f"digest binary, {ed._BEST}")
    plan = settled._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Exchange" not in plan
    hot = spill.rows.where("content = 'thehottext'").count()
    assert hot <= docs.rdd.getNumPartitions()  # equal contents meet in each task first
    spill.drop()
