"""The cache log: what it writes, replays, hides and purges, against a plain table."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hitloom.operators.cache import cached_and_fresh, live_entries, mark_cached
from hitloom.plans import inputs, queries
from hitloom.plans.run import search_cached
from hitloom.schemas import PAGE_CACHE
from hitloom.sources.cache_log import append_entries, purge_log, read_log
from hitloom.streaming.stages import stream_cache_upkeep

SF = "/root/testdata/sf0.001"
HOUR = 3600


def entries(spark, rows):
    return spark.createDataFrame([(k, "u", t, "h" * 50, "s", at) for k, t, at in rows], PAGE_CACHE).coalesce(1)


def table(spark, root, now):
    rows = live_entries(read_log(spark, root, PAGE_CACHE), now).collect()
    return sorted((r.cache_key, r.title) for r in rows)


def test_against_a_plain_table(spark, tmp_path):
    """Random batches, replays, drops and purges give what a dictionary gives."""
    rng, root, plain, now = random.Random(4), str(tmp_path / "log"), {}, 10 * HOUR
    assert table(spark, root, now) == []
    for batch in range(9):
        keys = rng.sample("abcdefgh", rng.randrange(1, 5))
        if rng.random() < 0.2:
            rows = [(k, None, rng.choice([0, now + 9 * HOUR])) for k in keys]
            append_entries(entries(spark, rows), root, batch, dropped=True)
            plain = {k: v for k, v in plain.items() if k not in keys}
        else:
            rows = [(k, f"{k}{batch}", rng.choice([0, now + 10, now + 2 * HOUR, now + 20 * HOUR])) for k in keys]
            for _ in range(rng.randrange(1, 3)):  # a replay changes nothing
                append_entries(entries(spark, rows), root, batch)
            plain |= {k: (t, at) for k, t, at in rows}
        want = sorted((k, t) for k, (t, at) in plain.items() if at == 0 or at >= now)
        assert table(spark, root, now) == want
        if rng.random() < 0.6:
            now += rng.randrange(3 * HOUR)
            purge_log(spark, root, now, PAGE_CACHE)
            plain = {k: (t, at) for k, (t, at) in plain.items() if at == 0 or at >= now}
            assert table(spark, root, now) == sorted((k, t) for k, (t, at) in plain.items())
            left = [int(p.name.split("=")[1]) for p in Path(root).glob("batch=*/expires_hour=*")]
            assert min(left, default=now) >= now // HOUR


def test_expired_entry_hides_an_older_one(spark, tmp_path):
    root = str(tmp_path / "log")
    append_entries(entries(spark, [("a", "old", 0), ("b", "old", 50 * HOUR), ("c", "old", 5)]), root, 0)
    append_entries(entries(spark, [("a", "new", 2 * HOUR), ("b", "new", 2 * HOUR)]), root, 1)
    assert purge_log(spark, root, 9 * HOUR, PAGE_CACHE) == 2
    assert table(spark, root, 9 * HOUR) == []
    assert purge_log(spark, root, 9 * HOUR, PAGE_CACHE) == 0
    assert purge_log(spark, root, 60 * HOUR, PAGE_CACHE) == 2  # the mark over b goes with b
    append_entries(entries(spark, [("a", "third", 0)]), root, 2)
    assert table(spark, root, 60 * HOUR) == [("a", "third")]


def test_bytes_follow_the_batch(spark, tmp_path):
    """Three batches of one size into a table that grows write about the same each."""
    written = []
    for n in range(3):
        rows = [(f"{n}-{i}", "t", 100 * HOUR) for i in range(2000)]
        entries(spark, rows).write.mode("append").parquet(str(tmp_path / "in"))
        before = {p: p.stat().st_mtime_ns for p in (tmp_path / "log").rglob("*.parquet")}
        stream = spark.readStream.schema(PAGE_CACHE).parquet(str(tmp_path / "in"))
        stream_cache_upkeep(stream, str(tmp_path / "log"), str(tmp_path / "cp"), PAGE_CACHE, now=HOUR).awaitTermination()
        after = {p: p.stat().st_mtime_ns for p in (tmp_path / "log").rglob("*.parquet")}
        assert all(after[p] == before[p] for p in before)
        written.append(sum(p.stat().st_size for p in after if p not in before))
    assert len(table(spark, str(tmp_path / "log"), HOUR)) == 6000
    assert max(written) < 1.2 * min(written)


def scans(df, path):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("FileScan" in line and path in line for line in plan.splitlines())


@pytest.fixture
def stored(spark, tmp_path):
    inputs.result_cache(spark, SF).write.parquet(str(tmp_path / "cachetable"))
    inputs.hits(spark, SF).write.parquet(str(tmp_path / "fetched"))
    queries.request_table(spark, SF).write.parquet(str(tmp_path / "asked"))
    return [spark.read.parquet(str(tmp_path / name)) for name in ("asked", "cachetable", "fetched")]


def test_cache_is_read_once(spark, stored):
    asked, cache, fetched = stored
    for plan in (cached_and_fresh(asked, cache, fetched, inputs.NOW), search_cached(asked, cache, fetched, now=inputs.NOW)):
        assert scans(plan, "cachetable") == 1 and scans(plan, "fetched") == 1
    marked = mark_cached(asked, cache, inputs.NOW)
    assert scans(marked, "cachetable") == 1
    line = next(x for x in marked._jdf.queryExecution().executedPlan().toString().splitlines() if "cachetable" in x)
    assert "title" not in line.split("ReadSchema")[1]


def test_requests_listed_twice(spark, stored):
    asked, cache, fetched = stored
    once = cached_and_fresh(asked, cache, fetched, inputs.NOW)
    twice = cached_and_fresh(asked.unionByName(asked), cache, fetched, inputs.NOW)
    assert once.exceptAll(twice).isEmpty() and twice.exceptAll(once).isEmpty()
    counts = mark_cached(asked, cache, inputs.NOW).groupBy("answered").count().collect()
    assert sum(r["count"] for r in counts) == asked.count() and len(counts) == 2
    off = mark_cached(asked, cache, inputs.NOW, refresh=True)
    assert off.where("answered").isEmpty() and off.columns == [*asked.columns, "answered"]
    assert cached_and_fresh(asked, cache, fetched.limit(0), inputs.NOW).where(~F.col("cached")).isEmpty()
