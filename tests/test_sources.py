"""Record files, versioned tables, bucketed bodies, and the stream stages."""

import json

import pytest
from pyspark.sql import functions as F

from hitloom.functions.keys import page_key
from hitloom.operators.attach import attach_pages
from hitloom.operators.records import record_json
from hitloom.operators.sanitize import sanitize
from hitloom.operators.cache import live_entries
from hitloom.plans import inputs
from hitloom.schemas import PAGE_CACHE, RECORD, RESULT_PAGE, SNAPSHOT
from hitloom.session import scratch_dir
from hitloom.sources.ndjson import read_records, write_records
from hitloom.sources.cache_log import read_log
from hitloom.sources.tables import (
    commit_version,
    latest_version,
    read_cache,
    read_result_pages,
    read_snapshots,
    save_snapshots,
)
from hitloom.streaming.stages import (
    stream_attach_pages,
    stream_cache_upkeep,
    stream_sanitize,
)

SF = "/root/testdata/sf0.001"


def lines_of(spark, path):
    return sorted(r["value"] for r in spark.read.text(path).collect())


def test_read_records(spark, tmp_path):
    good = '{"url":"https://a","score":2,"unknown":[1],"error":null}\n\n   \n{"raw_html":"<p>"}\n'
    (tmp_path / "a.json").write_text(good)
    rows = read_records(spark, str(tmp_path)).orderBy(F.col("url").desc()).collect()
    assert len(rows) == 2
    assert (rows[0]["title"], rows[0]["score"], rows[0]["engines"], rows[0]["cached"]) == ("", 2.0, [], False)
    assert rows[0]["snippet"] is None and rows[1]["raw_html"] == "<p>"


def test_malformed_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"url":"https://a"}\n{"url": oops\n\n')
    with pytest.raises(Exception):
        read_records(spark, str(tmp_path)).collect()
    rows = read_records(spark, str(tmp_path), mode="quarantine")
    assert [r["url"] for r in rows.filter("_corrupt_record is null").collect()] == ["https://a"]
    assert rows.filter("_corrupt_record is not null").first()["_corrupt_record"] == '{"url": oops'


def test_write_records(spark, tmp_path):
    rows = [("u", "t", None, 1.5, ["brave"], True, None, None, None, "text", None),
            ("v", "t", "s", 0.0, None, False, None, "<p>", None, None, "e")]
    records = spark.createDataFrame(rows, RECORD)
    write_records(records, str(tmp_path / "o"), keep_raw=True)
    u, v = (json.loads(x) for x in lines_of(spark, str(tmp_path / "o")))
    assert "raw_html" not in u and u["snippet"] is None and u["content_md"] == "text"
    assert v["raw_html"] == "<p>" and v["error"] == "e"
    write_records(records, str(tmp_path / "o"))
    assert all("raw_html" not in json.loads(x) for x in lines_of(spark, str(tmp_path / "o")))


def test_versions(spark, tmp_path):
    root = str(tmp_path / "cache")
    assert read_cache(spark, root, PAGE_CACHE).count() == 0
    for n in (1, 2):
        rows = spark.createDataFrame([(f"k{n}", "u", "t", "h", "s", 0)], PAGE_CACHE)
        old = read_cache(spark, root, PAGE_CACHE)
        assert commit_version(old.unionByName(rows), root) == n
    assert latest_version(spark, root) == 2
    assert read_cache(spark, root, PAGE_CACHE).count() == 2
    with pytest.raises(ValueError, match="lacks columns"):
        read_cache(spark, root)


def test_captured_tables(spark, tmp_path):
    inputs.result_pages(spark, SF).write.parquet(str(tmp_path / "r"))
    inputs.snapshots(spark, SF).write.parquet(str(tmp_path / "s"))
    assert read_result_pages(spark, str(tmp_path / "r")).schema == RESULT_PAGE
    assert read_snapshots(spark, str(tmp_path / "s")).schema == SNAPSHOT


def test_bucketed_bodies_do_not_move(spark):
    save_snapshots(inputs.snapshots(spark, SF), "bodies", 4)
    records = inputs.page_records(spark, SF).drop("page_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = attach_pages(records, spark.table("bodies"))
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table bodies")
    assert plan.count("Exchange hashpartitioning") == 1


def digest(df):
    return sorted(r[0] for r in df.select(F.md5(record_json(True))).collect())


def test_stream_equals_batch(spark):
    base = scratch_dir(spark, "stages")
    records = inputs.page_records(spark, SF)
    write_records(records, f"{base}/in", keep_raw=True)
    source = read_records(spark, f"{base}/in")

    stream_sanitize(spark, f"{base}/in", f"{base}/text", f"{base}/c1").awaitTermination()
    batch = sanitize(source, strip="sanitized")
    assert digest(read_records(spark, f"{base}/text")) == digest(batch)

    bodies, cache = inputs.snapshots(spark, SF), inputs.page_cache(spark, SF)
    stream_attach_pages(
        spark, f"{base}/in", bodies, f"{base}/pages", f"{base}/c2", cache, inputs.NOW
    ).awaitTermination()
    batch = attach_pages(source, bodies, cache, inputs.NOW)
    assert digest(read_records(spark, f"{base}/pages")) == digest(batch)

    # A second run picks up new files only.
    write_records(records.limit(1), f"{base}/in", mode="append", keep_raw=True)
    stream_sanitize(spark, f"{base}/in", f"{base}/text", f"{base}/c1").awaitTermination()
    assert read_records(spark, f"{base}/text").count() == records.count() + 1


def test_stream_upkeep(spark):
    base = scratch_dir(spark, "upkeep")

    def batch(*rows):
        full = [(k, "u", t, "h", "s", at) for k, t, at in rows]
        spark.createDataFrame(full, PAGE_CACHE).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(PAGE_CACHE).parquet(f"{base}/in")
        stream_cache_upkeep(
            stream, f"{base}/cache", f"{base}/checkpoint", PAGE_CACHE, now=100
        ).awaitTermination()
        table = live_entries(read_log(spark, f"{base}/cache", PAGE_CACHE), 100)
        return sorted((r["cache_key"], r["title"]) for r in table.collect())

    assert batch(("a", "1", 0), ("b", "1", 99), ("c", "1", 200)) == [("a", "1"), ("c", "1")]
    assert batch(("a", "2", 300), ("d", "1", 100)) == [("a", "2"), ("c", "1"), ("d", "1")]


def test_scratch_dir_is_shared(spark):
    assert scratch_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_page_key_matches_cache(spark):
    row = inputs.page_cache(spark, SF).select("cache_key", page_key(F.col("url")).alias("k")).first()
    assert row["cache_key"] == row["k"]
