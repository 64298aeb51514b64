"""The whole plan with both caches: what is read, parsed and given back."""

import pytest

from hitloom.plans import inputs
from hitloom.plans.run import answer_queries, run_search
from hitloom.schemas import PAGE_CACHE, RESULT_CACHE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base, found = tmp_path_factory.mktemp("answer"), {}
    for name in ("page_queries", "result_pages", "snapshots", "answered_before", "page_cache"):
        getattr(inputs, name)(spark, SF).write.parquet(str(base / name))
        found[name] = spark.read.parquet(str(base / name))
    return found


def run(tables, **more):
    own = {**tables, **{k: more.pop(k) for k in list(more) if k in tables}}
    return answer_queries(*own.values(), inputs.NOW, as_of=inputs.as_of(), **more)


NAMES = ["query_id", "rank", "total", "url", "title", "cached", "content_md", "error"]


def rows(df, names=NAMES):
    return sorted(map(str, df.select(*names).collect()))


def test_without_caches_it_is_the_plain_search(spark, tables):
    empty = spark.createDataFrame([], RESULT_CACHE), spark.createDataFrame([], PAGE_CACHE)
    asked = tables["page_queries"].where("query_id % 9 <> 4")
    plain = run_search(tables["result_pages"], tables["snapshots"], as_of=inputs.as_of(), queries=asked)
    got = run(tables, page_queries=asked, answered_before=empty[0], page_cache=empty[1])
    assert rows(got.records) == rows(plain)
    off = run(tables, page_queries=asked, use_cache=False)
    assert rows(off.records) == rows(plain)
    assert off.result_entries.isEmpty() and off.page_entries.isEmpty()
    refreshed = run(tables, page_queries=asked, refresh=True)
    assert rows(refreshed.records) == rows(plain) and not refreshed.result_entries.isEmpty()


def test_what_is_given_back_answers_the_next_search(spark, tables):
    first = run(tables)
    entries = tables["answered_before"].unionByName(first.result_entries)
    pages = tables["page_cache"].unionByName(first.page_entries)
    again = run(tables, answered_before=entries, page_cache=pages)
    assert again.result_entries.isEmpty() and again.page_entries.isEmpty()
    assert {r.cached for r in again.records.collect()} == {True}
    keys = ["query_id", "rank", "url", "content_md"]
    assert rows(again.records.where("error is null"), keys) == rows(first.records.where("error is null"), keys)
    assert rows(again.warnings, again.warnings.columns) == rows(first.warnings, first.warnings.columns)


def test_stored_parse_serves_all_outputs(tables):
    got = run(tables)
    for output in got:
        plan = output._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" not in plan and "CartesianProduct" not in plan
    warned = got.warnings._jdf.queryExecution().executedPlan().toString()
    assert "html" not in warned and "answered_before" not in warned


def test_no_queries(spark, tables):
    got = run(tables, page_queries=tables["page_queries"].limit(0))
    assert all(output.isEmpty() for output in got)


def test_default_limit(tables):
    asked = tables["page_queries"].drop("limit")
    got = run(tables, page_queries=asked, use_cache=False).records.groupBy("query_id").count().collect()
    assert 0 < max(r["count"] for r in got) <= 20
