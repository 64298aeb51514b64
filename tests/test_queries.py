"""Every registered query against its SQL; the plans that must stay narrow."""

import re

import pytest
from compare import connect, difference

import __spark_entry__ as entry_points
from hitloom.operators.attach import pick_snapshot
from hitloom.operators.merge import merge_hits, rank_results, within_page_limit
from hitloom.plans import inputs
from hitloom.plans.run import attach_text, run_search, search_pages
from hitloom.schemas import RESULT_PAGE
from hitloom.sources.tables import read_result_pages, save_result_pages, save_snapshots

SF = "/root/testdata/sf0.001"
QUERIES = {
    name: query for name, query in entry_points.queries().items() if name not in entry_points.LLM_QUERIES
}
ORACLE = {name: sql for name, sql in entry_points.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, ORACLE[name]) == ""


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.fixture
def stored(spark, tmp_path):
    """The derived inputs as parquet, with broadcast joins off, as large tables would be."""
    tables = {}
    for name in ("hits", "result_pages", "snapshots"):
        getattr(inputs, name)(spark, SF).write.parquet(str(tmp_path / name))
        tables[name] = spark.read.parquet(str(tmp_path / name))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield tables
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_page_limit_reaches_the_scan(stored):
    plan = plan_of(merge_hits(within_page_limit(stored["hits"], 20)))
    assert "LessThanOrEqual(page,2)" in plan


def test_ranking_cuts_before_the_shuffle(stored):
    plan = plan_of(rank_results(merge_hits(stored["hits"]), 20))
    assert re.search(r"WindowGroupLimit.*Partial", plan)
    # The count pass reads the keys only.
    scans = re.findall(r"FileScan parquet \[(.*?)\]", plan)
    assert sorted(len(s.split(",")) for s in scans) == [2, 10]


def test_pages_are_parsed_once(stored):
    ranked = plan_of(search_pages(stored["result_pages"], 20))
    assert len(re.findall(r"ArrowEvalPython", ranked)) == 1
    # The answer starts from the stored ranking: it parses nothing again.
    plan = plan_of(run_search(stored["result_pages"], stored["snapshots"], 20))
    assert "ArrowEvalPython" not in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_only_wanted_bodies_are_extracted(stored):
    """No extraction stands below the semi-join with the wanted URLs."""
    plan = run_search(stored["result_pages"], stored["snapshots"], 20)._jdf.queryExecution().executedPlan().toString()
    lines = [line for line in plan.splitlines() if "LeftSemi" in line or "content_md" in line and "Project" in line]
    semi = next(i for i, line in enumerate(lines) if "LeftSemi" in line)
    assert semi > 0 and not any("regexp" in line for line in lines[semi + 1 :])


def test_bodies_do_not_reach_the_join(spark, stored):
    """Between the scan of the bodies and the join, no shuffle carries raw HTML."""
    records = inputs.page_records(spark, SF).drop("page_id", "raw_html", "content_md")
    records = records.selectExpr("*", "cast(null as string) raw_html", "cast(null as string) content_md")
    join = attach_text(records, stored["snapshots"])._jdf.queryExecution().executedPlan()
    for line in join.treeString().splitlines():
        if "Exchange" in line:
            assert "raw_html" not in line
    exchanges = [
        node for node in re.findall(r"Exchange hashpartitioning\(_key[^)]*\)", join.toString())
    ]
    assert len(exchanges) == 2


def test_losing_captures_do_not_move(spark, tmp_path):
    """Bodies meet the winners where they are read; bucketed ones stay where they are."""
    inputs.captures(spark, SF).write.parquet(str(tmp_path / "captures"))
    captures = spark.read.parquet(str(tmp_path / "captures"))
    plan = pick_snapshot(captures)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    top, join = plan.index("Exchange hashpartitioning(url"), plan.index("LeftSemi")
    assert top < join and plan[join:].count("Exchange hashpartitioning") == 1
    scans = sorted(len(s.split(",")) for s in re.findall(r"FileScan parquet \[(.*?)\]", plan))
    assert scans == [3, 5]  # the winners come from the narrow columns

    save_snapshots(captures, "captures_by_url", 4)
    stored = pick_snapshot(spark.table("captures_by_url"), broadcast_urls=0)
    assert "Exchange" not in stored._jdf.queryExecution().executedPlan().toString()
    assert sorted(stored.collect()) == sorted(pick_snapshot(captures).collect())
    spark.sql("drop table captures_by_url")


def test_stored_pages_beyond_the_limit_are_not_listed(spark, tmp_path):
    path = str(tmp_path / "pages")
    save_result_pages(inputs.result_pages(spark, SF), path)
    save_result_pages(inputs.result_pages(spark, SF).limit(0), path)
    pages = read_result_pages(spark, path)
    assert pages.schema == RESULT_PAGE
    near = within_page_limit(pages, 20)
    assert re.search(r"PartitionFilters: \[.*page#\d+ <= 2", plan_of(near))
    assert near.exceptAll(within_page_limit(inputs.result_pages(spark, SF), 20)).count() == 0


def test_each_query_has_its_own_limit(spark, stored):
    """The plan with limits per query gives each query what it gets when asked alone."""
    as_of = inputs.as_of()
    ids = [r[0] for r in stored["result_pages"].select("query_id").distinct().orderBy("query_id").limit(6).collect()]
    limits = {q: [3, 12, None, 0, 45, 7][i] for i, q in enumerate(ids)}
    queries = spark.createDataFrame(list(limits.items()), "query_id bigint, limit int")
    names = ["query_id", "rank", "total", "url", "title", "content_md"]
    got = run_search(stored["result_pages"], stored["snapshots"], as_of=as_of, queries=queries).select(names).collect()
    want = []
    for limit in {limit or 20 for limit in limits.values()}:
        rows = run_search(stored["result_pages"], stored["snapshots"], limit, as_of=as_of).select(names).collect()
        want += [r for r in rows if r.query_id in limits and (limits[r.query_id] or 20) == limit]
    assert sorted(map(str, got)) == sorted(map(str, want)) and got
