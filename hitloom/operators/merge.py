"""Merge duplicate hits, score them, rank them, cut to the best per query."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitloom.functions.lookups import literal_map
from hitloom.functions.text import longest_of
from hitloom.functions.urls import normalize_url
from hitloom.operators.rules import DEFAULT_RULES, engine_names

DEFAULT_LIMIT = 20
PAGE_SIZE = 10
MAX_PAGES = 5
SALTS = 1024


def union_hits(*batches: DataFrame) -> DataFrame:
    """All page batches as one table; the seen order is a column, not the row order."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)


def seen_order(engines=None) -> Column:
    """First-seen order as one LONG: page, then engine rank, then position.

    An engine outside ``engines`` stops the job, as an unknown engine name does.
    """
    names = list(engines or engine_names(DEFAULT_RULES))
    ranks = literal_map({name: at + 1 for at, name in enumerate(names)})
    rank = F.try_element_at(ranks, F.col("engine"))
    unknown = F.raise_error(F.concat(F.lit("unknown engine "), F.col("engine")))
    rank = F.coalesce(rank, unknown.cast("int")).cast("long")
    return (
        F.shiftleft(F.col("page").cast("long"), 40)
        + F.shiftleft(rank, 28)
        + F.coalesce(F.col("position"), F.lit(0)).cast("long")
    )


def score(position: Column) -> Column:
    """Aggregate: number of positions times the sum of their inverses; none scores 0."""
    inverse = F.sum(F.lit(1.0) / position)
    return F.coalesce(F.count(position) * inverse, F.lit(0.0))


def merge_hits(hits: DataFrame, engines=None) -> DataFrame:
    """One row per query and normalized URL.

    URL, thumbnail, date and cached flag come from the first-seen hit, title and
    snippet are the longest ones, engines keep first-seen order. Every buffer has a
    fixed width (engines: one minimum per registered name), so the whole aggregate
    combines on the map side and a hot URL reaches its task as a few partial rows.
    """
    names = list(engines or engine_names(DEFAULT_RULES))
    o = F.col("_ord")
    firsts = {name: F.min(F.when(F.col("engine") == name, o)) for name in names}
    keyed = hits.select(
        "query_id",
        normalize_url(F.col("url")).alias("url_key"),
        "engine",
        "position",
        seen_order(names).alias("_ord"),
        "url",
        "title",
        "snippet",
        "thumbnail",
        "published",
        "cached",
    )
    merged = keyed.groupBy("query_id", "url_key").agg(
        F.min(F.struct("_ord", "url", "thumbnail", "published", "cached")).alias("first"),
        longest_of(F.col("title"), o).alias("title"),
        longest_of(F.col("snippet"), o).alias("snippet"),
        score(F.col("position")).alias("score"),
        F.count("position").alias("n_hits"),
        *[m.alias(f"_e{at}") for at, m in enumerate(firsts.values())],
    )
    seen = F.array(
        *[
            F.when(
                F.col(f"_e{at}").isNotNull(),
                F.struct(F.col(f"_e{at}").alias("o"), F.lit(name).alias("engine")),
            )
            for at, name in enumerate(names)
        ]
    )
    ordered = F.array_sort(F.filter(seen, lambda e: e.isNotNull()))
    return merged.select(
        "query_id",
        "url_key",
        F.col("first.url").alias("url"),
        "title",
        "snippet",
        F.col("first.thumbnail").alias("thumbnail"),
        F.col("first.published").alias("published"),
        F.col("first.cached").alias("cached"),
        F.transform(ordered, lambda e: e["engine"]).alias("engines"),
        "n_hits",
        "score",
        F.col("first._ord").alias("first_seen"),
    )


def position_lists(hits: DataFrame, engines=None) -> DataFrame:
    """Positions of each merged result in first-seen order, as runs ``(position, n)``.

    Equal slots are counted before anything is collected, so the list is as long as
    the number of distinct (page, engine, position) slots, whatever the row count.
    """
    slots = (
        hits.filter(F.col("position").isNotNull())
        .select(
            "query_id",
            normalize_url(F.col("url")).alias("url_key"),
            seen_order(engines).alias("o"),
            "position",
        )
        .groupBy("query_id", "url_key", "o", "position")
        .agg(F.count("*").alias("n"))
    )
    runs = F.array_sort(F.collect_list(F.struct("o", "position", "n")))
    return slots.groupBy("query_id", "url_key").agg(
        F.transform(runs, lambda r: F.struct(r["position"], r["n"])).alias("positions")
    )


def result_order() -> list[Column]:
    """Score, then number of engines, then first seen. Sums are compared to nine digits."""
    return [
        F.round("score", 9).desc(),
        F.size("engines").desc(),
        F.col("first_seen").asc(),
        F.col("url_key").asc(),
    ]


def _best(rows: DataFrame, k: int, *more: str, name: str = "rank") -> DataFrame:
    w = Window.partitionBy("query_id", *more).orderBy(*result_order())
    return rows.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def rank_results(
    merged: DataFrame, limit: int = DEFAULT_LIMIT, total: str = "recount"
) -> DataFrame:
    """Best ``limit`` results per query with ``rank``, and ``total`` before the cut.

    The numbered filter becomes a group limit ahead of the shuffle: a map task sends
    at most ``limit`` rows per query, so a hot query stays small. A window count
    would bring every row of a query into one task, so the total is taken

    - ``recount``: from a second pass that reads the keys only and combines on the
      map side; for hits that are stored;
    - ``salted``: in the same pass, counting and cutting each of ``SALTS`` slices of
      a query before the slices meet; for hits that are costly to produce twice;
    - ``none``: not at all.
    """
    k = limit if limit > 0 else DEFAULT_LIMIT
    if total == "none":
        return _best(merged, k)
    if total == "recount":
        totals = merged.groupBy("query_id").agg(F.count("*").alias("total"))
        return _best(merged, k).join(totals, "query_id")
    if total != "salted":
        raise ValueError(f"unknown total {total!r}")
    sliced = merged.withColumn("_salt", F.pmod(F.xxhash64("url_key"), F.lit(SALTS)))
    size = F.count("*").over(Window.partitionBy("query_id", "_salt"))
    cut = _best(sliced.withColumn("_size", size), k, "_salt", name="_at")
    # The first row of a slice stands for the slice: its size counts once.
    whole = F.sum(F.when(F.col("_at") == 1, F.col("_size"))).over(Window.partitionBy("query_id"))
    ranked = _best(cut.withColumn("total", whole), k)
    return ranked.drop("_salt", "_size", "_at")


def within_query_limits(
    ranked: DataFrame, queries: DataFrame, upper: int = DEFAULT_LIMIT
) -> DataFrame:
    """Keep of each query the rows its own ``limit`` asks for.

    ``queries`` has query_id and limit (null or not positive: the default).
    ``ranked`` was cut at ``upper``; a query that asks for more stops the job, so
    nothing is lost unseen.
    """
    asked = F.when(F.col("limit") > 0, F.col("limit")).otherwise(DEFAULT_LIMIT)
    message = F.concat(F.lit("limit above the cut at "), F.lit(upper))
    checked = F.when(asked > upper, F.raise_error(message).cast("int")).otherwise(asked)
    limits = queries.select("query_id", checked.alias("_limit"))
    kept = ranked.join(limits, "query_id").filter(F.col("rank") <= F.col("_limit"))
    return kept.drop("_limit")


def pages_for_limit(limit: Column) -> Column:
    """Pages to read per engine: ten results a page, between one and five pages."""
    wanted = F.when(limit > 0, limit).otherwise(DEFAULT_LIMIT)
    pages = F.ceil(wanted / F.lit(float(PAGE_SIZE))).cast("int")
    return F.least(F.greatest(pages, F.lit(1)), F.lit(MAX_PAGES))


def within_page_limit(hits: DataFrame, limit: int | Column = DEFAULT_LIMIT) -> DataFrame:
    """Drop the pages a limit does not ask for; a filter the scan can take."""
    value = F.lit(limit) if isinstance(limit, int) else limit
    return hits.filter(F.col("page") <= pages_for_limit(value))
