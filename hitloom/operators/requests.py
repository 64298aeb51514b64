"""Request planning: which engine pages a table of queries asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitloom.functions.keys import result_key
from hitloom.functions.lookups import (
    literal_map,
    map_locale,
    safesearch_name,
    time_range_code,
)
from hitloom.functions.text import quote_bangs
from hitloom.functions.urls import query_escape
from hitloom.operators.merge import pages_for_limit
from hitloom.operators.rules import DEFAULT_ENGINES, DEFAULT_RULES, engine_names

MAX_QUERY_BYTES = 499
BRAVE_LAST_PAGE = 10


def engine_list(names: Column) -> Column:
    """A comma list, trimmed, blanks dropped; null or blank gives the two defaults."""
    parts = F.filter(
        F.transform(F.split(names, ","), lambda n: F.trim(n, F.lit(" \t\r\n"))),
        lambda n: n != "",
    )
    default = F.array(*[F.lit(n) for n in DEFAULT_ENGINES])
    blank = names.isNull() | (names == "")
    return F.when(blank, default).otherwise(parts)


def select_engines(queries: DataFrame, rules=DEFAULT_RULES) -> DataFrame:
    """One row per query and listed engine with ``engine`` and ``engine_at`` (1-based).

    A list that names nothing (", ,") means every engine; a name listed twice is
    kept twice; an unknown name stops the job.
    """
    known = engine_names(rules)
    every = F.array(*[F.lit(n) for n in known])
    listed = engine_list(F.col("engines"))
    chosen = F.when(F.size(listed) == 0, every).otherwise(listed)
    rows = queries.select(
        *[c for c in queries.columns if c != "engines"],
        F.posexplode(chosen).alias("at", "name"),
    )
    message = F.concat(
        F.lit("unknown engine "), F.col("name"), F.lit(f" (available: {', '.join(known)})")
    )
    checked = F.when(F.col("name").isin(known), F.col("name")).otherwise(F.raise_error(message))
    return rows.withColumn("engine", checked).withColumn(
        "engine_at", (F.col("at") + 1).cast("int")
    ).drop("at", "name")


def engine_ranks(rules=DEFAULT_RULES) -> Column:
    """Registration order of ``engine`` as a literal lookup."""
    ranks = {name: at + 1 for at, name in enumerate(engine_names(rules))}
    return F.try_element_at(literal_map(ranks), F.col("engine"))


def _request_url() -> Column:
    engine, page, code = F.col("engine"), F.col("page"), F.col("time_code")
    q = F.col("_q")
    brave = F.concat(
        F.lit("https://search.brave.com/search?q="), q, F.lit("&source=web"),
        F.when(page > 1, F.concat(F.lit("&offset="), (page - 1).cast("string"))).otherwise(""),
        F.when(code != "", F.concat(F.lit("&tf="), code)).otherwise(""),
    )
    news = F.concat(F.lit("https://search.brave.com/news?q="), q, F.lit("&source=web"))
    bing = F.concat(
        F.lit("https://www.bing.com/news/infinitescrollajax?q="), q,
        F.lit("&InfiniteScroll=1&first="), ((page - 1) * 10 + 1).cast("string"),
        F.lit("&SFX="), (page - 1).cast("string"), F.lit("&form=PTFTNR"),
        F.when(code != "", F.concat(F.lit('&qft=interval="'), code, F.lit('"'))).otherwise(""),
        F.when(
            F.col("locale") != "", F.concat(F.lit("&mkt="), query_escape(F.col("locale")))
        ).otherwise(""),
    )
    return (
        F.when(engine == "brave", brave)
        .when(engine == "brave-news", news)
        .when(engine == "bingnews", bing)
        .when(engine == "duckduckgo", F.lit("https://html.duckduckgo.com/html/"))
    )


def _request_form() -> Column:
    """Form body of a duckduckgo request; a later page still needs the session token."""
    page = F.col("page")
    q = F.col("_banged")
    start = F.lit(10) + (page - 2) * 15
    first = F.concat(
        F.lit("b=&df="), F.col("time_code"), F.lit("&kl="), F.col("kl"), F.lit("&q="), q
    )
    later = F.concat(
        F.lit("api=d.js&dc="), (start + 1).cast("string"),
        F.lit("&df="), F.col("time_code"), F.lit("&kl="), F.col("kl"),
        F.lit("&nextParams=&o=json&q="), q,
        F.lit("&s="), start.cast("string"), F.lit("&v=l"),
    )
    return F.when(F.col("engine") == "duckduckgo", F.when(page <= 1, first).otherwise(later))


def plan_requests(queries: DataFrame, rules=DEFAULT_RULES) -> DataFrame:
    """The task grid of every query: pages times engines, with URL, form and cache key.

    ``queries`` has query_id, query, engines, time_range, safesearch, locale, limit
    (each null means its default). A query too long for duckduckgo gives one row
    with ``error`` and no URL. ``seq`` is the page-major order. Two explodes, no join;
    the query is escaped once, before it is multiplied.
    """
    known = {f.name: f.dataType.simpleString() for f in queries.schema}
    defaults = {
        "engines": F.lit(None).cast("string"),
        "time_range": F.lit(""),
        "safesearch": F.lit(0),
        "locale": F.lit(""),
        "limit": F.lit(0),
    }
    filled = queries.select(
        "query_id",
        "query",
        *[
            (F.coalesce(F.col(n), d) if n in known else d).alias(n)
            for n, d in defaults.items()
        ],
        query_escape(F.col("query")).alias("_q"),
        query_escape(quote_bangs(F.col("query"))).alias("_banged"),
    )
    grid = (
        select_engines(filled, rules)
        .withColumn("page", F.explode(F.sequence(F.lit(1), pages_for_limit(F.col("limit")))))
        .filter((F.col("engine") != "brave") | (F.col("page") <= BRAVE_LAST_PAGE))
    )
    too_long = (F.col("engine") == "duckduckgo") & (F.octet_length("query") > MAX_QUERY_BYTES)
    locale = map_locale(F.col("locale"))
    coded = grid.select(
        "*",
        time_range_code(F.col("engine"), F.col("time_range")).alias("time_code"),
        locale["country"].alias("country"),
        locale["ui_lang"].alias("ui_lang"),
        locale["kl"].alias("kl"),
        F.when(
            too_long, F.lit(f"duckduckgo: query too long (max {MAX_QUERY_BYTES} characters)")
        ).alias("error"),
    )
    ok = F.col("error").isNull()
    return coded.select(
        "query_id",
        "engine",
        "page",
        F.struct("page", "engine_at").alias("seq"),
        F.when(ok, _request_url()).alias("url"),
        F.when(ok, _request_form()).alias("form"),
        "country",
        "ui_lang",
        "kl",
        safesearch_name(F.col("safesearch")).alias("safesearch"),
        result_key(
            F.col("engine"), F.col("query"), F.col("time_range"), F.col("safesearch"),
            F.col("locale"), F.col("page"),
        ).alias("cache_key"),
        "error",
    )
