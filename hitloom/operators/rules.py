"""Extraction rules: one row per engine says where hits stand in its result pages."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """Selectors of one engine. A new engine is a new rule passed to the operators.

    A selector is a descendant chain of simple selectors: tag, ``#id``, ``.class``,
    ``[attr]``, ``[attr='v']``. The URL and the thumbnail come from the first match,
    the texts from all matches.
    """

    name: str
    rank: int
    container: str
    url: str
    title: str
    snippet: str = ""
    thumbnail: str = ""
    date: str = ""
    require_host: bool = False
    skip_class: str = ""
    origin: str = ""


# The selectors of the four built-in engines, in registration order.
DEFAULT_RULES = (
    Rule(
        name="brave", rank=1, container="div.snippet", url="a[href]", title="div.title",
        snippet="div.content", thumbnail="a.thumbnail img", date="span.t-secondary",
        require_host=True,
    ),
    Rule(
        name="duckduckgo", rank=2, container="div#links div.web-result", url="h2 a",
        title="h2 a", snippet="a.result__snippet", skip_class="result--ad",
    ),
    Rule(
        name="brave-news", rank=3, container="div[data-type='news']",
        url="a.result-header[href]", title="span.snippet-title", snippet="p.desc",
        thumbnail="div.image-wrapper img",
    ),
    Rule(
        name="bingnews", rank=4, container="div.newsitem", url="a.title[href]",
        title="a.title[href]", snippet="div.snippet", thumbnail="a.imagelink img",
        origin="https://www.bing.com",
    ),
)

DEFAULT_ENGINES = ("brave", "duckduckgo")


def engine_names(rules=DEFAULT_RULES) -> list[str]:
    """Names in registration order."""
    return [r.name for r in sorted(rules, key=lambda r: r.rank)]
