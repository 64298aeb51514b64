"""Row helper of the hit extraction: one result page in, its hit containers out."""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

from hitloom.operators.rules import Rule

# Elements without content, and elements whose content is no markup.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li "
    "main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SCOPES = frozenset("button caption html marquee object table td template th".split())
# A start tag that ends open elements: which ones, and what hides them from it.
ENDS = {tag: (("p",), SCOPES) for tag in BLOCKS} | {
    "a": (("a",), SCOPES),
    "li": (("li",), SCOPES | {"ul", "ol"}),
    "dt": (("dt", "dd"), SCOPES | {"dl"}),
    "dd": (("dt", "dd"), SCOPES | {"dl"}),
    "option": (("option",), frozenset({"select"})),
    "tr": (("tr",), frozenset({"table"})),
    "td": (("td", "th"), frozenset({"tr", "table"})),
    "th": (("td", "th"), frozenset({"tr", "table"})),
}
RAW_TEXT = frozenset(
    "script style textarea title xmp iframe noembed noframes noscript".split()
)

TAG_NAME = re.compile(r"<(/?)([a-z][^\s/>]*)", re.I)
TAG_END = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""", re.S)
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW_TEXT}
ATTRIBUTE = re.compile(
    r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]*)))?""", re.S
)
SIMPLE = re.compile(
    r"""(?P<tag>^[A-Za-z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)"""
    r"""|\[(?P<attr>[\w-]+)(?:=['"]?(?P<val>[^'"\]]*)['"]?)?\]"""
)
FIELDS = ("url", "title", "snippet", "thumbnail", "date")
FIELD_ATTRIBUTE = {"url": "href", "thumbnail": "src"}


class _Element:
    """An open tag; its attributes are read only when a selector asks for them."""

    __slots__ = ("tag", "text", "_attrs")

    def __init__(self, tag: str, text: str):
        self.tag, self.text, self._attrs = tag, text, None

    @property
    def attrs(self) -> dict:
        if self._attrs is None:
            self._attrs = {}
            for name, double, single, bare in ATTRIBUTE.findall(self.text):
                self._attrs.setdefault(name.lower(), unescape(double or single or bare))
        return self._attrs

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def fits(self, tests: list[dict]) -> bool:
        for t in tests:
            if t["tag"] and t["tag"].lower() != self.tag:
                return False
            if t["id"] and self.attrs.get("id") != t["id"]:
                return False
            if t["cls"] and t["cls"] not in self.classes:
                return False
            if t["attr"] and t["attr"] not in self.attrs:
                return False
            if t["val"] is not None and self.attrs[t["attr"]] != t["val"]:
                return False
        return True


@lru_cache(maxsize=256)
def _selectors(rule: Rule):
    """(container, fields) with every selector as a list of tests, one per step."""

    def steps(selector):
        return [[m.groupdict() for m in SIMPLE.finditer(p)] for p in selector.split()]

    fields = [(f, steps(getattr(rule, f))) for f in FIELDS if getattr(rule, f)]
    return steps(rule.container), fields


def _matches(stack: list[_Element], steps: list) -> bool:
    """The newest element fits the last step, its ancestors the steps before."""
    if not stack[-1].fits(steps[-1]):
        return False
    at = len(stack) - 2
    for tests in reversed(steps[:-1]):
        while at >= 0 and not stack[at].fits(tests):
            at -= 1
        if at < 0:
            return False
        at -= 1
    return True


def _tokens(html: str):
    """(start, end, closing slash, tag, attributes) of each piece of markup, in one scan.

    Comments, declarations and elements of raw text have no tag here. An open comment
    runs to the end of the page; a raw-text element that is never closed is an ordinary
    tag, and its closing tag is looked for once.
    """
    at, unclosed = 0, set()
    while (start := html.find("<", at)) >= 0:
        if html.startswith("<!--", start):
            stop = html.find("-->", start + 4)
            at = stop + 3 if stop >= 0 else len(html)
            yield start, at, None, None, None
            continue
        name = TAG_NAME.match(html, start)
        stop = html.find(">", start)
        if stop < 0:
            return
        if name is None:
            at = start + 1
            if html[at] in "!?":
                at = stop + 1
                yield start, at, None, None, None
            continue
        closing, tag = name[1], name[2].lower()
        if not closing and tag in RAW_TEXT and tag not in unclosed:
            end = RAW_END[tag].search(html, stop + 1)
            if end:
                at = end.end()
                yield start, at, None, None, None
                continue
            unclosed.add(tag)
        quoted = TAG_END.match(html, name.end())
        at = quoted.end() if quoted else stop + 1
        yield start, at, closing, tag, html[name.end() : at - 1]


def _open_at(places: dict, tags, hidden_by) -> int | None:
    """Place of the nearest open element among ``tags``, none beyond ``hidden_by``."""
    nearest = max((places[t][-1] for t in tags if places.get(t)), default=None)
    if nearest is None:
        return None
    hidden = max((places[t][-1] for t in hidden_by if places.get(t)), default=-1)
    return nearest if nearest >= hidden else None


def _raw_hits(html: str, rule: Rule) -> list[dict]:
    """One walk over the tags with the open elements, open hits and open texts."""
    container, fields = _selectors(rule)
    stack, open_hits, open_texts, hits = [], [], [], []
    places = {}  # of the open elements, by name

    def close_from(depth):
        for element in stack[depth:]:
            places[element.tag].pop()
        del stack[depth:]
        while open_hits and open_hits[-1][0] > depth:
            open_hits.pop()
        while open_texts and open_texts[-1][0] > depth:
            open_texts.pop()

    at = 0
    for start, end, closing, tag, attr_text in _tokens(html):
        if open_texts and start > at:
            text = unescape(html[at:start])
            for _, pieces in open_texts:
                pieces.append(text)
        at = end
        if tag is None:
            continue
        if closing:
            found = _open_at(places, (tag,), SCOPES if tag in BLOCKS else BLOCKS)
            if found is not None:
                close_from(found)
            continue
        if tag in ENDS:
            found = _open_at(places, *ENDS[tag])
            if found is not None:
                close_from(found)
        element = _Element(tag, attr_text)
        places.setdefault(tag, []).append(len(stack))
        stack.append(element)
        depth = len(stack)
        if open_hits:
            for field, steps in fields:
                if not _matches(stack, steps):
                    continue
                for _, hit in open_hits:
                    if field in FIELD_ATTRIBUTE:
                        hit[field].append(element.attrs.get(FIELD_ATTRIBUTE[field], ""))
                    else:
                        open_texts.append((depth, hit[field]))
        if _matches(stack, container):
            hit = {"classes": element.classes, **{f: [] for f in FIELDS}}
            hits.append(hit)
            open_hits.append((depth, hit))
        if tag in VOID:
            close_from(depth - 1)
    if open_texts:
        for _, pieces in open_texts:
            pieces.append(unescape(html[at:]))
    return hits


def page_hits(html: str | None, rule: Rule | None) -> list[dict]:
    """Hit containers of a page in document order."""
    if not html or rule is None:
        return []
    return [
        {
            "url": (hit["url"] or [""])[0],
            "title": "".join(hit["title"]),
            "snippet": "".join(hit["snippet"]),
            "thumbnail": (hit["thumbnail"] or [""])[0],
            "date_text": "".join(hit["date"]),
            "classes": hit["classes"],
        }
        for hit in _raw_hits(html, rule)
    ]
