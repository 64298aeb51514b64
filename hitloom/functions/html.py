"""Main text, blocks and metadata of a page, by built-in functions in linear time.

A page is cut into pieces once: comments, elements whose content is no markup, tags, texts.
One fold over the few tags that open or end a region says which pieces count; these are
rendered piece by piece.  No pattern runs past the next ``<`` unless it takes what it ran over.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hitloom.functions.text import decode_entities, let, trim_space, truncate_text

# Elements that never hold main text, and those among them whose content is no markup.
DROPPED_ELEMENTS = "template svg head nav footer aside form button select".split()
RAW_ELEMENTS = "script style noscript iframe title".split()
# Elements whose end also ends what was left open inside them.
CONTAINERS = "html body main article section div header table ul ol dl blockquote figure details fieldset".split()
# Elements that start a line.
BLOCK_ELEMENTS = (
    "p|div|h[1-6]|ul|ol|li|dl|dt|dd|table|caption|tr|article|section|main|header|"
    "blockquote|pre|figure|figcaption|br|hr|nav|footer|aside|form"
)
# A tag stops before the next "<"; a quoted value may hold ">".
_TAG = r"""<[a-zA-Z/!?](?:[^<>"']*+(?:"[^"<]*+"|'[^'<]*+'){0,1}+){0,64}+>|<[a-zA-Z/!?][^<>]*+>"""
PIECE = (
    r"(?s)<!--.*?(?:-->|\z)|(?i:<(" + "|".join(RAW_ELEMENTS) + r")\b[^<>]*+>.*?(?:</\1\s*+>|\z))|"
    + _TAG + r"|[^<]++|<"
)
_STRUCTURE = r"(?i)^</?(?:" + "|".join(DROPPED_ELEMENTS + CONTAINERS) + r")\b"
_NAME = "^</?([a-zA-Z][a-zA-Z0-9]*)"
_DROPS = r"(?i)^<(?:" + "|".join(DROPPED_ELEMENTS) + r")\b(?!.*/>$)"
# A block whose class says advertisement.
_ADVERT = r"""(?is)^<div\b.*\sclass\s*=\s*(?:"(?:[^"]*\s)?(?:ad|ads|advert)(?:\s[^"]*)?"|'(?:[^']*\s)?(?:ad|ads|advert)(?:\s[^']*)?'|(?:ad|ads|advert)[\s>])"""
_MARKUP = r"^<[a-zA-Z/!?]"
_BLOCK = rf"(?i)^</?(?:{BLOCK_ELEMENTS})\b"
_CELL = r"(?i)^</?t[dh]\b"
BLANKS = r"[ \t\r\f\x{00A0}]{2,}|[\t\r\f\x{00A0}]"
LINE_EDGES = r" ?\n[ \n]*+"
TAG = r"<[^<>]*+>"

# Characters no page may hold, as marks of structure: start of a block's kind, its end, a cell,
# the start of a link's target, the start of its text, its end.
_KIND, _KIND_END, _CELL_MARK, _LINK, _LINK_TEXT, _LINK_END = "\x01\x02\x03\x04\x05\x06"
_MARKS = _KIND + _KIND_END + _CELL_MARK + _LINK + _LINK_TEXT + _LINK_END
BLOCK = "struct<kind:string,text:string,cells:array<string>,links:array<struct<text:string,url:string>>>"
#: What a block's start tag says of its kind; all others are paragraphs.
KINDS = "h[1-6] li tr blockquote pre caption d[td]".split()

# The first such element; one that is never closed has no text, and is looked through once.
TITLE = r"(?is)<title\b[^<>]*+>(?:(.*?)</title\s*+>|.*\z)"
HEADING = r"(?is)<h1\b[^<>]*+>(?:(.*?)</h1\s*+>|.*\z)"
# Names of metadata that hold a publication date.
DATE_NAMES = "article:published_time datepublished date pubdate publish_date dc.date".split()
META_TAGS = r"(?is)<meta\b[^<>]*+>"
TIME_TAGS = r"(?is)<time\b[^<>]*+>"
JSON_LD = r"(?is)<script\b[^<>]*application/ld\+json[^<>]*+>([^<]*+)<"
JSON_DATE = r'"datePublished"\s*:\s*"([^"]*)"'
ISO_DAY = r"^\s*([0-9]{4}-[0-9]{2}-[0-9]{2})"


_RANGE = "struct<pieces:int,part:int>"
_DROPPED, _PAGE, _ARTICLE = 0, 1, 2
_RUN = 128


def _parts(pieces: Column) -> Column:
    """For each piece whether it is dropped, of the page, or in an article.

    A dropped element ends with its own end tag, the nesting of its name counted, or where
    an element around it ends; one that is never closed takes the rest.
    """
    numbered = F.transform(pieces, lambda p, i: F.struct(i.alias("at"), p.alias("p")))
    marks = F.transform(
        F.filter(numbered, lambda x: x["p"].rlike(_STRUCTURE)),
        lambda x: F.struct(
            x["at"].alias("at"),
            F.lower(F.regexp_extract(x["p"], _NAME, 1)).alias("name"),
            x["p"].startswith("</").alias("ends"),
            (x["p"].rlike(_DROPS) | x["p"].rlike(_ADVERT)).alias("drops"),
        ),
    )
    # Ranges follow each other without a gap.  The last ones stand apart, so that adding one
    # copies a short run and not all that were found.
    start = F.struct(
        F.lit("").alias("skip"), F.lit(0).alias("same"), F.lit(0).alias("inner"), F.lit(0).alias("first"),
        F.lit(0).alias("articles"), F.array().cast(f"array<{_RANGE}>").alias("run"),
        F.array().cast(f"array<array<{_RANGE}>>").alias("done"),
    )

    def part(a: Column) -> Column:
        return F.when(a["skip"] != "", _DROPPED).when(a["articles"] > 0, _ARTICLE).otherwise(_PAGE)

    def step(a: Column, m: Column) -> Column:
        inside, same = a["skip"] != "", m["name"] == a["skip"]
        article, container = m["name"] == "article", m["name"].isin(CONTAINERS)
        edge = F.when(m["ends"], F.lit(-1)).otherwise(1)
        # Inside a dropped element: its own tags, those of containers, and what ends it.
        closes = inside & m["ends"] & F.when(same, a["same"] == 1).otherwise(container & (a["inner"] == 0))
        closes = closes | (inside & (a["skip"] == "head") & (m["name"] == "body"))
        opens = ~inside & m["drops"]
        nests = article & (~m["ends"] | (a["articles"] > 0)) & ((~inside & ~m["drops"]) | (closes & m["ends"]))
        articles = F.when(nests, a["articles"] + edge).otherwise(a["articles"])
        cuts = opens | closes | (~inside & nests & F.least(a["articles"], articles).isin(0))

        def told(cut: Column) -> Column:
            grown = F.when(cut, F.concat(a["run"], F.array(F.struct((m["at"] + 1 - a["first"]).alias("pieces"), part(a).alias("part")))))
            return let(
                F.coalesce(grown, a["run"]),
                lambda run: F.struct(
                    F.when(opens, m["name"]).when(closes, "").otherwise(a["skip"]).alias("skip"),
                    F.when(opens, 1).when(inside & same, a["same"] + edge).otherwise(a["same"]).alias("same"),
                    F.when(opens, 0).when(inside & ~same & container, F.greatest(a["inner"] + edge, F.lit(0)))
                    .otherwise(a["inner"]).alias("inner"),
                    F.when(cut, m["at"] + 1).otherwise(a["first"]).alias("first"),
                    articles.alias("articles"),
                    F.when(F.size(run) < _RUN, run).otherwise(F.array().cast(f"array<{_RANGE}>")).alias("run"),
                    F.when(F.size(run) < _RUN, a["done"]).otherwise(F.concat(a["done"], F.array(run))).alias("done"),
                ),
            )

        return let(cuts, told)

    def finish(a: Column) -> Column:
        last = F.struct((F.size(pieces) - a["first"]).alias("pieces"), part(a).alias("part"))
        ranges = F.concat(F.flatten(a["done"]), a["run"], F.array(last))
        return F.flatten(F.transform(ranges, lambda r: F.array_repeat(r["part"], r["pieces"])))

    return F.aggregate(marks, start, step, finish)


def _is_text(piece: Column) -> Column:
    return ~piece.startswith("<") | (piece == "<")


def main_pieces(html: Column) -> Column:
    """The pieces of the main text: those of the articles where any holds text, else of the page."""

    def chosen(pieces: Column) -> Column:
        def pick(parts: Column) -> Column:
            of = lambda least: F.filter(pieces, lambda p, i: F.get(parts, i) >= least)
            has_text = lambda own: F.exists(own, lambda p: _is_text(p) & (trim_space(p) != ""))
            return let(of(_ARTICLE), lambda own: F.when(has_text(own), own).otherwise(of(_PAGE)))

        return let(_parts(pieces), pick)

    return let(F.regexp_extract_all(html, F.lit(PIECE), F.lit(0)), chosen)


def _tidy(text: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(text, BLANKS, " "), LINE_EDGES, "\n")
    return F.trim(text, F.lit(" \n"))


def main_text(html: Column, links: bool = False) -> Column:
    """Readable text: boilerplate dropped, the article preferred, one line per block.

    With ``links`` the blocks are written as Markdown: headings, list items, table rows,
    quotes and links keep their form (see ``render_blocks``).
    """
    if links:
        return render_blocks(text_blocks(html))

    def rendered(p: Column) -> Column:
        return (
            F.when(_is_text(p), p).when(p.rlike(_BLOCK), "\n").when(p.rlike(_CELL), " ").otherwise("")
        )

    return _tidy(decode_entities(F.array_join(F.transform(main_pieces(html), rendered), "")))


def text_blocks(html: Column) -> Column:
    """The main text as array<struct<kind, text, cells, links>>, in document order.

    ``kind`` is ``p``, ``h1`` to ``h6``, ``li``, ``tr``, ``dt``, ``dd``, ``blockquote``,
    ``pre`` or ``caption``; a row of a table has its cells, any block the links inside it.
    """
    clean = F.translate(html, _MARKS, "")

    def rendered(p: Column) -> Column:
        name = F.lower(F.regexp_extract(p, _NAME, 1))
        kind = F.concat(F.lit("\n" + _KIND), name, F.lit(_KIND_END))
        opens = ~p.startswith("</")
        return (
            F.when(_is_text(p), F.regexp_replace(p, r"\n", " "))
            .when(opens & p.rlike(rf"(?i)^<(?:{'|'.join(KINDS)})\b"), kind)
            .when(p.rlike(_BLOCK), "\n")
            .when(opens & p.rlike(_CELL), _CELL_MARK)
            .when(p.rlike(_CELL), " ")
            .when(opens & (name == "a"), F.concat(F.lit(_LINK), _attribute(p, "href"), F.lit(_LINK_TEXT)))
            .when(name == "a", _LINK_END)
            .otherwise("")
        )

    def plain(line: Column) -> Column:
        line = F.regexp_replace(line, rf"{_LINK}[^{_LINK_TEXT}]*+{_LINK_TEXT}|{_LINK_END}", "")
        return F.trim(F.regexp_replace(F.translate(line, _MARKS, " " * len(_MARKS)), r"[ \t\r\f\x{00A0}]+", " "), F.lit(" "))

    def block(line: Column) -> Column:
        kind = F.regexp_extract(line, rf"^{_KIND}([^{_KIND_END}]*+){_KIND_END}", 1)
        body = F.regexp_replace(line, rf"^{_KIND}[^{_KIND_END}]*+{_KIND_END}", "")
        link = rf"{_LINK}([^{_LINK_TEXT}]*+){_LINK_TEXT}([^{_LINK}{_LINK_END}]*+)"
        found = F.arrays_zip(
            F.transform(F.regexp_extract_all(body, F.lit(link), F.lit(2)), plain).alias("text"),
            F.regexp_extract_all(body, F.lit(link), F.lit(1)).alias("url"),
        )
        cells = F.transform(F.split(body, _CELL_MARK), plain)
        return F.struct(
            F.when(kind == "", "p").otherwise(kind).alias("kind"),
            plain(body).alias("text"),
            F.when(kind == "tr", F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))))
            .otherwise(F.array().cast("array<string>")).alias("cells"),
            F.filter(found, lambda x: x["url"] != "").alias("links"),
        )

    lines = F.split(decode_entities(F.array_join(F.transform(main_pieces(clean), rendered), "")), r"\n")
    return F.filter(F.transform(lines, block), lambda b: b["text"] != "").cast(f"array<{BLOCK}>")


def render_blocks(blocks: Column) -> Column:
    """Blocks as Markdown lines; a link is written where its text first stands in its block."""

    def linked(text: Column, links: Column) -> Column:
        start = F.struct(F.lit("").alias("done"), text.alias("rest"))

        def step(a: Column, x: Column) -> Column:
            at = F.instr(a["rest"], x["text"])
            past = F.concat(a["done"], F.left(a["rest"], at - 1), F.lit("["), x["text"], F.lit("]("), x["url"], F.lit(")"))
            rest = F.substring(a["rest"], at + F.length(x["text"]), F.length(a["rest"]))
            found = (at > 0) & (x["text"] != "")
            return F.when(found, F.struct(past.alias("done"), rest.alias("rest"))).otherwise(a)

        return F.aggregate(links, start, step, lambda a: F.concat(a["done"], a["rest"]))

    def line(b: Column) -> Column:
        level = F.when(b["kind"].rlike("^h[1-6]$"), F.repeat(F.lit("#"), F.right(b["kind"], F.lit(1)).cast("int")))
        row = F.concat(F.lit("| "), F.array_join(F.transform(b["cells"], lambda c: linked(c, b["links"])), " | "), F.lit(" |"))
        text = linked(b["text"], b["links"])
        return (
            F.when(level.isNotNull(), F.concat(level, F.lit(" "), text))
            .when(b["kind"].isin("li", "dd"), F.concat(F.lit("- "), text))
            .when(b["kind"] == "blockquote", F.concat(F.lit("> "), text))
            .when(F.size(b["cells"]) > 0, row)
            .otherwise(text)
        )

    return F.array_join(F.transform(blocks, line), "\n")


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in double, single or no quotes; empty when it is absent."""
    value = F.regexp_extract(tag, rf"(?is)[\s\"']{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
    return F.trim(value, F.lit("\"'"))


def _meta(html: Column, names: list[str]) -> Column:
    """Contents of the meta tags of these names (lower case), in document order."""
    keys = ("property", "name", "itemprop")
    tags = F.filter(
        F.regexp_extract_all(html, F.lit(META_TAGS), F.lit(0)),
        lambda tag: F.exists(F.array(*[F.lower(_attribute(tag, k)) for k in keys]), lambda v: v.isin(names)),
    )
    return F.transform(tags, lambda tag: _attribute(tag, "content"))


def page_title(html: Column) -> Column:
    """Title the page declares for sharing, else of its title element, else its first heading."""

    def cleaned(text: Column) -> Column:
        return F.nullif(trim_space(decode_entities(text)), F.lit(""))

    def text_of(pattern: str) -> Column:
        return cleaned(F.regexp_replace(F.regexp_extract(html, pattern, 1), TAG, ""))

    shared = cleaned(F.get(_meta(html, ["og:title"]), F.lit(0)))
    return F.coalesce(shared, text_of(TITLE), text_of(HEADING))


def page_published(html: Column) -> Column:
    """Publication day from the document's own metadata, as UTC wire text.

    Looked for in meta tags, then in structured data (JSON-LD), then in time elements.
    """

    def first_day(values: Column) -> Column:
        day = lambda v: F.try_to_date(F.regexp_extract(v, ISO_DAY, 1), "yyyy-MM-dd")
        days = F.filter(F.transform(values, day), lambda d: d.isNotNull())
        return F.date_format(F.get(days, F.lit(0)), "yyyy-MM-dd'T00:00:00Z'")

    blocks = F.array_join(F.regexp_extract_all(html, F.lit(JSON_LD), F.lit(1)), " ")
    times = F.transform(
        F.regexp_extract_all(html, F.lit(TIME_TAGS), F.lit(0)), lambda tag: _attribute(tag, "datetime")
    )
    return F.coalesce(
        first_day(_meta(html, DATE_NAMES)),
        first_day(F.regexp_extract_all(blocks, F.lit(JSON_DATE), F.lit(1))),
        first_day(times),
    )


def page_metadata(html: Column) -> Column:
    return F.struct(page_title(html).alias("title"), page_published(html).alias("published_at"))


def body_text_length(html: Column) -> Column:
    """Characters of the body's text, scripts included, as a content poll counts them."""
    body = F.regexp_extract(html, r"(?is)<body\b[^<>]*+>(.*)$", 1)
    return F.length(decode_entities(F.regexp_replace(body, TAG, "")))


def sanitize_html(html: Column, max_chars: int = 0, extractor=None, unit: str = "bytes") -> Column:
    """Struct of content_md, title, published_at, error for one document.

    ``extractor`` maps the HTML column to a text column (built-in expressions or a
    pandas UDF); a null from it is an extraction failure.
    """
    extract = extractor or main_text
    empty = F.coalesce(html, F.lit("")) == ""
    failed = F.when(empty, F.lit("no raw HTML to sanitize")).otherwise("sanitize: no content")
    return let(
        F.when(~empty, truncate_text(extract(html), max_chars, unit)),
        lambda content: F.struct(
            F.nullif(content, F.lit("")).alias("content_md"),
            truncate_text(F.when(~empty, page_title(html)), max_chars, unit).alias("title"),
            F.when(~empty, page_published(html)).alias("published_at"),
            F.when(content.isNull(), failed).alias("error"),
        ),
    )
