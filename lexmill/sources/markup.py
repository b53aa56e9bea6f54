"""Markup as a tree, with Column expressions: tags in order, the matching of their ends, and the text of elements.

A page is cut once into its tags of interest and the pieces of text between them. One fold with a stack of open elements
gives each tag what it opens in and what it ends; an element is then a range of pieces. An end tag ends the innermost
open element of its name and all within it; one that matches nothing is ignored; the start of a list item, table cell,
row, paragraph or definition ends an open one as HTML has it; what is open at the end of the page ends there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import html_unescape, let, running, squeeze

#: Elements that stand on lines of their own; html, head and body are left out (fixed values of HTML).
BLOCKS = (
    "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li",
    "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th", "ul",
)
#: Elements without content (fixed values of HTML).
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
#: Elements whose start ends these if they are innermost (fixed values of HTML); every other block ends a paragraph.
ENDS = {"li": ("li", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tr": ("td", "th", "tr", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "option": ("option",)}
#: What is no text of a page.
UNREAD = r"(?is)<(script|style|template|title)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)"

_MARK = "struct<at:int,tag:string,close:boolean,attrs:string,whole:string>"
_STACK = "array<struct<at:int,tag:string>>"
_EVENT = "struct<top:string,parent:int,depth:int,stray:boolean,popped:array<int>>"


def plain(html: Column) -> Column:
    """The text of markup: tags as blanks, entities resolved, white space squeezed."""
    return squeeze(html_unescape(F.regexp_replace(html, r"(?s)<!--.*?-->|<[^>]*>", " ")))


def parsed(html: Column, tags: tuple[str, ...] = BLOCKS) -> Column:
    """struct<pieces,marks,events>: the text between the tags of interest, these tags, and what they open and end.

    A mark tells its place, its name in lower case, whether it is an end, its attributes and the tag itself; after the
    last tag comes a mark of the end of the page, so there are as many pieces as marks. An event tells the innermost open
    element before its mark (top), the one that the mark opens in and how deep (parent, depth), whether it is an end that
    matches nothing (stray), and the places of the elements that it ends (popped). A null page is an empty one.
    """
    tag = rf"""(?is)<(/?)({"|".join(tags)})\b((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)>"""
    mark = lambda x, i: F.struct(i.alias("at"), F.lower(x["tag"]).alias("tag"), (x["slash"] == "/").alias("close"), x["attrs"].alias("attrs"), x["whole"].alias("whole")).cast(_MARK)
    last = lambda z: F.struct(F.size(z).alias("at"), F.lit("").alias("tag"), F.lit(True).alias("close"), F.lit("").alias("attrs"), F.lit("").alias("whole")).cast(_MARK)

    def split(clean: Column) -> Column:
        group = lambda k: F.regexp_extract_all(clean, F.lit(tag), F.lit(k))
        found = F.arrays_zip(group(0).alias("whole"), group(1).alias("slash"), group(2).alias("tag"), group(3).alias("attrs"))
        marks = let(found, lambda z: F.concat(F.transform(z, mark), F.array(last(z))))
        return let(marks, lambda m: F.struct(F.split(clean, tag, -1).alias("pieces"), m.alias("marks"), running(m, F.array(), _STACK, _EVENT, _step).alias("events")))

    return let(F.regexp_replace(F.coalesce(html, F.lit("")), UNREAD, ""), split)


def attribute(attrs: Column, name: str) -> Column:
    """An attribute's value, "" where there is none."""
    each = rf"""(?is)(?:^|\s){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*(F.regexp_extract(attrs, each, k) for k in (1, 2, 3)))


def _ended_by_start(tag: Column, open_tag: Column) -> Column:
    """Whether the start of tag ends an innermost open_tag."""
    test = F.when(tag.isin(*(t for t in BLOCKS if t not in ENDS)), open_tag == "p")
    for t, ends in ENDS.items():
        test = test.when(tag == t, open_tag.isin(*ends))
    return F.coalesce(test, F.lit(False))


def _popped(stack: Column, mark: Column) -> Column:
    """How many open elements a mark ends."""
    back = F.reverse(stack)
    named = F.array_position(F.transform(back, lambda s: s["tag"]), mark["tag"])
    kept = F.array_position(F.transform(back, lambda s: ~_ended_by_start(mark["tag"], s["tag"])), F.lit(True))
    opening = F.when(kept == 0, F.size(stack)).otherwise(kept - 1)
    return F.when(mark["tag"] == "", F.size(stack)).when(mark["close"], named).otherwise(opening).cast("int")


def _step(stack: Column, mark: Column) -> Column:
    opens = ~mark["close"]
    empty = opens & (mark["tag"].isin(*VOID) | mark["attrs"].endswith("/"))

    def with_count(n: Column) -> Column:
        left = F.slice(stack, F.lit(1), F.size(stack) - n)
        gone = F.transform(F.slice(stack, F.size(stack) - n + 1, n), lambda s: s["at"])
        state = F.when(opens & ~empty, F.concat(left, F.array(F.struct(mark["at"].alias("at"), mark["tag"].alias("tag"))).cast(_STACK))).otherwise(left)
        event = F.struct(
            F.coalesce(F.get(stack, F.size(stack) - 1)["tag"], F.lit("")).alias("top"), F.coalesce(F.get(left, F.size(left) - 1)["at"], F.lit(-1)).alias("parent"), F.size(left).alias("depth"),
            (mark["close"] & (mark["tag"] != "") & (n == 0)).alias("stray"), F.when(empty, F.concat(gone, F.array(mark["at"]))).otherwise(gone).alias("popped"))
        return F.struct(state.cast(_STACK).alias("state"), event.cast(_EVENT).alias("out"))

    return let(_popped(stack, mark), with_count)


def elements(page: Column) -> Column:
    """The elements of a parsed page in document order: at, parent (-1: none), depth, tag, attrs, and till, the place of the mark that ends it."""
    ended = F.array_sort(F.flatten(F.transform(page["events"], lambda e, i: F.transform(e["popped"], lambda p: F.struct(p.alias("at"), i.alias("till"))))))
    mark, event = (lambda x: F.get(page["marks"], x["at"])), (lambda x: F.get(page["events"], x["at"]))
    return F.transform(ended, lambda x: F.struct(x["at"].alias("at"), event(x)["parent"].alias("parent"), event(x)["depth"].alias("depth"), mark(x)["tag"].alias("tag"), mark(x)["attrs"].alias("attrs"), x["till"].alias("till")))


def element_text(pieces: Column, element: Column) -> Column:
    """All text within an element, its descendants' included."""
    return plain(F.array_join(F.slice(pieces, element["at"] + 2, element["till"] - element["at"]), " "))


def between(page: Column, first: Column, last: Column) -> Column:
    """The markup of a parsed page from piece `first` to piece `last`, with the marks between them."""
    n = F.greatest(last - first + 1, F.lit(0))
    some = F.arrays_zip(F.slice(page["pieces"], first + 1, n).alias("piece"), F.slice(F.transform(page["marks"], lambda m: m["whole"]), first + 1, F.greatest(n - 1, F.lit(0))).alias("mark"))
    return F.array_join(F.flatten(F.transform(some, lambda x: F.array(x["piece"], F.coalesce(x["mark"], F.lit(""))))), "")


def html_blocks(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, ord, tag, text) of the runs of text of pages in document order, each with the innermost block that it stands in.

    A run ends where a block starts or ends, so text before, between and after nested blocks is kept, each part in its
    place; bare text has its container's tag, or "" outside of all blocks. Scripts, styles, titles, comments and blank runs
    are left out. A null page has none.
    """
    run = lambda x: F.struct(x["event"]["top"].alias("tag"), plain(x["piece"]).alias("text"))
    page = pages.select(key, parsed(F.col(html)).alias("_x"))
    runs = F.filter(F.transform(F.arrays_zip(F.col("_x.pieces").alias("piece"), F.col("_x.events").alias("event")), run), lambda x: x["text"] != "")
    return page.select(key, F.posexplode(runs).alias("ord", "b")).select(key, "ord", "b.tag", "b.text")


def page_elements(pages: DataFrame, key: str, tags: tuple[str, ...], html: str = "html", within: str | None = None) -> DataFrame:
    """(key, at, parent, depth, tag, attrs, text) of the elements of these tags, in document order; text is all that stands in one.

    Only these tags make the tree, so parent is the nearest of them (-1: none). within is the id of the container that is
    read; a page without it gives nothing.
    """
    source = F.col(html) if within is None else inner_html(F.col(html), "id", within)
    page = pages.select(key, parsed(source, tags).alias("_x"))
    listed = F.transform(elements(F.col("_x")), lambda e: F.struct(e["at"].alias("at"), e["parent"].alias("parent"), e["depth"].alias("depth"), e["tag"].alias("tag"), e["attrs"].alias("attrs"), element_text(F.col("_x.pieces"), e).alias("text")))
    return page.select(key, F.explode(listed).alias("e")).select(key, "e.*")


#: Containers that inner_html looks for.
CONTAINERS = ("div", "main", "article", "section", "body")


def inner_html(html: Column, name: str, value: str) -> Column:
    """The markup inside the first container whose attribute `name` holds `value` (an id is equal to it), up to its own end; null without one."""
    fits = lambda e: attribute(e["attrs"], name) == value if name == "id" else attribute(e["attrs"], name).contains(value)
    first = lambda page: F.get(F.filter(elements(page), fits), F.lit(0))
    inside = lambda page: let(first(page), lambda e: F.when(e.isNotNull(), between(page, e["at"] + 1, e["till"])))
    return let(parsed(html, CONTAINERS), inside)


def siblings(html: Column) -> Column:
    """The markup up to an end tag that ends what began before it: the rest of the container that html starts in."""
    stray = lambda page: F.array_position(F.transform(page["events"], lambda e: e["stray"]), F.lit(True)).cast("int")
    before = lambda page: let(stray(page), lambda k: F.when(k == 0, html).otherwise(between(page, F.lit(0), k - 1)))
    return let(parsed(html, tuple(t for t in BLOCKS if t != "p")), before)
