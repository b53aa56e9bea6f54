"""Landed raw documents to rows: HTML blocks and links, statute XML, PDF words, catalogue discovery.

Fetching is not a Spark job: a crawler lands bytes in Parquet or as files. What cannot be read carries an error column
instead of failing the sweep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions.text import absolute_url, content_hash, html_unescape, let, markdown_table, matches, plain_dashes, statute_code, strip
from lexmill.functions.values import dmy, year_range
from lexmill.operators.classify import eligible_url
from lexmill.operators.ordered import carry_forward, first_wins, sections
from lexmill.sources.markup import attribute, html_blocks, inner_html, page_elements, plain, siblings


def landed_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, error) of binary files; error tells what is no PDF although its name says so."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.withColumn("error", pdf_error(F.col("content"), F.col("path")))


def pdf_error(content: Column, path: Column) -> Column:
    head = F.substring(content, 1, 512)
    is_pdf = F.hex(F.substring(content, 1, 4)) == "25504446"
    page = F.lower(F.decode(head, "ISO-8859-1")).rlike(r"<(!doctype|html)")
    return F.when(F.lower(path).endswith(".pdf") & ~is_pdf, F.when(page, "html instead of pdf").otherwise("not a pdf"))


def html_links(pages: DataFrame, key: str, base: str, html: str = "html") -> DataFrame:
    """(key, ord, href, text) with absolute links."""
    link = r"""(?is)<a\b[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a\s*>"""
    found = F.arrays_zip(F.regexp_extract_all(html, F.lit(link), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(link), F.lit(2)).alias("inner"))
    rows = pages.select(key, F.col(base).alias("_base"), F.posexplode(found).alias("ord", "a"))
    return rows.select(key, "ord", absolute_url(html_unescape(F.col("a.href")), F.col("_base")).alias("href"), plain(F.col("a.inner")).alias("text"))


def page_sections(pages: DataFrame, key: str, header: str = "h2", least: int = 50) -> DataFrame:
    """(key, section, title, body) of pages cut at a heading; short sections dropped."""
    blocks = html_blocks(pages, key)
    cut = sections(blocks, [key], ["ord"], F.col("tag") == header, "text")
    return cut.where(F.length("body") >= least)


def faq_pairs(pages: DataFrame, key: str, html: str = "html", least: int = 50) -> DataFrame:
    """(key, ord, question, answer) of <details> with a <summary>."""
    item = r"(?is)<details\b[^>]*>\s*<summary\b[^>]*>(.*?)</summary\s*>(.*?)</details\s*>"
    found = F.arrays_zip(F.regexp_extract_all(html, F.lit(item), F.lit(1)).alias("q"), F.regexp_extract_all(html, F.lit(item), F.lit(2)).alias("a"))
    rows = pages.select(key, F.posexplode(found).alias("ord", "d"))
    return rows.select(key, "ord", plain(F.col("d.q")).alias("question"), plain(F.col("d.a")).alias("answer")).where(F.length("answer") >= least)


#: Elements whose whole text is taken where a page has none of the named headings.
FULL_TEXT = ("h2", "h3", "p", "ul", "ol")


def guidance(pages: DataFrame, key: str, headings: dict[str, str | list[str]], footer: str, main: str | None = None, skip: tuple[str, ...] = (), least: int = 0) -> DataFrame:
    """One row a page: the text under each of the named headings, else all of it; cut at the footer; and its hash.

    A heading is an h2 that, without what leads up to a dash in it, equals one of the names, or that holds one; of several
    the last counts. Where none has text, the first column gets all h3, p, ul and ol of at least `least` letters, the
    outermost ones with all that stands in them, but for those under an h2 named in `skip`. main is the id of the element that
    is read; pages without it, and empty ones, have empty texts.
    """
    wanted = {n: [h.lower() for h in ([hs] if isinstance(hs, str) else hs)] for n, hs in headings.items()}
    bare = lambda c: F.trim(F.regexp_replace(F.lower(c), r"^.+\s*[-–]\s*", ""))
    source = pages.select(key, (F.col("html") if main is None else inner_html(F.col("html"), "id", main)).alias("html"))
    cut = lambda c: F.trim(F.substring_index(F.coalesce(c, F.lit("")), footer, 1))
    parts = sections(html_blocks(source, key), [key], ["ord"], F.col("tag") == "h2", "text", " ")
    holds = lambda hs: F.exists(F.array(*map(F.lit, hs)), lambda h: (bare(F.col("title")) == h) | F.lower("title").contains(h))
    named = parts.groupBy(key).agg(*(F.max_by("body", F.when(holds(hs), F.col("section"))).alias(n) for n, hs in wanted.items()))
    under = carry_forward(page_elements(source, key, FULL_TEXT).where("depth = 0"), [key], ["at"], F.when(F.col("tag") == "h2", bare(F.col("text"))), "_under")
    kept = under.where((F.col("tag") != "h2") & (F.length("text") >= max(least, 1)) & ~F.coalesce(F.col("_under").isin(list(skip)), F.lit(False)))
    whole = kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), " ").alias("_all"))
    joined = pages.select(key).join(named, key, "left").join(whole, key, "left")
    filled = joined.select(key, *(cut(F.col(n)).alias(n) for n in wanted), cut(F.col("_all")).alias("_all"))
    first = next(iter(wanted))
    nothing = F.concat(*(F.col(n) for n in wanted)) == ""
    out = filled.withColumn(first, F.when(nothing, F.col("_all")).otherwise(F.col(first))).drop("_all")
    return out.withColumn("content_hash", content_hash([F.col(n) for n in wanted]))


def statute_references(pages: DataFrame, key: str, html: str = "html", site: str = "/", main: str | None = None) -> DataFrame:
    """(key, ord, act, code, chapter, section, text) of references in list items, in the order of the tree.

    The act is that of the last link before the item that leads to one on `site` (its href holds it and ends in a year and
    a number); items before any act give nothing, and a link inside an item counts for later items. act is "year/number", code
    "number/year". A section's chapter is the item's own, else that of the nearest item before it in the same list that begins
    with one. Of equal references the first stays; one without a chapter stays only as the first of its section.
    """
    tree = page_elements(pages, key, ("a", "li", "ul", "ol"), html, main)
    href = F.when(F.col("tag") == "a", html_unescape(attribute(F.col("attrs"), "href")))
    act = F.when(href.contains(site), statute_code(href))
    before = lambda *by: Window.partitionBy(key, *by).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    coded = tree.withColumn("_own", act).withColumn("code", F.last("_own", ignorenulls=True).over(before()))
    number = lambda pattern: F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))
    items = coded.where("tag = 'li'").withColumn("_leads", number(r"(?i)^(\d+)\s+luku"))
    chaptered = items.withColumn("chapter", F.coalesce(number(r"(?i)(\d+)\s*luku"), F.last("_leads", ignorenulls=True).over(before("parent"))).cast("int"))
    each = chaptered.where("code is not null").select(key, F.col("at").alias("ord"), "code", "chapter", "text", F.posexplode(F.regexp_extract_all("text", F.lit(r"(\d+)\s*§"), F.lit(1))).alias("_nth", "section"))
    each = each.withColumn("section", F.col("section").cast("int"))
    place = lambda *by: F.row_number().over(Window.partitionBy(key, "code", "section", *by).orderBy("ord", "_nth"))
    ranked = each.withColumns({"_first": place(), "_same": place("chapter")})
    kept = ranked.where(F.when(F.col("chapter").isNull(), F.col("_first") == 1).otherwise(F.col("_same") == 1))
    parts = F.split("code", "/")
    return kept.select(key, "ord", F.concat_ws("/", parts[1], parts[0]).alias("act"), "code", "chapter", "section", F.substring("text", 1, 100).alias("text"))


def statute_paragraphs(acts: DataFrame, key: str, xml: str = "xml") -> DataFrame:
    """(key, chapter, chapter_title, section, section_title, order_index, text) of statute XML with chapter, section, num, heading and p elements, in any namespace."""
    bare = F.regexp_replace(F.regexp_replace(xml, r"<(/?)[A-Za-z0-9]+:", "<$1"), r"""\sxmlns(:\w+)?=("[^"]*"|'[^']*')""", "")
    inner = lambda c, tag: F.regexp_extract_all(c, F.lit(rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))
    head = lambda c, tag: plain(F.regexp_extract(c, rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>", 1))
    number = lambda c: F.regexp_extract(head(c, "num"), r"(\d+)", 1).try_cast("int")
    whole = F.when(bare.rlike(r"<chapter\b"), inner(bare, "chapter")).otherwise(F.array(bare))
    chapters = acts.select(key, F.explode(whole).alias("_c"))
    own = F.regexp_replace("_c", r"(?s)<section\b.*$", "")
    rows = chapters.select(key, number(own).alias("chapter"), head(own, "heading").alias("chapter_title"), F.explode(inner(F.col("_c"), "section")).alias("_s"))
    named = rows.select(key, "chapter", "chapter_title", number(F.col("_s")).alias("section"), head(F.col("_s"), "heading").alias("section_title"), F.posexplode(inner(F.col("_s"), "p")).alias("order_index", "_p"))
    return named.withColumn("text", plain(F.col("_p"))).drop("_p").where("text <> ''")


def version_date(xml: Column) -> Column:
    return F.regexp_extract(xml, r"""dateProduced\s*=\s*["'](\d{4}-\d{2}-\d{2})""", 1).try_cast("date")


def discover(pages: DataFrame, config: dict) -> DataFrame:
    """(page_id, href, text, ord) of a catalogue's links by a portal's configuration.

    Keys: catalog_url, marker, domain, depth, excluded, and strategy: first_pdf (a page's first one), by_text (links whose
    text holds link_text) or all_pdfs. Of equal links the first stays.
    """
    links = html_links(pages, "page_id", "url")
    pdf = F.lower("href").rlike(r"\.pdf($|[?#])")
    match config.get("strategy", "pages"):
        case "first_pdf":
            kept = first_wins(links.where(pdf), ["page_id"], [F.col("ord")])
        case "by_text":
            kept = links.where(F.lower("text").contains(config["link_text"].lower()))
        case "all_pdfs":
            kept = links.where(pdf)
        case _:
            kept = links.where(eligible_url(F.col("href"), config["marker"], config["domain"], config["catalog_url"], config.get("depth"), config.get("excluded", [])))
    return first_wins(kept, ["href"], [F.col("page_id"), F.col("ord")])


def agreement_clauses(pages: DataFrame, key: str, least: int = 80) -> DataFrame:
    """(key, section, title, body) of agreement pages: an h3 with a section sign, or any shorter heading that begins with a number and one, starts a clause."""
    head = ((F.col("tag") == "h3") & F.col("text").contains("§")) | (F.col("tag").rlike("^h[2-6]$") & (F.length("text") < 150) & F.col("text").rlike(r"^\d+\s*§"))
    return sections(html_blocks(pages, key), [key], ["ord"], head, "text").where(F.length("body") >= least)


def _inner(html: Column, tag: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?is)<(?:{tag})\b[^>]*>(.*?)</(?:{tag})\s*>"), F.lit(1))


def as_text(html: Column) -> Column:
    """Markup as paragraphs: tables as Markdown, what other blocks hold as lines of text, blank ones left out."""
    table = r"(?is)<table\b[^>]*>.*?</table\s*>"
    block_end = r"(?i)</(?:p|div|ul|ol|li|h[1-6]|pre|section|article|blockquote)\s*>"
    between = F.transform(F.split(html, table, -1), lambda x: F.array_join(F.filter(F.transform(F.split(x, block_end), lambda part: plain(part)), lambda part: part != ""), "\n\n"))
    cells = lambda row: F.transform(_inner(row, "td|th"), lambda c: plain(c))
    tables = F.transform(F.regexp_extract_all(html, F.lit(table), F.lit(0)), lambda x: let(F.filter(F.transform(_inner(x, "tr"), cells), lambda r: F.size(r) > 0), lambda rows: F.when(F.size(rows) > 0, markdown_table(rows)).otherwise("")))
    parts = F.flatten(F.transform(F.arrays_zip(between.alias("a"), tables.alias("b")), lambda x: F.array(x["a"], F.coalesce(x["b"], F.lit("")))))
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n\n")


def chapter_clauses(pages: DataFrame, key: str, container: str, html: str = "html", least: int = 80, footers: tuple[str, ...] = ()) -> DataFrame:
    """(key, ord, section, title, body) of chapter pages: an h2 with a section sign starts a clause.

    Only what stands inside the first container whose class holds `container` is read, up to its own end; pages without it
    give nothing. A clause ends at the next such h2 or where the element that its h2 stands in ends. A page without such an
    h2 is one clause under its h1, if that has a section sign. section is the sign with the number that leads the title,
    or with ? where none does. Bodies shorter than `least` are dropped; `footers` are cut out.
    """
    clean = F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")
    inside = inner_html(F.col(html), "class", container)
    rows = pages.select(key, inside.alias("_in"), F.regexp_extract(clean, r"(?is)<h1\b[^>]*>(.*?)</h1\s*>", 1).alias("_h1")).where("_in <> ''")
    heads = F.filter(matches(F.col("_in"), r"(?is)<h2\b[^>]*>(.*?)</h2\s*>", 1), lambda m: m["g"][1].contains("§"))

    def cut(found: Column) -> Column:
        end = lambda i: F.coalesce(F.get(found, i + 1)["start"], F.length("_in"))
        return F.transform(found, lambda m, i: F.struct(plain(m["g"][1]).alias("title"), siblings(F.substring(F.col("_in"), m["end"] + 1, end(i) - m["end"])).alias("html")))

    whole = F.when(F.col("_h1").contains("§"), F.array(F.struct(plain(F.col("_h1")).alias("title"), F.col("_in").alias("html")))).otherwise(F.array().cast("array<struct<title:string,html:string>>"))
    clauses = let(heads, lambda found: F.when(F.size(found) > 0, cut(found)).otherwise(whole))
    each = rows.select(key, F.posexplode(clauses).alias("ord", "c"))
    body = as_text(F.col("c.html"))
    number = F.regexp_extract("c.title", r"^(\d+)\s*§\s*(.*)$", 1)
    title = F.when(number != "", F.trim(F.regexp_extract("c.title", r"^(\d+)\s*§\s*(.*)$", 2))).otherwise(F.col("c.title"))
    out = each.select(key, "ord", F.when(number != "", F.concat(F.lit("§ "), number)).otherwise("§ ?").alias("section"), title.alias("title"), body.alias("body")).where(F.length("body") >= least)
    for footer in footers:
        out = out.withColumn("body", strip(F.replace("body", F.lit(footer), F.lit(""))))
    return out


def version_links(pages: DataFrame, key: str, base: str, pattern: str) -> DataFrame:
    """(key, ord, slug, period, href) of a catalogue's links to versions; pattern's groups are slug and period; of equal versions the first."""
    links = html_links(pages, key, base).where(F.regexp_extract("href", pattern, 1) != "")
    named = links.select(key, "ord", F.regexp_extract("href", pattern, 1).alias("slug"), F.regexp_extract("href", pattern, 2).alias("period"), "href")
    return first_wins(named, ["slug", "period"], [F.col(key), F.col("ord")])


def version_pages(pages: DataFrame, key: str, base: str, slug: str, period: str, ending: str, tail: str, sectors: dict[str, str], html: str = "html") -> DataFrame:
    """(key, name, full_url, valid_from, valid_until, sector) of landed version pages that link to their full text.

    The name is the page's og:title without the words `tail` at its end, dashes made plain, or the slug in capitals;
    the full text is the first link that ends in `ending`; validity is read from the name, else from the period. A sector
    that is not listed is the slug in words.
    """
    first = first_wins(html_links(pages, key, base, html).where(F.col("href").endswith(ending)), [key], [F.col("ord")]).select(F.col(key).alias("_k"), F.col("href").alias("full_url"))
    meta = F.regexp_extract(F.col(html), r"""(?is)<meta\b[^>]*property\s*=\s*["']og:title["'][^>]*content\s*=\s*["']([^"']*)["']""", 1)
    name = F.replace(plain_dashes(F.trim(F.regexp_replace(F.trim(html_unescape(meta)), rf"(?iu)\s*[-–]\s*{tail}\s*[>»]?\s*$", ""))), F.lit("?"), F.lit("-"))
    named = pages.select(key, slug, F.col(period).alias("_period"), F.when(meta != "", name).otherwise(F.upper(slug)).alias("name"))
    since = dmy(F.nullif(F.regexp_extract("name", r"(?iu)voimassa\s+(\d{1,2}\.\d{1,2}\.\d{4})", 1), F.lit("")))
    here, link = year_range(F.col("name")), year_range(F.col("_period"))
    table = F.create_map(*(F.lit(x) for kv in sectors.items() for x in kv)) if sectors else F.create_map().cast("map<string,string>")
    words = F.replace(slug, F.lit("-"), F.lit(" "))
    sector = F.coalesce(F.try_element_at(table, F.col(slug)), F.concat(F.upper(F.substring(words, 1, 1)), F.lower(F.substring(words, 2, 1000))))
    first_day = F.coalesce(since, here["first"], link["first"])
    until = F.coalesce(F.when(since.isNull(), here["last"]), link["last"])
    return named.join(first, F.col(key) == F.col("_k")).select(key, "name", "full_url", first_day.alias("valid_from"), until.alias("valid_until"), sector.alias("sector"))


def chapter_pages(pages: DataFrame, key: str, base: str, marker: str, html: str = "html") -> DataFrame:
    """(key, agreement, name, valid_from, valid_until, ord, href) of landed index pages: a row for each distinct link to a chapter.

    The agreement is the last part of the page's link, the name its h1, validity the first range of days in its text.
    Pages without a chapter give nothing.
    """
    chapters = first_wins(html_links(pages, key, base, html).where(F.col("href").contains(marker)), [key, "href"], [F.col("ord")]).select(F.col(key).alias("_k"), "ord", "href")
    days = r"(\d{1,2}\.\d{1,2}\.\d{4})\s*[–-]\s*(\d{1,2}\.\d{1,2}\.\d{4})"
    words = plain(F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1\s*>", ""))
    head = plain(F.regexp_extract(F.col(html), r"(?is)<h1\b[^>]*>(.*?)</h1\s*>", 1))
    agreement = F.element_at(F.split(F.rtrim(F.col(base), F.lit("/")), "/"), -1)
    index = pages.select(key, agreement.alias("agreement"), head.alias("name"), words.alias("_w"))
    day = lambda k: dmy(F.nullif(F.regexp_extract("_w", days, k), F.lit("")))
    return index.join(chapters, F.col(key) == F.col("_k")).select(key, "agreement", "name", day(1).alias("valid_from"), day(2).alias("valid_until"), "ord", "href")
