"""Greedy packing of text into chunks and pages, and clause segmentation, by folds within a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import grouped, let, matches, opened, strip


def pack(parts: Column, limit: int, sep: str) -> Column:
    """Parts joined by sep as long as the sum stays within limit; a larger part stands alone.

    A fold over lengths finds the places of the cuts; the parts are joined once.
    """

    def step(size: Column, n: Column):
        joined = size + len(sep) + n
        fits = (size >= 0) & (joined <= limit)
        return ~fits, F.when(fits, joined).otherwise(n)

    lengths = F.transform(parts, lambda x: F.length(x))
    places = let(lengths, lambda n: opened(n, F.lit(-1.0), step))
    return let(places, lambda at: F.transform(grouped(parts, at), lambda group: F.array_join(group, sep)))


def chunks(text: Column, limit: int = 500) -> Column:
    """Chunks of at most limit letters: lines, within long lines sentences, within long sentences hard slices; packed with spaces."""
    hard = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / limit).cast("int")), lambda i: F.substring(s, i * limit + 1, F.lit(limit)))
    filled = lambda a: F.filter(F.transform(a, lambda x: strip(x)), lambda x: x != "")
    sentences = lambda line: F.flatten(F.transform(filled(F.split(line, r"(?<=[.!?])\s+")), lambda s: F.when(F.length(s) > limit, hard(s)).otherwise(F.array(s))))
    parts = F.flatten(F.transform(filled(F.split(text, "\n")), lambda x: F.when(F.length(x) > limit, sentences(x)).otherwise(F.array(x))))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(let(parts, lambda p: pack(p, limit, " ")))


def pages(text: Column, limit: int = 900) -> Column:
    """Pages of at most limit letters: blocks between blank lines, or sentences where there is none; an oversize block is a page of its own."""
    blocks = F.when(text.contains("\n\n"), F.split(text, "\n\n")).otherwise(F.split(text, r"(?<=\.) "))
    filled = F.filter(F.transform(blocks, lambda x: strip(x)), lambda x: x != "")
    return let(filled, lambda p: pack(p, limit, "\n\n"))


def page_at(paged: Column, index: Column) -> Column:
    """The page at an index clamped to the pages there are, with its number."""
    n = F.size(paged)
    at = F.least(F.greatest(index, F.lit(0)), n - 1)
    return F.when(n > 0, F.concat(F.get(paged, at), F.lit("\n\nPage "), at + 1, F.lit("/"), n))


def length_route(text: Column, limit: int = 500) -> Column:
    return F.when(F.length(text) <= limit, "batch").otherwise("single")


#: A clause header: a line that begins with a number, a section sign and a title.
CLAUSE_HEADER = r"(?m)^[ \t]*(\d+)\s*§[ \t]*([^\n]*)$"


def clauses(docs: DataFrame, key: str, text: str, least: int = 100, most: int = 30_000) -> DataFrame:
    """(key, ord, number, title, body, start): text between headers.

    Titles that end in dots and a page number are entries of a table of contents; those and titles that begin with : or
    ) start no clause; bodies are cut at `most` letters, and shorter ones than `least` are dropped.
    """
    found = F.filter(matches(F.col(text), CLAUSE_HEADER, 2), lambda m: ~m["g"][2].rlike(r"(\.{3,}|\s)\s*\d+\s*$") & ~F.trim(m["g"][2]).rlike(r"^[:)]"))
    rows = docs.select(key, F.col(text).alias("_text"), found.alias("_m")).select(key, "_text", "_m", F.posexplode("_m").alias("ord", "h"))
    end = F.coalesce(F.get(F.col("_m"), F.col("ord") + 1)["start"], F.length("_text"))
    body = strip(F.substring(F.col("_text"), F.col("h.end") + 1, F.least(end - F.col("h.end"), F.lit(most))))
    out = rows.select(key, "ord", F.col("h.g")[1].alias("number"), F.trim(F.col("h.g")[2]).alias("title"), body.alias("body"), F.col("h.start").alias("start"))
    return out.where(F.length("body") >= least)
