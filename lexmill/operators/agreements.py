"""Agreements: name and validity out of header text, clauses with page numbers, and union portals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import clean_name, let, matches, squeeze, strip
from lexmill.functions.values import dmy_as_iso
from lexmill.operators.lookup import asof_last
from lexmill.operators.ordered import without_repeats

# The notations of periods, and the words that end or spoil a name.
DAYS = r"(\d{1,2}\.\d{1,2}\.\d{4})\s*[–-]\s*(\d{1,2}\.\d{1,2}\.\d{4})"
YEARS = r"(20\d{2})\s*[–—-]\s*(20\d{2})"
NAME_ENDS = ["isbn", "kustantaja", "paino", "taitto", "sisältö", "sisällys"]
NO_NAMES = ["työntekijät", "palkkaliite", "liite"]


def validity_period(text: Column) -> Column:
    """struct(first, last) as text: of all day ranges of the header the one of most years, the first of equal ones; else a range of years."""
    header = F.substring(text, 1, 4000)

    def longest(found: Column) -> Column:
        rated = F.transform(found, lambda m, i: F.struct(F.abs(F.substring(m["g"][2], -4, 4).try_cast("int") - F.substring(m["g"][1], -4, 4).try_cast("int")).alias("span"), (-i).alias("place"), m["g"][1].alias("a"), m["g"][2].alias("b")))
        return F.array_max(rated)

    near = matches(header, DAYS, 2)
    best = F.when(F.size(near) > 0, longest(near)).otherwise(longest(matches(F.substring(text, 1, 20_000), DAYS, 2)))
    years = F.get(matches(header, YEARS, 2), F.lit(0))
    first = F.coalesce(dmy_as_iso(best["a"]), F.concat(years["g"][1], F.lit("-01-01")))
    return F.struct(first.alias("first"), F.coalesce(dmy_as_iso(best["b"]), F.concat(years["g"][2], F.lit("-12-31"))).alias("last"))


def agreement_name(text: Column, markers: list[str]) -> Column:
    """Up to six lines of the header before a stop word, a long line or a section sign; repeats collapsed, cut at a marker."""
    lines = F.filter(F.transform(F.split(F.substring(text, 1, 4000), "\n"), lambda x: strip(x)), lambda x: x != "")
    before = lambda xs, stop: F.slice(xs, F.lit(1), F.coalesce(F.get(F.filter(F.transform(xs, lambda x, i: F.when(stop(x), i)), lambda i: i.isNotNull()), F.lit(0)), F.size(xs)))
    named = lambda x: (F.length(x) > 3) & ~x.rlike(r"^\d") & ~x.contains(".....") & ~F.lower(x).contains("alkaen") & ~x.rlike(DAYS) & ~F.lower(x).isin(NO_NAMES)
    ends = lambda x: F.lower(x).rlike("|".join(NAME_ENDS)) | (F.length(x) > 80)
    filtered = F.filter(before(lines, lambda x: x.contains("§")), named)
    block = F.slice(before(filtered, ends), F.lit(1), F.lit(6))
    tokens = F.split(squeeze(F.array_join(block, " ")), " ")
    name = let(tokens, lambda ts: F.array_join(without_repeats(ts), " "))
    return clean_name(F.coalesce(F.nullif(name, F.lit("")), F.get(lines, F.lit(0))), markers)


def clause_pages(clauses: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """clauses (key, start) with the page they begin on; pages: (key, page, start)."""
    marks = pages.select(key, F.col("start").alias("_at"), "page")
    return asof_last(clauses, marks, [key], "start", "_at", "page").withColumnRenamed("last_page", "page")


def pending(agreements: DataFrame, parse) -> tuple[DataFrame, DataFrame]:
    """(rows parsed, outcome counts) of agreements that are not parsed yet; parse() adds a column error, null where it went well."""
    done = parse(agreements.where(~F.col("is_parsed")))
    marked = done.withColumn("is_parsed", F.col("error").isNull())
    return marked, marked.agg(F.count_if(F.col("error").isNull()).alias("success"), F.count_if(F.col("error").isNotNull()).alias("errors"))
