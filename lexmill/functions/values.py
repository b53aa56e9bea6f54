"""Numbers and dates out of text as Column expressions; what cannot be read is null."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number words of the source language in the inflections that occur.
NUMBER_WORDS = {
    "yksi": 1, "yhden": 1, "yhdeltä": 1,
    "kaksi": 2, "kahden": 2, "kahdelta": 2,
    "kolme": 3, "kolmen": 3, "kolmelta": 3,
    "neljä": 4, "neljän": 4, "neljältä": 4,
    "viisi": 5, "viiden": 5, "viideltä": 5,
    "kuusi": 6, "kuuden": 6, "kuudelta": 6,
    "seitsemän": 7, "seitsemältä": 7,
    "kahdeksan": 8, "kahdeksalta": 8,
    "yhdeksän": 9, "yhdeksältä": 9,
    "kymmenen": 10, "kymmeneltä": 10,
}

#: Tenure answers and the months that stand for them.
TENURE_MONTHS = {"lt_1m": 0, "1_12m": 1, "1_4y": 12, "4_8y": 48, "8_12y": 96, "gt_12y": 144}


def locale_decimal(text: Column) -> Column:
    """1 746,50 with blanks or no-break spaces between thousands, as decimal(10,2)."""
    plain = F.regexp_replace(F.translate(text, ", \u00a0", "."), r"\.$", "")
    return plain.try_cast("decimal(10,2)")


def number_word(text: Column) -> Column:
    word = F.lower(F.trim(text))
    table = F.create_map(*map(F.lit, chain.from_iterable(NUMBER_WORDS.items())))
    return F.coalesce(F.try_element_at(table, word), F.when(word.rlike(r"^\d+$"), word.try_cast("int")))


def percent(part: Column, total: Column) -> Column:
    """part of total in percent with one decimal, half up on exact decimals; 0.0 of nothing."""
    exact = part.cast("decimal(20,0)") * 100 / total.cast("decimal(20,0)")
    return F.when(total > 0, F.round(exact, 1)).otherwise(F.lit(0)).cast("decimal(10,1)")


def tenure_months(answer: Column) -> Column:
    return F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(TENURE_MONTHS.items()))), answer)


def dmy(text: Column) -> Column:
    """d.m.yyyy as a date; null if there is no such day."""
    return F.when(text.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), F.try_to_date(text, "d.M.yyyy"))


def dmy_as_iso(text: Column) -> Column:
    """d.m.yyyy rewritten as yyyy-mm-dd without a look at the calendar."""
    part = lambda k: F.regexp_extract(text, r"(\d{1,2})\.(\d{1,2})\.(\d{4})", k)
    return F.when(part(3) != "", F.concat_ws("-", part(3), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0")))


def iso_date(text: Column) -> Column:
    return text.try_cast("date")


def year_range(text: Column) -> Column:
    """struct(first, last): 1 January of the first and 31 December of the second year of a range such as 2025-2028."""
    year = lambda k: F.regexp_extract(text, r"(\d{4})\s*[-–—]\s*(\d{4})", k).try_cast("int")
    return F.struct(F.make_date(year(1), F.lit(1), F.lit(1)).alias("first"), F.make_date(year(2), F.lit(12), F.lit(31)).alias("last"))


def validity(text: Column, period: Column) -> Column:
    """struct(first, last): "in force from d.m.yyyy" has no end; else a range in the text, else one in the link's period."""
    since = dmy(F.nullif(F.regexp_extract(text, r"(?iu)voimassa\s+(\d{1,2}\.\d{1,2}\.\d{4})\s+alkaen", 1), F.lit("")))
    here, link = year_range(text), year_range(period)
    first = F.coalesce(since, here["first"], link["first"])
    return F.struct(first.alias("first"), F.when(since.isNull(), F.coalesce(here["last"], link["last"])).alias("last"))


def span_days(first: Column, last: Column) -> Column:
    """Years between two dates as days of 365 a year: the measure by which validity spans are compared."""
    return F.abs(F.year(last) - F.year(first)) * 365
