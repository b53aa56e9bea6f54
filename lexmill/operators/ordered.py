"""Ordered computations: sections, carried values, segments, first and last wins, lines out of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import grouped, let, opened


def _upto(by: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def sections(rows: DataFrame, by: list[str], order: list[str], is_header: Column, text: str, sep: str = "\n\n") -> DataFrame:
    """(by..., section, title, body): a header starts a section, rows before the first header are dropped."""
    numbered = rows.withColumn("_header", is_header).withColumn("section", F.sum(F.col("_header").cast("int")).over(_upto(by, order))).where("section > 0")
    ordered = F.array_sort(F.collect_list(F.when(~F.col("_header"), F.struct(*order, F.col(text).alias("_t")))))
    title = F.max(F.when(F.col("_header"), F.col(text)))
    return numbered.groupBy(*by, "section").agg(title.alias("title"), F.array_join(F.transform(ordered, lambda x: x["_t"]), sep).alias("body"))


def carry_forward(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last value seen so far in each group."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(_upto(by, order)))


def segments(rows: DataFrame, by: list[str], start: str, end: Column) -> DataFrame:
    """Each row with segment_end: where the next row of the group starts, or end."""
    return rows.withColumn("segment_end", F.coalesce(F.lead(start).over(Window.partitionBy(*by).orderBy(start)), end))


def changes_only(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before in the group."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1
    return rows.withColumns({"_first": first, "_before": before}).where(F.col("_first") | ~F.col(value).eqNullSafe(F.col("_before"))).drop("_first", "_before")


def first_wins(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rn = 1").drop("_rn")


def take_while(rows: DataFrame, by: list[str], order: list[str], stop: Column, most: int) -> DataFrame:
    """Rows of a group before the first stop, at most so many."""
    stopped = F.max(stop.cast("int")).over(_upto(by, order))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumns({"_stop": stopped, "_rn": place}).where((F.col("_stop") == 0) & (F.col("_rn") <= most)).drop("_stop", "_rn")


def second_or_first(found: Column) -> Column:
    """The second of an array of places, else the first, else 0: past a table of contents."""
    return F.coalesce(F.get(found, F.lit(1)), F.get(found, F.lit(0)), F.lit(0))


def without_repeats(tokens: Column) -> Column:
    """An array without entries equal to the one before; a sequence that is one half twice becomes that half."""
    once = F.filter(tokens, lambda x, i: (i == 0) | (x != F.get(tokens, i - 1)))
    half = F.floor(F.size(once) / 2).cast("int")
    twice = (F.size(once) > 0) & (F.size(once) % 2 == 0) & (F.slice(once, F.lit(1), half) == F.slice(once, half + 1, half))
    return F.when(twice, F.slice(once, F.lit(1), half)).otherwise(once)


def lines_of_words(words: DataFrame, by: list[str], drift: float = 3.0) -> DataFrame:
    """(by..., line, text) from words (top, x0, text): a line holds words within `drift` of its first word's top.

    The anchor is the line's first word, not the word before, so slow drift does not chain lines together; a page's
    words are read in order within their row.
    """
    one = F.struct(F.col("top").cast("double").alias("top"), F.col("x0").cast("double").alias("x0"), "text")
    ordered = words.groupBy(*by).agg(F.array_sort(F.collect_list(one)).alias("w"))

    def step(anchor: Column, x: Column):
        fresh = anchor.isNull() | (F.abs(x["top"] - anchor) > drift)
        return fresh, F.when(fresh, x["top"]).otherwise(anchor)

    lines = let(opened(F.col("w"), F.lit(None), step), lambda at: grouped(F.col("w"), at))
    read = lambda ws: F.array_join(F.transform(F.array_sort(F.transform(ws, lambda w: F.struct(w["x0"], w["text"]))), lambda w: w["text"]), " ")
    return ordered.select(*by, F.posexplode(lines).alias("line", "_ws")).select(*by, "line", read(F.col("_ws")).alias("text"))
