"""Filters, joins, nesting and aggregates over document tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import let

#: Rows that a side may have to be broadcast; its rows are counted first.
BROADCAST_ROWS = 200_000


def dimension(df: DataFrame) -> DataFrame:
    """df for a join: broadcast if it is small when counted, else left to a shuffle join."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def one_row(df: DataFrame, **equal) -> DataFrame:
    """The row with these values, if any; two of them are an error."""
    found = all_of(df, **equal)
    if found.limit(2).count() > 1:
        raise ValueError(f"more than one row for {equal}")
    return found


def all_of(df: DataFrame, **equal) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, (F.col(k) == v for k, v in equal.items()), F.lit(True)))


def optional(df: DataFrame, flags: dict[str, bool | None] | None = None, **equal: str | None) -> DataFrame:
    """Equality filters that are left out where nothing is given: "" or None for values, None for flags."""
    tests = [F.col(k) == v for k, v in equal.items() if v] + [F.col(k) == v for k, v in (flags or {}).items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def icontains(column: Column, part: str) -> Column:
    """Contains in any case; % and _ of part stay wildcards."""
    return column.ilike(f"%{part}%")


def starts_like(column: Column, text: Column, n: int = 50) -> Column:
    return column.contains(F.substring(text, 1, n))


#: What the search for heads takes for a word: both sides are cut into the same runs.
WORDS = r"[\p{L}\p{N}_]+"
INNER_WORDS = r"(?<=[^\p{L}\p{N}_])[\p{L}\p{N}_]+(?=[^\p{L}\p{N}_])"

#: Words in a row that documents and heads meet by: one word of a language is in most texts, three of them in few.
RUN = 3


def containing(docs: DataFrame, key: str, text: str, items: DataFrame, item: str, head: str, same: tuple[str, ...] = ()) -> DataFrame:
    """(key, item) of the documents whose text contains an item's head; `same` columns must be equal as well.

    A head's words with other characters on both sides stand as one run in every text that contains the head, so the
    longest RUN of them in a row are the key of an equal join, as one number with the `same` columns; the pairs that meet
    are then tested. Heads with fewer such words are found by the longest one, and only those without any are tested on
    all documents, which needs few of them. Nulls contain nothing; repeated rows count once.
    """
    inner = F.regexp_extract_all(head, F.lit(INNER_WORDS), F.lit(0))
    longest = lambda parts: F.array_max(F.transform(parts, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    wanted = items.where(F.col(head).isNotNull()).select(F.col(item).alias("_item"), F.col(head).alias("_head"), let(inner, lambda ws: F.coalesce(longest(_runs(ws)), longest(ws))).alias("_word"), (F.size(inner) >= RUN).alias("_long"), *same)
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    hashed = lambda word: F.xxhash64(word, *(F.col(c) for c in same))
    keyed = lambda rows: rows.select(hashed(F.col("_word")).alias("_at"), "_item", "_head", *same)
    grams = lambda found: docs.select(F.col(key).alias("_key"), F.explode(F.array_distinct(F.transform(found, hashed))).alias("_at"))
    few = dimension(keyed(wanted.where("_word is not null and not _long")))
    met = grams(let(words, _runs)).join(keyed(wanted.where("_long")), "_at").unionByName(grams(words).join(few, "_at")).select("_key", "_item", "_head", *same).distinct()
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), *same)
    near = met.join(texts, ["_key", *same]).where(F.col("_text").contains(F.col("_head")))
    bare = texts.join(dimension(wanted.where("_word is null")), reduce(lambda a, b: a & b, (texts[c] == wanted[c] for c in same), F.col("_text").contains(F.col("_head"))))
    return near.select("_key", "_item").unionAll(bare.select("_key", "_item")).distinct().select(F.col("_key").alias(key), F.col("_item").alias(item))


def _runs(words: Column) -> Column:
    """All runs of RUN words of an array in a row, joined by spaces; none where it has fewer."""
    return F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - RUN + 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, *(F.get(words, i + k) for k in range(1, RUN))))


def in_or_source(column: Column, values: list, source: Column, name: str) -> Column:
    """column IN values OR source = name in three-valued logic; no values, no filter."""
    return column.isin(values) | (source == name) if values else F.lit(True)


def nest(parents: DataFrame, children: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """parents with an array of their children, in order; an empty array where there are none."""
    fields = [c for c in children.columns if c != key]
    rows = F.array_sort(F.collect_list(F.struct(*order, *(c for c in fields if c not in order))))
    return parents.join(children.groupBy(key).agg(rows.alias(name)), key, "left").withColumn(name, F.coalesce(name, F.array()))


def asof_last(rows: DataFrame, marks: DataFrame, by: list[str], at: str, mark_at: str, value: str) -> DataFrame:
    """rows with the value of the last mark at or before them in their group: one union and one window, no range join."""
    kept = [c for c in rows.columns]
    left = rows.withColumns({"_at": F.col(at), "_turn": F.lit(1), "_value": F.lit(None).cast(marks.schema[value].dataType)})
    right = marks.select(*by, F.col(mark_at).alias("_at"), F.lit(0).alias("_turn"), F.col(value).alias("_value"))
    order = Window.partitionBy(*by).orderBy("_at", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right, allowMissingColumns=True)
    return both.withColumn(f"last_{value}", F.last("_value", ignorenulls=True).over(order)).where("_turn = 1").select(*kept, f"last_{value}")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join in which null equals null; the right side's other columns are added."""
    r = right.select(*(F.col(k).alias(f"_r_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    test = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys))
    return left.join(r, test, how).drop(*(f"_r_{k}" for k in keys))


def with_default(df: DataFrame, lookup: DataFrame, key: str, value: str, default: str) -> DataFrame:
    return df.join(dimension(lookup.select(key, value)), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def coverage(df: DataFrame, by: list[str], done: dict[str, str], stamps: dict[str, str] | None = None) -> DataFrame:
    """Per group: total, filled columns and what is pending of them, latest stamps."""
    counts = [F.count(F.col(c)).alias(n) for n, c in done.items()]
    latest = [F.max(F.col(c)).alias(n) for n, c in (stamps or {}).items()]
    grouped = df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *counts, *latest)
    return grouped.withColumns({f"pending_{n}": F.col("total") - F.col(n) for n in done})


def outcome_counts(df: DataFrame, status: str, names: list[str]) -> DataFrame:
    return df.agg(*(F.count_if(F.col(status) == n).alias(n) for n in names))


def transitions(df: DataFrame, old: str, new: str) -> DataFrame:
    """(transition, n) of changes, most frequent first, equal ones by name."""
    text = F.concat(F.coalesce(F.col(old), F.lit("None")), F.lit(" -> "), F.coalesce(F.col(new), F.lit("None")))
    changed = df.where(~F.col(old).eqNullSafe(F.col(new)))
    return changed.groupBy(text.alias("transition")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "transition")


def union_missing(present: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """All rows of present, and those of listed whose key is not among them."""
    return present.unionByName(listed.join(present.select(key), key, "left_anti"))


def exactly(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """The rows of groups of exactly n."""
    return df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by))).where(F.col("_n") == n).drop("_n")


def request_status(requests: DataFrame, known: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    """requests with status: 400 where the key is missing, 404 where it is unknown or has no rows, else 200."""
    there = known.select(F.col(key).alias("_k")).distinct().withColumn("_known", F.lit(True))
    filled = rows.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    found = there.join(filled, "_k", "left")
    joined = requests.join(found, F.col(key) == F.col("_k"), "left")
    missing = F.coalesce(F.trim(F.col(key).cast("string")) == "", F.lit(True))
    return joined.withColumn("status", F.when(missing, 400).when(F.col("_known").isNull() | (F.coalesce("_n", F.lit(0)) == 0), 404).otherwise(200)).select(*requests.columns, "status")


def page(df: DataFrame, order: list[Column], size: int, number: int) -> DataFrame:
    """Page `number` (from 0, clamped to the pages there are) of an ordered result: a top-k of its rows, counted only beyond the last page."""
    at = max(number, 0)
    found = df.orderBy(*order).offset(at * size).limit(size)
    if at and found.isEmpty():
        return page(df, order, size, max(0, -(-df.count() // size) - 1)) if not df.isEmpty() else found
    return found


def page_after(df: DataFrame, keys: list[str], last: tuple | None, size: int) -> DataFrame:
    """The page that follows the row with these keys, in their ascending order: a filter and a top-k, whatever the page's number.

    The first page follows None. keys are not null and tell rows apart.
    """
    beyond = F.lit(last is None)
    for k, value in reversed(list(zip(keys, last or (), strict=False))):
        beyond = (F.col(k) > F.lit(value)) | ((F.col(k) == F.lit(value)) & beyond)
    return df.where(beyond).orderBy(*keys).limit(size)
