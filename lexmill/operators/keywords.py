"""Keyword tables of any size: an index of their rarest grams, met by the grams of texts in an equal join, then verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators.lookup import BROADCAST_ROWS

#: Letters of a text that are split at once; a block sees enough of the next one for the longest keyword.
BLOCK = 1 << 16
#: A letter of a word.
WORD_LETTER = r"^[\p{L}\p{N}_]$"


def _gram(letters: Column, at: Column, n: int) -> Column:
    """n letters as one number, kept apart from grams of other lengths."""
    return F.xxhash64(F.lit(n), *(F.get(letters, at + j) for j in range(n)))


def gram_index(rules: DataFrame, short: int = 6) -> DataFrame:
    """(topic, keyword, n, size, at, gram) of each rule (topic, keyword): the gram of `size` letters that the fewest keywords hold, `at` its place.

    Keywords are in lower case; one of at least `short` letters is found by such a gram of `short` letters, a shorter one by
    itself. Null and empty keywords match nothing.
    """
    words = rules.select("topic", F.lower("keyword").alias("keyword")).where("keyword <> ''").distinct().withColumn("n", F.length("keyword"))
    letters = words.withColumn("_c", F.split("keyword", ""))
    long = letters.where(F.col("n") >= short).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - short)).alias("at"))
    grams = long.select("topic", "keyword", "n", F.lit(short).alias("size"), "at", _gram(F.col("_c"), F.col("at"), short).alias("gram"))
    held = grams.groupBy("gram").agg(F.count_distinct("keyword").alias("_held"))
    rarest = grams.join(held, "gram").groupBy("topic", "keyword", "n", "size").agg(F.min(F.struct("_held", "at", "gram")).alias("_g"))
    found = rarest.select("topic", "keyword", "n", "size", "_g.at", "_g.gram")
    for n in range(1, short):
        found = found.unionAll(letters.where(F.col("n") == n).select("topic", "keyword", "n", F.lit(n).alias("size"), F.lit(0).alias("at"), _gram(F.col("_c"), F.lit(0), n).alias("gram")))
    return found


def _hits(docs: DataFrame, index: DataFrame, text: str, key: str, sizes: list[int], longest: int, short: int) -> DataFrame:
    """(key, topic, n) of every place of a text where a keyword stands, and a row without topic for every text."""
    lowered = docs.select(F.col(key).alias("_key"), F.coalesce(F.lower(text), F.lit("")).alias("_t"))
    starts = F.sequence(F.lit(0), F.greatest(F.length("_t") - 1, F.lit(0)), F.lit(BLOCK))
    blocks = lowered.select("_key", "_t", F.explode(starts).alias("_from"))
    # one letter before the block, to tell a word's beginning, and what the longest keyword needs behind it
    first = F.greatest(F.col("_from") - 1, F.lit(0))
    pieces = blocks.select("_key", F.split(F.substring(F.col("_t"), first + 1, F.col("_from") - first + BLOCK + longest + 1), "").alias("_c"))
    places = pieces.select("_key", "_c", F.explode(F.sequence(F.lit(-1), F.size("_c") - 1)).alias("_i"))
    i = F.col("_i")
    grams = [F.when((i >= 0) & (i + n <= F.size("_c")), _gram(F.col("_c"), i, n)) for n in sizes]
    probes = places.select("*", F.explode(F.array(*grams)).alias("_g")) if len(grams) > 1 else places.withColumn("_g", grams[0])
    table = F.broadcast(index.select("topic", "keyword", "n", "at", "gram"))
    start = F.greatest(i - F.col("at"), F.lit(0))
    stands = (i >= F.col("at")) & (F.array_join(F.slice("_c", start + 1, F.col("n")), "") == F.col("keyword"))
    apart = lambda c: ~F.coalesce(c.rlike(WORD_LETTER), F.lit(False))
    whole = apart(F.get("_c", F.when(start > 0, start - 1))) & apart(F.get("_c", start + F.col("n")))
    fits = F.col("keyword").isNotNull() & stands & ((F.col("n") >= short) | whole)
    met = probes.join(table, F.col("_g") == F.col("gram"), "left").where((i == -1) | fits)
    return met.select("_key", F.when(fits, F.col("topic")).alias("topic"), F.when(fits, F.col("n")).alias("n"))


def topic_by_index(docs: DataFrame, rules: DataFrame, text: str, key: str, short: int = 6, limit: int = BROADCAST_ROWS) -> DataFrame:
    """(key, topic) of docs: the topic of the longest keyword that a text holds, of equally long ones the greatest; null if none.

    Keywords under `short` letters match as whole words, longer ones anywhere. The grams of a text meet the index in a
    hash join and are verified in place, so neither documents nor rules meet each other as a whole. An index of more than
    `limit` rows is broadcast in parts, each a pass over the texts. Null texts have no topic; documents that share a key
    count as one; an empty rule table gives no topics.
    """
    index = gram_index(rules, short)
    shape = index.groupBy("size").agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("longest")).collect()  # at most `short` rows
    if not shape:
        return docs.select(F.col(key), F.lit(None).cast("string").alias("topic")).distinct()
    sizes, longest = sorted(r["size"] for r in shape), max(r["longest"] for r in shape)
    parts = -(-sum(r["rows"] for r in shape) // limit)
    found = None
    for part in range(parts):
        hits = _hits(docs, index.where(F.pmod("gram", F.lit(parts)) == part) if parts > 1 else index, text, key, sizes, longest, short)
        found = hits if found is None else found.unionAll(hits)
    best = found.groupBy("_key").agg(F.max(F.when(F.col("topic").isNotNull(), F.struct("n", "topic"))).alias("_b"))
    return best.select(F.col("_key").alias(key), F.col("_b.topic").alias("topic"))
