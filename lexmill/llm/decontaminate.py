"""Benchmark decontamination with DataFrame expressions alone: a broadcast hash set of test n-grams against token windows.

Benchmark items become windows of n consecutive normalised words; the set of their distinct hashes is broadcast. Every
window of every text is hashed where the text is read and looked up in the set; a hit is verified word by word
right after. Only hits and one row for each text leave the task. Texts are told by 128 bits, so copies of
a text collapse before anything moves. Documents or the hit words in them are then removed.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import BROADCAST_ROWS, packed, save, small, unpacked

#: What lies between words, as the inside of a character class: ASCII but for digits and letters (texts are in lower case by then).
BETWEEN = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
#: The same before A-Z are lowered.
BETWEEN_RAW = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"


def plain_words(text: Column) -> Column:
    """The words of a text with A-Z in lower case; a null text has none."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(t) == F.length(t)
    lowered = F.when(ascii_only, F.lower(t)).otherwise(F.translate(t, string.ascii_uppercase, string.ascii_lowercase))
    return F.regexp_extract_all(lowered, F.lit(f"[^{BETWEEN}]+"), F.lit(0))


def _window_key(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*(F.get(words, at + j) for j in range(k)))


def benchmark_windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """(item, k, window): the distinct windows of each item of (item_id, text), space-joined; k is the number of their words.

    Items of fewer than n words are one window; items without words or text have none. Rows that share an item_id are one
    item with the windows of all.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), plain_words(F.col("text")).alias("w"))
    size = F.size("w")
    starts = F.when(size >= n, F.sequence(F.lit(1), size - (n - 1))).when(size > 0, F.array(F.lit(1)))
    rows = items.select("item", "w", F.explode(starts).alias("i")).select("item", F.slice("w", F.col("i"), F.lit(n)).alias("ws"))
    return rows.select("item", F.size("ws").alias("k"), F.concat_ws(" ", "ws").alias("window")).distinct()


def _text_keys() -> list[Column]:
    """128 bits that stand for a text; a null text is the empty one."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.xxhash64(t).alias("_t1"), F.xxhash64(F.lit(1), t).alias("_t2")]


def _scan(docs: DataFrame, grams: DataFrame, lengths: list[int]) -> DataFrame:
    """(_t1, _t2, n_words, i, k, gram) of each text: a row without i, and a row for each window that is in grams.

    grams has a size at which it may be broadcast.
    """
    texts = docs.select(*_text_keys(), plain_words(F.col("text")).alias("w")).select("*", F.size("w").alias("n_words"))
    last = F.greatest(F.lit(-1), F.col("n_words") - (min(lengths) if lengths else 0))
    at = texts.select("*", F.explode(F.sequence(F.lit(-1), last) if lengths else F.array(F.lit(-1))).alias("i"))
    if not lengths:
        return at.select("_t1", "_t2", "n_words", F.lit(None).cast("int").alias("i"), F.lit(None).cast("int").alias("k"), F.lit(None).cast("long").alias("gram"))
    i = F.col("i")
    keys = [F.struct(F.lit(k).alias("k"), F.when((i >= 0) & (i + k <= F.col("n_words")), _window_key(F.col("w"), i, k)).alias("key")) for k in lengths]
    probes = at.select("*", F.explode(F.array(*keys)).alias("p")) if len(keys) > 1 else at.withColumn("p", keys[0])
    probes = probes.select("_t1", "_t2", "n_words", "w", "i", F.col("p.k").alias("k"), F.col("p.key").alias("key"))
    table = F.broadcast(grams.select("gram", "window", F.col("k").alias("gk"), F.col("key").alias("gkey")))
    # the hash alone is the key of the join; the words are compared where it is met
    same = (F.col("k") == F.col("gk")) & (F.concat_ws(" ", F.slice("w", F.greatest(i, F.lit(0)) + 1, F.col("k"))) == F.col("window"))
    met = probes.join(table, F.col("key") == F.col("gkey"), "left").where((i == -1) | (F.col("gram").isNotNull() & same))
    hit = F.col("gram").isNotNull()
    return met.select("_t1", "_t2", "n_words", F.when(hit, i).alias("i"), F.when(hit, F.col("k")).alias("k"), "gram")


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, n: int = 10, limit: int = BROADCAST_ROWS) -> DataFrame:
    """(_t1, _t2, n_words, positions, items) of every distinct text: the places of its hit words, from 0, and the hitting item_ids as sorted strings.

    A word is hit inside any occurrence of a window of the benchmark. Windows beyond `limit` distinct ones are looked up
    in parts of at most about that many, each a pass over the texts; none is left out. What is gathered for a text is
    bounded by the text itself and by the number of items.
    """
    owned = save(benchmark_windows(benchmark, n), "windows")
    keys = F.coalesce(*(F.when(F.col("k") == k, _window_key(F.split("window", " "), F.lit(0), k)) for k in range(1, n + 1)))
    grams = save(owned.select("k", "window").distinct().select("*", keys.alias("key"), F.monotonically_increasing_id().alias("gram")), "grams")
    sizes = {r["k"]: r["count"] for r in grams.groupBy("k").count().collect()}  # at most n rows
    total, lengths = sum(sizes.values()), sorted(sizes)
    parts = max(1, -(-total // limit))
    found = None
    for part in range(parts):
        some = _scan(docs, grams.where(F.pmod("key", F.lit(parts)) == part) if parts > 1 else grams, lengths)
        found = some if found is None else found.unionAll(some)
    spans, hits = F.collect_set(F.when(F.col("i").isNotNull(), F.struct("i", "k"))), F.collect_set("gram")
    texts = save(found.groupBy("_t1", "_t2").agg(F.max("n_words").alias("n_words"), spans.alias("spans"), hits.alias("grams")), "texts")
    places = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["i"], s["i"] + s["k"] - 1)))))
    items = owned.join(small(grams, total), ["k", "window"]).select("gram", "item")
    by_text = texts.where(F.size("grams") > 0).select("_t1", "_t2", F.explode("grams").alias("gram")).join(items, "gram")
    named = by_text.groupBy("_t1", "_t2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    none = F.array().cast("array<string>")
    # written, so that a join to many copies of a text has a plain table on either side and can be split
    return save(texts.join(named, ["_t1", "_t2"], "left").select("_t1", "_t2", "n_words", places.alias("positions"), F.coalesce("items", none).alias("items")), "found")


def contamination_report(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each row of docs.

    Null and empty texts have no words and are clean; repeated rows and null doc_ids are reported each; an empty table of
    documents gives an empty report, and an empty benchmark leaves all clean; other columns are ignored. An item without an
    item_id hits, but is not among the items counted.
    """
    texts = contaminated_texts(docs, benchmark, n)
    rows = docs.select(F.col("doc_id"), *_text_keys()).join(texts, ["_t1", "_t2"], "left")
    n_hit = F.size("positions").cast("long")
    return rows.select("doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "spans", most: float = 0.0) -> DataFrame:
    """docs without what the benchmark has: remove="spans" takes hit words with what follows them up to the next word out of
    the texts, remove="documents" drops documents of which more than the share `most` of words is hit.

    Columns stay as they are, whatever their names; null texts, repeated rows and clean texts stay; an empty table stays
    empty. Texts with hits alone are looked up, by broadcast where they are few, so clean texts need not move.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove is spans or documents, not {remove}")
    hit = save(contaminated_texts(docs, benchmark, n).where(F.size("positions") > 0).select("_t1", "_t2", "n_words", "positions"), "hit")
    n_hit = hit.agg(F.sum(F.size("positions"))).first()[0] or 0
    rows = packed(docs, "text").select("_row", "text", *_text_keys())
    share = F.size("positions") / F.col("n_words")
    if remove == "documents":
        bad = hit.where(share > most).select("_t1", "_t2")
        return unpacked(rows.join(small(bad, n_hit), ["_t1", "_t2"], "left_anti"))
    met = rows.join(small(hit, n_hit), ["_t1", "_t2"], "left")
    text = F.col("text").cast("string")
    head = F.regexp_extract(text, f"^[{BETWEEN_RAW}]*", 0)
    pieces = F.regexp_extract_all(text, F.lit(f"[^{BETWEEN_RAW}]+[{BETWEEN_RAW}]*"), F.lit(0))
    kept = met.withColumns({"_pieces": F.when(F.col("positions").isNotNull(), pieces), "_left": F.array_except(F.sequence(F.lit(0), F.col("n_words") - 1), "positions")})
    cleaned = F.when(F.col("positions").isNull(), F.col("text")).otherwise(F.concat(head, F.array_join(F.transform("_left", lambda i: F.get(F.col("_pieces"), i)), "")))
    return kept.select(*(cleaned.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
