"""Quality rules: a decision list learned from labelled statistics, applied as ordered Spark conditions.

Everything that touches documents is a DataFrame expression. Fitting reads a bounded sample of labelled rows
(`max_labels`), bins each statistic once at quantiles of the sample, and then needs one small count by
(statistic, bin) for each condition that it tries to add.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import WORD, decision_tree, packed, save, small, unpacked

#: Bits of a packed window that hold its place, as many as an array has places; the rest hold a hash.
PLACE_BITS = 31

#: The base rule: too few words, or more than this share of them in repeated windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: Statistics that rules may test, each worked out from the counted ones.
FEATURES = {
    "n_words": "n_words",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_lines_per_100_words": "100 * n_dup_lines / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "shout_share": "n_shout / greatest(n_words, 1)",
}


def _let(value: Column, body) -> Column:
    """body(value) with value worked out once: a lambda variable is evaluated where it is bound."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column, n: Column) -> Column:
    """Words of 3-word windows that occur twice or more, each place counted once.

    Windows are sorted as one long each, hash above place; only a window with a neighbour of the same hash can be a
    repeat. Those are sorted by their words, and equal neighbours are repeats, whatever the hashes. Then the covered
    places are the union of [p, p + 2].
    """
    mask = F.lit((1 << PLACE_BITS) - 1).cast("long")
    window = lambda i: F.shiftleft(F.xxhash64(words[i], words[i + 1], words[i + 2]), PLACE_BITS).bitwiseOR(i.cast("long"))

    def beside_equal(order: Column, same) -> Column:
        """The entries of an order that are the same as the one before or after."""
        last = F.size(order) - 1
        before = lambda x, i: F.when(i > 0, same(x, order[F.greatest(i - 1, F.lit(0))]))
        after = lambda x, i: F.when(i < last, same(x, order[F.least(i + 1, last)]))
        return F.filter(order, lambda x, i: F.coalesce(before(x, i), F.lit(False)) | F.coalesce(after(x, i), F.lit(False)))

    def spelled(x: Column) -> Column:
        return _let(x.bitwiseAND(mask).cast("int"), lambda p: F.struct(words[p].alias("a"), words[p + 1].alias("b"), words[p + 2].alias("c"), p.alias("p")))

    def covered(places: Column) -> Column:
        return F.aggregate(places, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("at")), lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["at"])).alias("n"), x.alias("at")), lambda a: a["n"])

    def repeats(order: Column) -> Column:
        near = beside_equal(order, lambda x, y: F.shiftright(x, PLACE_BITS) == F.shiftright(y, PLACE_BITS))
        exact = _let(F.sort_array(F.transform(near, spelled)), lambda o: beside_equal(o, lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])))
        return _let(F.array_sort(F.transform(exact, lambda x: x["p"])), covered)

    windows = F.transform(F.sequence(F.lit(0), n - 3), window)
    return F.when(n >= 4, _let(F.sort_array(windows), repeats)).otherwise(F.lit(0).cast("long"))


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs with a struct column _q of the counted statistics of the whole text; null counts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))

    def counted(words: Column) -> Column:
        n = F.size(words)
        return F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            _repeat_words(words, n).alias("n_repeat_words"),
            F.regexp_count(text, F.lit(r"\p{Lu}{2,}")).cast("long").alias("n_shout"),
        )

    return docs.withColumn("_q", _let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), counted))


def base_failed(q: str = "_q") -> Column:
    return (F.col(f"{q}.n_words") < MIN_WORDS) | (100 * F.col(f"{q}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{q}.n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def sql(self) -> str:
        return f"({FEATURES[self.feature]} {'>' if self.above else '<='} {self.threshold!r}D)"


@dataclass(frozen=True)
class Rule:
    """A conjunction that rejects, with its share of bad rows on the pruning rows."""

    conditions: tuple[Condition, ...]
    precision: float = 0.0
    covered: int = 0

    def sql(self) -> str:
        return " AND ".join(c.sql() for c in self.conditions)


def _labelled(docs: DataFrame, labels: DataFrame, max_labels: int) -> DataFrame:
    """(bad, prune, features) of a bounded sample of labelled documents, chosen by hash of doc_id.

    Labels with a null doc_id or quality, or with several qualities for one doc_id, teach nothing.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("quality").alias("q2")).where("q = q2")
    total = known.count()
    place = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000))
    sample = save(known.where(place < int(1e6 * min(1.0, max_labels / max(total, 1)))).select("doc_id", (F.col("q") == 0).alias("bad")).limit(2 * max_labels), "labels")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(sample, 2 * max_labels), "doc_id")
    # written before anything else reads them, so that each text is measured once
    measured = save(with_statistics(texts).select("doc_id", "bad", "_q"), "measured")
    stats = measured.where(~base_failed()).select("doc_id", "bad", "_q.*")
    features = stats.select("doc_id", "bad", *(F.expr(e).cast("double").alias(f) for f, e in FEATURES.items()))
    return save(features.select("bad", (F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(3)) == 0).alias("prune"), *FEATURES), "statistics")


def learn_rules(docs: DataFrame, labels: DataFrame, max_labels: int = 20_000, bins: int = 64, max_rules: int = 6, max_conditions: int = 3, precision: float = 0.97, least_covered: int = 5) -> list[Rule]:
    """Sequential covering over documents that pass the base rule.

    A rule grows on two thirds of the labelled rows by the condition with the best FOIL gain and is pruned on
    the rest: conditions go from its end while that does not lower (bad - good) / covered. A rule whose share of bad
    rows over all rows it covers is below `precision`, or that covers fewer than `least_covered` bad rows, ends the
    list. Without labels the list is empty. Ties are settled by the order of FEATURES and bins.

    The list is kept short and coarse on purpose: it has at most `max_rules` rules of at most `max_conditions` conditions,
    and thresholds lie between `bins` quantiles of a statistic. At most 2 * `max_labels` labelled documents teach it. Its
    rules judge all documents.
    """
    rows = _labelled(docs, labels, max_labels)
    names = list(FEATURES)
    cuts = rows.agg(*(F.percentile_approx(f, [k / bins for k in range(1, bins)], 10_000).alias(f) for f in names)).first()
    # a threshold lies halfway between neighbouring quantiles, away from the values on either side
    marks = {f: sorted(set(cuts[f] or [])) for f in names}
    edges = {f: [(a + b) / 2 for a, b in zip(marks[f], marks[f][1:], strict=False)] for f in names}
    binned = save(rows.select("bad", "prune", *(decision_tree(F.col(f), edges[f], compare=lambda v, t: v <= F.lit(t)).alias(f) for f in names)), "binned")
    test = lambda c: F.col(c.feature) > edges[c.feature].index(c.threshold) if c.above else F.col(c.feature) <= edges[c.feature].index(c.threshold)
    both = lambda conditions: F.expr("true") if not conditions else _all(test(c) for c in conditions)

    def tally(where: Column) -> tuple[int, int]:
        found = binned.where(where).agg(F.count_if("bad"), F.count_if(~F.col("bad"))).first()
        return found[0], found[1]

    found: list[Rule] = []
    left = F.expr("true")
    while len(found) < max_rules:
        grown: list[Condition] = []
        while len(grown) < max_conditions:
            best = _best_condition(binned.where(left & ~F.col("prune") & both(grown)), names, edges)
            if best is None or best[0] <= 1e-9:
                break
            grown.append(best[1])
        if not grown:
            break
        worth = []
        for k in range(1, len(grown) + 1):
            bad, good = tally(left & F.col("prune") & both(grown[:k]))
            worth.append(((bad - good) / max(bad + good, 1), -k))
        conditions = tuple(grown[: -max(worth)[1]])
        bad, good = tally(left & both(conditions))
        if bad < least_covered or bad < precision * (bad + good):
            break
        found.append(Rule(conditions, bad / (bad + good), bad + good))
        left = left & ~both(conditions)
    return found


def _all(tests) -> Column:
    joined = F.expr("true")
    for t in tests:
        joined = joined & t
    return joined


def _best_condition(rows: DataFrame, names: list[str], edges: dict[str, list[float]]) -> tuple[float, Condition] | None:
    """The condition of best FOIL gain; the driver sees one count for each (statistic, bin, label)."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("f"), F.col(n).alias("bin")) for k, n in enumerate(names)))).alias("x")
    counts = {(r.f, r.bin, r.bad): r.n for r in rows.select("bad", pairs).groupBy("x.f", "x.bin", "bad").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = [sum(n for (f, _, b), n in counts.items() if f == 0 and b is want) for want in (True, False)]
    if not total[0] or not total[1]:
        return None
    base = log2(total[0] / sum(total))
    best = None
    for k, name in enumerate(names):
        bad = good = 0
        for b, threshold in enumerate(edges[name]):
            bad += counts.get((k, b, True), 0)
            good += counts.get((k, b, False), 0)
            for above, p, n in ((False, bad, good), (True, total[0] - bad, total[1] - good)):
                if p:
                    gain = p * (log2(p / (p + n)) - base)
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, Condition(name, above, threshold))
    return best


def verdict(rules: list[Rule], q: str = "_q") -> Column:
    """The number (from 1) of the first rule that rejects, 0 if none does: ordered Spark conditions."""
    found = None
    for k, rule in enumerate(rules, 1):
        test = F.expr(_qualified(rule.sql(), q))
        found = F.when(test, F.lit(k)) if found is None else found.when(test, F.lit(k))
    return F.lit(0) if found is None else found.otherwise(F.lit(0))


def _qualified(sql: str, q: str) -> str:
    return re.sub(r"\b(n_words|word_chars|n_symbols|n_dup_lines|n_repeat_words|n_shout)\b", rf"{q}.\1", sql)


def _rated(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    rated = with_statistics(rows).withColumn("_base_failed", base_failed())
    return rated.withColumn("_rule", F.when(F.col("_base_failed"), F.lit(0)).otherwise(verdict(rules))).withColumn("_kept", ~F.col("_base_failed") & (F.col("_rule") == 0))


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, _q, _base_failed, _rule, _kept) of every row: statistics, the number of the rejecting rule or 0, the verdict.

    A null text counts as empty and fails the base rule; repeated rows are judged alike; other columns are dropped; an
    empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _rated(rows, learn_rules(docs, labels, **options)).drop("text")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that neither the base rule nor a learned rule rejects, with all of their columns.

    A null text counts as empty and goes; repeated rows stay or go together, null ids like any; extra columns move along
    whatever their names; an empty table gives an empty result.
    """
    rules = learn_rules(docs, labels, **options)
    # a filter on a column that is not deterministic stays above the statistics instead of repeating them
    rated = _rated(packed(docs, "text"), rules).select("_row", "_kept", F.monotonically_increasing_id().alias("_place"))
    return unpacked(rated.where(F.col("_kept") & (F.col("_place") >= 0)))
