"""Mixing sources to target weights by entropy balancing.

Of all document rates that give each source its wanted words and stay between 0 and `most` copies, the ones
nearest to 1 in entropy are tilted exponentials, rate = min(most, exp(tilt * size / mean size of the source)). The
tilts solve a convex dual with one unknown for each source; distributed Newton steps on exact histograms of (source,
size) find them. Rates become whole copies so that rounding errors cancel from the largest sizes down.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import WORD, packed, save, ship, small, unpacked

#: Documents of one cell that are put in order at once, about, when only some of them get a further copy.
SLICE = 64

#: The tilt of a source whose target is nothing.
NEVER = -1e9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """A source that joins like any other: null apart from every string."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def _measured(docs: DataFrame) -> DataFrame:
    """_row (all columns), doc_id, source, _s (source key), _n (words) and _h (hash that orders documents of a cell)."""
    rows = packed(docs, "doc_id", "source", "text")
    return rows.select("_row", "doc_id", "source", _key(F.col("source")).alias("_s"), word_count(F.col("text")).alias("_n"), F.xxhash64(F.col("doc_id"), F.col("text").cast("string")).alias("_h"))


def cyclic_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """(_s, weight): sources by code point, null last, weigh 1, 2, ..., cycle, repeating.

    sources has one row for each source: the configuration of a mix, not its documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    return sources.select(_key(F.col("source")).alias("_s"), ((F.row_number().over(order) - 1) % cycle + 1).cast("double").alias("weight"))


def water_fill(sources: DataFrame, most: float) -> DataFrame:
    """(_s, size, weight) with target: the whole size shared by weight, none above most * size; the excess is shared anew.

    Each round fixes the sources whose share reaches their limit; only sums reach the driver.
    """
    limit = F.lit(most) * F.col("size")
    everything = float(sources.agg(F.sum("size")).first()[0] or 0)
    level = 0.0
    full = F.lit(False)
    for _ in count():
        r = sources.agg(F.sum(F.when(full, limit)).alias("fixed"), F.sum(F.when(~full, F.col("weight"))).alias("open"), F.count_if(full).alias("n")).first()
        if not r["open"]:
            break
        level = (everything - (r["fixed"] or 0.0)) / r["open"]
        full = F.col("weight") * F.lit(level) >= limit
        if sources.where(full).count() == r["n"]:
            break
    return sources.withColumn("target", F.when(full, limit).otherwise(F.col("weight") * F.lit(level)))


def _solve(hist: DataFrame, sources: DataFrame, most: float, tolerance: float = 1e-7, rounds: int = 60) -> DataFrame:
    """(_s, target, scale, tilt): Newton steps on the logarithm of each source's words, kept within a bracket.

    A source that is not solved after `rounds` is an error. hist: (_s, _n, n). A source whose target is its limit gets a null tilt: all of its documents have `most` copies.
    """
    state = save(
        sources.withColumns({"scale": F.try_divide(F.col("size").cast("double"), F.col("n_docs")), "tilt": F.when((F.col("size") > 0) & (F.col("target") <= 0), F.lit(NEVER)).when((F.col("size") > 0) & (F.col("target") < most * F.col("size") * (1 - 1e-12)), F.log(F.try_divide(F.col("target"), F.col("size").cast("double"))))})
        .select("_s", "target", "scale", "tilt", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), (F.col("tilt").isNull() | (F.col("tilt") == NEVER)).alias("done")), "state")
    n_sources = state.count()
    for _ in range(rounds):
        if state.where("not done").isEmpty():
            break
        open_rows = state.where("not done")
        x = F.try_divide(F.col("_n").cast("double"), F.col("scale"))
        rate = F.exp(F.least(F.col("tilt") * x, F.log(F.lit(most))))
        words = F.col("n") * F.col("_n") * rate
        sums = hist.join(small(open_rows, n_sources), "_s").groupBy("_s").agg(F.sum(words).alias("g"), F.sum(F.when(F.col("tilt") * x < F.log(F.lit(most)), words * x)).alias("dg"))
        gap = F.log(F.try_divide(F.greatest("g", F.lit(1e-300)), F.col("target")))
        low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - F.try_divide(gap * F.col("g"), F.col("dg"))
        spread = F.greatest(F.abs("tilt"), F.lit(1.0))
        halved = F.coalesce((low + high) / 2, low + spread, high - spread)
        inside = (newton > F.coalesce(low, F.lit(float("-inf")))) & (newton < F.coalesce(high, F.lit(float("inf")))) & (F.abs(newton - F.col("tilt")) <= 4 * spread)
        near = F.abs(gap) <= tolerance
        step = F.when(F.coalesce(inside, F.lit(False)), newton).otherwise(halved)
        moved = state.join(small(save(sums, "sums"), n_sources), "_s", "left")
        state = save(moved.select("_s", "target", "scale", F.when(F.col("done") | F.coalesce(near, F.lit(True)), F.col("tilt")).otherwise(step).alias("tilt"), F.coalesce(low, "low").alias("low"), F.coalesce(high, "high").alias("high"), (F.col("done") | F.coalesce(near, F.lit(True))).alias("done")), "state")
    if not state.where("not done").isEmpty():
        raise ValueError(f"no tilts within {tolerance} of the targets after {rounds} rounds")
    return state.select("_s", "target", "scale", "tilt")


def _round(most: int):
    def work(cells: pd.DataFrame) -> pd.DataFrame:
        """Whole copies of one source's cells; what rounding leaves is carried on to the next smaller size."""
        cells = cells.sort_values("_n", ascending=False, kind="stable")
        carry, all_copies = 0.0, []
        for size, n, rate in zip(cells["_n"].tolist(), cells["n"].tolist(), cells["rate"].tolist(), strict=True):
            if size == 0:
                all_copies.append(n)
                continue
            wanted = n * rate * size + carry
            copies = min(max(int(np.floor(wanted / size + 0.5)), 0), most * n)
            carry = wanted - copies * size
            all_copies.append(copies)
        n = cells["n"].to_numpy()
        copies = np.array(all_copies, dtype=np.int64)
        return pd.DataFrame({"_s": cells["_s"], "_n": cells["_n"], "n": n, "base": copies // n, "more": copies % n})

    return work


def plan_mix(measured: DataFrame, weights: DataFrame, most: int = 3) -> DataFrame:
    """One row for each cell (source, size): _s, _n, base copies, last, tied, source_size, target.

    Documents of a cell with an _h below `last` get one more copy than base (null: none does). So do those at `last`, or
    only `tied` of them where that is not null. measured: (_s, _n, _h) of all documents; weights: (_s, weight), sources
    without a weight weigh 0.
    """
    ship(measured.sparkSession)
    hist = save(measured.groupBy("_s", "_n").agg(F.count(F.lit(1)).alias("n")), "histogram")
    sizes = hist.groupBy("_s").agg(F.sum(F.col("_n") * F.col("n")).alias("size"), F.sum("n").alias("n_docs"))
    sources = save(water_fill(save(sizes.join(weights, "_s", "left").fillna(0.0, ["weight"]), "sources"), float(most)), "targets")
    n_sources = sources.count()
    solved = _solve(hist, sources, float(most))
    x = F.try_divide(F.col("_n").cast("double"), F.col("scale"))
    rate = F.when(F.col("tilt").isNull(), F.lit(float(most))).otherwise(F.exp(F.least(F.col("tilt") * x, F.log(F.lit(float(most))))))
    rated = hist.join(small(solved, n_sources), "_s").select("_s", "_n", "n", rate.alias("rate"))
    # a source's cells are its distinct sizes: a histogram, however many documents it stands for
    cells = save(rated.groupBy("_s").applyInPandas(_round(most), "_s string, _n long, n long, base long, more long"), "cells")
    n_cells = cells.count()
    limits = _limits(measured, cells.where("more > 0"), n_cells)
    named = small(sources.select("_s", F.col("size").alias("source_size"), "target"), n_sources)
    return save(cells.join(limits, ["_s", "_n"], "left").join(named, "_s").select("_s", "_n", "base", "last", "tied", "source_size", "target"), "plan")


def _crossing(counts: DataFrame, order: str, wanted: str) -> DataFrame:
    """Of counted (cell, order, wanted, k), the row of each cell in which its number `wanted` falls, with `left`: how many of that row."""
    upto = F.sum("k").over(Window.partitionBy("_s", "_n").orderBy(order))
    return counts.withColumn("_upto", upto).where((F.col("_upto") >= F.col(wanted)) & (F.col("_upto") - F.col("k") < F.col(wanted))).withColumn("left", F.col(wanted) - F.col("_upto") + F.col("k"))


def _limits(measured: DataFrame, cells: DataFrame, n_cells: int) -> DataFrame:
    """(_s, _n, last, tied): the hash of the document that is number `more` in the order of hashes of its cell.

    Hashes are counted by ranges, as many as the cell has documents by SLICE, then one by one in the range in which the
    wanted one falls; so no task holds a large cell or the copies of one document. tied: how many rows of the hash
    `last` the number takes, null where it takes them all.
    """
    cells = cells.withColumn("bits", F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / SLICE))).cast("int"))
    # the range is the leading bits of the hash, kept in signed order
    member = measured.select("_s", "_n", "_h").join(small(cells, n_cells), ["_s", "_n"]).withColumn("range", F.expr("if(bits = 0, 0L, shiftright(_h, 64 - bits))"))
    counts = member.groupBy("_s", "_n", "more", "range").agg(F.count(F.lit(1)).alias("k"))
    wanted = save(_crossing(counts, "range", "more").select("_s", "_n", "range", F.col("left").alias("rest")), "crossing")
    hashes = member.join(small(wanted, n_cells), ["_s", "_n", "range"]).groupBy("_s", "_n", "rest", "_h").agg(F.count(F.lit(1)).alias("k"))
    return _crossing(hashes, "_h", "rest").select("_s", "_n", F.col("_h").alias("last"), F.when(F.col("left") < F.col("k"), F.col("left")).alias("tied"))


def _dealt(ties: DataFrame) -> DataFrame:
    """Rows (_s, _n, tied, ...) that are alike within a cell with _more: true for exactly `tied` of each cell.

    The rows are written once with a number each; numbers are counted by the partition that wrote them, then put in order
    within one partition, so no task holds all rows of a large group.
    """
    rows = save(ties.withColumn("_u", F.monotonically_increasing_id()), "ties")
    narrow = rows.select("_s", "_n", "tied", "_u", F.shiftright("_u", 33).alias("part"))
    counts = narrow.groupBy("_s", "_n", "tied", "part").agg(F.count(F.lit(1)).alias("k"))
    at = save(_crossing(counts, "part", "tied").select("_s", "_n", "part", "left"), "tie_parts")
    rank = F.row_number().over(Window.partitionBy("_s", "_n").orderBy("_u"))
    n = at.count()  # at most one row a cell
    last = narrow.join(small(at, n), ["_s", "_n", "part"]).withColumn("rank", rank).where(F.col("rank") == F.col("left")).select("_s", "_n", F.col("_u").alias("_last_u"))
    return rows.join(small(last, n), ["_s", "_n"]).withColumn("_more", F.col("_u") <= F.col("_last_u")).drop("_u", "_last_u")


def apply_plan(measured: DataFrame, plan: DataFrame) -> DataFrame:
    """measured with copies and the plan's columns; of rows that are alike as many get a further copy as the plan says."""
    joined = measured.join(small(plan, plan.count()), ["_s", "_n"])
    further = joined.withColumn("_more", F.coalesce((F.col("_h") < F.col("last")) | ((F.col("_h") == F.col("last")) & F.col("tied").isNull()), F.lit(False)))
    if not plan.where("tied is not null").isEmpty():
        tie = F.coalesce((F.col("_h") == F.col("last")) & F.col("tied").isNotNull(), F.lit(False))
        further = further.where(~tie).unionByName(_dealt(joined.where(tie)))
    return further.withColumn("copies", F.col("base") + F.col("_more").cast("long")).drop("_more")


def mix_digest(docs: DataFrame, weights: DataFrame | None = None, most: int = 3) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies): words that a mix takes of each document, repeats counted.

    A null text has no words and is taken once; a null source is a source of its own; of rows with equal doc_id and
    text some may get one copy more than others; a document has at most `most` copies; extra columns are ignored; an
    empty table gives an empty result.
    """
    kept = save(_measured(docs).select("doc_id", "source", "_s", "_n", "_h"), "measured")
    mixed = apply_plan(kept, plan_mix(kept, weights or cyclic_weights(kept.select("source").distinct()), most))
    return mixed.select("doc_id", F.col("_n").alias("size"), "source_size", "target", (F.col("_n") * F.col("copies")).alias("taken"), "copies")


def mix_documents(docs: DataFrame, weights: DataFrame | None = None, most: int = 3) -> DataFrame:
    """docs with each document as often as the mix takes it, with all of its columns.

    Nulls, repeated rows and empty tables are as in mix_digest(); extra columns move along whatever their names.
    """
    kept = save(_measured(docs).select("source", "_s", "_n", "_h"), "measured")
    plan = plan_mix(kept, weights or cyclic_weights(kept.select("source").distinct()), most)
    mixed = apply_plan(_measured(docs), plan.drop("source_size", "target")).where("copies > 0")
    return unpacked(mixed.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy")))
