"""Near copies of embeddings by collision counting on sorted one-dimensional projections.

A table is a family of `levels` sets of random directions. A vector goes to the line of the direction (and
sign) on which its projection is largest in each set, at the value of that projection on the last; a line is a
sorted list of values. Vectors on the same line within a window around each other collide. Pairs are counted over all
tables, and pairs with enough collisions are verified by their cosine in double precision. The number that is
enough is calibrated by simulation: pairs exactly at the threshold must reach it with the wanted recall. More levels
mean shorter lines; they are chosen from the number of vectors, so a vector's collisions with strangers stay bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import save, ship, small
from lexmill.llm.components import Forest, connected_components

DIRECTIONS = 48
#: Rows of one line that one task holds at once; longer lines are dealt out as pairs of blocks.
BLOCK = 4096
#: Pairs that a task expands at once.
PAIRS = 1 << 18


def directions(dim: int, tables: int, levels: int, seed: int = 7) -> np.ndarray:
    """(tables, levels, DIRECTIONS, dim) Gaussian directions, the same on every executor."""
    return np.random.default_rng(seed).standard_normal((tables, levels, DIRECTIONS, dim))


def lines(vectors: np.ndarray, planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For unit rows: (n, tables) line numbers and (n, tables) values."""
    tables, levels = planes.shape[:2]
    number = np.zeros((len(vectors), tables), dtype=np.int64)
    value = np.zeros((len(vectors), tables))
    for t in range(tables):
        for level in range(levels):
            projected = vectors @ planes[t, level].T
            at = np.argmax(np.abs(projected), axis=1)
            top = projected[np.arange(len(vectors)), at]
            number[:, t] = number[:, t] * (2 * DIRECTIONS) + 2 * at + (top < 0)
            value[:, t] = np.abs(top)
    return number, value


def calibrate(dim: int, cosine: float, count: int, recall: float = 0.999, seed: int = 11) -> tuple[int, int, int, float]:
    """(tables, levels, least collisions, window) for groups of up to `count` vectors.

    The window holds the projections of 98 of 100 pairs at the threshold; tables are added until a count of at least 2
    has the wanted recall by the binomial law at the simulated collision rate. If 4096 tables do not give that, it is
    an error: there is no answer with less recall than was asked for.
    """
    levels = max(1, math.ceil(math.log(max(count, 2) / 32) / math.log(2 * DIRECTIONS))) if count > 32 else 1
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((4000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((4000, dim))
    if dim > 1:
        y -= (y * x).sum(axis=1, keepdims=True) * x
        y = cosine * x + math.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    else:  # on a line vectors are equal or opposite
        y = x
    probe = directions(dim, 4, levels, seed)
    (nx, vx), (ny, vy) = lines(x, probe), lines(y, probe)
    same, gap = nx == ny, np.abs(vx - vy)
    window = float(np.quantile(gap[same], 0.98)) if same.any() else 1.0
    rate = float((same & (gap <= window)).mean()) * 0.98  # a little under what was seen
    for tables in range(16, 4097, 8):
        tail, least = 1.0, 0
        while True:
            tail -= math.comb(tables, least) * rate**least * (1 - rate) ** (tables - least)
            if tail < recall:
                break
            least += 1
        if least >= 2:
            return tables, levels, least, window
    raise ValueError(f"no number of tables up to 4096 finds pairs at {cosine} of {dim} dimensions and groups of {count} with a recall of {recall}")


def marked_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, label, v, h1, h2) of every row; h1 and h2, 128 bits that stand for label and vector, are null where it links with nothing.

    A row may link if its label is not null and its vector has finite components, one of them not zero.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    links = F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    usable = F.coalesce(links, F.lit(False))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v"))
    return rows.withColumns({"h1": F.when(usable, F.xxhash64("label", "v")), "h2": F.when(usable, F.xxhash64("v", "label", F.lit(1)))})


def _scaled(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors divided by a power of two near their largest component: squares neither overflow nor vanish, and nothing is rounded."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.ldexp(flat, -np.frexp(np.abs(flat).max(axis=1, keepdims=True))[1])


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    flat = _scaled(column, dim)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _window_pairs(window: float):
    """Pairs of rows on one line (and block pair) within the window: rows come sorted by line, block and value."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def solve(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            line, block, value, rep, mine = cols
            group = np.cumsum(np.concatenate([[0], (line[1:] != line[:-1]) | (block[1:] != block[:-1])]))
            # groups lie apart from each other on one axis, so that one search serves them all
            least = value.min()
            place = group * (float(value.max() - least) + 2 * window + 1) + (value - least)
            n = np.searchsorted(place, place + window, side="right") - np.arange(len(place)) - 1
            inside = (block >> 20) == (block & ((1 << 20) - 1))
            upto = np.cumsum(n)
            start = 0
            while start < len(place):
                # rows whose pairs come to PAIRS; one row has at most the pairs of its group
                before = int(upto[start - 1]) if start else 0
                stop = max(int(np.searchsorted(upto, before + PAIRS, side="right")), start + 1)
                some = n[start:stop]
                left = np.repeat(np.arange(start, start + len(some)), some)
                right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(some) - some, some)
                # a pair of blocks reports what meets across them, a block with itself what meets inside
                good = (rep[left] != rep[right]) & (inside[left] | (mine[left] != mine[right]))
                a, b = np.minimum(rep[left], rep[right])[good], np.maximum(rep[left], rep[right])[good]
                start = stop
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) if len(cols[0]) else np.zeros(0, dtype=bool)
            cut = int(np.argmax(same)) if len(same) else 0
            held = [c[cut:] for c in cols]
            if cut:
                yield from solve([c[:cut] for c in cols])
        if held is not None and len(held[0]):
            yield from solve(held)

    return work


def near_vectors(table: DataFrame, cosine: float = 0.93, recall: float = 0.999) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label).

    Vectors link if their labels are equal and their cosine in double precision is at least `cosine`; those that are
    null, zero or hold null or non-finite components, and those without a label, link with nothing. Vectors of
    different lengths never link. Equal vectors of a label are one class: its members
    link with each other, and classes are compared by one representative. component_id is the smallest vec_id
    reachable; rows without a vec_id count as links and have the component of their class, if any. Repeated rows stay. An
    empty table gives no rows; other columns are ignored.
    """
    spark = table.sparkSession
    ship(spark)
    rows = marked_vectors(table)
    # a class is a label and a vector; it gets its number when it is written
    grouped = rows.where("h1 is not null").groupBy("h1", "h2", "label", "v").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("members"))
    classes = save(grouped.withColumn("rep", F.monotonically_increasing_id()), "classes")
    shapes = classes.groupBy(F.size("v").alias("dim"), "label").count().groupBy("dim").agg(F.max("count").alias("most")).collect()  # one row for each length of vector
    found = None
    for shape in shapes:
        part = _links_of(classes.where(F.size("v") == shape["dim"]), shape["dim"], shape["most"], cosine, recall)
        found = part if found is None else found.unionAll(part)
    bare = rows.select("vec_id", "h1", "h2")
    if found is None:
        return bare.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = save(found, "links")
    others = links.where("n is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    linked = connected_components(links.where("b is not null").select("a", "b"))
    rooted = save(classes.join(linked.select(F.col("node").alias("rep"), "component"), "rep", "left").select("rep", "h1", "h2", "first", "members", F.coalesce("component", "rep").alias("root")), "rooted")
    least = save(rooted.groupBy("root").agg(F.min("first").alias("least")), "least")
    named = save(rooted.join(least, "root").join(others, "rep", "left").select("h1", "h2", (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("links"), "least"), "named")
    out = bare.join(named, ["h1", "h2"], "left")
    component = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _links_of(classes: DataFrame, dim: int, most: int, cosine: float, recall: float) -> DataFrame:
    """(a, b, n) of classes of one vector length, from verified links: (a, null, n) adds n vectors that a's link to, and
    (a, b, null) are links enough to connect all that are linked.
    """
    tables, levels, least, window = calibrate(dim, cosine, most, recall)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = directions(dim, tables, levels)
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                number, value = lines(_unit(batch.column(2), dim), planes)
                n = batch.num_rows
                spread = lambda c: np.repeat(batch.column(c).to_numpy(zero_copy_only=False), tables)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(spread(0)), pa.array(spread(1)), pa.array(np.tile(np.arange(tables), n)), pa.array(number.reshape(-1)), pa.array(value.reshape(-1))], ["rep", "kind", "turn", "number", "value"])

    placed = classes.select("rep", F.xxhash64("label").alias("kind"), "v").mapInArrow(place, "rep long, kind long, turn long, number long, value double")
    entries = save(placed.select(F.xxhash64("kind", "turn", "number").alias("line"), "value", "rep"), "entries")
    hot = save(entries.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("line", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks")), "hot")
    n_hot = hot.count()
    if n_hot:
        mine = F.coalesce(F.pmod(F.xxhash64("rep"), F.col("blocks")), F.lit(0).cast("long"))
        dealt = entries.join(small(hot, n_hot), "line", "left").withColumn("mine", mine)
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1).cast("long")) - 1)))
        dealt = dealt.select("line", (F.least("mine", "other") * (1 << 20) + F.greatest("mine", "other")).alias("block"), "value", "rep", "mine")
    else:
        dealt = entries.select("line", F.lit(0).cast("long").alias("block"), "value", "rep", F.lit(0).cast("long").alias("mine"))
    met = dealt.repartition("line", "block").sortWithinPartitions("line", "block", "value").mapInArrow(_window_pairs(window), "a long, b long")
    counted = save(met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("a", "b"), "candidates")
    left = classes.select(F.col("rep").alias("a"), F.col("label").alias("la"), F.col("v").alias("va"), F.col("members").alias("ma"))
    right = classes.select(F.col("rep").alias("b"), F.col("label").alias("lb"), F.col("v").alias("vb"), F.col("members").alias("mb"))
    pairs = counted.join(right, "b").join(left, "a").where("la = lb").select("a", "b", "va", "vb", "ma", "mb")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for whole in batches:
            for start in range(0, whole.num_rows, 5000):
                batch = whole.slice(start, 5000)
                x, y = (_scaled(batch.column(k), dim) for k in (2, 3))
                dot = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
                good = dot >= cosine
                a, b, more_a, more_b = (batch.column(k).to_numpy(zero_copy_only=False)[good] for k in (0, 1, 5, 4))
                nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
                n = np.zeros(len(nodes), dtype=np.int64)
                np.add.at(n, place, np.concatenate([more_a, more_b]))
                new = np.array(forest.grown(a.tolist(), b.tolist()), dtype=bool)
                a, b = a[new], b[new]
                columns = [np.concatenate([nodes, a]), np.concatenate([np.zeros(len(nodes), np.int64), b]), np.concatenate([n, np.zeros(len(a), np.int64)])]
                is_link = np.concatenate([np.zeros(len(nodes), bool), np.ones(len(a), bool)])
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64(), mask=~is_link), pa.array(columns[2], pa.int64(), mask=is_link)], ["a", "b", "n"])

    return pairs.mapInArrow(verify, "a long, b long, n long")
