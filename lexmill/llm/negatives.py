"""Hard negatives by distributed radix selection of integer scores.

Rows are dealt to groups and anchors to blocks; every block meets every group once, as one pair of Arrow tables, where
their scores are one matrix product. A window is a range of scores of one anchor, with a number of rows wanted from its
top. Each round counts scores by digit within every open window; the counts of all groups are summed, the digit that holds
the k-th score becomes the window, and the next round counts in it more finely. When a window's digit is one score or few
rows, the rows at or above it are gathered, at most k from each group. So what moves is vectors, counts of at most k
digits a window and group, and the rows that are wanted; neither ties nor equal vectors make a group larger.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import save, ship

#: Bits of a score that one round settles.
DIGIT_BITS = 10
#: Anchors of a block, and rows of a group, about.
BLOCK, GROUP = 4096, 8192
#: Anchors whose scores a task holds at once.
SLICE = 256
#: Rows beyond those wanted that a digit may hold to be gathered without another round.
SLACK = 32
#: Scores beyond this count as this, so that differences of scores stay within a long.
LIMIT = 1 << 61


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, v) of the rows that take part; each component x of v is floor(scale * x), x as double.

    Rows with a null vec_id, label or vector, or a null or non-finite component, take no part. Components that fit no
    long become the nearest long.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", x.alias("v")).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    return rows.withColumn("v", F.transform("v", lambda c: F.floor(c * F.lit(float(scale))).cast("long")))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = [np.asarray(c.flatten()) for c in column.chunks] or [np.zeros(0, dtype=np.int64)]
    return np.concatenate(flat).reshape(len(column), dim)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _scores(x: np.ndarray, y: np.ndarray, largest: int) -> np.ndarray:
    """Exact inner products; largest is a bound of them: below 2^53 doubles hold every partial sum."""
    if largest < 1 << 53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    exact = x.astype(object) @ y.astype(object).T if x.shape[1] else np.zeros((len(x), len(y)), dtype=object)
    return np.clip(exact, -LIMIT, LIMIT).astype(np.int64)


def _inside(anchors: pa.Table, rows: pa.Table, dim: int, largest: int, same: bool):
    """For slices of anchors and each of their windows in turn: (numbers of the anchors, slots, lows, tops, needs, places of window and row, scores there)."""
    x, y = _matrix(anchors.column("v"), dim), _matrix(rows.column("v"), dim)
    kind, kinds = _numbers(anchors, "kind"), _numbers(rows, "kind")
    number, numbers = _numbers(anchors, "n"), _numbers(rows, "n")
    windows = [w.as_py() for w in anchors.column("windows")]
    for start in range(0, len(x), SLICE):
        part = slice(start, start + SLICE)
        score = _scores(x[part], y, largest)
        fits = (kind[part, None] == kinds[None, :]) == same
        if same:
            fits &= number[part, None] != numbers[None, :]
        some = windows[part]
        for turn in range(max(map(len, some))):
            at = np.array([i for i, w in enumerate(some) if len(w) > turn])
            slot, low, top, need = (np.array([some[i][turn][k] for i in at], dtype=np.int64) for k in ("slot", "low", "top", "need"))
            mine = score[at]
            w, r = np.nonzero(fits[at] & (mine >= low[:, None]) & (mine <= top[:, None]))
            yield number[part][at], slot, low, top, need, w, r, mine[w, r]


def _table(columns: dict[str, list[np.ndarray]]) -> pa.Table:
    return pa.table({k: pa.array(np.concatenate(v) if v else np.zeros(0, dtype=np.int64), pa.int64()) for k, v in columns.items()})


def _count_digits(dim: int, largest: int, same: bool):
    def work(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        """(n, slot, top, low, count): the digits of each window from its top on, until they hold what is needed."""
        out: dict[str, list[np.ndarray]] = {k: [] for k in ("n", "slot", "top", "low", "count")}
        if anchors.num_rows and rows.num_rows:
            for number, slot, low, top, need, w, _, score in _inside(anchors, rows, dim, largest, same):
                shift = np.array([max(0, int(v).bit_length() - DIGIT_BITS) for v in top - low], dtype=np.int64)
                digit = (top[w] - score) >> shift[w]
                counts = np.bincount((w << DIGIT_BITS) + digit, minlength=len(slot) << DIGIT_BITS).reshape(len(slot), -1)
                # a digit behind those that hold enough here cannot hold the k-th score of all groups
                wanted = (counts > 0) & (np.cumsum(counts, axis=1) - counts < need[:, None])
                i, d = np.nonzero(wanted)
                upper = top[i] - (d.astype(np.int64) << shift[i])
                for k, v in zip(out, (number[i], slot[i], upper, np.maximum(low[i], upper - (np.int64(1) << shift[i]) + 1), counts[i, d]), strict=True):
                    out[k].append(v)
        return _table(out)

    return work


def _gather(dim: int, largest: int, same: bool):
    def work(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        """(n, slot, id, score): of each window the first rows that it needs, by score and then by id."""
        out: dict[str, list[np.ndarray]] = {k: [] for k in ("n", "slot", "id", "score")}
        if anchors.num_rows and rows.num_rows:
            ids = _numbers(rows, "vec_id")
            for number, slot, _, _, need, w, r, score in _inside(anchors, rows, dim, largest, same):
                order = np.lexsort((ids[r], -score, w))
                w, r, score = w[order], r[order], score[order]
                rank = np.arange(len(w)) - np.searchsorted(w, w)
                first = rank < need[w]
                for k, v in zip(out, (number[w], slot[w], ids[r], score), strict=True):
                    out[k].append(v[first])
        return _table(out)

    return work


class _Grid:
    """Rows of one vector length and the anchors among them, dealt to groups and blocks."""

    def __init__(self, rows: DataFrame, dim: int, n_rows: int, n_anchors: int, largest: int):
        self.rows, self.dim, self.largest = rows, dim, largest
        self.blocks = max(1, -(-n_anchors // BLOCK))
        self.groups = max(1, -(-n_rows // GROUP), min(24, -(-n_rows // 256)))
        self.parts = min(4096, 2 * self.blocks * self.groups)

    def _meet(self, windows: DataFrame, work, schema: str) -> DataFrame:
        """work on every block of anchors with (n, slot, low, top, need) windows and every group of rows."""
        listed = windows.groupBy("n").agg(F.collect_list(F.struct("slot", "low", "top", "need")).alias("windows"))  # a few for each anchor
        deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        own = lambda *names: [F.col(c).alias(c) for c in names]  # noqa: E731  # columns of a side's own, as both come from one table
        anchors = self.rows.where("anchor").select(*own("n", "kind", "v")).join(listed, "n").select("*", deal("n", self.blocks).alias("a"), every(self.groups).alias("g"))
        rows = self.rows.select(*own("n", "vec_id", "kind", "v"), deal("n", self.groups).alias("g"), every(self.blocks).alias("a"))
        left, right = (side.repartition(self.parts, "a", "g").groupBy("a", "g") for side in (anchors, rows))
        return left.cogroup(right).applyInArrow(work, schema)

    def first_of(self, windows: DataFrame, same: bool) -> DataFrame:
        """(n, slot, id, score, rank): for each window (n, slot, low, top, need) the first `need` rows by score, highest first, then by id.

        same: rows of the anchor's label but itself, else rows of other labels.
        """
        live, settled = save(windows.withColumn("wanted", F.col("need")), "windows"), []
        while not live.isEmpty():
            counts = self._meet(live, _count_digits(self.dim, self.largest, same), "n long, slot long, top long, low long, count long")
            counts = counts.groupBy("n", "slot", "top", "low").agg(F.sum("count").alias("count"))
            downwards = Window.partitionBy("n", "slot").orderBy(F.desc("top"))
            upto = counts.withColumns({"upto": F.sum("count").over(downwards), "last": F.lead("top").over(downwards).isNull()})
            held = live.select("n", "slot", "need", "wanted", F.col("low").alias("floor"))
            met = upto.join(held, ["n", "slot"]).where((F.col("upto") - F.col("count") < F.col("need")) & ((F.col("upto") >= F.col("need")) | F.col("last")))
            few = (F.col("upto") <= F.col("need") + SLACK) | (F.col("top") == F.col("low"))
            low = F.when(F.col("upto") < F.col("need"), F.col("floor")).otherwise(F.col("low"))
            found = save(met.select("n", "slot", "top", low.alias("low"), (F.col("need") - F.col("upto") + F.col("count")).alias("need"), "wanted", few.alias("few")), "digits")
            settled.append(found.where("few").select("n", "slot", "low"))
            live = found.where(~F.col("few")).drop("few")
        if not settled:
            return live.select("n", "slot", F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("score"), F.lit(0).alias("rank"))
        lows = settled[0]
        for more in settled[1:]:
            lows = lows.unionAll(more)
        final = windows.drop("low").join(lows, ["n", "slot"])
        rows = self._meet(final, _gather(self.dim, self.largest, same), "n long, slot long, id long, score long").join(windows.select("n", "slot", "need"), ["n", "slot"])
        order = Window.partitionBy("n", "slot").orderBy(F.desc("score"), "id")
        return save(rows.withColumn("rank", F.row_number().over(order)).where("rank <= need").drop("need"), "first")


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over rows of (vec_id, embedding, label).

    anchors is a condition on vec_id. An anchor's positives are its first `positives` other rows of its label; for each, the
    first `negatives` rows of other labels whose score is between least and most hundredths of the positive's are
    returned, ranked from 1. Scores are inner products of quantised vectors; higher ones come first, then smaller vec_ids.
    Rows that quantised() leaves out take no part. Vectors of another length than the anchor's never meet it. Repeated rows
    are rows of their own: as anchors, positives and negatives. An anchor without positives, and a positive without
    negatives, gives no row; an empty table gives none; other columns are ignored. Scores beyond 2^61 count as 2^61.
    """
    spark = vectors.sparkSession
    ship(spark)
    marked = quantised(vectors, scale).select(F.monotonically_increasing_id().alias("n"), "vec_id", F.xxhash64("label").alias("kind"), "v", F.coalesce(anchors, F.lit(False)).alias("anchor"))
    rows = save(marked, "rows")
    size = F.size("v").alias("dim")
    largest = F.array_max(F.transform("v", lambda c: F.abs(c.cast("decimal(20,0)"))))
    shapes = rows.groupBy(size).agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("anchors"), F.max(largest).alias("largest")).where("anchors > 0").collect()  # one row for each length of vector
    found = None
    for shape in shapes:
        bound = min(LIMIT, shape["dim"] * int(shape["largest"] or 0) ** 2)
        grid = _Grid(rows.where(F.size("v") == shape["dim"]), shape["dim"], shape["n"], shape["anchors"], shape["dim"] * int(shape["largest"] or 0) ** 2)
        long = lambda v: F.lit(v).cast("long")
        whole = grid.rows.where("anchor").select("n", long(0).alias("slot"), long(-bound).alias("low"), long(bound).alias("top"), long(positives).alias("need"))
        near = grid.first_of(whole, same=True).select("n", F.col("rank").cast("long").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        score = F.col("positive_score").cast("decimal(20,0)")
        low, top = F.ceil(score * least / 100).cast("long"), F.floor(score * most / 100).cast("long")
        windows = near.select("n", "slot", low.alias("low"), top.alias("top"), long(negatives).alias("need")).where("low <= top")
        chosen = grid.first_of(windows, same=False).select("n", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        part = chosen.join(near, ["n", "slot"]).join(grid.rows.select("n", F.col("vec_id").alias("anchor_id")), "n").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
        found = part if found is None else found.unionAll(part)
    if found is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return found
