"""SimHash near-dedup: fingerprints, pigeonring candidates and components of linked fingerprints.

A fingerprint has 64 bits in PARTS cyclic parts. If two fingerprints differ in at most `distance` bits, then
some part starts a chain of consecutive parts in which the first j parts differ in at most
floor(j * distance / PARTS) bits, for every j (the pigeonring principle). Candidates share a key made of such
a chain: one side writes its own chain values, the other all values within the chain's budgets. The
full Hamming distance decides. Rows of a key are compared in a task; within a key only a spanning forest of
the links leaves it, so a large group of near copies costs links in proportion to its members.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import BROADCAST_ROWS, batches_of, packed, released, save, ship, small, unpacked
from lexmill.llm.components import connected_components

#: Widths of the cyclic parts of a fingerprint.
PARTS = (13, 13, 13, 13, 12)
OFFSETS = tuple(int(x) for x in np.cumsum((0, *PARTS[:-1])))

#: Rows of one key that one task compares at once; larger keys are dealt out as pairs of blocks.
BLOCK = 4096


def fingerprint(text: str | None, width: int = 4) -> int:
    """The 64-bit fingerprint of a text as a signed integer; 0 for a text without words or a null."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        starts = [0, *(e + 1 for e in ends)]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], 42) for s, e in zip(starts, ends[width - 1 :], strict=False)]
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 65_536):
        part = np.array(hashes[k : k + 65_536], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def text_keys(text: str = "text") -> tuple[Column, Column]:
    """t1 and t2, 128 bits that stand for a text."""
    value = F.col(text).cast("string")
    return F.xxhash64(value).alias("t1"), F.xxhash64(value, F.lit(1)).alias("t2")


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, t1, t2, fp) of every row; whole texts, one Arrow batch at a time."""
    ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            found = [fingerprint(batch.column(3)[k].as_py(), width) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(found, pa.int64())], ["doc_id", "t1", "t2", "fp"])

    return docs.select(F.col("doc_id").cast("long"), *text_keys(), F.col("text").cast("string")).mapInArrow(work, "doc_id long, t1 long, t2 long, fp long")


def chain_masks(start: int, length: int, distance: int) -> list[int]:
    """All differences that a chain's budgets allow, as masks over the chain's key; the first is 0."""
    masks = [(0, 0)]
    for j in range(length):
        width = PARTS[(start + j) % len(PARTS)]
        budget = (j + 1) * distance // len(PARTS)
        grown = []
        for mask, used in masks:
            for k in range(budget - used + 1):
                for bits in combinations(range(width), k):
                    grown.append(((mask << width) | sum(1 << x for x in bits), used + k))
        masks = grown
    return [m for m, _ in masks]


def chain_keys(start: int, length: int):
    """The key of the chain that begins at a part, as a column over fp."""
    key = F.lit(start).cast("long")
    for j in range(length):
        p = (start + j) % len(PARTS)
        part = F.shiftrightunsigned("fp", OFFSETS[p]).bitwiseAND(F.lit((1 << PARTS[p]) - 1).cast("long"))
        key = F.shiftleft(key, PARTS[p]).bitwiseOR(part)
    return key


def within(a: Column, b: Column, distance: int, length: int = 3) -> Column:
    """Whether two fingerprints differ in at most `distance` bits: the chain test first, which prunes most, then all bits.

    Some part must begin a chain of `length` consecutive parts whose first j parts differ in at most floor(j * distance /
    PARTS) bits for every j, else the whole cannot be within the distance.
    """
    apart = a.bitwiseXOR(b)

    def chained(parts: Column) -> Column:
        found = F.lit(False)
        for k in range(len(PARTS)):
            used, test = F.lit(0), F.lit(True)
            for j in range(length):
                used = used + parts[(k + j) % len(PARTS)]
                test = test & (used <= (j + 1) * distance // len(PARTS))
            found = found | test
        return found

    parts = F.array(*(F.bit_count(F.shiftrightunsigned(apart, at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))) for at, width in zip(OFFSETS, PARTS, strict=True)))
    return F.transform(F.array(parts), chained)[0] & (F.bit_count(apart) <= distance)


def _differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of signed fingerprints; the sign bit counts like any other, which needs unsigned numbers."""
    return np.bitwise_count((x ^ y).view(np.uint64))


def _forest(fp: np.ndarray, own: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of one key: links have at least one end that wrote its own chain."""
    left, links = np.arange(len(fp)), []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            near = np.zeros(len(left), dtype=bool)
            by = np.zeros(len(left), dtype=np.int64)
            for k in range(0, len(front), 64):
                some = front[k : k + 64]
                hit = (_differing(fp[some][:, None], fp[left][None, :]) <= distance) & (own[some][:, None] | own[left][None, :])
                any_hit = hit.any(axis=0) & ~near
                by[any_hit] = some[hit[:, any_hit].argmax(axis=0)]
                near |= any_hit
            links += zip(fp[by[near]].tolist(), fp[left[near]].tolist(), strict=True)
            front, left = left[near], left[~near]
    return links


def _links(distance: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None

        def solve(key, block, fp, own):
            edge = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
            starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
            size = ends - starts
            found: list[tuple[int, int]] = []
            tiny = (size > 1) & (size <= 8)
            for d in range(1, 8):
                s = starts[tiny & (size > d)]
                n = size[tiny & (size > d)]
                if not len(s):
                    break
                at = np.repeat(s, n - d) + np.arange((n - d).sum()) - np.repeat(np.cumsum(n - d) - (n - d), n - d)
                x, y = fp[at], fp[at + d]
                good = (x != y) & (own[at] | own[at + d]) & (_differing(x, y) <= distance)
                found += zip(x[good].tolist(), y[good].tolist(), strict=True)
            for k in np.flatnonzero(size > 8):
                g = slice(starts[k], ends[k])
                values, back = np.unique(fp[g], return_inverse=True)
                mine = np.zeros(len(values), dtype=bool)
                np.logical_or.at(mine, back, own[g])
                if mine.any():
                    found += _forest(values, mine, distance)
            pairs = np.unique(np.sort(np.array(found, dtype=np.int64).reshape(-1, 2), axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) if len(cols[0]) else np.zeros(0, dtype=bool)
            cut = int(np.argmax(same)) if len(same) else 0
            held = [c[cut:] for c in cols]
            if cut:
                yield solve(*(c[:cut] for c in cols))
        if held is not None and len(held[0]):
            yield solve(*held)

    return work


def fingerprint_links(prints: DataFrame, distance: int = 4, block: int = BLOCK) -> DataFrame:
    """(a, b) over a table of distinct fp: enough links to connect all that differ in at most `distance` bits."""
    total = prints.count()
    length = 2
    while length < len(PARTS) - 1 and sum(PARTS[:length]) < math.log2(max(total, 2)) - 5:
        length += 1
    masks = [chain_masks(k, length, distance) for k in range(len(PARTS))]
    per_chain = max(map(len, masks))
    own = prints.select(F.explode(F.array(*(chain_keys(k, length) for k in range(len(PARTS))))).alias("key"))
    # a key with more than `block` rows has a neighbour key that more than block / per_chain fingerprints wrote as their own
    busy = own.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block // per_chain)
    shift = sum(PARTS[:length])
    chain_of = F.array(*(F.array(*(F.lit(m).cast("long") for m in ms)) for ms in masks))
    starts = [F.shiftrightunsigned("key", sum(PARTS[(k + j) % len(PARTS)] for j in range(length))) == k for k in range(len(PARTS))]
    start = F.coalesce(*(F.when(c, F.lit(k)) for k, c in enumerate(starts)))
    hot = save(
        busy.select("n", "key", F.explode(F.element_at(chain_of, start + 1)).alias("mask"))
        .groupBy(F.col("key").bitwiseXOR(F.col("mask")).alias("key")).agg(F.sum("n").alias("n"))
        .where(F.col("n") > block).select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "hot")
    assert shift + 3 < 63
    rows = [chain_keys(k, length).bitwiseXOR(F.lit(m).cast("long")) for k, ms in enumerate(masks) for m in ms]
    firsts = F.lit([sum(len(ms) for ms in masks[:k]) for k in range(len(masks))])
    keyed = prints.select("fp", F.posexplode(F.array(*rows)).alias("pos", "key")).select("key", "fp", F.array_contains(firsts, F.col("pos")).alias("own"))
    n_hot = hot.count()
    if n_hot:
        mine = F.pmod(F.xxhash64("fp"), F.col("blocks").cast("long"))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("blocks"), F.lit(1)).cast("long") - 1)).alias("other")
        keyed = keyed.join(small(hot, n_hot, BROADCAST_ROWS), "key", "left").select("key", "fp", "own", F.coalesce(mine, F.lit(0)).alias("mine"), other)
        keyed = keyed.select("key", (F.least("mine", "other") * 1_000_000 + F.greatest("mine", "other")).alias("block"), "fp", "own")
    else:
        keyed = keyed.select("key", F.lit(0).cast("long").alias("block"), "fp", "own")
    ship(prints.sparkSession)
    return keyed.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(_links(distance), "a long, b long")


def simhash_rows(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, t1, t2, fp, root) of every row; root, a fingerprint, is the same throughout a component.

    Null and wordless texts have the fingerprint zero; null doc_ids and repeated rows stay as they are; an empty table gives
    no rows; other columns are ignored.
    """
    with batches_of(docs.sparkSession, 2000):
        rows = save(fingerprints(docs, width), "fingerprints")
    classes = save(rows.select("fp").distinct(), "classes")
    linked = connected_components(fingerprint_links(classes, distance))
    roots = save(linked.select(F.col("node").alias("fp"), F.col("component").alias("root")), "roots")
    return rows.join(small(roots, roots.count()), "fp", "left").select("doc_id", "t1", "t2", "fp", F.coalesce("root", "fp").alias("root"))


def simhash_groups(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) of every row: components of fingerprints that differ in at most `distance` bits.

    component_id is the smallest doc_id reachable. A null or wordless text has fingerprint 0 and is linked like
    any other; a null doc_id never becomes a component_id unless nothing else is in the component; repeated rows
    stay as they are; extra columns are ignored; an empty table gives an empty result.
    """
    rows = save(simhash_rows(docs, width, distance), "rooted")
    least = save(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    return rows.join(small(least, least.count()), "root").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """docs with one document of each component of near fingerprints, as keep_first() has it."""
    return keep_first(docs, save(simhash_rows(docs, width, distance), "rooted"), ["root"])


def keep_first(docs: DataFrame, rows: DataFrame, root: list[str]) -> DataFrame:
    """docs with one row of each group: the one with the smallest doc_id, null ids last, of equal ids the one with the least text key.

    rows: (doc_id, t1, t2) of every row of docs with the columns `root`, which tell its group. A row goes for its own text's
    sake, so rows with equal ids and unlike texts stay. Of rows alike in doc_id and text one stays, the least by the hash
    of its other columns. Extra columns move along whatever their names; an empty table gives an empty result.
    """
    key = ["doc_id", "t1", "t2"]
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), *key)
    counted = save(rows.groupBy(*root, *key).agg(F.count(F.lit(1)).alias("n")), "row_keys")
    first = save(counted.groupBy(*root).agg(F.min(place).alias("first")), "first")
    judged = save(counted.join(small(first, first.count()), root).select(*key, "n", (place == F.col("first")).alias("stays")), "judged")
    gone, repeated = judged.where("not stays").select(*key), judged.where("stays and n > 1").select(*key)
    id_, (t1, t2) = F.col("doc_id").cast("long").alias("doc_id"), text_keys()
    others = F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")), F.lit(0).alias("_"))))
    keyed = packed(docs, "doc_id", "text").select("_row", id_, t1, t2)

    def match(other: DataFrame, how: str, left: DataFrame) -> DataFrame:
        o = small(other.select(*(F.col(c).alias(f"_{c}") for c in key)), other.count())
        return left.join(o, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2")), how)

    kept = match(gone, "left_anti", keyed)
    if not repeated.isEmpty():
        alike = match(repeated, "left_semi", docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), id_, t1, t2, others.alias("_others")))
        one = alike.groupBy(*key).agg(F.min_by("_row", "_others").alias("_row"))
        kept = match(repeated, "left_anti", kept).select("_row").unionAll(one.select("_row"))
    return unpacked(kept)
