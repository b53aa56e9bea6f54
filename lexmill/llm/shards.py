"""Sharding by histogram sort, with DataFrame expressions alone.

Rows are ordered by the key (hash of the text, hash of the doc_id, hash of a row number), so equal texts lie together
and are cut apart only where a boundary must fall among them; the last part tells rows with equal texts and equal
doc_ids apart. For every boundary the bytes below candidate keys are counted exactly over all partitions; the interval
that holds the wanted byte is probed again, more finely, until a candidate is within the tolerance or the interval is
one key. Then rows move once, to their shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import decision_tree, packed, save, small, unpacked

#: Bits of the key that one round of probes settles; a first round has 4096 intervals.
ROUND_BITS = (12, 8)
#: An interval of so few rows is not probed again but read.
FEW = 256
#: Rows that one numbering task takes, about.
TASK_ROWS = 4096


#: The parts of a key, 64 bits each.
KEYS = ("_k1", "_k2", "_k3")
WIDTH = 64 * len(KEYS)

#: The first key of a shard, one signed number for each part.
Splitter = tuple[int, int, int]


def keyed(docs: DataFrame) -> DataFrame:
    """_row (all columns), doc_id, text, _size and the parts of the key; a null text has no bytes, a null doc_id is ordered by the text alone.

    _k3 is a one-to-one function of a row number; write the rows before they are used more than once.
    """
    text = F.col("text").cast("string")
    k1 = F.xxhash64(text, F.lit(4))
    return packed(docs, "doc_id", "text").withColumns({"_size": (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long"), "_k1": k1, "_k2": F.xxhash64(F.col("doc_id").cast("long"), k1), "_k3": F.xxhash64(F.monotonically_increasing_id())})


def _bits(key: str, first: int, n: int) -> Column:
    """n bits of a key from its most significant on, with the sign bit flipped so that the order is unsigned."""
    flipped = F.col(key).bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    return F.shiftrightunsigned(F.shiftleft(flipped, first), 64 - n) if first else F.shiftrightunsigned(flipped, 64 - n)


def _parts(value: int) -> list[int]:
    """The signed parts of an unsigned key of WIDTH bits."""
    return [((value >> (WIDTH - 64 * (k + 1))) & ((1 << 64) - 1)) - (1 << 63) for k in range(len(KEYS))]


def find_splitters(rows: DataFrame, shards: int, tolerance: float = 0.001) -> list[Splitter]:
    """Boundaries between shards over written rows with _size and KEYS, exact to `tolerance` of a shard's bytes or to one row.

    Each round counts bytes by interval in one aggregation; the driver sees at most 4096 counts, then 256 for
    each open boundary. The rows of an interval of at most FEW rows are candidates themselves in a last round.
    """
    total = rows.agg(F.sum("_size")).first()[0] or 0
    slack = tolerance * total / shards
    # an open boundary lies in the interval of keys that share `depth` bits, with `below` bytes before it
    goals = {j: total * j / shards for j in range(1, shards)}
    spans = {j: (0, 0, 0) for j in goals}  # value of the shared bits, depth, below
    done: dict[int, int] = {}
    last: dict[int, tuple[int, int, int]] = {}
    while spans:
        depth = min(d for _, d, _ in spans.values())
        place, at = divmod(depth, 64)
        n = min(ROUND_BITS[0] if depth == 0 else ROUND_BITS[1], 64 - at)
        now = {j: x for j, x in spans.items() if x[1] == depth}
        prefixes = sorted({v for v, _, _ in now.values()})
        groups = [(_prefix_number(prefixes, depth) if depth else F.lit(0)).alias("prefix"), _bits(KEYS[place], at, n).alias("slot")]
        counts = rows.select(*groups, "_size", F.col(KEYS[place]).alias("_k")).where("prefix is not null").groupBy("prefix", "slot").agg(F.sum("_size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("_k").alias("least"), F.max("_k").alias("most"))
        by: dict[int, list] = {}
        for r in counts.collect():
            by.setdefault(prefixes[r["prefix"]], []).append(r)
        for j, (value, _, below) in now.items():
            del spans[j]
            done[j] = 1 << WIDTH
            for r in sorted(by.get(value, []), key=lambda r: r["slot"]):
                lower, end = (value << n) | r["slot"], depth + n
                if below + r["bytes"] < goals[j]:
                    below += r["bytes"]
                    continue
                before, after = goals[j] - below, below + r["bytes"] - goals[j]
                done[j] = (lower if before <= after else lower + 1) << (WIDTH - end)
                if min(before, after) > slack and end < WIDTH:
                    if r["n"] <= FEW:
                        last[j] = (lower, end, below)
                    elif r["least"] == r["most"] and place + 1 < len(KEYS):  # equal in this part of the key: on to the next
                        spans[j] = (((value >> at) << 64) | (r["least"] + (1 << 63)), 64 * (place + 1), below)
                    else:
                        spans[j] = (lower, end, below)
                break
    for at_depth in {d for _, d, _ in last.values()}:
        prefixes = sorted({v for v, d, _ in last.values() if d == at_depth})
        sizes: dict[int, list[tuple[int, int]]] = {}
        for r in rows.select(_prefix_number(prefixes, at_depth).alias("prefix"), *KEYS, "_size").where("prefix is not null").collect():  # at most FEW rows a boundary
            key = 0
            for k in KEYS:
                key = (key << 64) | (r[k] + (1 << 63))
            sizes.setdefault(prefixes[r["prefix"]], []).append((key, r["_size"]))
        for j, (value, d, below) in last.items():
            if d == at_depth:
                best = (goals[j] - below, value << (WIDTH - d))
                for k, size in sorted(sizes[value]):
                    below += size
                    best = min(best, (abs(goals[j] - below), k + 1))
                done[j] = best[1]
    return [tuple(_parts(min(done[j], (1 << WIDTH) - 1))) for j in sorted(done)]


def _prefix_number(prefixes: list[int], depth: int) -> Column:
    """The place in prefixes of the row's first `depth` bits, else null; at most one prefix for each boundary."""
    as_long = lambda v: F.lit(v - (1 << 64) if v >= 1 << 63 else v).cast("long")
    found = None
    for k, v in enumerate(prefixes):
        test = F.lit(True)
        for place, key in enumerate(KEYS):
            own = min(max(depth - 64 * place, 0), 64)
            if own:
                beyond = max(depth - 64 * (place + 1), 0)
                test &= _bits(key, 0, own) == as_long((v >> beyond) & ((1 << own) - 1))
        found = F.when(test, F.lit(k)) if found is None else found.when(test, F.lit(k))
    return found


def shard_of(splitters: list[Splitter]) -> Column:
    """A row's shard: how many splitters its key has reached, as nested conditions."""

    def before(_, splitter: Splitter) -> Column:
        test = F.lit(False)
        for key, value in reversed(list(zip(KEYS, splitter, strict=True))):
            bound = F.lit(value).cast("long")
            test = (F.col(key) < bound) | ((F.col(key) == bound) & test)
        return test

    return decision_tree(F.struct(*KEYS), splitters, compare=before)


def numbered(rows: DataFrame, splitters: list[Splitter], n_rows: int) -> DataFrame:
    """rows with shard and slot; rows move once, to (shard, sub-range of the doc_id hash), and are numbered there.

    Numbers of rows in the sub-ranges are summed up first, so no task takes a whole shard. Rows alike in text and doc_id of
    which there are more than a task should take come after the others, in sub-ranges of their own.
    """
    bits = max(0, (n_rows // (len(splitters) + 1) // TASK_ROWS).bit_length())
    part = lambda key: _bits(key, 0, bits) if bits else F.lit(0).cast("long")
    none = F.lit(0).cast("long")
    placed = rows.withColumns({"shard": shard_of(splitters), "_sub": part("_k2"), "_busy": F.lit(False), "_b1": none, "_b2": none})
    full = save(placed.groupBy("shard", "_sub").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * TASK_ROWS).select("shard", "_sub"), "full")
    n_full = full.count()
    if n_full:
        alike = placed.join(small(full, n_full), ["shard", "_sub"], "left_semi").groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TASK_ROWS)
        alike = save(alike.select("_k1", "_k2", F.lit(True).alias("_many")), "alike")
        found = placed.join(small(alike, alike.count()), ["_k1", "_k2"], "left")
        busy = lambda value, other: F.when(F.col("_many"), value).otherwise(other)
        placed = found.withColumns({"_busy": busy(F.lit(True), F.lit(False)), "_b1": busy(F.col("_k1"), none), "_b2": busy(F.col("_k2"), none), "_sub": busy(part("_k3"), F.col("_sub"))}).drop("_many")
    group = ["shard", "_busy", "_b1", "_b2", "_sub"]
    counts = placed.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy(*group[1:]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = save(counts.select(*group, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_offset")), "offsets")
    within = Window.partitionBy(*group).orderBy(*KEYS)
    return placed.join(offsets, group).withColumn("slot", (F.col("_offset") + F.row_number().over(within) - 1).cast("long")).drop(*group[1:], "_offset")


def shard_documents(docs: DataFrame, shards: int, tolerance: float = 0.001) -> DataFrame:
    """docs with size, shard and slot: shards of nearly equal bytes, slots gapless from 0 within each.

    Null texts weigh 16 bytes, as empty ones do; repeated rows, null ids and all may lie in different shards; extra columns
    move along, but for columns named size, shard or slot, which are replaced; an empty table gives an empty result.
    Boundaries are within `tolerance` of a shard's bytes or, where single documents are larger, at the nearest document.
    The documents are written once with their keys, so that a row keeps its number when an executor is lost.
    """
    rows = save(keyed(docs.drop("size", "shard", "slot")).drop("doc_id", "text"), "keyed")
    out = numbered(rows, find_splitters(rows, shards, tolerance), rows.count())
    return unpacked(out, F.col("_size").alias("size"), "shard", "slot")


def write_shards(docs: DataFrame, shards: int, path: str) -> None:
    """Write docs as Parquet folders shard=0, 1, ..., each in order of slot within its files."""
    shard_documents(docs, shards).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_digest(docs: DataFrame, shards: int) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) without moving the texts.

    Slots are gapless from 0 in each shard; they follow ranges of the doc_id's hash, and rows of a group of more than
    TASK_ROWS alike rows come after the others, so their order is no promise.

    Nulls, repeated rows and empty tables are as in shard_documents(); the crc32 of a null text is that of an empty one;
    extra columns are ignored.
    """
    rows = keyed(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "_size", *KEYS, F.crc32(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_crc32"))
    kept = save(rows, "keyed")
    out = numbered(kept, find_splitters(kept, shards), kept.count())
    return out.select("doc_id", F.col("_size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"))
