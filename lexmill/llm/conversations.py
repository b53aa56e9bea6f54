"""Prefix trie of conversations by mergeable partial tries.

A turn is a digest of its role and text; a node of the trie is the hash of the digests from the root to it, a polynomial
over two bases modulo a prime, so a path that is cut into pieces is hashed piece by piece and put together. Each task
combines its turns into a partial trie, a table of nodes with their members; tables are merged by the hash of the
nodes, first within groups of tasks and then across them. Lists of the conversations that end at a node are merged as
sorted runs, so the list of one node never lies in one row. The rollup goes bottom up by doubling: after j rounds a
node knows its descendants within 2^j turns, so the number of rounds is the logarithm of the longest shared prefix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import save, ship, small

PRIME = (1 << 61) - 1
BASES = (1_170_586_013_440_917_233, 2_020_373_991_177_604_481)
#: Nodes of a partial trie that a task holds before it emits them.
HELD = 200_000
#: Groups of tasks whose partial tries are merged first.
FAN = 32
#: Ids of one run of an end list.
RUN = 4096

TURN = ["d1", "d2", "bytes"]


def digested(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, d1, d2, bytes) of (conv_id, turn, role, text): 128 bits that stand for role and text, and the UTF-8 bytes of the text.

    Null roles and texts become empty; rows without a conv_id take no part.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text")).where("conv_id is not null")
    return rows.select("conv_id", "turn", "role", F.xxhash64("role", "text").alias("d1"), F.xxhash64(F.lit(1), "text", "role").alias("d2"), F.octet_length("text").cast("long").alias("bytes"))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted: the place of each in its conversation and the hash up to it (l) and before it (q), both within this task."""
    last, seq, a, b = None, 0, 0, 0
    for batch in batches:
        columns: list[list[int]] = [[], [], [], [], []]
        for c, x, y in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "d1", "d2")), strict=True):
            if c != last:
                last, seq, a, b = c, 0, 0, 0
            before = a, b
            seq, a, b = seq + 1, (a * BASES[0] + x) % PRIME, (b * BASES[1] + y) % PRIME
            for column, value in zip(columns, (seq, a, b, *before), strict=True):
                column.append(value)
        kept = [batch.column(k) for k in ("part", "conv_id", *TURN)]
        yield pa.RecordBatch.from_arrays(kept + [pa.array(c, pa.int64()) for c in columns], ["part", "conv_id", *TURN, "seq", "l1", "l2", "q1", "q2"])


def _before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of conversations come in order: the number of turns and the hash before each piece."""
    last, n, a, b = None, 0, 0, 0
    for batch in batches:
        rows = []
        for part, c, seq, x, y in zip(*(batch.column(k).to_pylist() for k in ("part", "conv_id", "seq", "l1", "l2")), strict=True):
            if c != last:
                last, n, a, b = c, 0, 0, 0
            rows.append((part, c, n, a, b))
            n, a, b = n + seq, (a * pow(BASES[0], seq, PRIME) + x) % PRIME, (b * pow(BASES[1], seq, PRIME) + y) % PRIME
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), *[pa.int64()] * 4))], ["part", "conv_id", "n0", "b1", "b2"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of a path and of its parent, from those within a task and what came before the task."""
    for batch in batches:
        keys: list[list[int]] = [[], [], [], []]
        for seq, n0, b1, b2, l1, l2, q1, q2 in zip(*(batch.column(k).to_pylist() for k in ("seq", "n0", "b1", "b2", "l1", "l2", "q1", "q2")), strict=True):
            if n0:
                r1, r2 = pow(BASES[0], seq - 1, PRIME), pow(BASES[1], seq - 1, PRIME)
                q1, q2 = (q1 + b1 * r1) % PRIME, (q2 + b2 * r2) % PRIME
                l1, l2 = (l1 + b1 * r1 * BASES[0]) % PRIME, (l2 + b2 * r2 * BASES[1]) % PRIME
            for column, value in zip(keys, (l1, l2, q1, q2), strict=True):
                column.append(value)
        kept = [batch.column(k) for k in ("conv_id", "pos", *TURN)]
        yield pa.RecordBatch.from_arrays(kept + [pa.array(k, pa.int64()) for k in keys], ["conv_id", "pos", *TURN, "k1", "k2", "p1", "p2"])


def prefixes(turns: DataFrame, *order: Column) -> DataFrame:
    """(conv_id, pos, d1, d2, bytes, k1, k2, p1, p2): turns in order within their conversations, from 1, with the hash of the path to each and to its parent.

    Turns are sorted across tasks, so a conversation of any length is dealt to several of them; what comes before a piece
    of a conversation is put together from the totals of its earlier pieces.
    """
    ship(turns.sparkSession)
    by = [F.col("conv_id").asc(), *order]
    ranged = turns.repartitionByRange(*by).sortWithinPartitions(*by).select("conv_id", *TURN, F.spark_partition_id().alias("part"))
    local = save(ranged.mapInArrow(_running, "part int, conv_id long, d1 long, d2 long, bytes long, seq long, l1 long, l2 long, q1 long, q2 long"), "runs")
    pieces = local.groupBy("conv_id", "part").agg(F.max(F.struct("seq", "l1", "l2")).alias("end"))
    cut = local.groupBy("conv_id").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select("conv_id")
    pieces = save(pieces.join(cut, "conv_id", "left_semi").select("part", "conv_id", "end.*"), "pieces")  # at most two for each task
    before = save(pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_before, "part int, conv_id long, n0 long, b1 long, b2 long"), "before")
    placed = local.join(small(before, before.count()), ["part", "conv_id"], "left").withColumn("pos", F.col("seq") + F.coalesce("n0", F.lit(0)))
    schema = "conv_id long, pos long, d1 long, d2 long, bytes long, k1 long, k2 long, p1 long, p2 long"
    return save(placed.select("conv_id", "pos", *TURN, "seq", "n0", "b1", "b2", "l1", "l2", "q1", "q2").mapInArrow(_joined, schema), "prefixes")


def spliced(turns: DataFrame, source: Column, head: Column, longest: int) -> DataFrame:
    """(conv_id, pos, d1, d2, bytes): every conversation with its first `head` turns replaced by those of conversation `source`.

    turns has (conv_id, pos, ...); source and head are expressions of conv_id, and head is at most `longest`. Where the
    source is absent or shorter, there are fewer turns; places keep their order but may have gaps.
    """
    heads = turns.where(F.col("pos") <= longest).select(F.col("conv_id").alias("source"), "pos", *TURN)
    convs = turns.select("conv_id").distinct().select("conv_id", source.alias("source"), head.alias("head"))
    given = convs.join(heads, "source").where("pos <= head").select("conv_id", "pos", *TURN)
    own = turns.where(F.col("pos") > head).select("conv_id", "pos", *TURN)
    return given.unionAll(own)


def _partial_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of this task's turns, each once (or once for each HELD nodes), with members and the smallest of them."""
    nodes: dict[tuple, list] = {}
    names = ["depth", "k1", "k2", "p1", "p2", "bytes", "conv_id", "n_convs"]

    def emit() -> pa.RecordBatch:
        rows = [(*key, *value) for key, value in nodes.items()]
        nodes.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names)

    for batch in batches:
        for depth, k1, k2, p1, p2, size, c in zip(*(batch.column(k).to_pylist() for k in ("pos", "k1", "k2", "p1", "p2", "bytes", "conv_id")), strict=True):
            node = nodes.get((depth, k1, k2))
            if node is None:
                nodes[depth, k1, k2] = [p1, p2, size, c, 1]
            else:
                node[3] = min(node[3], c)
                node[4] += 1
        if len(nodes) >= HELD:
            yield emit()
    yield emit()


def _merged(partial: DataFrame) -> DataFrame:
    """One row for each node: partial tries are merged by node within groups of tasks, then across the groups."""
    key = ["depth", "k1", "k2"]
    sums = [F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("bytes").alias("bytes"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs")]
    tables = partial.withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(FAN)))
    return tables.groupBy(*key, "_group").agg(*sums).groupBy(*key).agg(*sums)


def _runs_of_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ends come sorted by node and conv_id: one row for each run of ids of a node, comma-joined."""
    key, ids = None, []
    names = ["depth", "k1", "k2", "first", "ids"]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    for batch in batches:
        rows = []
        for d, k1, k2, c in zip(*(batch.column(k).to_pylist() for k in ("depth", "k1", "k2", "conv_id")), strict=True):
            if (d, k1, k2) != key or len(ids) >= RUN:
                if ids:
                    rows.append((*key, ids[0], ",".join(map(str, ids))))
                key, ids = (d, k1, k2), []
            ids.append(c)
        yield packed(rows)
    if ids:
        yield packed([(*key, ids[0], ",".join(map(str, ids)))])


def _digests_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs come sorted by node and first id: the SHA-256 of all ids of a node, read as a stream."""
    key, digest = None, None
    names = ["depth", "k1", "k2", "ends_sha256"]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64()] * 3 + [pa.string()])], names)

    for batch in batches:
        rows = []
        for d, k1, k2, ids in zip(*(batch.column(k).to_pylist() for k in ("depth", "k1", "k2", "ids")), strict=True):
            if (d, k1, k2) != key:
                if key is not None:
                    rows.append((*key, digest.hexdigest()))
                key, digest = (d, k1, k2), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield packed(rows)
    if key is not None:
        yield packed([(*key, digest.hexdigest())])


def _end_digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the nodes at which conversations end, from (depth, k1, k2, conv_id)."""
    key = ["depth", "k1", "k2"]
    sorted_ends = ends.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")
    runs = save(sorted_ends.mapInArrow(_runs_of_ids, "depth long, k1 long, k2 long, first long, ids string"), "runs_of_ids")
    return runs.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(_digests_of_runs, "depth long, k1 long, k2 long, ends_sha256 string")


def _rolled_up(nodes: DataFrame) -> DataFrame:
    """(nid, n_leaves, saved) of (nid, pid, leaves, saved): sums over subtrees.

    In each round a node takes what its descendants at a distance of 2^j have gathered, and looks 2^j further up.
    """
    live = save(nodes.select("nid", F.col("pid").alias("up"), "leaves", "saved"), "rollup")
    while not live.where("up is not null").isEmpty():
        given = live.where("up is not null").groupBy(F.col("up").alias("nid")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        further = live.where("up is not null").select(F.col("nid").alias("up"), F.col("up").alias("next"))
        plus = lambda c: (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c)
        live = save(live.join(given, "nid", "left").join(further, "up", "left").select("nid", F.col("next").alias("up"), plus("leaves"), plus("saved")), "rollup")
    return live.select("nid", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def prefix_trie(turns: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """The nodes of the trie of conversations, from (conv_id, pos, d1, d2, bytes) and the conv_ids of all, turnless ones too.

    Per node: conv_id, its smallest member; depth; parent_conv_id, the parent's (root: null); n_convs; n_children; n_leaves
    and saved_tokens, summed over its subtree; ends_sha256, the digest of the ids of the members that end there. Turns of
    a conversation go by pos, equal ones by d1 and d2. Equal conversations share their nodes. No conversations, no nodes.
    """
    rows = prefixes(turns, F.col("pos").asc(), F.col("d1").asc(), F.col("d2").asc())
    every = save((turns if convs is None else convs).select("conv_id").distinct(), "convs")
    partial = rows.mapInArrow(_partial_tries, "depth long, k1 long, k2 long, p1 long, p2 long, bytes long, conv_id long, n_convs long")
    long = lambda v: F.lit(v).cast("long")
    root = every.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(long(0).alias("depth"), long(0).alias("k1"), long(0).alias("k2"), long(None).alias("p1"), long(None).alias("p2"), long(0).alias("bytes"), "conv_id", "n_convs")
    nodes = save(_merged(partial).unionByName(root).withColumn("nid", F.monotonically_increasing_id()), "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("lone"))
    parents = nodes.where("n_convs > 1 or depth = 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("nid").alias("pid"), F.col("conv_id").alias("shared_parent"))
    zero = lambda c: F.coalesce(c, long(0)).alias(c)
    full = nodes.join(children, ["depth", "k1", "k2"], "left").join(parents, ["depth", "p1", "p2"], "left")
    full = save(full.select("nid", "pid", "depth", "k1", "k2", "bytes", "conv_id", "n_convs", "shared_parent", zero("n_children"), zero("lone")), "full")
    # below a node of one member lies one path: nothing of it is shared, and it has one leaf
    shared = full.where("n_convs > 1")
    sums = _rolled_up(shared.select("nid", "pid", F.when(F.col("n_children") == 0, long(1)).otherwise(F.col("lone")).alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")))
    last = rows.groupBy("conv_id").agg(F.max(F.struct(F.col("pos").alias("depth"), "k1", "k2")).alias("end"))
    ends = every.join(last, "conv_id", "left").select(*(zero(f"end.{c}").alias(c) for c in ("depth", "k1", "k2")), "conv_id")
    out = full.join(sums, "nid", "left").join(_end_digests(ends), ["depth", "k1", "k2"], "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("shared_parent", "conv_id"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", F.coalesce("n_leaves", long(1)).alias("n_leaves"), zero("saved_tokens"), F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, source: Column | None = None, head: Column | None = None, longest: int = 8) -> DataFrame:
    """The prefix trie of (conv_id, turn, role, text), or of the conversations rebuilt with the first `head` turns of conversation `source`.

    Turns go by turn, null first; those of one conversation and turn by role and then by the digest of the text. Repeated rows
    are turns of their own. Null roles and texts are empty ones. Rows without a conv_id take no part. Other columns are
    ignored. An empty table gives no nodes.
    """
    turns = digested(conversations)
    if source is None:
        return prefix_trie(prefixes(save(turns, "turns"), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("d1").asc(), F.col("d2").asc()))
    placed = prefixes(save(turns, "turns"), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("d1").asc(), F.col("d2").asc())
    return prefix_trie(save(spliced(placed, source, head, longest), "spliced"), placed.select("conv_id"))
