"""Near copies by exact Jaccard similarity of word shingles.

Candidates come from op8's own step, and from MinHash bands beside it for the near copies that its 4 bits do not reach: texts
whose fingerprints simhash.fingerprint_links() joins by pigeonring chains are in one group, as are texts that share a band
of MinHash values. Their lengths must not rule the similarity out, and SimHash fingerprints of their sets must pass the
pigeonring chain test and then the full Hamming check of simhash.within() at FAR bits; the shingle sets of the whole texts
decide. A group of either kind is called a band below. Every candidate pair is compared unless links already connect its ends:
first each text with the least one of its band, then, in bands that still hold several components, every text
outside the component of the least one with all others. These are compared within tasks, a block of texts against a
block, and only links that join two trees leave a task; so pairs of a large group are never rows. A band of many texts
that stay apart (they share a long passage, say) is dealt anew by an exact prefix filter: two sets as similar as that share
one of their rarest shingles, as many as may be missing and one more, so its texts meet by those and not all with all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import BROADCAST_ROWS, batches_of, released, save, ship, small
from lexmill.llm.components import Forest, connected_components
from lexmill.llm.simhash import fingerprint, fingerprint_links, keep_first, text_keys, within

#: Words of a shingle, and the least similarity of near copies.
WIDTH, SIMILAR = 5, 0.8

#: At a similarity of 0.8 a pair shares no band with a probability of (1 - 0.8**ROWS)**BANDS = 5e-5; above it, with less.
BANDS, ROWS = 25, 5

#: At 0.8 the bits of two SimHash fingerprints differ in 9.7 of 64 on average, with a deviation of 2.9.
FAR = 24

#: Texts, and shingles of them all, in a block of an open band.
BLOCK, BLOCK_SHINGLES = 256, 500_000

#: Texts of an open band beyond which it is dealt anew by the prefixes of their sets.
HOT = 2048

#: Texts that tell which shingles are common, about, and how many of these are known to each task. They only give the
#: order in which prefixes are taken; any order is exact.
SAMPLED, COMMON = 10_000, 200_000

_RNG = np.random.default_rng(8)
_XOR = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
_TIMES = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_PLACES = _RNG.integers(0, 2**64, WIDTH, dtype=np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the runs of WIDTH words of a whole text; of all its words where it has fewer."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(w, 42) for w in found], dtype=np.uint64)
    n = max(len(h) - WIDTH + 1, 1)
    total = np.full(n, min(len(h), WIDTH), dtype=np.uint64)
    for k in range(min(WIDTH, len(h))):
        total += h[k : k + n] * _PLACES[k]
    return np.unique(_mixed(total))


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Similarity of two sets of shingles; texts without words are alike."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    every = len(x) + len(y) - both
    return both / every if every else 1.0


def sketch(found: np.ndarray) -> tuple[int, np.ndarray]:
    """The SimHash fingerprint and the band keys of a set of shingles."""
    least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(found), 2048):
        part = found[k : k + 2048]
        # the upper half of the product is mixed best
        least = np.minimum(least, (((part[:, None] ^ _XOR) * _TIMES) >> np.uint64(16)).min(axis=0))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    keys = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        keys = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) + least[k::ROWS])
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<i8")[0]), keys.view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in released(batches):
        prints, sizes, made = [], [], []
        for k in range(batch.num_rows):
            text = batch.column(2)[k].as_py()
            prints.append(fingerprint(text))
            found = shingles(text)
            sizes.append(len(found))
            made.append(sketch(found))
        keys = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1) * BANDS, pa.int32()), pa.array(np.concatenate([m[1] for m in made]) if made else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.int64()), pa.array([m[0] for m in made], pa.int64()), pa.array(sizes, pa.int64()), keys], ["t1", "t2", "print", "fp", "size", "keys"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = held = None
    for batch in released(batches):
        good = []
        for k in range(batch.num_rows):
            a = batch.column(0)[k].as_py()
            if held is None or a != last:
                last, held = a, shingles(batch.column(2)[k].as_py())
            good.append(jaccard(held, shingles(batch.column(3)[k].as_py())) >= SIMILAR)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))


def _possible(size_a: str, size_b: str, fp_a: str, fp_b: str):
    return (F.least(size_a, size_b) >= F.greatest(size_a, size_b) * SIMILAR) & within(F.col(fp_a), F.col(fp_b), FAR)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in released(batches):
        found = [shingles(batch.column(1)[k].as_py()).tobytes() for k in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "found"])


def _compared(node: np.ndarray, part: np.ndarray, fp: np.ndarray, size: np.ndarray, outside: np.ndarray, asking: np.ndarray, found: list[bytes]) -> list[tuple[int, int]]:
    """Links between the asking rows and the others of a group that join two trees; part is a row's component so far."""
    ask, other = np.flatnonzero(asking), np.flatnonzero(~asking)
    if not len(ask) or not len(other):
        return []
    sets = [np.frombuffer(found[k], dtype=np.uint64) for k in other]
    flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])[:-1]])
    forest, links = Forest(), []
    for k in ask.tolist():
        likely = (part[other] != part[k]) & (~outside[other] | (node[other] < node[k])) & (np.minimum(size[other], size[k]) >= SIMILAR * np.maximum(size[other], size[k]))
        likely &= np.bitwise_count((fp[other] ^ fp[k]).view(np.uint64)) <= FAR
        own = forest.root(int(part[k]))
        left = [j for j in np.flatnonzero(likely).tolist() if forest.root(int(part[other[j]])) != own]
        if not left:
            continue
        mine = np.frombuffer(found[k], dtype=np.uint64)
        if len(left) > 12:
            at = np.searchsorted(mine, flat)
            at[at == len(mine)] = 0
            both = np.add.reduceat(mine[at] == flat, starts)[left]
        else:
            both = np.array([len(np.intersect1d(mine, sets[j], assume_unique=True)) for j in left])
        near = both >= SIMILAR * (len(mine) + size[other[left]] - both)
        for j in np.array(left)[near].tolist():
            if forest.grown([int(part[k])], [int(part[other[j]])])[0]:
                links.append((int(node[k]), int(node[other[j]])))
    return links


def _crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, of, to), in which one block of a band asks another."""

    def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        columns = [table.column(k).to_numpy() for k in range(3, 9)]
        links = _compared(*columns, table.column(9).to_pylist())
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    held: list[pa.RecordBatch] = []
    last = None
    for batch in released(batches):
        if not batch.num_rows:
            continue
        group = np.stack([batch.column(k).to_numpy() for k in range(3)])
        cuts = [0, *(np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if held and tuple(group[:, start]) != last:
                yield solve(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = tuple(group[:, start])
    if held:
        yield solve(held)


def _cross_links(docs: DataFrame, nodes: DataFrame, marked: DataFrame, name: str) -> DataFrame:
    """(a, b) of near copies in bands that hold several components: those outside the head's compared with all others."""
    blocks = lambda n, w: F.greatest(F.ceil(n / BLOCK), F.ceil(w / BLOCK_SHINGLES), F.lit(1)).cast("int")
    outer = F.when(F.col("outside"), F.col("size"))
    counted = marked.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count(outer).alias("o"), F.sum("size").alias("w"), F.sum(outer).alias("wo")).where("o > 0")
    bands = save(counted.select("key", blocks(F.col("n"), F.col("w")).alias("all"), blocks(F.col("o"), F.col("wo")).alias("outer")), f"{name}_bands")
    members = save(marked.where("size > 0").join(small(bands, bands.count()), "key"), f"{name}_members")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["key", "of", "to", "node", "component", "fp", "size", "outside", "asking"]
    asked = members.select("*", each("outer").alias("of"), place("all").alias("to"), F.lit(False).alias("asking")).select(*columns)
    asking = members.where("outside").select("*", place("outer").alias("of"), each("all").alias("to"), F.lit(True).alias("asking")).select(*columns)
    sets = _sets_of(docs, nodes, members.select("node").distinct(), name)
    with batches_of(docs.sparkSession, 500):
        rows = asked.unionAll(asking).join(sets, "node").select(*columns, "found")
        dealt = rows.repartition("key", "of", "to").sortWithinPartitions("key", "of", "to")
        return save(dealt.mapInArrow(_crossed, "a long, b long"), f"{name}_cross_links")


def _sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """(node, found) of the wanted nodes: the shingles of their texts, packed."""
    texts = _texts(docs, nodes, wanted, name)
    with batches_of(docs.sparkSession, 500):
        return save(texts.mapInArrow(_sets, "node long, found binary"), f"{name}_sets")


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in released(batches):
        for k in range(batch.num_rows):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(batch.column(1)[k].as_py(), dtype=np.int64))], ["shingle"])


def prefix(found: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, int]:
    """The rarest shingles of a set, in an order that is the same for all sets: those of `common` (sorted) last, from the rarest on.

    Two sets with a similarity of SIMILAR or more share one of them: each lacks at most a part 1 - SIMILAR of its own. The
    smaller set of the two lacks at most a part 1 - 2 * SIMILAR / (1 + SIMILAR), so they share one of its first ones,
    as many as the second result says.
    """
    n = len(found) - int(np.ceil(SIMILAR * len(found) - 1e-9)) + 1
    few = len(found) - int(np.ceil(2 * SIMILAR / (1 + SIMILAR) * len(found) - 1e-9)) + 1
    at = np.searchsorted(common["shingle"], found)
    at[at == len(common)] = 0
    rank = np.where(common["shingle"][at] == found, common["n"][at], 0) if len(common) else np.zeros(len(found), dtype=np.int64)
    return found[np.lexsort((found, rank))[: min(n, len(found))]], min(few, len(found))


def _prefix_keys(docs: DataFrame, nodes: DataFrame, crowded: DataFrame) -> DataFrame:
    """(key, node, fp, size, first) with the rarest shingles of the texts of crowded bands as keys; crowded: (node, fp, size).

    first: whether the key is among those that a text shares with every larger one that is near it. Keys without such a
    text are left out.
    """
    sets = _sets_of(docs, nodes, crowded.select("node"), "crowded")
    every = max(1, crowded.count() // SAMPLED)
    seen = sets.where(F.pmod(F.xxhash64("node"), F.lit(every)) == 0).mapInArrow(_exploded, "shingle long")
    counts = seen.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "shingle").limit(COMMON).collect()  # COMMON rows at most
    common = np.sort(np.array([(r["shingle"] % 2**64, r["n"]) for r in counts], dtype=[("shingle", np.uint64), ("n", np.int64)]), order="shingle")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for k in range(batch.num_rows):
                keys, few = prefix(np.frombuffer(batch.column(1)[k].as_py(), dtype=np.uint64), common)
                node = np.full(len(keys), batch.column(0)[k].as_py(), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(node), pa.array(np.arange(len(keys)) < few)], ["key", "node", "first"])

    found = save(sets.mapInArrow(work, "key long, node long, first boolean"), "prefixes")
    shared = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("first").alias("any")).where("any and n > 1").select("key")
    return save(found.join(shared, "key").join(crowded, "node").select("key", "node", "fp", "size", "first"), "prefix_keys")


def _texts(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """(node, text) of the wanted nodes, one of each."""
    known = save(nodes.join(wanted, "node").select("node", "t1", "t2"), f"{name}_nodes")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    some = docs.select(*text_keys(), text.alias("text")).join(small(known, known.count()), ["t1", "t2"])
    return save(some.groupBy("node").agg(F.min("text").alias("text")), f"{name}_texts")


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are near copies; nodes: (node, t1, t2)."""
    pairs = save(pairs.select("a", "b").distinct(), f"{name}_pairs")
    texts = _texts(docs, nodes, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), name)
    named = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
    joined = pairs.join(named("b"), "b").join(named("a"), "a").select("a", "b", "text_a", "text_b")
    with batches_of(docs.sparkSession, 500):
        return save(joined.mapInArrow(_similar, "a long, b long"), f"{name}_links")


def _stars(docs: DataFrame, nodes: DataFrame, keyed: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(members, links): the members of keys (key, node, fp, size, first) that several share, with their head, and the links to heads.

    Two members need to be compared only if one of them has the key among its first ones.
    """
    head = F.min(F.struct("node", "fp", "size", "first")).alias("head")
    shared = save(keyed.groupBy("key").agg(head, F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "head"), f"{name}_shared")
    members = save(keyed.join(small(shared, shared.count(), BROADCAST_ROWS), "key").select("key", "node", "fp", "size", "first", "head"), f"{name}_members")
    star = members.select("node", "fp", "size", F.col("head.node").alias("a"), F.col("head.fp").alias("fp_a"), F.col("head.size").alias("size_a"), (F.col("first") | F.col("head.first")).alias("asks")).where("node <> a and asks")
    return members, _verified(docs, nodes, star.where(_possible("size", "size_a", "fp", "fp_a")).select("a", F.col("node").alias("b")), name)


def _marked(members: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """(key, node, fp, size, first, component, outside) of members: whether they are outside the component of their key's head."""
    parts = connected_components(links)
    label = parts.select(F.col("node"), F.col("component"))
    root = parts.select(F.col("node").alias("_head"), F.col("component").alias("_root"))
    marked = members.join(label, "node", "left").withColumn("component", F.coalesce("component", "node")).withColumn("_head", F.col("head.node")).join(root, "_head", "left")
    return save(marked.select("key", "node", "fp", "size", "first", "component", (F.col("component") != F.coalesce("_root", "_head")).alias("outside")), f"{name}_marked")


def _ringed(nodes: DataFrame) -> DataFrame:
    """nodes with ring, the same where op8 fingerprints (print) are linked by pigeonring chains at op8's 4 bits, and where they are equal."""
    linked = connected_components(fingerprint_links(save(nodes.select(F.col("print").alias("fp")).distinct(), "prints")))
    parts = save(linked.select(F.col("node").alias("print"), F.col("component").alias("_part")), "rings")
    named = nodes.join(small(parts, parts.count()), "print", "left")
    return named.withColumn("ring", F.xxhash64(F.coalesce("_part", "print"), F.lit("ring")))


def near_copy_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, t1, t2) of the distinct texts, and (a, b): enough links between nodes to connect all near copies that share a ring of fingerprints or a band.

    Null and wordless texts are one node each and link with each other; an empty table gives none; other columns are ignored.
    """
    ship(docs.sparkSession)
    texts = docs.select(*text_keys(), F.col("text").cast("string").alias("text"))
    with batches_of(docs.sparkSession, 2000):
        rows = save(texts.mapInArrow(_sketches, "t1 long, t2 long, print long, fp long, size long, keys array<long>"), "sketches")
    one = save(rows.dropDuplicates(["t1", "t2"]).withColumn("node", F.monotonically_increasing_id()), "distinct_sketches")
    nodes = one.select("node", "t1", "t2")
    keyed = _ringed(one).select("node", "fp", "size", F.lit(True).alias("first"), F.explode(F.concat("keys", F.array("ring"))).alias("key"))
    members, links = _stars(docs, nodes, keyed, "star")
    marked = _marked(members, links, "star")
    crowds = save(marked.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("outside").alias("open")).where(F.col("open") & (F.col("n") > HOT)).select("key"), "crowds")
    n_crowds = crowds.count()
    if not n_crowds:
        return nodes, links.unionAll(_cross_links(docs, nodes, marked, "open"))
    few = marked.join(small(crowds, n_crowds), "key", "left_anti")
    crowded = save(marked.where("size > 0").join(small(crowds, n_crowds), "key", "left_semi").select("node", "fp", "size").distinct(), "crowded")
    finer, finer_links = _stars(docs, nodes, _prefix_keys(docs, nodes, crowded), "finer")
    found = links.unionAll(_cross_links(docs, nodes, few, "open")).unionAll(finer_links)
    marked = _marked(finer, found, "finer")
    split = marked.groupBy("key").agg(F.max("outside").alias("open")).where("open").select("key")
    # in keys that hold several components those that have them among their first ones are compared with all
    asking = save(marked.join(split, "key").withColumn("outside", F.col("first")), "asking")
    return nodes, found.unionAll(_cross_links(docs, nodes, asking, "finer"))


def near_copy_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, r1, r2) of every row; r1 and r2, the key of a text, are the same throughout a component of near copies.

    Null and wordless texts are alike; null doc_ids and repeated rows stay as they are; an empty table gives no rows; other
    columns are ignored.
    """
    nodes, links = near_copy_links(docs)
    linked = connected_components(links)
    named = nodes.select(F.col("node").alias("component"), F.col("t1").alias("r1"), F.col("t2").alias("r2"))
    roots = save(linked.join(nodes, "node").join(named, "component").select("t1", "t2", "r1", "r2"), "roots")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_keys())
    return rows.join(small(roots, roots.count()), ["t1", "t2"], "left").select("doc_id", "t1", "t2", F.coalesce("r1", "t1").alias("r1"), F.coalesce("r2", "t2").alias("r2"))


def near_copy_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) of every row: components of texts whose Jaccard similarity is SIMILAR or more.

    component_id is the smallest doc_id reachable. Null and wordless texts are alike; a null doc_id never becomes a
    component_id unless nothing else is in the component; repeated rows stay as they are; extra columns are ignored; an
    empty table gives an empty result.
    """
    rows = save(near_copy_rows(docs), "placed")
    least = save(rows.groupBy("r1", "r2").agg(F.min("doc_id").alias("component_id")), "least")
    return rows.join(small(least, least.count()), ["r1", "r2"]).select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one document of each component of near copies, as simhash.keep_first() has it."""
    return keep_first(docs, save(near_copy_rows(docs), "placed"), ["r1", "r2"])
