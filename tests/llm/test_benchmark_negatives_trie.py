"""Decontamination, hard negatives and the prefix trie against plain Python."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexmill.llm import conversations, decontaminate, negatives
from tests.llm.conftest import AWKWARD, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(lowered(text))


def grams_of(items, n):
    grams = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            grams[tuple(w[i : i + n])].add(item)
    return grams


def contamination(text, grams):
    w = words(text)
    hit, items = set(), set()
    for k in {len(g) for g in grams}:
        for i in range(len(w) - k + 1):
            found = grams.get(tuple(w[i : i + k]))
            if found:
                hit.update(range(i, i + k))
                items |= found
    return w, hit, items


PASSAGE = "Seven grey Geese, flew over the cold northern lake at dawn; nobody saw them leave."
ITEMS = [(1, PASSAGE), (2, "Élan VITAL"), (10, "quick brown fox"), (3, None), (4, "... !!"), (5, "word"), (1, "jumps over"), (6, PASSAGE.upper()), (None, "12345")]
TEXTS = [
    (20, "Start. " + PASSAGE + " Then more words follow here.", "en", "s1"),
    (21, "x seven GREY geese flew over the cold northern lake at dusk", "en", "s1"),
    (22, (PASSAGE + " filler ") * 200, "en", "s1"),
    (23, "élan vital; Élan Vital, ÉLAN vital", "fr", "s1"),
    (24, "geese-flew over the", "en", "s1"),
]


def report_rows(docs, items, spark, n=10, **more):
    table = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in decontaminate.contamination_report(docs, table, n).collect()), key=str)


def test_contamination_against_all_windows(spark):
    docs, grams = documents(spark, AWKWARD + TEXTS, ["positions", "items", "w", "i", "gram"]), grams_of(ITEMS, 10)
    wanted = []
    for doc_id, text, *_ in AWKWARD + TEXTS:
        w, hit, items = contamination(text, grams)
        names = sorted(str(i) for i in items - {None})
        wanted.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    assert report_rows(docs, ITEMS, spark) == sorted(wanted, key=str)


def test_windows_beyond_the_broadcast_bound_are_looked_up_in_parts(spark):
    docs, items = documents(spark, TEXTS), spark.createDataFrame(ITEMS, "item_id long, text string")
    whole, parts = (sorted(map(str, decontaminate.contaminated_texts(docs, items, 10, limit).collect())) for limit in (1000, 3))
    assert whole == parts


def test_spans_and_documents_are_removed(spark):
    docs, items = documents(spark, AWKWARD + TEXTS, ["positions", "_row"]), spark.createDataFrame(ITEMS, "item_id long, text string")
    grams = grams_of(ITEMS, 10)
    cut = decontaminate.decontaminate(docs, items)
    assert cut.columns == docs.columns
    wanted = []
    for doc_id, text, *_ in AWKWARD + TEXTS:
        _, hit, _ = contamination(text, grams)
        if hit:
            inside = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
            pieces = re.findall(inside + r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", text)
            text = re.match(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", text)[0] + "".join(p for i, p in enumerate(pieces) if i not in hit)
        wanted.append((doc_id, text))
    assert sorted(((r.doc_id, r.text) for r in cut.collect()), key=str) == sorted(wanted, key=str)
    left = decontaminate.decontaminate(docs, items, remove="documents", most=0.5)
    ids = [(d, t) for d, t, *_ in AWKWARD + TEXTS if not (c := contamination(t, grams))[1] or len(c[1]) <= 0.5 * len(c[0])]
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(ids, key=str)
    with pytest.raises(ValueError, match="remove"):
        decontaminate.decontaminate(docs, items, remove="all")


def test_contamination_of_nothing_and_by_nothing(spark, nothing, awkward):
    assert report_rows(nothing, ITEMS, spark) == []
    for items in ([], [(1, None), (2, "")]):
        clean = report_rows(awkward, items, spark)
        assert len(clean) == len(AWKWARD) and not any(r[2] or r[3] or r[5] for r in clean)
        assert {r[0]: r[1] for r in clean}[7] == 100_000


def mined(rows, every, positives=5, share=3):
    usable = [(i, v, lab, k) for k, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and v is not None and all(x is not None and abs(x) < float("inf") for x in v)]
    quantised = [(i, [int(256 * x // 1) for x in v], lab, k) for i, v, lab, k in usable]
    out = []
    for i, q, lab, k in quantised:
        if i % every == 0:
            scored = [(-sum(a * b for a, b in zip(q, r, strict=True)), j, other) for j, r, other, m in quantised if m != k and len(r) == len(q)]
            for p, pid in sorted((s, j) for s, j, other in scored if other == lab)[:positives]:
                near = sorted((s, j) for s, j, other in scored if other != lab and 50 * -p <= 100 * -s <= 95 * -p)[:share]
                out += [(i, pid, rank, j, -p, -s) for rank, (s, j) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "group", "bits", "slack"), [(4096, 8192, 10, 32), (3, 16, 2, 0)])
def test_hard_negatives_against_all_scores(spark, monkeypatch, block, group, bits, slack):
    for name, value in (("BLOCK", block), ("GROUP", group), ("DIGIT_BITS", bits), ("SLACK", slack), ("SLICE", 2)):
        monkeypatch.setattr(negatives, name, value)
    import random

    rng = random.Random(5)
    rows = [(k, [rng.gauss(0, 1) + (k % 3 == 0) for _ in range(4)], rng.choice([0, 1, 1, 2])) for k in range(80)]
    rows += [(k, [1.0, 1.0, 0.5, 0.25], k % 2) for k in range(80, 110)]  # ties and equal vectors
    rows += [rows[40], rows[40], rows[90], (None, [1.0] * 4, 1), (200, None, 1), (210, [1.0, None, 1.0, 1.0], 1), (220, [float("nan")] * 4, 1), (230, [float("inf")] * 4, 1), (240, [1.0] * 4, None)]
    rows += [(300, [0.5, 0.5], 1), (301, [0.5, 0.6], 1), (302, [0.45, 0.4], 2), (310, [], 1), (311, [], 2), (312, [], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n", F.lit("own")).withColumn("slot", F.lit(1))
    found = negatives.hard_negatives(table, F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, found.collect())) == mined(rows, 10)
    assert negatives.hard_negatives(table.limit(0), F.col("vec_id") % 10 == 0).collect() == []


def test_hard_negatives_of_extreme_components(spark):
    """Scores beyond doubles' whole numbers stay exact; beyond 2^61 they count as 2^61."""
    rows = [(0, [3e6, 1.0], 1), (1, [2e6, 1.0], 1), (2, [1.9e6, 0.5], 2), (3, [1.9e6, 0.25], 2), (4, [1.9e6, 1.0], 2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, negatives.hard_negatives(table, F.col("vec_id") == 0).collect())) == mined(rows, 1000) != []
    huge = spark.createDataFrame([(0, [1e300], 1), (1, [1e300], 1), (2, [1e300], 2)], "vec_id long, embedding array<double>, label int")
    assert negatives.hard_negatives(huge, F.col("vec_id") == 0).collect() == []  # a negative may have 0.95 of the score at most


def trie(rows, rebuilt=True):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    paths = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuilt else 0
        paths[c] = own.get(c - c % 5, [])[:h] + ts[h:] if rebuilt else ts
    nodes = defaultdict(set)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].add(c)
    children = defaultdict(set)
    for path in nodes:
        if path:
            children[path[:-1]].add(path)
    leaves, saved = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        leaves[path] = sum(leaves[x] for x in children[path]) or 1
        saved[path] = sum(saved[x] for x in children[path]) + ((len(nodes[path]) - 1) * len(path[-1][1].encode()) if path else 0)
    out = []
    for path, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(paths[c]) == len(path))
        parent = min(nodes[path[:-1]]) if path else None
        out.append((min(members), len(path), parent, len(members), len(children[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TURNS = (
    [(c, t, "user" if t % 2 == 0 else "assistant", f"text {t if t < 4 else c}" + "é" * (t % 3)) for c in range(60) for t in range(c % 7)]
    + [(100, t, "user", f"turn {t}") for t in range(300)]  # long, and long shared prefixes
    + [(101, t, "user", f"turn {t}") for t in range(280)]
    + [(105 + k, t, "user", f"turn {t}") for k in range(40) for t in range(12)]
    + [(7, None, "system", "first"), (7, None, None, None), (8, 0, None, "text 0"), (None, 0, "user", "nobody"), (-7, 0, "user", "x"), (-7, 1, "user", "y")]
    + [(9, 5, "user", "again"), (9, 5, "user", "again"), (201, 0, "user", "lone"), (202, 0, "user", "long " * 50_000)]
)


@pytest.mark.parametrize("rebuilt", [True, False])
def test_prefix_trie_against_a_trie_of_sets(spark, monkeypatch, rebuilt):
    for name, value in (("HELD", 50), ("RUN", 3), ("FAN", 2)):
        monkeypatch.setattr(conversations, name, value)
    keep = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that conversations are cut into pieces
    try:
        table = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("own"))
        c = F.col("conv_id")
        # Python's remainder of negative numbers is another than SQL's: conversation -7 has its source absent in both
        nodes = conversations.conversation_trie(table, c - c % 5, F.crc32(c.cast("string")) % 9) if rebuilt else conversations.conversation_trie(table)
        assert sorted(map(tuple, nodes.collect()), key=str) == trie(TURNS, rebuilt)
        assert conversations.conversation_trie(table.limit(0), c - c % 5, F.crc32(c.cast("string")) % 9).collect() == []
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", keep)
