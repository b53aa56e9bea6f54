import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexmill.llm import nearcopies, simhash
from tests.llm.conftest import AWKWARD, documents


def brute_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()


def brute_similar(x, y):
    return len(x & y) >= 0.8 * len(x | y)


def brute_groups(rows):
    """doc_id: smallest doc_id reachable over pairs of a 5-word Jaccard similarity of 0.8 or more; all pairs."""
    sets = [(d, brute_shingles(t)) for d, t, *_ in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if find(i) != find(j) and brute_similar(sets[i][1], sets[j][1]):
                parent[find(i)] = find(j)
    least = {}
    for k, (d, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), d), d)
    return {d: least[find(k)] for k, (d, _) in enumerate(sets)}


def near_rows(seed, bases=25):
    """Texts with copies in which words are changed, passages added or cut, near and beyond a similarity of 0.8."""
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "lmnrst"]
    rows = []
    shared = rng.choices(words, k=60)
    for _ in range(bases):
        base = rng.choices(words, k=rng.choice([30, 120, 400]))
        if rng.random() < 0.4:
            base += shared
        for _ in range(rng.choice([1, 2, 8])):
            text = list(base)
            for _ in range(rng.choice([0, 1, max(1, len(base) // 60), len(base) // 30])):
                text[rng.randrange(len(text))] = rng.choice(words)
            if rng.random() < 0.3:
                text += rng.choices(words, k=len(base) // rng.choice([5, 7]))
            rows.append((1000 + len(rows), " ".join(text), "en", "s"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [256, 3])
def test_near_dedup_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    rows = near_rows(4)
    truth = brute_groups(rows)
    assert 20 < len(set(truth.values())) < len(rows) - 20
    docs = documents(spark, rows)
    assert {r.doc_id: r.component_id for r in nearcopies.near_copy_groups(docs).collect()} == truth
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(truth.values()))


def test_a_large_group_of_edited_copies(spark, monkeypatch):
    """Copies of one base with more and less words changed: many are near each other, some only to a few, some to none."""
    monkeypatch.setattr(nearcopies, "BLOCK", 20)
    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "lmnr"]
    base, rows = rng.choices(words, k=150), []
    for k in range(160):
        text = list(base)
        for _ in range(rng.randint(0, 9)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((k, " ".join(text), "en", "s"))
    truth = brute_groups(rows)
    found = {r.doc_id: r.component_id for r in nearcopies.near_copy_groups(documents(spark, rows)).collect()}
    assert 1 < len(set(truth.values())) < 100 and found == truth


def test_texts_that_share_long_passages_stay(spark):
    rng = random.Random(5)
    words = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "lmnr"]
    passage = rng.choices(words, k=300)
    rows = [(k, " ".join(passage + rng.choices(words, k=60)), "en", "s") for k in range(30)]
    assert len(set(brute_groups(rows).values())) == 30
    assert corpus_pipeline.near_dedup(spark, documents(spark, rows), "").count() == 30


def test_awkward_rows(spark, nothing):
    kept = corpus_pipeline.near_dedup(spark, documents(spark, AWKWARD, ("node", "key", "size")), "")
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 3, 6, 7, 8, None, 9], key=str)
    assert corpus_pipeline.near_dedup(spark, nothing, "").collect() == []


def test_the_prefix_filter_is_exact():
    import numpy as np

    rng = np.random.default_rng(3)
    common = np.sort(np.array([(k * 7, k) for k in range(1, 50)], dtype=[("shingle", np.uint64), ("n", np.int64)]), order="shingle")
    for _ in range(300):
        x = np.unique(rng.integers(0, 400, rng.integers(1, 60)).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) > 0.1], rng.integers(0, 400, rng.integers(0, 6)).astype(np.uint64)]))
        if len(y) and nearcopies.jaccard(x, y) >= 0.8:
            for known in (common, common[:0]):
                (a, few), (b, _) = sorted((nearcopies.prefix(x, known), nearcopies.prefix(y, known)), key=lambda p: len(p[0]))
                if len(x) > len(y):
                    (a, few), b = nearcopies.prefix(y, known), nearcopies.prefix(x, known)[0]
                elif len(x) < len(y):
                    (a, few), b = nearcopies.prefix(x, known), nearcopies.prefix(y, known)[0]
                assert len(np.intersect1d(a[:few], b))


def test_a_band_of_many_unlike_texts(spark, monkeypatch):
    """Thousands of texts that share most of their words, too few to be near copies, and some pairs that are, in bounded rows."""
    monkeypatch.setattr(nearcopies, "HOT", 100)
    asked, meet = {}, nearcopies._cross_links

    def counting(docs, nodes, marked, name):
        asked[name] = marked.groupBy("key").agg(F.count_if("outside").alias("o"), F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("o") * F.col("n"))).first()[0] or 0
        return meet(docs, nodes, marked, name)

    monkeypatch.setattr(nearcopies, "_cross_links", counting)
    rng = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, f"{passage} {' '.join(str(rng.random()) for _ in range(12))}", "en", "s") for k in range(4000)]
    pairs = [(4000 + k, rows[k * 50][1] + " more", "en", "s") for k in range(60)]
    found = {r.doc_id: r.component_id for r in nearcopies.near_copy_groups(documents(spark, rows + pairs)).collect()}
    assert found == {k: k for k in range(4000)} | {4000 + k: k * 50 for k in range(60)}
    assert asked["open"] + asked["finer"] < 400_000  # all with all in their bands would be millions for each of 25


def test_pigeonring_finds_candidates_without_bands(spark, monkeypatch):
    """Near copies within op8's 4 bits are found by its chains alone."""
    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "lmnrst"]
    rows = []
    for k in range(6):
        base = rng.choices(words, k=3000)
        pair = [" ".join(base), " ".join([*base[:1500], "changed", *base[1501:]])]
        x, y = map(simhash.fingerprint, pair)
        if ((x ^ y) & (2**64 - 1)).bit_count() <= 4:
            rows += [(10 * k + j, text, "en", "s") for j, text in enumerate(pair)]
    sketches = nearcopies._sketches

    def bandless(batches):
        for batch in sketches(batches):
            none = pa.array([[] for _ in range(batch.num_rows)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], none], batch.schema.names)

    monkeypatch.setattr(nearcopies, "_sketches", bandless)
    found = {r.doc_id: r.component_id for r in nearcopies.near_copy_groups(documents(spark, rows)).collect()}
    assert len(rows) >= 8 and found == {d: d // 10 * 10 for d, *_ in rows}
