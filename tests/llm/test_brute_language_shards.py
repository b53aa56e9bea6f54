"""Language centroids and shards against plain Python, and reruns that learn the same."""

import math
import random
import re

from pyspark.sql import functions as F

from lexmill.llm import language, shards
from tests.llm.conftest import documents

VOCABULARY = {"xx": "the and with from house river walking", "yy": "und nicht schön straße haus fluss gehen", "zz": "les des été maison rivière être marcher"}


def counts_of(text):
    letters = [ord(c) for c in " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " "]
    found = {}
    for i in range(len(letters)):
        key = letters[i] * 2654435761 % 2**32
        for n in (1, 2, 3):
            if n > 1:
                if i + n > len(letters):
                    break
                key = (key * 2246822519 + letters[i + n - 1] * 3266489917) % 2**32
            slot = (key >> 15) % 4096
            found[slot] = found.get(slot, 0) + 1
    return found


def unit(vector):
    norm = math.sqrt(sum(x * x for x in vector.values()))
    return {k: x / norm for k, x in vector.items()} if norm else vector


def dot(x, y):
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    return sum(v * y.get(k, 0.0) for k, v in x.items())


def total(vectors):
    out = {}
    for v in vectors:
        for k, x in v.items():
            out[k] = out.get(k, 0.0) + x
    return out


def centroids(rows, clusters=4):
    """{lang: centroids} of (doc_id, text, lang), by spherical k-means from far-apart starts."""
    counted = [(lang, counts_of(text)) for _, text, lang in sorted(rows)]
    n = len(counted)
    seen = total([dict.fromkeys(c, 1) for _, c in counted])
    idf = {k: 1 + math.log((1 + n) / (1 + x)) for k, x in seen.items()}
    weigh = lambda c: unit({k: math.log1p(x) * idf.get(k, 1.0) for k, x in c.items()})
    out = {}
    for lang in sorted({x for x, _ in counted}):
        vectors = [weigh(c) for x, c in counted if x == lang]
        mean = total(vectors)
        chosen = [max(range(len(vectors)), key=lambda k: (round(dot(vectors[k], mean), 9), -k))]
        best = [dot(v, vectors[chosen[0]]) for v in vectors]
        while len(chosen) < min(clusters, len(vectors)):
            chosen.append(min(range(len(vectors)), key=lambda k: (round(best[k], 12), k)))
            best = [max(b, dot(v, vectors[chosen[-1]])) for b, v in zip(best, vectors, strict=True)]
        centres = [vectors[k] for k in chosen]
        for _ in range(15):
            member = [max(range(len(centres)), key=lambda k: (dot(v, centres[k]), -k)) for v in vectors]
            centres = [unit(total(v for v, m in zip(vectors, member, strict=True) if m == k)) if k in member else centres[k] for k in range(len(centres))]
        out[lang] = centres
    return out, weigh


def test_languages_against_plain_centroids(spark):
    rng = random.Random(12)
    rows = [(k, " ".join(rng.choice(VOCABULARY[lang].split()) for _ in range(rng.randint(4, 25))), lang, "s") for k, lang in enumerate(list(VOCABULARY) * 20)]
    docs = documents(spark, rows, ("h", "n", "slots"))
    model = language.train(docs)
    learned, weigh = centroids([(k, t, x) for k, t, x, _ in rows])
    asked = [*rows, (900, "le house und rivière", None, None), (901, "Straße 12", None, None), (902, "12", None, None)]
    for r in language.predict(documents(spark, asked), model, ("doc_id", "text")).collect():
        if r.doc_id == 902:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        scores = sorted(((max(dot(weigh(counts_of(r.text)), c) for c in cs), lang) for lang, cs in learned.items()), reverse=True)
        assert math.isclose(r.score, scores[0][0], abs_tol=1e-9)
        assert r.lang_pred == scores[0][1] or scores[0][0] - scores[1][0] < 1e-9


def test_a_rerun_learns_the_same_whatever_the_order_of_rows(spark):
    rng = random.Random(13)
    rows = [(k % 50, " ".join(rng.choice(VOCABULARY[lang].split()) for _ in range(9)), lang, "s") for k, lang in enumerate(list(VOCABULARY) * 40)]
    rows += rows[:30] * 5
    first = language.train(documents(spark, rows), max_texts=20)
    again = language.train(documents(spark, rows[::-1]).repartition(7), max_texts=20)
    assert first.languages == again.languages and (first.vectors == again.vectors).all() and (first.radii == again.radii).all()


def test_shards_against_boundaries_at_the_nearest_row(spark, monkeypatch):
    monkeypatch.setattr(shards, "FEW", 8)
    rng = random.Random(14)
    texts = ["".join(rng.choice("abcé") for _ in range(rng.choice([0, 3, 40, 200]))) for _ in range(300)]
    docs = documents(spark, [(k, t, None, None) for k, t in enumerate(texts)])
    keys = shards.keyed(docs).select("doc_id", "_size", *shards.KEYS).collect()
    rows = sorted((tuple(r[k] for k in shards.KEYS), r["_size"], r["doc_id"]) for r in keys)
    whole, n = sum(size for _, size, _ in rows), 9
    ends, below = [], 0
    for _, size, _ in rows:
        below += size
        ends.append(below)
    cuts = [min(range(len(rows) + 1), key=lambda k: (abs((ends[k - 1] if k else 0) - whole * j / n), k)) for j in range(1, n)]
    expected = {doc: sum(at >= c for c in cuts) for at, (_, _, doc) in enumerate(rows)}
    found = {r.doc_id: r.shard for r in shards.shard_documents(docs, n, tolerance=0).select("doc_id", "shard").collect()}
    assert found == expected
    sizes = {r.doc_id: (r.size, r.text_crc32) for r in shards.shard_digest(docs, n).collect()}
    import zlib

    assert sizes == {k: (len(t.encode()) + 16, zlib.crc32(t.encode())) for k, t in enumerate(texts)}
