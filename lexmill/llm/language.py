"""Language identification by the nearest of several centroids a language.

A text becomes a normalised TF-IDF vector of hashed character n-grams (one, two and three letters of the
lower-cased text, other characters as one space). Each language's training vectors are clustered by spherical
k-means; a text goes to the language of the centroid with the highest cosine. A text further from that centroid than
nearly all of the centroid's own training texts is marked as rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import batches_of, released, save, ship

#: Slots of hashed n-grams.
WIDTH = 4096
NOT_LETTERS = re.compile(r"[\W\d_]+")


def ngram_counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of a whole text, a block of letters at a time."""
    counts = np.zeros(WIDTH, dtype=np.float64)
    letters = np.frombuffer((" " + NOT_LETTERS.sub(" ", text.lower()).strip() + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    for start in range(0, len(letters), 1 << 20):
        block = letters[start : start + (1 << 20) + 2].astype(np.uint32)
        own = min(len(block), 1 << 20)
        key = block * np.uint32(2654435761)
        for n in (1, 2, 3):
            if n > 1:
                key = key[:-1] * np.uint32(2246822519) + block[n - 1 :] * np.uint32(3266489917)
            slots = (key[:own] >> np.uint32(15)) & np.uint32(WIDTH - 1)
            counts += np.bincount(slots, minlength=WIDTH)
    return counts


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


@dataclass(frozen=True)
class Centroids:
    """Unit vectors of shape (k, WIDTH), their languages, their least usual cosines, and the weights of the slots."""

    languages: tuple[str, ...]
    vectors: np.ndarray
    radii: np.ndarray
    idf: np.ndarray

    def cosines(self, counts: np.ndarray) -> np.ndarray:
        """For rows of counts: the cosine with every centroid."""
        weighted = np.log1p(counts) * self.idf
        norms = np.linalg.norm(weighted, axis=1, keepdims=True)
        return (weighted / np.where(norms > 0, norms, 1)) @ self.vectors.T


def _cluster(vectors: np.ndarray, clusters: int, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from far-apart starts; returns centroids and each vector's cosine with its own."""
    chosen = [int(np.argmax(vectors @ vectors.mean(axis=0)))]
    best = vectors @ vectors[chosen[0]]
    while len(chosen) < min(clusters, len(vectors)):
        chosen.append(int(np.argmin(best)))
        best = np.maximum(best, vectors @ vectors[chosen[-1]])
    centres = vectors[chosen]
    for _ in range(rounds):
        member = np.argmax(vectors @ centres.T, axis=1)
        sums = np.stack([vectors[member == k].sum(axis=0) if (member == k).any() else centres[k] for k in range(len(centres))])
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        moved = sums / np.where(norms > 0, norms, 1)
        if np.allclose(moved, centres):
            break
        centres = moved
    own = vectors @ centres.T
    member = np.argmax(own, axis=1)
    return centres, np.array([np.quantile(own[member == k, k], 0.005) if (member == k).any() else 0.0 for k in range(len(centres))])


def train(labelled: DataFrame, clusters: int = 4, max_texts: int = 1000) -> Centroids | None:
    """Centroids from rows (doc_id, text, lang); None if there is nothing to learn from.

    Of each language about `max_texts` texts teach, at most twice as many, chosen by hash of doc_id and text: the bound of
    the sample. They are taken in order of doc_id and text, so a rerun learns the same. Equal rows teach once; texts
    without a letter and rows without a language teach nothing; an empty table gives None; other columns are ignored.
    """
    ship(labelled.sparkSession)
    usable = labelled.where("lang is not null and text is not null")
    shares = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    rows = usable.select("lang", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"))
    place = F.pmod(F.xxhash64("doc_id", "h", F.lit(21)), F.lit(1_000_000)) / 1e6
    shared = rows.join(F.broadcast(shares), "lang").where(place < F.lit(max_texts) / F.col("n"))  # one row a language
    chosen = shared.dropDuplicates(["lang", "doc_id", "h"]).select("lang", "text", "doc_id", "h")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            langs, slots, values, at_rows = [], [], [], []
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py()
                if has_letter(text):
                    counts = ngram_counts(text)
                    at = np.flatnonzero(counts)
                    langs.append(batch.column(0)[k].as_py())
                    slots.append(at.astype(np.int32))
                    values.append(counts[at])
                    at_rows.append(k)
            own = [batch.column(c).take(pa.array(at_rows, pa.int64())) for c in (2, 3)]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), *own, pa.array(slots, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], ["lang", "doc_id", "h", "slots", "counts"])

    with batches_of(labelled.sparkSession, 500):
        sample = save(chosen.mapInArrow(features, "lang string, doc_id long, h long, slots array<int>, counts array<double>"), "features")
    total = sample.count()
    if not total:
        return None
    idf = np.ones(WIDTH)
    for slot, n in sample.select(F.explode("slots").alias("slot")).groupBy("slot").count().collect():  # at most WIDTH rows
        idf[slot] = 1 + np.log((1 + total) / (1 + n))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "h"]).head(2 * max_texts)
        dense = np.zeros((len(group), WIDTH))
        for k, (slots, counts) in enumerate(zip(group["slots"], group["counts"], strict=True)):
            dense[k, np.asarray(slots)] = np.log1p(np.asarray(counts))
        dense *= idf
        norms = np.linalg.norm(dense, axis=1, keepdims=True)
        centres, radii = _cluster(dense / np.where(norms > 0, norms, 1), clusters)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "k": range(len(centres)), "vector": [c.tolist() for c in centres], "radius": radii})

    rows = sample.groupBy("lang").applyInPandas(fit, "lang string, k int, vector array<double>, radius double").orderBy("lang", "k").collect()  # `clusters` rows a language
    return Centroids(tuple(r["lang"] for r in rows), np.array([r["vector"] for r in rows]), np.array([r["radius"] for r in rows]), idf)


def predict(docs: DataFrame, model: Centroids | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with lang_pred, score (cosine with the nearest centroid, 0 to 1) and rejected.

    lang_pred is `und` with score 0 for a null text or one without a letter, or if nothing was learned. Ties go to the
    language that sorts first. Repeated rows and null ids stay as they are; other columns are dropped, whatever their names;
    an empty table gives no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in released(batches):
            for start in range(0, whole.num_rows, 128):
                batch = whole.slice(start, 128)
                texts = batch.column(len(keep)).to_pylist()
                langs, scores, rejected = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
                known = [k for k, t in enumerate(texts) if model is not None and has_letter(t)]
                if known:
                    cosines = model.cosines(np.stack([ngram_counts(texts[k]) for k in known]))
                    for k, nearest, row in zip(known, np.argmax(cosines, axis=1), cosines, strict=True):
                        langs[k], scores[k] = model.languages[nearest], float(min(max(row[nearest], 0.0), 1.0))
                        rejected[k] = bool(row[nearest] < model.radii[nearest])
                columns = [*(batch.column(k) for k in range(len(keep))), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "lang_pred", "score", "rejected"])

    ship(docs.sparkSession)
    own = "_" * (1 + max(map(len, keep), default=0)) + "text"  # no kept column's name
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").cast("string").alias(own))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    with batches_of(docs.sparkSession, 1000):
        return save(rows.mapInArrow(work, f"{kinds}, lang_pred string, score double, rejected boolean"), "predicted")


def held_out_fold(docs: DataFrame) -> DataFrame:
    """docs with held_out: crc32 of doc_id as text leaves 1 by 3; false for a null doc_id, which teaches nothing either."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)))
