import numpy as np
import pytest

import corpus_pipeline
from lexmill.llm import projections
from tests.llm.conftest import AWKWARD, documents


def brute_links(rows, cosine):
    usable = [(i, np.array(v, dtype=float), lab) for i, v, lab in rows if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for a, (i, v, lab) in enumerate(usable):
        for j, w, other in usable[:a]:
            if lab == other and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= cosine:
                links.append((i, j))
    return links


@pytest.mark.parametrize("block", [4096, 16])
def test_near_vectors_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(projections, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows, k = [], 0
    for _ in range(60):
        centre = rng.standard_normal(16)
        for _ in range(rng.choice([1, 2, 6])):
            rows.append((k, (centre + 0.12 * rng.standard_normal(16)).tolist(), int(rng.integers(0, 3))))
            k += 1
    hot = rng.standard_normal(16)
    for _ in range(40):
        rows.append((k, (hot + 0.05 * rng.standard_normal(16)).tolist(), 1))
        k += 1
    rows += [(k + n, hot.tolist(), 1) for n in range(5)]
    k += 5
    rows += [(k, None, 1), (k + 1, [0.0] * 16, 1), (k + 2, [float("nan")] + [1.0] * 15, 1), (k + 3, [None] + [1.0] * 15, 1), (k + 4, hot.tolist(), None), (k + 5, [], 1), (k + 6, hot.tolist()[:4], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: r for r in projections.near_vectors(table).collect()}
    assert len(found) == len(rows)
    links = brute_links(rows, 0.93)
    degree, parent = {i: 0 for i in found}, {i: i for i in found}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in links:
        degree[i] += 1
        degree[j] += 1
        a, b = sorted((find(i), find(j)))
        parent[b] = a
    assert sum(r.n_links for r in found.values()) >= 0.99 * sum(degree.values())
    assert all(found[i].n_links <= degree[i] for i in degree)
    assert sum(found[i].component_id == find(i) for i in found) >= 0.99 * len(found)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found.values())


def test_a_recall_that_is_missed_is_an_error():
    with pytest.raises(ValueError, match="recall"):
        projections.calibrate(64, 0.05, 10**9, 0.9999999)
    tables, levels, least, _ = projections.calibrate(64, 0.93, 10**6)
    assert least >= 2 and tables <= 4096 and levels >= 2
    assert projections.calibrate(1, 0.93, 100)[2] >= 2


def test_vectors_on_a_line_and_slices_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(projections, "PAIRS", 50)
    rows = [(k, [float(k % 5 - 2)], k % 2) for k in range(60)]
    found = {r.vec_id: r for r in projections.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    links = brute_links(rows, 0.93)
    assert {k: r.n_links for k, r in found.items()} == {k: sum(k in link for link in links) for k, *_ in rows}


def test_no_vectors(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert projections.near_vectors(table).collect() == []
    one = spark.createDataFrame([(1, None, 1), (2, [1.0], None)], "vec_id long, embedding array<float>, label int")
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in projections.near_vectors(one).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_stages_keep_the_columns_and_run(spark, tmp_path):
    words = "river house garden window table stone cloud forest letter winter summer bridge market morning evening silver".split()
    rng = np.random.default_rng(1)
    prose = lambda: " ".join(rng.choice(words, 80))
    rows = [(k, prose(), "en", "ab"[k % 2]) for k in range(40)]
    copy = prose()
    rows += [(100 + k, copy, "en", "a") for k in range(5)] + [(200, prose() + " password=hunter2hunter2", "en", "b")]
    rows += [(300 + (d or 0), t, la, s) for d, t, la, s in AWKWARD]
    docs = documents(spark, rows, ("_q", "kind"))
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder)
        assert now.columns == docs.columns
        path = f"{folder}/out-{name}"
        now.write.parquet(path)
        now = spark.read.parquet(path)
        seen[name] = now.collect()
    good = {r.doc_id for r in seen["quality_rules"]}
    assert set(range(40)) | {100, 104, 200} <= good and not good & {303, 304, 305, 306}
    assert {r.doc_id for r in seen["near_dedup"]} & {100, 101, 102, 103, 104} == {100}
    assert "hunter2" not in "".join(r.text for r in seen["secret_scan"]) and len(seen["secret_scan"]) == len(seen["near_dedup"])
    final = corpus_pipeline.run(spark, folder).collect()
    assert len(final) == len(seen["source_mix"]) and all(r.n_tokens * 4 == len(r.ids) for r in final)


def test_stages_on_no_documents(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
