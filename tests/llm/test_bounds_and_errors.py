"""What must be an error, and vectors whose squares overflow or vanish."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexmill.llm import common, mixing, projections
from tests.llm.conftest import AWKWARD, documents


def test_a_mix_that_is_not_solved_is_an_error(spark):
    rows = [(k, "word " * (k % 50 + 1), "en", "ab"[k % 3 == 0]) for k in range(200)]
    measured = mixing._measured(documents(spark, rows))
    hist = measured.groupBy("_s", "_n").agg(F.count(F.lit(1)).alias("n"))
    sources = hist.groupBy("_s").agg(F.sum(F.col("n") * F.col("_n")).alias("size"), F.sum("n").alias("n_docs")).withColumn("target", F.col("size") * 1.7)
    assert mixing._solve(hist, sources, 3.0).count() == 2
    with pytest.raises(ValueError, match="no tilts"):
        mixing._solve(hist, sources, 3.0, rounds=1)


def test_scratch_tables_need_a_shared_folder_on_a_cluster():
    class Context:
        applicationId = "app"

        def __init__(self, master):
            self.master = master

    class Session:
        def __init__(self, master, folder=None):
            self.sparkContext, self.folder = Context(master), folder

        @property
        def conf(self):
            folder = self.folder
            return type("Conf", (), {"get": staticmethod(lambda key, default=None: folder)})

    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1000]", "k8s://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            common.scratch_root(Session(master))
        assert common.scratch_root(Session(master, "hdfs://shared/")).startswith("hdfs://shared/lexmill/app")
    for master in ("local", "local[4]", "local[*]"):
        assert common.scratch_root(Session(master)).startswith("file://")


def test_vectors_of_extreme_length_link_by_their_angle(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal(8)
    near = base + 0.02 * rng.standard_normal(8)
    far = rng.standard_normal(8)
    rows = [(k, (v * scale).tolist(), 1) for k, (v, scale) in enumerate([(base, 1e200), (near, 1e-200), (near, 1e200), (base, 1e-200), (far, 1e200), (base, 1.0), (base, 5e-310)])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: (r.n_links, r.component_id) for r in projections.near_vectors(table).collect()}
    assert found == {k: (5, 0) for k in (0, 1, 2, 3, 5, 6)} | {4: (0, 4)}


def test_the_pipeline_takes_columns_with_clashing_names(spark, tmp_path):
    names = ("node", "key", "size", "component", "_row", "_s", "_n", "rate", "found", "positions")
    for name, table in (("documents", documents(spark, AWKWARD * 2, names)), ("labels", spark.createDataFrame([(1, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int"))):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns) and out.count() >= 0
