"""Publishing: only touched buckets are written, readers see a merge at once or not at all, counts come from the pass that writes."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexmill.functions import inference
from lexmill.operators import merge
from lexmill.operators.publish import Store

SCHEMA = "k long, v string, hash string"


def rows(spark, *values):
    return spark.createDataFrame([(k, v, v) for k, v in values], SCHEMA)


def files(store):
    return {str(p): p.stat().st_mtime_ns for p in Path(store.path).rglob("*.parquet")}


def upsert(new):
    return lambda old: {"t": merge.upsert(old["t"], new, ["k"], "hash")}


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    store = Store(f"{tmp_path}/s", {"t": rows(spark, (0, "")).schema}, ["k"], 16)
    assert store.read(spark, "t").count() == 0
    first = rows(spark, *((k, f"a{k}") for k in range(200)))
    assert store.merge(spark, {"t": first}, upsert(first)) == 0
    before = files(store)
    second = rows(spark, (7, "b7"), (1000, "new"))
    touched = {r[0] for r in second.select(store.bucket()).collect()}
    assert store.merge(spark, {"t": second}, upsert(second)) == 1
    written = set(files(store)) - set(before)
    assert written and {int(p.split("_bucket=")[1].split("/")[0]) for p in written} <= touched
    assert all(files(store)[p] == t for p, t in before.items())
    got = {r.k: r.v for r in store.read(spark, "t").collect()}
    assert got == {**{k: f"a{k}" for k in range(200)}, 7: "b7", 1000: "new"}
    assert {r.k: r.v for r in store.read(spark, "t", before=1).collect()}[7] == "a7"  # a reader of the version before
    assert store.merge(spark, {"t": second}, upsert(second), number=1) == 1 and files(store).keys() == set(before) | written  # again: nothing to do
    third = rows(spark, (7, "c7"))
    store.merge(spark, {"t": third}, upsert(third))
    assert store.numbers(spark) == [1, 2]  # versions that no kept manifest names are gone
    assert len([p for p in files(store) if f"_bucket={third.select(store.bucket()).first()[0]}/" in p and "_version=0" in p]) == 0
    assert store.read(spark, "t").count() == 201


def test_a_failed_write_leaves_the_old_snapshot(spark, tmp_path):
    store = Store(f"{tmp_path}/s", {"t": rows(spark, (0, "")).schema}, ["k"], 4)
    first = rows(spark, (1, "a"), (2, "b"))
    store.merge(spark, {"t": first}, upsert(first))
    bad = rows(spark, (1, "x"), (3, "y"))
    fails = lambda old: {"t": upsert(bad)(old)["t"].withColumn("v", F.when(F.col("k") == 3, F.raise_error("lost").cast("string")).otherwise(F.col("v")))}
    with pytest.raises(Exception, match="lost"):
        store.merge(spark, {"t": bad}, fails)
    assert store.numbers(spark) == [0] and {r.k: r.v for r in store.read(spark, "t").collect()} == {1: "a", 2: "b"}
    store.merge(spark, {"t": bad}, upsert(bad))  # the next run makes up for it
    assert {r.k: r.v for r in store.read(spark, "t").collect()} == {1: "x", 2: "b", 3: "y"}


def test_acts_are_published_with_their_children(spark, tmp_path):
    table = lambda data, schema: spark.createDataFrame(data, schema)
    def parse(act, text):
        return {"acts": table([(act, "n", "u", None)], "act string, name string, url string, version_date date"), "chapters": table([(act, "1", "c")], "act string, chapter string, title string"),
                "sections": table([(act, "1", 1, "t", text, None)], "act string, chapter string, section int, title string, hash string, translated string"), "paragraphs": table([(act, "1", 1, 0, text)], "act string, chapter string, section int, order_index int, text string")}
    store = Store(f"{tmp_path}/s", {t: df.schema for t, df in parse("a", "x").items()}, ["act"], 8)
    for act, text in (("a", "x"), ("b", "y"), ("a", "z")):
        new = parse(act, text)
        store.merge(spark, new, lambda old, new=new: {t: df for t, df in merge.upsert_acts(old, new).items() if t != "statuses"})
    assert sorted((r.act, r.text) for r in store.read(spark, "paragraphs").collect()) == [("a", "z"), ("b", "y")]
    assert sorted((r.act, r.hash) for r in store.read(spark, "sections").collect()) == [("a", "z"), ("b", "y")]


RATE = "a string, b string, value decimal(10,2), effective_from string, clause int"


def test_rates_are_merged_and_counted_in_one_pass(spark, tmp_path):
    old = spark.createDataFrame([("x", None, 1, "2024", None), ("y", "1", 2, "2024", 5)], "a string, b string, value int, effective_from string, clause int").withColumn("value", F.col("value").cast("decimal(10,2)"))
    new = spark.createDataFrame([("x", None, 1, "2024", 7, 1), ("z", None, 3, "2024", 8, 1), ("z", None, 4, "2024", 9, 2), ("q", None, None, "2024", 1, 1), ("y", "1", 9, "2024", 6, 1), ("y", "1", 9, "2024", 6, 2)], "a string, b string, value int, effective_from string, clause int, ord int").withColumn("value", F.col("value").cast("decimal(10,2)"))
    snapshot, counts = merge.merge_rates(old, new, ["a", "b"], ["ord"], ["clause"])
    observed, seen = merge.merge_rates_counted(old, new, ["a", "b"], ["ord"], ["clause"])
    observed.write.parquet(f"{tmp_path}/rates")
    assert seen.get == counts.first().asDict() == {"created": 1, "updated": 2, "skipped": 2, "rejected": 1}
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/rates").collect()), key=str) == sorted(map(tuple, snapshot.collect()), key=str)


def test_a_worker_loads_its_model_once_and_counts_what_it_did(spark, tmp_path):
    log = f"{tmp_path}/loads"

    def load():
        import os
        import uuid

        os.makedirs(log, exist_ok=True)
        Path(log, f"{os.getpid()}-{uuid.uuid4().hex}").touch()
        return lambda texts: [None if t == "none" else f"{t.upper()}/{len({len(x) for x in texts})}" for t in texts]

    texts = [("none", None), *(("ab"[k % 2] * (k % 40 + 1), None) for k in range(400)), ("kept", "old"), (None, None)]
    data = spark.createDataFrame(texts, "src string, out string").repartition(12)
    done, seen = inference.translation_job(data, "src", "out", load)
    done.write.parquet(f"{tmp_path}/done")
    loads = [p.name.split("-")[0] for p in Path(log).iterdir()]
    assert len(loads) == len(set(loads)) <= 12
    assert seen.get == {"translated": 400, "skipped": 1}
    got = spark.read.parquet(f"{tmp_path}/done").collect()
    assert all(not r.out or r.out == "old" or r.out.split("/")[0] == r.src.upper() for r in got) and sum(not r.out for r in got) == 2
