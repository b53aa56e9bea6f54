"""Incremental runs: documents that land in a folder are classified and merged by content hash, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexmill.functions.text import content_hash
from lexmill.operators.classify import Keyword, topic_of
from lexmill.operators.merge import last_rows, upsert
from lexmill.operators.publish import Store


def classified(docs: DataFrame, rules: list[Keyword], text: str = "text") -> DataFrame:
    """docs with topic and content_hash; the same for a batch and for a stream."""
    return docs.withColumns({"topic": topic_of(F.col(text), rules), "content_hash": content_hash([F.col(text)])})


def merge_batch(old: DataFrame | None, batch: DataFrame, key: str, order: str) -> DataFrame:
    """A snapshot with a batch merged in: of equal keys the last row, unchanged hashes left alone."""
    last = last_rows(batch, [key], [order])
    return last if old is None else upsert(old, last, [key], "content_hash")


def snapshot_store(schema: StructType, store: str, key: str, buckets: int = 64, keep: int = 2) -> Store:
    """The store that follow() publishes documents of this schema to: one table, bucketed by the documents' key."""
    full = StructType([*schema.fields]).add("topic", "string").add("content_hash", "string")
    return Store(store, {"documents": full}, [key], buckets, keep)


def follow(spark: SparkSession, path: str, schema: StructType, rules: list[Keyword], store: Store, checkpoint: str, key: str, order: str, run: Callable | None = None):
    """Start a stream over Parquet files that land at path; every batch is merged into the store as the manifest of its number.

    A batch rewrites only the buckets of its documents, and readers see it when its manifest is there. A batch that is run
    again is not published twice, so a restart after a lost driver leaves each document once.
    Returns the query; the trigger takes what is there and ends.
    """

    def merge(batch: DataFrame, number: int) -> None:
        kept = batch.persist()  # its buckets are looked up before it is merged
        try:
            store.merge(batch.sparkSession, {"documents": kept}, lambda old: {"documents": merge_batch(old["documents"], kept, key, order)}, number)
        finally:
            kept.unpersist()
        if run:
            run(number)

    stream = classified(spark.readStream.schema(schema).parquet(path), rules)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
