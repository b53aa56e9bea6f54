"""Sweeps over landed documents in which a broken one costs only itself: its reason is kept, and only it is tried again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What tells one version of a landed document from another.
VERSION = "_version"


def sweep(landed: DataFrame, key: str, content: str, broken: dict[str, Column], parsed: dict[str, Column], required: list[str]) -> DataFrame:
    """(key, _version, parsed columns..., error), a row for each document of landed.

    broken: reasons with conditions on the landed row, the first that holds is the error, and nothing else is worked out for
    the row. parsed: columns made of try_ expressions, which give null instead of failing; a required one that is null
    is an error "no <column>". A row in error has nulls. A null content is "nothing landed".
    """
    reason = F.when(F.col(content).isNull(), "nothing landed")
    for name, condition in broken.items():
        reason = reason.when(F.coalesce(condition, F.lit(False)), name)
    checked = landed.withColumn("_reason", reason)
    tried = checked.select(key, F.xxhash64(content).alias(VERSION), "_reason", *(F.when(F.col("_reason").isNull(), c).alias(n) for n, c in parsed.items()))
    error = F.col("_reason")
    for name in required:
        error = F.coalesce(error, F.when(F.col(name).isNull(), F.lit(f"no {name}")))
    marked = tried.withColumn("error", error)
    return marked.select(key, VERSION, *(F.when(F.col("error").isNull(), F.col(n)).alias(n) for n in parsed), "error")


def split(swept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, errors): the rows that went well without their error, and (key, _version, error) of the others."""
    key = swept.columns[0]
    return swept.where("error is null").drop("error"), swept.where("error is not null").select(key, VERSION, "error")


def to_try_again(landed: DataFrame, key: str, content: str, documents: DataFrame, errors: DataFrame, same: bool = False) -> DataFrame:
    """The rows of landed that the next sweep takes: those that were never swept and those that failed and have changed since.

    same: those that failed and are as they were, too (the parser has changed).
    """
    marked = landed.withColumn("_v", F.xxhash64(content))
    done = documents.select(F.col(key).alias("_k")).distinct().withColumn("_done", F.lit(True))
    failed = errors.select(F.col(key).alias("_k"), F.col(VERSION).alias("_v"), F.lit(True).alias("_failed")).distinct()
    fresh = marked.join(done, F.col(key) == F.col("_k"), "left").where("_done is null").drop("_k", "_done")
    return (fresh if same else fresh.join(failed, (F.col(key) == F.col("_k")) & (fresh["_v"] == failed["_v"]), "left_anti")).select(*landed.columns)


def outcome(swept: DataFrame) -> DataFrame:
    """(error, n) with a null error for what went well."""
    return swept.groupBy("error").agg(F.count(F.lit(1)).alias("n"))
