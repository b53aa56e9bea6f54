"""Publishing merges: tables bucketed by key, of which a merge writes only the buckets that it touches, and one step that readers see.

A version of a bucket is a partition of a Parquet table; a manifest says which version of each bucket is current. A merge
writes new versions beside the old ones, then adds the next manifest by one rename: until then readers, and a run after
a failure, see what was there before. Several tables that share a key are published together.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType


@dataclass(frozen=True)
class Store:
    """Tables (name to schema) below path, all bucketed by the same key columns, which each of them has."""

    path: str
    tables: dict[str, StructType]
    keys: list[str]
    buckets: int = 64
    keep: int = 2

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _files(self, spark: SparkSession):
        context = spark.sparkContext
        path = lambda *parts: context._jvm.org.apache.hadoop.fs.Path("/".join([self.path.rstrip("/"), *parts]))
        return path, path().getFileSystem(context._jsc.hadoopConfiguration())

    def numbers(self, spark: SparkSession) -> list[int]:
        """The numbers of the manifests there are."""
        path, fs = self._files(spark)
        folder = path("_manifest")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, spark: SparkSession, number: int) -> dict[str, dict[str, int]]:
        """The current version of each bucket of each table, at a manifest."""
        text = spark.read.text("/".join([self.path.rstrip("/"), "_manifest", str(number)])).first()
        return json.loads(text[0])

    def read(self, spark: SparkSession, table: str, only: list[int] | None = None, before: int | None = None) -> DataFrame:
        """A table as last published, or before a manifest; of all buckets or of some of them. Nothing published, no rows."""
        found = [n for n in self.numbers(spark) if before is None or n < before]
        schema = self.tables[table]
        versions = self.manifest(spark, found[-1]).get(table, {}) if found else {}
        by_version: dict[int, list[int]] = {}
        for bucket, version in versions.items():
            if only is None or int(bucket) in only:
                by_version.setdefault(version, []).append(int(bucket))
        path, fs = self._files(spark)
        if not by_version or not fs.exists(path(table)):
            return spark.createDataFrame([], schema)
        current = F.lit(False)
        for version, buckets in by_version.items():
            current = current | ((F.col("_version") == version) & F.col("_bucket").isin(buckets))
        stored = StructType([*schema.fields]).add("_bucket", IntegerType()).add("_version", IntegerType())
        return spark.read.schema(stored).parquet(f"{self.path.rstrip('/')}/{table}").where(current).drop("_bucket", "_version")

    def merge(self, spark: SparkSession, new: dict[str, DataFrame], how: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], number: int | None = None) -> int:
        """Publish how(old), old being the tables' rows in the buckets that the rows of `new` fall into; returns the manifest's number.

        how must leave rows in the bucket of their key. A number that is published already is not done again, so a
        stream's batch can be repeated.
        """
        there = self.numbers(spark)
        number = (there[-1] + 1 if there else 0) if number is None else number
        if number in there:
            return number
        touched = None
        for rows in new.values():
            part = rows.select(self.bucket().alias("b")).distinct()
            touched = part if touched is None else touched.unionAll(part)
        buckets = sorted(r["b"] for r in touched.distinct().collect())  # as many as there are buckets at most
        earlier = [n for n in there if n < number]
        versions = self.manifest(spark, earlier[-1]) if earlier else {}
        merged = how({t: self.read(spark, t, buckets, number) for t in self.tables})
        for table, rows in merged.items():
            placed = rows.select(*self.tables[table].names).withColumns({"_bucket": self.bucket(), "_version": F.lit(number)})
            # files of one bucket together, but a large bucket in several
            dealt = placed.hint("rebalance", "_bucket")
            dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket", "_version").parquet(f"{self.path.rstrip('/')}/{table}")
            versions[table] = versions.get(table, {}) | {str(b): number for b in buckets}
        self._publish(spark, number, versions)
        self._sweep(spark)
        return number

    def _publish(self, spark: SparkSession, number: int, versions: dict) -> None:
        path, fs = self._files(spark)
        draft, final = path("_manifest", f".{number}.draft"), path("_manifest", str(number))
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(versions).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"manifest {number} of {self.path} was published by another writer")

    def _sweep(self, spark: SparkSession) -> None:
        """Manifests beyond the last `keep` go, and the versions of buckets that none of those left names."""
        path, fs = self._files(spark)
        numbers = self.numbers(spark)
        left, gone = numbers[-self.keep :], numbers[: -self.keep]
        if not gone:
            return
        used = [self.manifest(spark, n) for n in left]
        for old in gone:
            for table, versions in self.manifest(spark, old).items():
                for bucket, version in versions.items():
                    if all(m.get(table, {}).get(bucket) != version for m in used):
                        fs.delete(path(table, f"_bucket={bucket}", f"_version={version}"), True)
            fs.delete(path("_manifest", str(old)), False)


def counted(rows: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
    """rows, and what is counted of them when they are written: sums over the pass that writes, not another one.

    The counts are taken where rows leave the last shuffle, in the tasks whose results count once, so a stage that is run
    again after a lost executor is not counted twice. Read the observation's get after the write.
    """
    seen = Observation()
    return rows.observe(seen, *(F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in counts.items())), seen
