"""What the corpus operators share: written scratch tables, shipping of code, size checks and Arrow helpers."""

from __future__ import annotations

import atexit
import io
import os
import re
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: anything between the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that a broadcast side may have at most; beyond it the join is left to shuffle.
BROADCAST_ROWS = 500_000


def scratch_root(spark: SparkSession) -> str:
    """This application's part of the shared folder of the cluster; where none is set, of a local one under a local master, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", master := spark.sparkContext.master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        root = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{root.rstrip('/')}/lexmill/{spark.sparkContext.applicationId}"


def save(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet below the shared folder and read it back: a cut of the lineage that survives lost executors.

    The tables go when the driver's process ends, or with drop_scratch().
    """
    spark = df.sparkSession
    _drop_at_exit(spark)
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete every scratch table of this application; call it when no result is in use any more."""
    _delete(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), scratch_root(spark))


def _delete(jvm, conf, root: str) -> None:
    path = jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(conf).delete(path, True)


_KNOWN: set[str] = set()


def _drop_at_exit(spark: SparkSession) -> None:
    root = scratch_root(spark)
    if root not in _KNOWN:
        _KNOWN.add(root)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

        def drop():
            try:
                _delete(jvm, conf, root)
            except Exception as e:  # the JVM may be gone already
                print(f"scratch tables left at {root}: {type(e).__name__}", file=sys.stderr)

        atexit.register(drop)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a context, whatever folder they start in."""
    context = spark.sparkContext
    if getattr(context, "_lexmill_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    if package.parent.is_dir():
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        target = os.path.join(tempfile.mkdtemp(), "lexmill_code.zip")
        Path(target).write_bytes(packed.getvalue())
        context.addPyFile(target)
    context._lexmill_shipped = True


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns beside _row, a struct of all columns: whatever else docs has cannot clash with an operator's own names."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return docs.select(F.struct(*columns).alias("_row"), *(F.col(f"`{n}`") for n in names))


def unpacked(rows: DataFrame, *more: str) -> DataFrame:
    """The columns that packed() put away, and more of the operator's own."""
    return rows.select("_row.*", *more)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if its counted rows are within the limit, else as it is."""
    return F.broadcast(df) if rows <= limit else df


def decision_tree(value: Column, bounds: list, lower: int = 0, compare: Callable = None) -> Column:
    """How many of the sorted bounds are <= value, as nested conditions of logarithmic depth."""
    compare = compare or (lambda v, b: v < F.lit(b))
    if not bounds:
        return F.lit(lower)
    mid = len(bounds) // 2
    return F.when(compare(value, bounds[mid]), decision_tree(value, bounds[:mid], lower, compare)).otherwise(decision_tree(value, bounds[mid + 1 :], lower + mid + 1, compare))


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows for what is written within: for columns of whole texts, whose rows are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches as they come; what Arrow holds in reserve goes back to the system when a task ends, as workers live on."""
    yield from batches
    pa.default_memory_pool().release_unused()


#: What an entry of a dict costs besides the letters of its key and the bytes of its value, about.
ENTRY_BYTES = 140


class Memo(dict):
    """A dict that works out missing entries; of two generations the older goes, so a worker's memory stays bounded.

    It holds at most `bound` entries and about `most_bytes` of keys and values; texts of more than `longest` letters
    are worked out each time.
    """

    def __init__(self, work: Callable, bound: int = 400_000, most_bytes: int = 48 << 20, longest: int = 64):
        super().__init__()
        self.work, self.bound, self.most_bytes, self.longest = work, bound // 2, most_bytes // 2, longest
        self.older, self.bytes = {}, 0

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.work(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.bound or self.bytes >= self.most_bytes:
            self.older, self.bytes = dict(self), 0
            self.clear()
        self[key] = value
        self.bytes += (len(key) + len(value) if isinstance(value, bytes) else 40) + ENTRY_BYTES
        return value
