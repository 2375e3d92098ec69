"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convspark.session import ensure_checkpoint_dir, scratch_path

__all__ = ["materialize", "materialize_by", "parts_for", "safe_text", "spread_ids", "ensure_checkpoint_dir", "give_back", "thrifty", "slices"]


#: With this on, Spark drops a write's shuffle files as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, drop_shuffles: bool = False) -> DataFrame:
    """Write ``df`` to a fresh table in the shared checkpoint folder and read
    it back: lineage is cut and every later read sees the same rows, whatever
    executors are lost meanwhile.  ``drop_shuffles``: the write's shuffle files
    go when it has ended, not when the driver collects its garbage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if drop_shuffles:
        before = spark.conf.get(_CLEANUP)
        spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            spark.conf.set(_CLEANUP, before)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """``materialize``, laid out in buckets of ``key``: later joins on it move
    the other side only.  The files are in the shared folder; the session's
    catalogue holds no more than their description."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = f"{name}_{path.rsplit('/', 1)[1]}"
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), most)
    # without this, every task would write a file for each bucket
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)


def give_back() -> None:
    """Return a Python worker's free memory to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)     # glibc only
    if trim:
        trim(0)


def thrifty(run):
    """The Arrow function ``run`` of a task, which ends by giving memory back:
    workers outlive their tasks, and the executor needs it for what runs next."""
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def slices(batches, column: int, limit: int):
    """The rows of the batches in slices of at most ``limit`` bytes of a text
    or binary column (or one longer row)."""
    import numpy as np
    import pyarrow.compute as pc

    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0)
        ends = np.concatenate(([0], np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)))
        at = 0
        while at < b.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
            yield b.slice(at, stop - at)
            at = stop


def safe_text(name: str) -> Column:
    """The text column, null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def parts_for(spark: SparkSession, rows: int, rows_per_part: int) -> int:
    """Partitions for ``rows`` rows, at least the session's shuffle count."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / rows_per_part))


def spread_ids(id_col: str, salts: int) -> Column:
    """A stable salt in 0..salts-1 from the id."""
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).cast("int")
