"""Operator 5, sharding by jump consistent hashing.

A stable 64-bit key goes through the jump hash: no ring table is kept, and
one more shard takes rows only into itself, about 1/(n+1) of them.  Slots
number a shard's rows from 0 without gaps: the (narrow) assignment rows are
range-sorted by shard and id over all tasks, each task counts its rows per
shard, and the counts before a task are added to its local numbers, so no
shard is ever gathered in one task.

Defined cases
    * a null id is a key of its own (hashed as such); equal ids share a shard;
    * a null text has size 1 and the checksum of the empty text;
    * repeated rows each take a slot; ties in the sort are any order of
      identical rows;
    * an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from convspark.llm.common import materialize, parts_for, safe_text

#: Multiplier of the generator in the published jump hash.
JUMP_MULTIPLIER = 2862933555777941757


def jump_numpy(keys, n_shards: int):
    """Jump consistent hash of an array of 64-bit keys."""
    import numpy as np

    key = np.asarray(keys).astype(np.int64).view(np.uint64).copy()
    shard = np.full(key.shape, -1, np.int64)
    nxt = np.zeros(key.shape, np.int64)
    live = np.arange(len(key))
    while len(live):
        shard[live] = nxt[live]
        k = key[live] * np.uint64(JUMP_MULTIPLIER) + np.uint64(1)
        key[live] = k
        step = (shard[live] + 1) * (float(1 << 31) / ((k >> np.uint64(33)).astype(np.float64) + 1.0))
        nxt[live] = step.astype(np.int64)
        live = live[nxt[live] < n_shards]
    return shard.astype(np.int32)


def jump_hash(key: Column, n_shards: int) -> Column:
    """Shard 0..n_shards-1 of a long key column."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")

    @F.pandas_udf(T.IntegerType())
    def shard_of(k: pd.Series) -> pd.Series:
        return pd.Series(jump_numpy(k.to_numpy(), n_shards))

    return shard_of(key)


def stable_key(id_col: str) -> Column:
    """A well-mixed key that depends on the id alone."""
    return F.xxhash64(F.col(id_col))


def assign_shards(df: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text",
                  rows_per_part: int = 2_000_000) -> DataFrame:
    """``id, size, crc, shard, slot, grown`` for every row of ``df``; ``grown``
    is the shard the same key has with one shard more."""
    spark = df.sparkSession
    t = safe_text(text_col)
    rows = df.select(F.col(id_col).alias("id"),
                     (F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long") + 1).alias("size"),
                     F.crc32(t.cast("binary")).alias("crc"),
                     F.monotonically_increasing_id().alias("tie"))
    key = stable_key("id")
    rows = materialize(rows.withColumns({"shard": jump_hash(key, n_shards), "grown": jump_hash(key, n_shards + 1)}), "op5_rows")
    parts = parts_for(spark, rows.count(), rows_per_part)
    # the tie column lets the range partitioner split an id that holds many rows
    order = ["shard", "id", "size", "crc", "tie"]
    sorted_rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = T.StructType([f for f in rows.schema if f.name != "tie"]
                          + [T.StructField("part", T.IntegerType()), T.StructField("local", T.LongType())])

    def number(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen = np.zeros(n_shards, np.int64)
        for b in batches:
            shard = b.column("shard").to_numpy()
            # rows come sorted by shard: a run's first row restarts the count
            first = np.searchsorted(shard, np.arange(n_shards))
            local = np.arange(len(shard)) - first[shard] + seen[shard]
            seen += np.bincount(shard, minlength=n_shards)
            cols = [b.column(f.name) for f in schema[:-2]]
            yield pa.RecordBatch.from_arrays(
                cols + [pa.array(np.full(len(shard), part, np.int32)), pa.array(local)], names=[f.name for f in schema])

    numbered = materialize(sorted_rows.drop("tie").mapInArrow(number, schema), "op5_numbered")
    # one row per task and shard it holds (a task of a range holds few)
    counts = numbered.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = materialize(counts.select("shard", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start")), "op5_start")
    out = numbered.join(start, ["shard", "part"])
    return out.select("id", "size", "crc", "shard", (F.col("start") + F.col("local")).alias("slot"), "grown")


def write_shards(df: DataFrame, path: str, n_shards: int, id_col: str = "doc_id") -> None:
    """Write ``df`` in one folder per shard (``shard=<n>``); a shard's rows
    are written by all tasks that hold some, never by one."""
    out = df.withColumn("shard", jump_hash(stable_key(id_col), n_shards))
    out.write.partitionBy("shard").parquet(path)


def op5_shards(spark, sf_dir: str) -> DataFrame:
    from convspark.sources.tables import read_table

    a = assign_shards(read_table(spark, sf_dir, "documents"), 16)
    return a.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"),
                    "shard", "slot", F.col("grown").alias("grown_shard"))
