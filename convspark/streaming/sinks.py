"""Sources and sinks of the streaming jobs.

The operators of this package take a streaming DataFrame and return one; what
they read and where they write is decided here or by the caller.  Sinks are
written with ``foreachBatch`` into ``batch=<id>`` folders, so a retried
micro-batch overwrites its own output (idempotent) and an executor loss costs
a task retry, not a duplicate.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

# transformWithState keeps value, list and map states in RocksDB column
# families; with change logs a commit writes what changed, not the whole store
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def table_stream(spark: SparkSession, path: str, max_files: int | None = None, max_bytes: str | None = None) -> DataFrame:
    """A parquet table (folder or file) as a file stream with the table's own
    schema.  ``max_bytes`` (or ``max_files``) bounds a micro-batch, and with it
    the slice of one key that a stateful task holds."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.parquet(path)


@contextmanager
def _state_conf(spark: SparkSession):
    """The settings a query copies when it starts; the session's own are put back."""
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def start(sdf: DataFrame, sink: str, checkpoint: str, mode: str = "append", split: dict[str, Column] | None = None,
          **trigger) -> StreamingQuery:
    """Starts writing ``sdf`` to ``sink/<name>/batch=<id>``; ``split`` maps the
    name of each output to the rows it takes (default: one output, ``out``).
    ``trigger`` is that of ``DataStreamWriter.trigger`` (default: everything
    available, then stop)."""
    def write(batch: DataFrame, batch_id: int):
        parts = split or {"out": F.lit(True)}
        if len(parts) > 1:
            batch.persist()
        for name, rows in parts.items():
            batch.filter(rows).write.mode("overwrite").parquet(f"{sink}/{name}/batch={batch_id}")
        if len(parts) > 1:
            batch.unpersist()

    writer = sdf.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    with _state_conf(sdf.sparkSession):
        return writer.trigger(**(trigger or {"availableNow": True})).start()


def run_available(sdf: DataFrame, sink: str, checkpoint: str, mode: str = "append", split: dict[str, Column] | None = None) -> None:
    """Everything available, then stop; a failure of the query is raised."""
    start(sdf, sink, checkpoint, mode, split).awaitTermination()


def read_sink(spark: SparkSession, sink: str, name: str = "out") -> DataFrame:
    """All rows of an output, with the number of the ``batch`` that wrote them."""
    return spark.read.option("basePath", f"{sink}/{name}").parquet(f"{sink}/{name}/batch=*")


def read_upserts(spark: SparkSession, sink: str, keys, name: str = "out") -> DataFrame:
    """Latest version of each key in an update-mode sink (highest batch)."""
    df = read_sink(spark, sink, name)
    rest = [c for c in df.columns if c not in (*keys, "batch")]
    latest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
    return latest.select(*keys, "_row.*")
