"""Corpus files: land submitted datasets (SRC2) and scan them (SRC1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convspark.functions.names import sanitize_request_id
from convspark.operators.batches import attach


def land_corpus(lines: DataFrame, path: str, order_col: str | None = None) -> None:
    """SRC2: store each request's lines under its sanitised id (``rid=``
    folders, one row per line with its ``line_no``).  Re-landing a request replaces only its folder
    (dynamic partition overwrite).  When two raw ids sanitise to the same
    folder, the later submission (highest ``order_col``) wins.

    ``lines``: ``(request_id, line_no, value)``."""
    x = lines.withColumn("rid", sanitize_request_id(F.col("request_id")))
    if order_col:
        # a submission is a raw id at one order value: the same raw id submitted
        # again replaces its own earlier lines too
        latest = x.groupBy("rid").agg(F.max(F.struct(F.col(order_col).alias("o"), F.col("request_id").alias("r"))).alias("_winner"))
        # lines are dealt by number: most of them may belong to one request
        x = attach(x, latest, key="rid", spread="line_no").filter(F.col("request_id").eqNullSafe(F.col("_winner.r"))
                                         & F.col(order_col).eqNullSafe(F.col("_winner.o"))).drop("_winner")
    # no repartition by request: a request holding a third of all lines would
    # land through one task; each task writes its own file per folder,
    # lines in their original order within it
    out = x.sortWithinPartitions("rid", "line_no").select("rid", F.col("line_no").cast("long").alias("line_no"), "value")
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("rid").parquet(path))


def scan_corpus(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: one row per landed line, ``(request_id, line_no, value)``.

    ``line_no`` is the one the line was landed with, so ids, and the seeded
    shuffles that hash them, do not depend on how the files are split."""
    return (spark.read.schema("line_no long, value string, rid string").parquet(path)
            .select(F.col("rid").alias("request_id"), "line_no", "value"))


def scan_text(spark: SparkSession, path: str) -> DataFrame:
    """SRC1 for plain text files under ``rid=`` folders.  ``spark.read.text``
    splits on ``\\n``, ``\\r\\n`` and ``\\r`` like a text-mode reader; blank
    lines are kept (P3 removes them).

    ``line_no`` grows with the position in a file, but its values depend on
    the file splits: land the lines once (:func:`land_corpus`) and work from
    :func:`scan_corpus` where they must repeat."""
    df = spark.read.schema("value string, rid string").text(path)
    return df.select(F.col("rid").alias("request_id"), F.monotonically_increasing_id().alias("line_no"), "value")
