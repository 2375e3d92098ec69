"""Layered JSON config files (SRC6) as long-form rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convspark.functions.json import exact_json, json_numbers
from convspark.functions.text import py_strip


def scan_config(spark: SparkSession, path: str, file_col: str | None = None) -> DataFrame:
    """SRC6: every ``section.key`` of each JSON config file as
    ``(file, section, key, value, status)``; ``value`` is the JSON text of the
    value.

    Each file is read whole (``wholetext``) and parsed to a variant as Python
    reads JSON (see ``functions.json``), so files are parsed in parallel and no
    schema is inferred; a non-object section becomes one row with a null key.
    Every file gives a row (but for files of no bytes, which Spark's readers
    leave out): ``status`` is ``ok``, ``empty`` (an object without
    sections) or ``broken`` (no JSON object), the last two with a null
    section."""
    df = spark.read.text(path, wholetext=True)  # one row per file (the option form is reset by text())
    f = F.col(file_col) if file_col else F.input_file_name()
    x = exact_json(df.select(f.alias("file"), py_strip("value").alias("_text")), "_text", "_v")
    sections = F.when(F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT")), F.try_variant_get("_v", "$", "map<string,variant>"))
    status = F.when(sections.isNull(), F.lit("broken")).when(F.size(sections) == 0, F.lit("empty")).otherwise(F.lit("ok"))
    secs = x.select("file", "_text", status.alias("status"), F.explode_outer(sections).alias("section", "_s"))
    is_obj = F.startswith(F.schema_of_variant("_s"), F.lit("OBJECT"))
    kv = F.when(is_obj, F.try_variant_get("_s", "$", "map<string,variant>"))
    rows = secs.select("file", "_text", "status", "section", "_s", F.explode_outer(kv).alias("key", "_val"))
    return rows.select("file", "section", "key",
                       json_numbers(F.when(F.col("key").isNull(), F.to_json("_s")).otherwise(F.to_json("_val")), F.col("_text")).alias("value"),
                       "status")


def write_config_files(config: DataFrame, path: str, file_col: str = "file_id") -> None:
    """Write long-form ``(file, section, key, value-json)`` rows as one JSON
    document per file (``file_col=`` folders)."""
    pairs = config.groupBy(file_col, "section").agg(
        F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(
            F.concat(F.to_json(F.array("key")).substr(F.lit(2), F.length(F.to_json(F.array("key"))) - 2),
                     F.lit(":"), F.col("value")))), ","), F.lit("}")).alias("_obj"))
    docs = pairs.groupBy(file_col).agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(
        F.concat(F.to_json(F.array("section")).substr(F.lit(2), F.length(F.to_json(F.array("section"))) - 2),
                 F.lit(":"), F.col("_obj")))), ","), F.lit("}")).alias("value"))
    docs.repartition(file_col).write.mode("overwrite").partitionBy(file_col).text(path)
