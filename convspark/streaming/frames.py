"""The frame log as a live stream: streaming DataFrames in, streaming
DataFrames out.

* X1 ``stream_frames``: P12 routing; dispatched messages and dead letters are
  two outputs of the sink (``frame_outputs``).
* X2 ``stream_sessions``: the live session table, with ``transformWithState``;
  the first ``ack`` closes a session for good, later frames are answered with
  an error (``session_outputs``).
* SRC3 ``stream_append_log``: the encoded log written batch by batch.
* X4 ``stream_dedupe``: at-least-once replays de-duplicated on the line id;
  lines behind the watermark are an output of their own (``late_outputs``).
* X5 ``stream_job_status``: A7 kept current by a streaming aggregation (update
  mode).
* X6 ``stream_transcripts``: A1 emitted when a generation closes; frames behind
  the watermark are an output of their own (``late_outputs``).

Sources and sinks are in :mod:`convspark.streaming.sinks`; any source will do,
such as a file stream or ``readStream.format("kafka")``.  A stream processes a
key's rows in order of arrival, and by ``seq`` within a micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StringType

from convspark.operators import frames as FR
from convspark.operators import jobs as JB
# module-level on purpose: classes that run inside Python workers must not
# import this package at run time (executors may not have it installed; they
# and these globals travel by value)
from convspark.operators.config import GENERATION_DEFAULTS, json_text
from convspark.streaming.state import LineDedupe, SessionTable, TranscriptBuilder

# ------------------------------------------------------------------ X1
def stream_frames(msgs: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Every message with its ``route``, ``msg_type`` and ``error``."""
    return FR.route_frames(msgs, raw_col)


def frame_outputs() -> dict:
    """The sink outputs of X1: what is dispatched or ignored, and dead letters."""
    dead = F.col("route") == "dead_letter"
    return {"dispatch": ~dead, "dead_letter": dead}


# ------------------------------------------------------------------ SRC3 on a stream
def stream_append_log(frames: DataFrame, log_path: str, key: str, checkpoint: str, **trigger) -> StreamingQuery:
    """SRC3 fed by a stream of ``(session_id, seq, frame)``: each micro-batch is
    encoded and written to ``log_path/batch=<id>`` with overwrite, so a replayed
    batch replaces its own lines; line ids are hashes of the frame key, so
    readers can also de-duplicate across batches (X4).  Returns the running
    query (default trigger: everything available, then stop)."""
    from convspark.sources.log import append_log

    def write(batch: DataFrame, batch_id: int):
        append_log(batch, f"{log_path}/batch={batch_id}", key, mode="overwrite")

    return (frames.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
            .trigger(**(trigger or {"availableNow": True})).start())


# ------------------------------------------------------------------ X5
def stream_job_status(events: DataFrame) -> DataFrame:
    """A7 as a streaming aggregation (update mode; the latest row of a
    request is its status)."""
    return JB.job_status(events)


# A stateful task works per bucket of ids, not per id: the cost of a key (its
# rows handed over, its state asked for) is then paid a fixed number of times
# per micro-batch.  A bucket of a batch must fit a task's memory.
BUCKETS = 4096


def _bucketed(df: DataFrame, col: str):
    return df.withColumn("_bucket", F.pmod(F.xxhash64(col), F.lit(BUCKETS))).groupBy("_bucket")


# ------------------------------------------------------------------ X4
def _event_time(df: DataFrame, ts_col: str, delay: str) -> DataFrame:
    """``df`` with the watermark of ``ts_col`` and its event time in ``_ms``.

    The column that carries the watermark is dropped, for a stateful operator
    that reads it would throw late rows away before they reach the processor;
    the watermark itself holds for the whole query."""
    et = df.withColumn("_et", F.col(ts_col).cast("timestamp")).withWatermark("_et", delay)
    return et.withColumn("_ms", F.unix_millis("_et")).drop("_et")


def late_outputs() -> dict:
    """The sink outputs of X4 and X6: rows in time and rows behind the watermark."""
    return {"out": ~F.col("late"), "late": F.col("late")}


def stream_dedupe(lines: DataFrame, ts_col: str = "ts", delay: str = "1 hour", id_col: str = "id") -> DataFrame:
    """The first of the lines of one id, and with ``late`` true every line
    whose event time is behind the watermark (``delay`` behind the latest seen
    in earlier micro-batches).  An id is forgotten ``delay`` after its first
    line, so state is bounded by the watermark."""
    text = lines.schema[id_col].dataType == StringType()
    x = _event_time(lines, ts_col, delay).withColumn("_id", F.col(id_col) if text else F.to_json(F.struct(id_col)))
    return _bucketed(x, "_id").transformWithState(
        LineDedupe(lines.columns, _interval_ms(lines.sparkSession, delay)),
        lines.withColumn("late", F.lit(True)).schema, "Append", "EventTime")


# ------------------------------------------------------------------ X2
SESSION_COLUMNS = ("session_id", "created", "last_activity", "n_frames", "n_config", "pending", "config", "closed")


def stream_sessions(frames: DataFrame, closed_ttl: str | None = None) -> DataFrame:
    """The live session table of a stream of ``(session_id, seq, type,
    cfg_key, cfg_value)``, update mode.

    Every frame bumps ``last_activity``; ``config`` frames set a key (the last
    one wins, extra keys are kept); ``pending`` counts the buffered frames since
    the last flush.  The first ``ack`` closes the session for good: its state
    goes, but for a mark, and later frames are answered with the error a missing
    session gives.  ``row`` tells session rows from those errors
    (``session_outputs``).  ``closed_ttl`` (an interval of processing time, such
    as '30 days') bounds how long marks are kept; a frame after that would open
    a session anew.  Processing time always goes on, so a stream with it runs
    under a ``processingTime`` or ``once`` trigger, not ``availableNow``."""
    kind = frames.schema["session_id"].dataType.simpleString()
    schema = ("row string, session_id string, created long, last_activity long, n_frames long, n_config long, pending long, "
              "config string, closed boolean, seq long, message string")
    ttl = _interval_ms(frames.sparkSession, closed_ttl) if closed_ttl else None
    table = SessionTable({k: json_text(v) for k, v in GENERATION_DEFAULTS.items()}, FR.BUFFERED_TYPES, FR.FLUSH_TYPES, ttl)
    # ids travel as text: pandas would make floats of whole numbers beside a null
    name = F.coalesce(F.concat(F.lit("="), F.col("session_id").cast("string")), F.lit(""))
    out = _bucketed(frames.select(name.alias("name"), "seq", "type", "cfg_key", "cfg_value"), "name") \
        .transformWithStateInPandas(table, schema, "Update", "ProcessingTime" if ttl else "None")
    return out.withColumn("session_id", F.col("session_id").cast(kind))


def session_outputs() -> dict:
    """The sink outputs of X2: session rows and errors."""
    return {"sessions": F.col("row") == "session", "errors": F.col("row") == "error"}


def sessions_batch(frames: DataFrame) -> DataFrame:
    """Batch twin of X2 (same answer as the stream at its end).  Aggregates
    only; the merged config is the defaults plus the last update per key (J3).
    A session with an ``ack`` is closed."""
    from convspark.operators.config import merge_settings

    first_ack = F.min(F.when(F.col("type") == "ack", F.col("seq")))
    marks = frames.groupBy("session_id").agg(first_ack.alias("_ack"),
                                             F.max(F.when(F.col("type").isin(*FR.FLUSH_TYPES), F.col("seq"))).alias("_fl"))
    y = frames.join(marks.filter(F.col("_ack").isNull()).drop("_ack"), "session_id")
    live = y.groupBy("session_id").agg(
        F.min("seq").alias("created"), F.max("seq").alias("last_activity"), F.count(F.lit(1)).alias("n_frames"),
        F.count_if(F.col("type") == "config").alias("n_config"),
        F.count_if(F.col("type").isin(*FR.BUFFERED_TYPES)
                   & (F.col("_fl").isNull() | (F.col("seq") > F.col("_fl")))).alias("pending"))
    upd = y.filter((F.col("type") == "config") & F.col("cfg_key").isNotNull() & F.col("cfg_value").isNotNull()).select(
        "session_id", F.col("cfg_key").alias("key"), F.col("cfg_value").alias("value"), F.lit(1).alias("layer"), "seq")
    # sessions without updates still get the defaults
    scopes = live.select("session_id", F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"),
                         F.lit(1).alias("layer"), F.lit(-2).cast("long").alias("seq"))
    pairs = F.array_sort(F.filter("settings", lambda s: s["key"].isNotNull()))
    conf = merge_settings(upd.unionByName(scopes)).select("session_id", F.array_join(
        F.transform(pairs, lambda s: F.concat(s["key"], F.lit("="), s["value"])), ";").alias("config"))
    closed = marks.filter(F.col("_ack").isNotNull()).select(
        "session_id", F.lit(None).cast("long").alias("created"), F.lit(None).cast("long").alias("last_activity"),
        F.lit(0).cast("long").alias("n_frames"), F.lit(0).cast("long").alias("n_config"),
        F.lit(0).cast("long").alias("pending"), F.lit(None).cast("string").alias("config"))
    return (live.join(conf, "session_id", "left").withColumn("closed", F.lit(False))
            .unionByName(closed.withColumn("closed", F.lit(True))))


def session_errors(frames: DataFrame) -> DataFrame:
    """Batch twin of X2's errors: ``session_id, seq, message`` of the frames
    after a session's first ``ack``."""
    marks = frames.filter(F.col("type") == "ack").groupBy("session_id").agg(F.min("seq").alias("_ack"))
    return frames.join(marks, "session_id").filter(F.col("seq") > F.col("_ack")).select(
        "session_id", "seq", F.concat(F.lit("'"), F.col("session_id").cast("string"), F.lit("'")).alias("message"))


# ------------------------------------------------------------------ X6
def stream_transcripts(frames: DataFrame, ts_col: str | None = None, delay: str = "1 hour", idle: str | None = None) -> DataFrame:
    """One row per closed generation of a stream of ``(session_id, seq,
    type, data)``, append mode: ``session_id, gen, text, outcome``.

    A token is appended to the state's list; the text is put together once,
    when the generation closes (``done``, ``error`` or the next ``start``).
    With ``ts_col`` (event time), a frame behind the watermark (``delay``
    behind the latest event time of earlier micro-batches) joins no transcript
    and is handed out with ``late`` true and its ``seq``, ``type``, ``data`` and
    ``ts``; and a generation without frames for ``idle`` (default: ``delay``)
    closes as ``open`` once the watermark has passed that time, so abandoned
    generations do not hold state forever."""
    spark = frames.sparkSession
    kind = frames.schema["session_id"].dataType.simpleString()
    schema = f"row string, session_id {kind}, gen long, text string, outcome string, seq long, type string, data string, ms long"
    keep = ["session_id", "seq", "type", "data"]
    if ts_col:
        idle_ms = _interval_ms(spark, idle or delay)
        x = _event_time(frames, ts_col, delay).select(*keep, F.col("_ms").alias("ms"))
    else:
        idle_ms, x = None, frames.select(*keep)
    out = x.groupBy("session_id").transformWithStateInPandas(
        TranscriptBuilder(FR.END_TYPES, idle_ms), schema, "Append", "EventTime" if ts_col else "None")
    return out.select("session_id", "gen", "text", "outcome", (F.col("row") == "late").alias("late"),
                      "seq", "type", "data", F.timestamp_millis("ms").alias("ts"))


def _interval_ms(spark, interval: str) -> int:
    """Milliseconds in an interval literal such as '1 hour'."""
    row = spark.sql(f"SELECT unix_millis(TIMESTAMP'1970-01-01 00:00:00 UTC' + INTERVAL {interval}) AS ms").first()
    return int(row["ms"])
