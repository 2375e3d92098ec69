"""The chat service's message log as an append-only event table.

Frames are ``(session_id, seq, type, ...)``; ``seq`` orders a session.
Operators: route raw messages (P12), segment generations (W1), rebuild
transcripts (A1) and their statistics (A2), the reconnect replay (X3),
de-duplication (X4), session resolution (J1) and the restart purge (X7).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convspark.functions.json import exact_json, number_text
from convspark.functions.text import py_strip
from convspark.operators.prefix import running

# Message types a client may send; any other type is ignored.
CLIENT_TYPES = (
    "ping", "config", "inference", "ack", "get_resources", "list_models", "switch_model",
    "recheck_model", "get_status", "train_status", "save_snapshot", "train",
    "download_model", "delete_model",
)
# Server frames kept in a session's replay buffer, and the
# frames whose sending writes the buffer to disk.
BUFFERED_TYPES = ("start", "token", "done", "train_waiting", "train_started", "train_progress",
                  "train_checkpoint", "train_done")
FLUSH_TYPES = ("done", "train_done")
END_TYPES = ("done", "error")


def parse_exact_json(df: DataFrame, text_col: str, out: str, note: str | None = None) -> DataFrame:
    """``out`` = variant of ``text_col`` when the whole (stripped) text is one
    JSON value as Python reads it, else null (see ``functions.json``)."""
    x = df.withColumn("_s", py_strip(text_col))
    return exact_json(x, "_s", out, note).drop("_s")


def route_frames(msgs: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Classify each raw client message.

    ``dead_letter`` with error ``Invalid JSON`` when it does not parse (or a
    Python-style attribute error when it is JSON but not an object);
    otherwise its ``type`` (key missing => ``inference``); a known type is
    ``dispatch``, anything else ``ignored`` (the dispatcher has no else)."""
    x = exact_json(msgs.withColumn("_stripped", py_strip(raw_col)), "_stripped", "_j", "_note")
    x = x.withColumn("_jt", F.schema_of_variant("_j"))
    is_obj = F.startswith(F.col("_jt"), F.lit("OBJECT"))
    x = x.withColumn("_tn", F.when(is_obj, F.try_variant_get("_j", "$.type", "variant")))
    x = x.withColumn("_tt", F.schema_of_variant("_tn"))
    msg_type = (F.when(~is_obj | F.col("_j").isNull(), F.lit(None).cast("string"))
                .when(F.col("_tn").isNull(), F.lit("inference"))
                .when(F.col("_tt") == "STRING", F.try_variant_get("_tn", "$", "string")))
    # a type that is no string, such as NaN, is none of the known ones
    msg_type = F.when(~F.coalesce(number_text(msg_type, F.col("_stripped")) != msg_type, F.lit(False)), msg_type)
    x = x.withColumn("msg_type", msg_type)
    jt = F.col("_jt")
    # a NaN or Infinity alone comes as a string with that note; so does one as the type
    odd = F.coalesce(F.col("_note").contains("non_finite"), F.lit(False))
    pytype = (F.when((jt == "STRING") & odd, F.lit("float"))
              .when(F.startswith(jt, F.lit("ARRAY")), F.lit("list"))
              .when(jt == "STRING", F.lit("str"))
              .when(jt == "BOOLEAN", F.lit("bool"))
              .when(jt == "VOID", F.lit("NoneType"))
              .when(jt.isin("BIGINT", "INT", "SMALLINT", "TINYINT")
                    | (F.startswith(jt, F.lit("DECIMAL")) & F.endswith(jt, F.lit(",0)"))), F.lit("int"))
              .otherwise(F.lit("float")))
    route = (F.when(F.col("_j").isNull() | ~is_obj, F.lit("dead_letter"))
             .when(F.col("msg_type").isin(*CLIENT_TYPES), F.lit("dispatch"))
             .otherwise(F.lit("ignored")))
    err = (F.when(F.col("_j").isNull(), F.lit("Invalid JSON"))
           .when(~is_obj, F.concat(F.lit("'"), pytype, F.lit("' object has no attribute 'get'"))))
    return x.withColumn("route", route).withColumn("error", err).drop("_j", "_jt", "_tn", "_tt", "_note", "_stripped")


def segment_generations(frames: DataFrame, block_bits: int | None = None) -> DataFrame:
    """Generation number of each frame = running count of ``start``;
    frames after a ``done``/``error`` and before the next ``start`` get null.

    One skew-safe blocked scan (see :mod:`convspark.operators.prefix`) gives
    the last start, the count of starts and the last end strictly before."""
    is_start = F.col("type") == "start"
    is_end = F.col("type").isin(*END_TYPES)
    x = running(frames, ["session_id"], "seq",
                maxes={"_ls": (F.when(is_start, F.col("seq")), True),
                       "_le": (F.when(is_end, F.col("seq")), False)},
                sums={"_cnt": (F.when(is_start, F.lit(1)).otherwise(F.lit(0)), True)},
                block_bits=block_bits)
    open_ = F.col("_ls").isNotNull() & (F.col("_le").isNull() | (F.col("_le") < F.col("_ls")))
    return x.withColumn("gen", F.when(open_, F.col("_cnt")).cast("long")).drop("_ls", "_cnt", "_le")


def rebuild_transcripts(frames: DataFrame, js_errors: bool = False) -> DataFrame:
    """A1: the text of each generation = its ``token`` data in ``seq`` order.

    Input: segmented frames (``gen`` from W1).  ``js_errors`` follows the web
    page, which appends ``\\n[error] <message>`` when a generation fails.
    Groups are single generations (bounded by the token budget)."""
    g = frames.filter(F.col("gen").isNotNull())
    toks = F.array_sort(F.collect_list(F.when(F.col("type") == "token", F.struct("seq", "data"))))
    agg = g.groupBy("session_id", "gen").agg(
        F.array_join(F.transform(toks, lambda s: s["data"]), "").alias("text"),
        F.max_by(F.when(F.col("type").isin(*END_TYPES), F.col("type")),
                 F.when(F.col("type").isin(*END_TYPES), F.col("seq"))).alias("outcome"),
        F.max_by(F.when(F.col("type") == "error", F.col("message")),
                 F.when(F.col("type") == "error", F.col("seq"))).alias("_msg"),
    )
    text = F.col("text")
    if js_errors:
        text = F.when(F.col("outcome") == "error",
                      F.concat(text, F.lit("\n[error] "), F.coalesce(F.col("_msg"), F.lit("unknown error")))) \
            .otherwise(text)
    return agg.select("session_id", "gen", text.alias("text"),
                      F.coalesce(F.col("outcome"), F.lit("open")).alias("outcome"))


def generation_stats(frames: DataFrame) -> DataFrame:
    """A2: per generation the prompt size (``tokens_in`` of ``start``), the
    client's count of token frames, the server's ``total_tokens`` and the
    outcome done / error / open."""
    g = frames.filter(F.col("gen").isNotNull())
    is_end = F.col("type").isin(*END_TYPES)
    return g.groupBy("session_id", "gen").agg(
        F.max(F.when(F.col("type") == "start", F.col("tokens_in"))).alias("tokens_in"),
        F.count_if(F.col("type") == "token").alias("token_frames"),
        F.sum(F.when(F.col("type") == "token", F.length("data"))).cast("long").alias("chars"),
        F.max(F.when(F.col("type") == "done", F.col("total_tokens"))).alias("total_tokens"),
        F.coalesce(F.max_by(F.when(is_end, F.col("type")), F.when(is_end, F.col("seq"))),
                   F.lit("open")).alias("outcome"),
    )


def replay(frames: DataFrame) -> DataFrame:
    """Frames re-sent on reconnect, i.e. buffered frames written to disk
    since the last ``ack``: ``last ack < seq <= last flush``.  Flushes happen
    at ``done``/``train_done``; frames after the last flush are still in
    memory and are not replayed; replay does not clear the buffer.

    An ``error`` frame is buffered only when it reports a training failure,
    which names the request (``request_id``, where the frames carry one).

    Two per-session maxima (map-side combined) joined back: no per-session
    sort, so a session of any length is handled in parallel."""
    marks = frames.groupBy("session_id").agg(
        F.max(F.when(F.col("type") == "ack", F.col("seq"))).alias("last_ack"),
        F.max(F.when(F.col("type").isin(*FLUSH_TYPES), F.col("seq"))).alias("last_flush"))
    kept = F.col("type").isin(*BUFFERED_TYPES)
    if "request_id" in frames.columns:
        kept = kept | ((F.col("type") == "error") & F.col("request_id").isNotNull())
    j = frames.filter(kept).join(marks, "session_id")
    return (j.filter((F.col("seq") > F.coalesce(F.col("last_ack"), F.lit(-1)))
                     & (F.col("seq") <= F.col("last_flush")))
            .drop("last_ack", "last_flush"))


def dedupe_frames(lines: DataFrame, id_col: str = "id") -> DataFrame:
    """X4 (batch): keep one copy of every log line id (at-least-once replay)."""
    return lines.dropDuplicates([id_col])


def resolve_sessions(hellos: DataFrame, sessions: DataFrame) -> DataFrame:
    """A hello naming a live session resumes it; a missing or unknown id
    starts a new session (its id derived from the hello's own key)."""
    live = sessions.select(F.col("session_id").alias("_sid")).distinct()
    # hellos without an id would all be shuffled to one task by the join
    named, new = hellos.filter(F.col("session_id").isNotNull()), hellos.filter(F.col("session_id").isNull())
    j = named.join(live, named["session_id"] == live["_sid"], "left")
    j = j.unionByName(new.withColumn("_sid", F.lit(None).cast(live.schema["_sid"].dataType)))
    return j.select(
        *[F.col(c) for c in hellos.columns if c != "session_id"],
        F.col("session_id").alias("requested"),
        F.when(F.col("_sid").isNotNull(), F.lit("resume")).otherwise(F.lit("new")).alias("outcome"),
        F.when(F.col("_sid").isNotNull(), F.col("_sid").cast("string"))
        .otherwise(F.concat(F.lit("new-"), F.col("hello_id").cast("string"))).alias("session_id"),
    )


def purge_sessions(sessions: DataFrame, restarts: DataFrame) -> DataFrame:
    """A restart drops every session created before it; keep sessions
    created at or after the latest restart (all when there was none).

    The latest restart is a scalar subquery: one value, no join."""
    last = restarts.agg(F.max("ts")).scalar()
    return sessions.filter(F.coalesce(F.col("created") >= last, F.lit(True)))
