"""The session log on disk: append encoded frames (SRC3) and read them back
(SRC4).

Each line is a JSON envelope ``{"session_id", "seq", "id", "data"}`` where
``data`` is the encoded frame (T6).  Files are bucketed by a hash of the
session id, not one folder per session, so a million sessions do not make
a million folders; readers prune by bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from convspark.functions.codec import decode_log, encode_log
from convspark.operators.frames import parse_exact_json
from convspark.session import materialize

LOG_SCHEMA = StructType([
    StructField("session_id", LongType()), StructField("seq", LongType()),
    StructField("id", StringType()), StructField("data", StringType()),
    StructField("_corrupt_record", StringType()),
])


def frame_id(session_id, seq):
    """Line id derived from the frame's key, so a retried write repeats it
    (a random uuid would not)."""
    return F.sha2(F.concat_ws(":", session_id.cast("string"), seq.cast("string")), 256)


def append_log(frames: DataFrame, path: str, key: str, frame_json: str = "frame", buckets: int = 64,
               mode: str = "append") -> None:
    """SRC3: append ``(session_id, seq, frame)`` rows as log lines encoded with ``key``."""
    out = frames.select(
        F.col("session_id").cast("long"), F.col("seq").cast("long"),
        frame_id(F.col("session_id"), F.col("seq")).alias("id"),
        encode_log(F.col(frame_json), key).alias("data"),
        F.pmod(F.xxhash64("session_id"), F.lit(buckets)).alias("bucket"))
    out.write.mode(mode).partitionBy("bucket").json(path)


def session_bucket(session_id, buckets: int = 64):
    """The folder a session's lines land in (same rule as ``append_log``)."""
    sid = session_id if hasattr(session_id, "cast") else F.lit(session_id).cast("long")
    return F.pmod(F.xxhash64(sid.cast("long")), F.lit(buckets))


def scan_log(spark: SparkSession, path: str, key: str, session_ids=None, buckets: int = 64) -> tuple[DataFrame, DataFrame]:
    """SRC4: decoded frames and dead letters.

    Blank lines are skipped; a line whose data decodes to nothing is
    dropped; a line whose decoded text is not JSON ends its session's read:
    that line and every later one (by ``seq``) of the session are left out,
    what came before is kept.  A line that is not a JSON envelope at all
    cannot be tied to a session and goes to the dead letters.  With
    ``session_ids`` only those sessions' bucket folders are read;
    without, the decoded frames are written once to the shared checkpoint folder.
    Returns ``(frames, dead_letters)``."""
    raw = (spark.read.schema(LOG_SCHEMA).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    if session_ids is not None:
        # reading a few sessions (a reconnect) touches only their bucket
        # folders: the bucket test folds to literals and prunes partitions
        wanted = sorted({int(s) for s in session_ids})
        raw = raw.filter(F.col("bucket").isin(*[session_bucket(s, buckets) for s in wanted])
                         & F.col("session_id").isin(*wanted))
    dead = raw.filter(F.col("_corrupt_record").isNotNull() | F.col("session_id").isNull()) \
        .select("bucket", "_corrupt_record")
    good = raw.filter(F.col("_corrupt_record").isNull() & F.col("session_id").isNotNull())
    dec = parse_exact_json(good.withColumn("frame", decode_log(F.col("data"), key)), "frame", "_v")  # strict: trailing text is an error
    dec = dec.select("session_id", "seq", "id", "frame", F.col("_v").isNotNull().alias("_ok"),
                     F.try_variant_get("_v", "$.type", "string").alias("type"))
    if session_ids is None:     # the whole log is decoded and parsed once, not for each use of it
        dec = materialize(dec, "log-frames")
    dec = dec.filter(F.col("frame") != "")
    bad = dec.filter(~F.col("_ok")).groupBy("session_id").agg(F.min("seq").alias("_first_bad"))
    kept = (dec.join(bad, "session_id", "left")
            .filter(F.col("_first_bad").isNull() | (F.col("seq") < F.col("_first_bad")))
            .select("session_id", "seq", "id", "frame", "type"))
    return kept, dead
