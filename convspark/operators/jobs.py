"""Training-job bookkeeping: latest status per request (A7) and the train
lock (J7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convspark.operators.prefix import block_of, running

FOREVER = 1 << 61         # microseconds: the end of a job that still runs
TRAIN_IN_PROGRESS = "Training in progress. Inference is temporarily unavailable."  # fixed value


def job_status(events: DataFrame) -> DataFrame:
    """State of each training request after its events.

    ``events``: ``(request_id, n, type, step, loss, message)`` with ``n``
    the event order.  Only events after the latest ``train_started`` count
    (a start resets); ``train_progress`` sets steps and loss;
    ``train_done`` ends the run keeping the last loss and reporting its step
    count (``steps``, or ``step`` where the events have no such column or it
    is null); ``error`` ends it keeping the steps.

    Events may have ``max_steps`` (of ``train_started`` and
    ``train_progress``), ``checkpoint`` (of ``train_done``; null if none was
    written) and ``ts``; for each of them that they have, the state has a
    column ``max_steps``, ``checkpoint``, or ``started_at`` (``ts`` of the
    latest start).

    One grouped aggregation (each piece a ``max_by`` on ``n``) and a
    projection, so the same code runs on a stream in update mode."""
    t = F.col("type")

    def last(cond, *cols):
        return F.max_by(F.when(cond, F.struct(F.col("n").alias("n"), *[F.col(c) if isinstance(c, str) else c for c in cols])),
                        F.when(cond, F.col("n")))

    done_steps = (F.coalesce("steps", "step") if "steps" in events.columns else F.col("step")).alias("step")
    extra = {}
    if "max_steps" in events.columns:
        extra["max_steps"] = last(t.isin("train_started", "train_progress") & F.col("max_steps").isNotNull(), "max_steps")
    if "checkpoint" in events.columns:
        extra["checkpoint"] = last(t == "train_done", "checkpoint")
    started = [last(t == "train_started", "ts").alias("_st")] if "ts" in events.columns else []
    g = events.groupBy("request_id").agg(
        F.max(F.when(t == "train_started", F.col("n"))).alias("_ls"), *started,
        last(t == "train_progress", "step", "loss").alias("_p"),
        last(t == "train_done", done_steps).alias("_d"),
        last(t == "error", "message").alias("_e"),
        *[piece.alias(f"_{name}") for name, piece in extra.items()],
    )
    since = lambda s: s.isNotNull() & (s["n"] > F.coalesce(F.col("_ls"), F.lit(-1)))
    p_ok, d_ok, e_ok = since(F.col("_p")), since(F.col("_d")), since(F.col("_e"))
    done_last = d_ok & (~e_ok | (F.col("_d.n") > F.col("_e.n")))
    err_last = e_ok & ~done_last
    return g.select(
        "request_id",
        (~d_ok & ~e_ok).alias("running"),
        F.when(done_last, F.col("_d.step")).when(p_ok, F.col("_p.step")).otherwise(F.lit(0))
        .cast("long").alias("steps_done"),
        F.when(p_ok, F.col("_p.loss")).alias("last_loss"),
        F.when(err_last, F.col("_e.message")).alias("error"),
        # a start's own maximum counts for its run
        *[F.when(F.col(f"_{name}").isNotNull() & (F.col(f"_{name}.n") >= F.coalesce(F.col("_ls"), F.lit(-1))), F.col(f"_{name}.{name}"))
          .alias(name) for name in extra], *[F.col("_st.ts").alias("started_at") for _ in started])


def job_islands(jobs: DataFrame) -> DataFrame:
    """The times in which some job runs, as disjoint intervals ``start, end``
    (microseconds): overlapping and touching jobs are merged.  ``jobs``:
    ``(start, end)``; a job without an end still runs, one without a start or
    that ends before it starts holds nothing.

    Gaps and islands by two blocked running maxima (see
    :mod:`convspark.operators.prefix`), so no task sorts all jobs."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    spans = jobs.select(us("start").alias("start"), F.coalesce(us("end"), F.lit(FOREVER)).alias("end")).filter("start < end")
    spans = spans.groupBy("start").agg(F.max("end").alias("end")).withColumn("_g", F.lit(0))
    block = block_of(spans, "start")
    block = False if block is None else block
    x = running(spans, ["_g"], "start", block=block, maxes={"_before": (F.col("end"), False)})
    opens = F.col("_before").isNull() | (F.col("_before") < F.col("start"))
    x = running(x, ["_g"], "start", block=block, maxes={"_island": (F.when(opens, F.col("start")), True)})
    return x.groupBy(F.col("_island").alias("start")).agg(F.max("end").alias("end"))


def blocked_requests(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Requests that arrive while a training job holds the lock
    (``start <= ts < end``): inference is refused, a train request waits.

    Overlapping jobs are merged first.  Of disjoint intervals only the last
    one that starts before a request can hold it: a running maximum over both
    tables in order of time finds it, so a request meets one candidate however
    many jobs run.  A request without a time is never blocked."""
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    names = requests.columns
    asked = requests.select(F.struct(*names).alias("_r"), ts.alias("_t"), F.lit(None).cast("long").alias("_s"), F.lit(None).cast("long").alias("_e"))
    held = job_islands(jobs).select(F.lit(None).cast(asked.schema["_r"].dataType).alias("_r"), F.col("start").alias("_t"),
                                    F.col("start").alias("_s"), F.col("end").alias("_e"))
    # at one time an interval comes before the requests that it holds
    both = asked.filter("_t is not null").unionByName(held).withColumn("_at", 2 * F.col("_t") + F.col("_s").isNull().cast("int")) \
        .withColumn("_g", F.lit(0))
    last = running(both, ["_g"], "_at", maxes={"_last": (F.when(F.col("_s").isNotNull(), F.struct("_s", "_e")), True)})
    found = last.filter(F.col("_s").isNull()).select("_r.*", F.coalesce(F.col("_t") < F.col("_last._e"), F.lit(False)).alias("blocked"))
    out = found.unionByName(asked.filter("_t is null").select("_r.*", F.lit(False).alias("blocked")))
    blocked = F.col("blocked")
    return out.select(*names, "blocked",
                      F.when(blocked & (F.col("kind") == "inference"), F.lit("rejected"))
                      .when(blocked, F.lit("waiting")).otherwise(F.lit("run")).alias("outcome"))
