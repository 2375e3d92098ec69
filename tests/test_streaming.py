"""Streams of several micro-batches give the batch answers."""

import os
import time

import pytest
from pyspark.sql import functions as F

from convspark.operators import frames as FR
from convspark.operators.jobs import job_status
from convspark.plans import fixtures as FX
from convspark.streaming import frames as ST
from convspark.streaming import sinks as SK

CONTROL = "session_id long, seq long, type string, cfg_key string, cfg_value string"


def rows(df, cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda r: tuple((x is not None, x) for x in r))


def feed(path, *parts):
    """Adds a file per part to the folder, each later than the one before."""
    for part in parts:
        before = set(os.listdir(path)) if os.path.isdir(path) else set()
        part.coalesce(1).write.mode("append").parquet(path)
        n = len([f for f in os.listdir(path) if f.endswith(".parquet")])
        for f in set(os.listdir(path)) - before:
            os.utime(f"{path}/{f}", (1_700_000_000 + n, 1_700_000_000 + n))


def cut(df, by, n):
    """n consecutive ranges of a column."""
    at = df.approxQuantile(by, [i / n for i in range(1, n)], 0.0)
    lows, highs = [float("-inf"), *at], [*at, float("inf")]
    return [df.filter((F.col(by) > a) & (F.col(by) <= b)) for a, b in zip(lows, highs)]


def run(spark, tmp, sdf, mode="append", split=None):
    SK.run_available(sdf, f"{tmp}/sink", f"{tmp}/checkpoint", mode, split)
    return f"{tmp}/sink"


def batches(spark, sink, name="out"):
    return SK.read_sink(spark, sink, name).select("batch").distinct().count()


def test_frames_stream_equals_batch(spark, sf, tmp_path):
    msgs = FX.f_msgs(spark, sf)
    feed(f"{tmp_path}/in", *cut(msgs, "seq", 3))
    routed = ST.stream_frames(SK.table_stream(spark, f"{tmp_path}/in", max_files=1))
    assert routed.isStreaming
    sink = run(spark, tmp_path, routed, split=ST.frame_outputs())
    cols = ["session_id", "seq", "route", "msg_type", "error"]
    dead, rest = SK.read_sink(spark, sink, "dead_letter"), SK.read_sink(spark, sink, "dispatch")
    assert rows(dead.unionByName(rest), cols) == rows(FR.route_frames(msgs), cols)
    assert batches(spark, sink, "dispatch") == 3 and dead.filter("route <> 'dead_letter'").count() == 0 < dead.count()


def test_sessions_stream_equals_batch(spark, sf, tmp_path):
    frames = FX.f_conns(spark, sf)
    feed(f"{tmp_path}/in", *cut(frames, "seq", 4))
    out = ST.stream_sessions(SK.table_stream(spark, f"{tmp_path}/in", max_files=1))
    assert out.isStreaming
    sink = run(spark, tmp_path, out, "update", ST.session_outputs())
    got = SK.read_upserts(spark, sink, ["session_id"], "sessions")
    assert rows(got, ST.SESSION_COLUMNS) == rows(ST.sessions_batch(frames), ST.SESSION_COLUMNS)
    assert got.filter("closed").count() > 0 < got.filter("not closed").count()
    cols = ["session_id", "seq", "message"]
    errors = SK.read_sink(spark, sink, "errors")
    assert rows(errors, cols) == rows(ST.session_errors(frames), cols) and errors.count() > 0


def test_an_ack_closes_a_session_for_good(spark, tmp_path):
    a = spark.createDataFrame([(1, 1, "config", "top_k", "7"), (1, 2, "start", None, None), (1, 3, "token", None, None), (2, 1, "ping", None, None),
                               (3, 1, "start", None, None), (3, 2, "done", None, None), (3, 3, "token", None, None)], CONTROL)
    b = spark.createDataFrame([(1, 4, "ack", None, None), (1, 5, "config", "top_k", "9"), (2, 2, "config", "note", "x"), (3, 4, "train_done", None, None)], CONTROL)
    c = spark.createDataFrame([(1, 6, "ping", None, None), (2, 3, "config", "note", "y"), (2, 4, "token", None, None)], CONTROL)
    feed(f"{tmp_path}/in", a, b, c)
    sink = run(spark, tmp_path, ST.stream_sessions(SK.table_stream(spark, f"{tmp_path}/in", max_files=1)), "update", ST.session_outputs())
    every = SK.read_sink(spark, sink, "sessions")
    got = {(r.session_id, r.batch): r for r in every.collect()}
    assert set(got) == {(1, 0), (2, 0), (3, 0), (1, 1), (2, 1), (3, 1), (2, 2)}
    assert (got[1, 0].created, got[1, 0].last_activity, got[1, 0].n_frames, got[1, 0].pending) == (1, 3, 3, 2)
    assert "top_k=7" in got[1, 0].config and got[1, 1].closed and got[1, 1].config is None
    assert "note=y;" in got[2, 2].config and got[2, 2].n_config == 2 and got[2, 2].pending == 1
    assert (got[3, 0].pending, got[3, 1].pending) == (1, 0)
    assert rows(SK.read_sink(spark, sink, "errors"), ["session_id", "seq", "message"]) == [(1, 5, "'1'"), (1, 6, "'1'")]


def test_the_mark_of_a_closed_session_may_expire(spark, tmp_path):
    feed(f"{tmp_path}/in", spark.createDataFrame([(1, 1, "ack", None, None)], CONTROL))
    stream = lambda: ST.stream_sessions(SK.table_stream(spark, f"{tmp_path}/in"), closed_ttl="2 seconds")
    sink, outputs = f"{tmp_path}/sink", ST.session_outputs()
    go = lambda: SK.start(stream(), sink, f"{tmp_path}/checkpoint", "update", outputs, once=True).awaitTermination()
    go()
    time.sleep(2.5)
    feed(f"{tmp_path}/in", spark.createDataFrame([(1, 2, "ping", None, None)], CONTROL))
    go()
    got = SK.read_upserts(spark, sink, ["session_id"], "sessions").collect()
    assert [(r.created, r.closed) for r in got] == [(2, False)]


def test_job_status_stream_equals_batch(spark, sf, tmp_path):
    ev = FX.f_train(spark, sf).withColumn("message", F.lit(None).cast("string"))
    feed(f"{tmp_path}/in", *cut(ev, "n", 3))
    out = ST.stream_job_status(SK.table_stream(spark, f"{tmp_path}/in", max_files=1))
    sink = run(spark, tmp_path, out, "update")
    cols = ["request_id", "running", "started_at", "steps_done", "max_steps", "last_loss", "checkpoint", "error"]
    assert rows(SK.read_upserts(spark, sink, ["request_id"]), cols) == rows(job_status(ev), cols)
    assert batches(spark, sink) == 3


def test_dedupe_hands_out_late_lines(spark, tmp_path):
    lines = lambda *x: spark.createDataFrame([(i, s, 1_700_000_000 + 60 * m) for i, s, m in x], "id string, seq long, t long") \
        .withColumn("ts", F.timestamp_seconds("t"))
    parts = [lines(("a", 1, 0), ("a", 2, 5), ("b", 3, 10)), lines(("b", 4, 20), ("c", 5, 200)),
             lines(("a", 6, 100), ("d", 7, 150), ("c", 8, 201)), lines(("a", 9, 400)), lines(("c", 10, 410), ("z", 11, 1))]
    feed(f"{tmp_path}/in", *parts)
    sdf = ST.stream_dedupe(SK.table_stream(spark, f"{tmp_path}/in", max_files=1), delay="1 hour")
    assert sdf.columns == ["id", "seq", "t", "ts", "late"]
    sink = run(spark, tmp_path, sdf, split=ST.late_outputs())
    # watermarks of the batches: none, -50, 140, 140, 340; an id is forgotten an hour after its first line
    kept = [r[1] for r in rows(SK.read_sink(spark, sink), ["id", "seq"])]
    late = [r[1] for r in rows(SK.read_sink(spark, sink, "late"), ["id", "seq"])]
    assert (sorted(kept), sorted(late)) == ([1, 3, 5, 7, 9, 10], [6, 11])


def test_transcripts_stream_equals_batch(spark, sf, tmp_path):
    f = FX.f_frames(spark, sf).withColumn("ts", F.timestamp_seconds("seq"))
    feed(f"{tmp_path}/in", *cut(f.select("session_id", "seq", "type", "data", "ts"), "seq", 4))
    cols = ["session_id", "gen", "text", "outcome"]
    want = rows(FR.rebuild_transcripts(FR.segment_generations(f)), cols)
    sink = run(spark, tmp_path, ST.stream_transcripts(SK.table_stream(spark, f"{tmp_path}/in", max_files=1)), split=ST.late_outputs())
    assert rows(SK.read_sink(spark, sink), cols) == want and SK.read_sink(spark, sink, "late").count() == 0


def test_transcripts_time_out_and_late_frames(spark, tmp_path):
    frame = lambda s, q, k, d, m: (s, q, k, d, 1_700_000_000 + 60 * m)
    make = lambda *x: spark.createDataFrame([frame(*r) for r in x], "session_id long, seq long, type string, data string, t long") \
        .select("session_id", "seq", "type", "data", F.timestamp_seconds("t").alias("ts"))
    parts = [make((1, 1, "start", None, 0), (1, 2, "token", "a ", 1), (2, 1, "start", None, 0), (2, 2, "token", "x", 2)),
             make((1, 3, "token", "b", 40), (3, 1, "start", None, 45)),
             make((1, 4, "done", None, 50), (3, 2, "start", None, 46), (3, 3, "token", "new", 47), (4, 1, "start", None, 200)),
             make((2, 3, "token", "late", 3), (3, 4, "token", "late too", 48), (4, 2, "token", "y", 201)),
             make((4, 3, "error", None, 202), (5, 1, "ping", None, 600))]
    feed(f"{tmp_path}/in", *parts)
    out = ST.stream_transcripts(SK.table_stream(spark, f"{tmp_path}/in", max_files=1), ts_col="ts", delay="30 minutes", idle="100 minutes")
    sink = run(spark, tmp_path, out, split=ST.late_outputs())
    got = rows(SK.read_sink(spark, sink), ["session_id", "gen", "text", "outcome"])
    assert got == [(1, 1, "a b", "done"), (2, 1, "x", "open"), (3, 1, "", "open"), (3, 2, "new", "open"), (4, 1, "y", "error")]
    late = rows(SK.read_sink(spark, sink, "late"), ["session_id", "seq", "type", "data"])
    assert late == [(2, 3, "token", "late"), (3, 4, "token", "late too")]
    # texts of transcripts and late tokens: every token of the input, once
    tokens = "".join(sorted("".join(r[2] for r in got) + "".join(r[3] for r in late)))
    given = [r.data for p in parts for r in p.collect() if r.type == "token"]
    assert tokens == "".join(sorted("".join(given)))


def test_a_restarted_stream_goes_on_from_its_state(spark, tmp_path):
    make = lambda *x: spark.createDataFrame(list(x), "session_id long, seq long, type string, data string")
    stream = lambda: ST.stream_transcripts(SK.table_stream(spark, f"{tmp_path}/in"))
    feed(f"{tmp_path}/in", make((1, 1, "start", None), (1, 2, "token", "one ")))
    run(spark, tmp_path, stream(), split=ST.late_outputs())
    feed(f"{tmp_path}/in", make((1, 3, "token", "two"), (1, 4, "done", None), (1, 5, "token", "stray")))
    sink = run(spark, tmp_path, stream(), split=ST.late_outputs())
    assert rows(SK.read_sink(spark, sink), ["gen", "text", "outcome", "batch"]) == [(1, "one two", "done", 1)]


def test_log_stream_equals_batch(spark, sf, tmp_path):
    from convspark.plans.queries import frames_json
    from convspark.sources.log import scan_log

    fj = frames_json(spark, sf)
    feed(f"{tmp_path}/in", *cut(fj, "seq", 2))
    ST.stream_append_log(SK.table_stream(spark, f"{tmp_path}/in", max_files=1), f"{tmp_path}/log", "relay", f"{tmp_path}/checkpoint").awaitTermination()
    raw = spark.read.json(f"{tmp_path}/log")
    assert raw.select("batch").distinct().count() == 2 and raw.count() == fj.count()
    kept, _ = scan_log(spark, f"{tmp_path}/log", "relay")
    assert kept.count() > 0


def test_operators_refuse_nothing_but_lazy_plans(spark, sf):
    """The operators only build plans: nothing runs before a sink starts."""
    s = FX.events_stream(spark, sf)
    for out in (ST.stream_frames(FX.f_msgs(spark, sf, s)), ST.stream_sessions(FX.f_conns(spark, sf, s)),
                ST.stream_dedupe(FX.f_proto(spark, sf, s).select("id", "seq", "ts"))):
        assert out.isStreaming
    with pytest.raises(Exception, match="streaming"):
        out.collect()


def test_many_lines_share_a_key_of_the_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ST, "BUCKETS", 2)
    lines = lambda *x: spark.createDataFrame([(i, s, 1_700_000_000 + 60 * m) for i, s, m in x], "id long, seq long, t long") \
        .withColumn("ts", F.timestamp_seconds("t"))
    big = 2**53 + 1
    parts = [lines((big, 1, 0), (big + 1, 2, 0), (None, 3, 1), (big, 4, 2), *((i, 100 + i, 1) for i in range(20))),
             lines((big, 5, 10), (None, 6, 3), (7, 7, 500), (big + 1, 8, 9)),
             lines((None, 9, 501), (big, 10, 600), (big, 11, 2), (7, 12, 499)), lines((7, 13, 601), (None, 14, 601))]
    feed(f"{tmp_path}/in", *parts)
    sdf = ST.stream_dedupe(SK.table_stream(spark, f"{tmp_path}/in", max_files=1), delay="1 hour")
    sink = run(spark, tmp_path, sdf, split=ST.late_outputs())
    # watermarks of the batches: none, -59, 440, 540
    assert rows(SK.read_sink(spark, sink), ["seq", "id"]) == [(1, big), (2, big + 1), (3, None), (9, None), (10, big), (12, 7)] \
        + [(100 + i, i) for i in range(20)]
    assert rows(SK.read_sink(spark, sink, "late"), ["seq"]) == [(11,)]


def test_many_sessions_share_a_key_of_the_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ST, "BUCKETS", 2)
    big = 2**53 + 1
    make = lambda *x: spark.createDataFrame([(s, n, *r) if len(r) == 3 else (s, n, *r, None, None) for s, n, *r in x], CONTROL)
    parts = [make((big, 1, "config", "top_k", "1"), (None, 2, "start"), *((i, 3 + i, "token") for i in range(30))),
             make((big, 40, "config", "note", "x"), (big + 1, 41, "ping"), (None, 42, "ack"), (3, 43, "ack"), (3, 44, "ping")),
             make((None, 50, "ping"), (3, 51, "config", "top_k", "2"), (big, 52, "token"), (4, 53, "done"))]
    feed(f"{tmp_path}/in", *parts)
    sink = run(spark, tmp_path, ST.stream_sessions(SK.table_stream(spark, f"{tmp_path}/in", max_files=1)), "update", ST.session_outputs())
    got = {r.session_id: r for r in SK.read_upserts(spark, sink, ["session_id"], "sessions").collect()}
    assert set(got) == {big, big + 1, None, *range(30)}
    assert (got[big].created, got[big].last_activity, got[big].n_frames, got[big].n_config) == (1, 52, 3, 2)
    assert "note=x" in got[big].config and "top_k=1" in got[big].config and "top_k=1" not in got[big + 1].config
    assert got[None].closed and got[3].closed and (got[4].n_frames, got[4].pending, got[5].pending) == (2, 0, 1)
    assert rows(SK.read_sink(spark, sink, "errors"), ["session_id", "seq", "message"]) == [(None, 50, "'None'"), (3, 44, "'3'"), (3, 51, "'3'")]
