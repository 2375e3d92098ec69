"""Frame-log rules on hand-made sessions."""

from convspark.operators.frames import rebuild_transcripts, replay, route_frames, segment_generations
from convspark.operators.prefix import running

FR = "session_id long, seq long, type string, data string, tokens_in int, total_tokens int, message string"


def frames(spark, rows):
    return spark.createDataFrame([(s, q, t, d, None, None, m) for s, q, t, d, m in rows], FR)


def test_error_after_tokens_and_frames_between(spark):
    rows = [(1, 1, "start", None, None), (1, 2, "token", "a ", None), (1, 3, "token", "b", None),
            (1, 4, "error", None, "boom"), (1, 5, "pong", None, None), (1, 6, "start", None, None),
            (1, 7, "token", "c", None), (1, 8, "done", None, None), (1, 9, "token", "stray", None)]
    seg = {r.seq: r.gen for r in segment_generations(frames(spark, rows), block_bits=1).collect()}
    assert seg == {1: 1, 2: 1, 3: 1, 4: 1, 5: None, 6: 2, 7: 2, 8: 2, 9: None}
    tr = {r.gen: (r.text, r.outcome) for r in
          rebuild_transcripts(segment_generations(frames(spark, rows)), js_errors=True).collect()}
    assert tr == {1: ("a b\n[error] boom", "error"), 2: ("c", "done")}


def test_replay_unflushed_tail_and_ack(spark):
    rows = [(1, 1, "start", None, None), (1, 2, "token", "x", None), (1, 3, "done", None, None),
            (1, 4, "ack", None, None), (1, 5, "start", None, None), (1, 6, "done", None, None),
            (1, 7, "start", None, None), (1, 8, "token", "y", None),  # unflushed tail
            (2, 1, "start", None, None), (2, 2, "error", None, "e")]  # never flushed
    got = sorted((r.session_id, r.seq) for r in replay(frames(spark, rows)).collect())
    assert got == [(1, 5), (1, 6)]


def test_route_edge_rows(spark):
    msgs = ['{"type":"ping"}', '{"prompt":"p"}', '{"type":"warp"}', "[1]", '{"type": 5}', "{bad", '{"a":1} x',
            '{"type": null}', "7"]
    df = spark.createDataFrame([(1, i, m) for i, m in enumerate(msgs)], "session_id long, seq long, raw string")
    got = [(r.route, r.msg_type, r.error) for r in route_frames(df).orderBy("seq").collect()]
    assert got == [("dispatch", "ping", None), ("dispatch", "inference", None), ("ignored", "warp", None),
                   ("dead_letter", None, "'list' object has no attribute 'get'"), ("ignored", None, None),
                   ("dead_letter", None, "Invalid JSON"), ("dead_letter", None, "Invalid JSON"),
                   ("ignored", None, None), ("dead_letter", None, "'int' object has no attribute 'get'")]


def test_blocked_running_matches_plain_window(spark):
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    random.seed(3)
    data = [(k, s, random.choice([None, random.randint(0, 50)])) for k in range(3) for s in random.sample(range(400), 120)]
    df = spark.createDataFrame(data, "k long, s long, v long")
    out = running(df, ["k"], "s", maxes={"m": (F.col("v"), True), "mx": (F.col("v"), False)},
                  sums={"c": (F.coalesce("v", F.lit(0)), True)}, block_bits=3)
    w = Window.partitionBy("k").orderBy("s")
    ref = df.select("k", "s", F.max("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("m"),
                    F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("mx"),
                    F.sum(F.coalesce("v", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("c"))
    a = sorted(tuple(r) for r in out.select("k", "s", "m", "mx", "c").collect())
    b = sorted(tuple(r) for r in ref.collect())
    assert a == b


def test_scan_log_prunes_buckets(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    from convspark.plans.queries import frames_json
    from convspark.sources.log import append_log, scan_log

    path = str(tmp_path / "log")
    fj = frames_json(spark, sf)
    append_log(fj, path, "relay")
    kept, _ = scan_log(spark, path, "relay", session_ids=[3, 5])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    all_kept, _ = scan_log(spark, path, "relay")
    a = sorted(tuple(r) for r in kept.select("session_id", "seq").collect())
    b = sorted(tuple(r) for r in all_kept.filter(F.col("session_id").isin(3, 5)).select("session_id", "seq").collect())
    assert a == b and len(a) > 0


def test_replay_resends_training_errors(spark):
    rows = [(1, 1, "train_started", "r"), (1, 2, "error", "r"), (1, 3, "error", None), (1, 4, "train_started", "r"),
            (1, 5, "train_done", "r")]
    df = spark.createDataFrame(rows, "session_id long, seq long, type string, request_id string")
    assert sorted(r.seq for r in replay(df).collect()) == [1, 2, 4, 5]
