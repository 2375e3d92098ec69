"""Config layering, job status and the train lock on hand-made rows."""

import datetime as dt

from convspark.operators.config import config_pivot, fill_defaults, merge_config, typed_value
from convspark.operators.frames import purge_sessions, resolve_sessions
from convspark.operators.jobs import blocked_requests, job_status


def test_merge_config_later_wins_and_extra_keys(spark):
    upd = spark.createDataFrame([(1, "temperature", "0.2", 1, 5), (1, "temperature", "0.9", 1, 9),
                                 (1, "custom", "x", 1, 3), (1, "top_k", "7", 2, 1)],
                                "session_id long, key string, value string, layer int, seq long")
    got = {r.key: r.value for r in merge_config(upd).collect()}
    assert got["temperature"] == "0.9" and got["custom"] == "x" and got["top_k"] == "7"
    assert got["max_new_tokens"] == "2048" and got["do_sample"] == "true"


def test_fill_defaults_origins(spark):
    conf = spark.createDataFrame([(1, "server", "port", "9000"), (1, "extra", "k", "1")],
                                 "file_id long, section string, key string, value string")
    got = {(r.section, r.key): (r.value, r.origin) for r in fill_defaults(conf).collect()}
    assert got[("server", "port")] == ("9000", "file")
    assert got[("server", "host")] == ('"0.0.0.0"', "default")
    assert got[("extra", "k")] == ("1", "extra")
    assert got[("model", "path")] == ("null", "default")
    assert len(got) == 27 + 1


def test_typed_values(spark):
    df = spark.createDataFrame([(v,) for v in ["True", "false", "1.5", "12", "abc", "1.2.3"]], "v string")
    kind, b, num = typed_value("v")
    got = [(r.k, r.n) for r in df.select(kind.alias("k"), num.alias("n")).collect()]
    assert got == [("bool", None), ("bool", None), ("float", 1.5), ("int", 12.0), ("str", None), ("str", None)]
    piv = config_pivot(spark.createDataFrame([(1, "top_k", "5", 1), (1, "top_k", "9", 2)],
                                             "session_id long, key string, value string, seq long"), ["top_k"])
    assert piv.collect()[0].top_k.num == 9.0


def test_job_status_restart_resets(spark):
    ev = spark.createDataFrame([
        (1, 1, "train_started", 0, None, None), (1, 2, "train_progress", 5, 0.9, None),
        (1, 3, "error", 5, None, "boom"), (1, 4, "train_started", 0, None, None),
        (2, 1, "train_started", 0, None, None), (2, 2, "train_progress", 3, 0.5, None),
        (2, 3, "train_done", 4, None, None)],
        "request_id long, n long, type string, step long, loss double, message string")
    got = {r.request_id: (r.running, r.steps_done, r.last_loss, r.error) for r in job_status(ev).collect()}
    assert got == {1: (True, 0, None, None), 2: (False, 4, 0.5, None)}


def test_job_status_maximum_and_checkpoint(spark):
    ev = spark.createDataFrame([
        (1, 1, "train_started", 0, 50, None), (1, 2, "train_done", 50, None, "a"), (1, 3, "train_started", 0, None, None),
        (2, 1, "train_started", 0, 20, None), (2, 2, "train_progress", 3, 30, None), (2, 3, "train_done", 4, None, "b"),
        (3, 1, "train_started", 0, 20, None), (3, 2, "error", 0, None, None)],
        "request_id long, n long, type string, step long, max_steps long, checkpoint string")
    ev = ev.selectExpr("*", "cast(null as double) loss", "cast(null as string) message")
    got = {r.request_id: (r.running, r.max_steps, r.checkpoint) for r in job_status(ev).collect()}
    assert got == {1: (True, None, None), 2: (False, 30, "b"), 3: (False, 20, None)}


def test_lock_interval_bounds(spark):
    t0 = dt.datetime(2024, 1, 1, 10, 0)
    jobs = spark.createDataFrame([(t0, t0 + dt.timedelta(hours=3))], "start timestamp_ntz, end timestamp_ntz")
    reqs = spark.createDataFrame([(1, t0, "inference"), (2, t0 + dt.timedelta(hours=3), "inference"),
                                  (3, t0 + dt.timedelta(minutes=90), "train"), (4, t0 - dt.timedelta(seconds=1), "train")],
                                 "req_id long, ts timestamp_ntz, kind string")
    got = {r.req_id: r.outcome for r in blocked_requests(reqs, jobs).collect()}
    assert got == {1: "rejected", 2: "run", 3: "waiting", 4: "run"}


def test_sessions_resolve_and_purge(spark):
    hellos = spark.createDataFrame([(1, 10), (2, None), (3, 99)], "hello_id long, session_id long")
    live = spark.createDataFrame([(10,)], "session_id long")
    got = {r.hello_id: (r.outcome, r.session_id) for r in resolve_sessions(hellos, live).collect()}
    assert got == {1: ("resume", "10"), 2: ("new", "new-2"), 3: ("new", "new-3")}
    s = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 3))], "sid long, created timestamp_ntz")
    none = spark.createDataFrame([], "ts timestamp_ntz")
    assert purge_sessions(s, none).count() == 2
    one = spark.createDataFrame([(dt.datetime(2024, 1, 2),)], "ts timestamp_ntz")
    assert [r.sid for r in purge_sessions(s, one).collect()] == [2]


def test_settings_keep_booleans_and_texts(spark):
    from convspark.operators.config import last_settings

    df = spark.createDataFrame([(1, "do_sample", "false", 1), (1, "note", "abc", 2), (1, "top_p", "0.5", 3)],
                               "session_id long, key string, value string, seq long")
    r = config_pivot(df, ["do_sample", "note"]).first()
    assert (r.do_sample.kind, r.do_sample.bool, r.note.kind, r.note.text) == ("bool", False, "str", "abc")
    assert {x.key: x.setting.kind for x in last_settings(df).collect()} == \
        {"do_sample": "bool", "note": "str", "top_p": "float"}


def test_request_config_any_key(spark):
    """Every key, several overrides a request; equal to a plain replay."""
    import random

    from convspark.operators.config import GENERATION_DEFAULTS, json_text, request_config

    r = random.Random(4)
    keys = ["temperature", "top_k", "stop", "note", "x.y"]
    rows, want = [], {}
    base = {k: json_text(v) for k, v in GENERATION_DEFAULTS.items()}
    for sid in (1, 2):
        conf = dict(base)
        for seq in range(120):
            if r.random() < 0.6:
                k, v = r.choice(keys), str(r.randint(0, 99))
                rows.append((sid, seq, "update", k, v))
                conf[k] = v
            else:
                own = {k: str(r.randint(100, 199)) for k in r.sample(keys, r.choice([0, 0, 1, 2, 3]))}
                rows += [(sid, seq, "request", k, v) for k, v in own.items()] or [(sid, seq, "request", None, None)]
                want[sid, seq] = {**conf, **own}
    rows.append((3, 5, "request", "only", "here"))       # a session without updates
    want[3, 5] = {**base, "only": "here"}
    ev = spark.createDataFrame(rows, "session_id long, seq long, kind string, key string, value string")
    for bits in (None, 4):
        assert {(x.session_id, x.seq): x.config for x in request_config(ev, block_bits=bits).collect()} == want


def test_islands_and_blocked_requests_match_all_pairs(spark):
    import random

    from convspark.operators.jobs import job_islands

    r = random.Random(8)
    t0 = dt.datetime(2024, 1, 1)
    at = lambda m: t0 + dt.timedelta(minutes=m)
    spans = [(s, s + r.choice([0, 1, 5, 30, 200])) for s in (r.randint(0, 3000) for _ in range(60))] + [(10, 15), (15, 20), (10, 12)]
    jobs = [(at(a), at(b)) for a, b in spans] + [(at(5000), None), (None, at(1)), (at(7), at(3))]
    reqs = [(i, at(m), r.choice(["inference", "train"])) for i, m in enumerate([r.randint(0, 3400) for _ in range(200)] + [10, 15, 20, 5000, 9999])]
    reqs.append((999, None, "train"))
    jdf = spark.createDataFrame(jobs, "start timestamp_ntz, end timestamp_ntz")
    rdf = spark.createDataFrame(reqs, "req_id long, ts timestamp_ntz, kind string")
    held = lambda t: t is not None and any(a is not None and a <= t and (b is None or t < b) for a, b in jobs)
    got = {x.req_id: x.blocked for x in blocked_requests(rdf, jdf).collect()}
    assert got == {i: held(t) for i, t, _ in reqs}
    islands = sorted((x.start, x.end) for x in job_islands(jdf).collect())
    assert all(a[1] < b[0] for a, b in zip(islands, islands[1:]))
    assert rdf.count() == len(got)


def test_defaults_take_part_in_no_shuffle(spark):
    from convspark.operators.config import GENERATION_DEFAULTS, json_text, merge_settings

    upd = spark.createDataFrame(
        [("a", "top_k", "7", 1, 2), ("a", "top_k", "8", 2, 1), ("a", "note", None, 1, 3), ("a", "top_p", None, 1, 4), ("b", None, "x", 1, 1),
         ("c", "top_k", "9", -1, 5), ("c", "own", "y", -1, 5), (None, "top_k", "1", 1, 1)],
        "session_id string, key string, value string, layer int, seq long")
    assert "Generate" not in merge_settings(upd)._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in merge_config(upd).collect():
        assert r.key not in got.setdefault(r.session_id, {})
        got[r.session_id][r.key] = r.value
    base = {k: json_text(v) for k, v in GENERATION_DEFAULTS.items()}
    assert got == {"a": {**base, "top_k": "8", "note": None, "top_p": None}, "b": {**base, None: "x"}, "c": {**base, "own": "y"},
                   None: {**base, "top_k": "1"}}
