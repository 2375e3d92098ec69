"""Source/sink round trips on small hand-made inputs."""

import json
import os

from pyspark.sql import functions as F

from convspark.sources.config_file import scan_config
from convspark.sources.corpus import land_corpus, scan_corpus


def test_scan_config_sections_and_scalars(spark, tmp_path):
    doc = {"server": {"port": 9000, "host": "h"}, "flag": True, "model": {"path": None}}
    p = tmp_path / "cfg"
    p.mkdir()
    (p / "a.json").write_text(json.dumps(doc, indent=2))
    rows = {(r.section, r.key): r.value for r in scan_config(spark, str(p)).collect()}
    assert rows == {("server", "port"): "9000", ("server", "host"): '"h"', ("flag", None): "true",
                    ("model", "path"): "null"}


def test_every_config_file_gives_a_row(spark, tmp_path):
    from convspark.operators.config import DEFAULT_CONFIG, fill_defaults

    texts = {"a": "{}", "b": "{broken", "c": '{"server": {"port": 1, "port": 2}}', "d": "[1]", "e": " ", "f": '{"x": {"y": NaN}} '}
    (tmp_path / "cfg").mkdir()
    for name, text in texts.items():
        (tmp_path / "cfg" / f"{name}.json").write_text(text)
    got = scan_config(spark, str(tmp_path / "cfg")).withColumn("file", F.regexp_extract("file", r"(\w)\.json", 1))
    rows = sorted(((r.file, r.status, r.section, r.key) for r in got.collect()))
    assert rows == [("a", "empty", None, None), ("b", "broken", None, None), ("c", "ok", "server", "port"), ("d", "broken", None, None),
                    ("e", "broken", None, None), ("f", "ok", "x", "y")]
    assert {r.file: r.value for r in got.collect()}["f"] == "NaN"
    n = sum(len(kv) for kv in DEFAULT_CONFIG.values())
    full = fill_defaults(got, "file").groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("key") == "port", F.col("value"))).alias("port"))
    assert {r.file: (r.n, r.port) for r in full.collect()} == {"a": (n, "8765"), "c": (n, "2"), "f": (n + 1, "8765")}


def test_land_then_scan_corpus_keeps_lines(spark, tmp_path):
    lines = spark.createDataFrame([("job 1", 1, "a"), ("job 1", 2, "   "), ("job/1", 1, "b"), ("x", 1, "c\\r")],
                                  "request_id string, line_no long, value string")
    lines = lines.withColumn("sub", lines.request_id.contains("/").cast("int"))
    path = str(tmp_path / "corpus")
    land_corpus(lines, path, order_col="sub")
    got = sorted((r.request_id, r.value) for r in scan_corpus(spark, path).collect())
    # 'job 1' and 'job/1' both sanitise to job-1: the later submission wins
    assert got == [("job-1", "b"), ("x", "c\\r")]


def test_scan_log_dead_letters(spark, sf, tmp_path):
    from convspark.plans.queries import frames_json
    from convspark.sources.log import append_log, scan_log

    path = tmp_path / "log"
    fj = frames_json(spark, sf)
    append_log(fj, str(path), "relay")
    bucket = sorted(p for p in path.iterdir() if p.name.startswith("bucket="))[0]
    (bucket / "torn.json").write_text('{"session_id": 1, "seq": \n\nnot json at all\n')
    frames, dead = scan_log(spark, str(path), "relay")
    assert dead.count() == 2  # the torn envelope and the garbage line; the blank line is skipped
    clean, _ = scan_log(spark, str(path), "relay")
    assert frames.count() == clean.count() > 0


def test_catalog_from_real_listing(spark, tmp_path):
    from convspark.operators.catalog import auto_select, catalog_sizes, listing_to_files
    from convspark.sources.artifacts import scan_artifacts

    models, var = tmp_path / "models", tmp_path / "var"
    for root, name, files in [(models, "m1", {"config.json": 10, "w/part.bin": 2048}),
                              (models, "notmodel", {"readme.md": 5}),
                              (var, "snap", {"config.json": 3, "model.safetensors": 1000}),
                              (var, "nested", {"sub/config.json": 7})]:
        for rel, size in files.items():
            f = root / name / rel
            f.parent.mkdir(parents=True, exist_ok=True)
            f.write_bytes(b"x" * size)
    (models / "loose.txt").write_bytes(b"y")
    listing = scan_artifacts(spark, [("models", str(models)), ("var", str(var))])
    cat = {(r.source, r.name): r.size_mb for r in catalog_sizes(listing_to_files(listing)).collect()}
    assert cat == {("models", "m1"): 2058 / 1048576, ("var", "snap"): 1003 / 1048576}
    assert auto_select(catalog_sizes(listing_to_files(listing))).first().path == "models/m1"


def test_match_model_against_listing(spark, tmp_path):
    from convspark.operators.catalog import catalog_sizes, listing_to_files, match_model
    from convspark.sources.artifacts import scan_artifacts

    for root, name in [("models", "llama-x"), ("var", "llama-x"), ("var", "snap_1")]:
        f = tmp_path / root / name / "config.json"
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("{}")
    listing = scan_artifacts(spark, [("models", str(tmp_path / "models")), ("var", str(tmp_path / "var"))])
    cat = catalog_sizes(listing_to_files(listing))
    refs = spark.createDataFrame([(1, "var/snap_1"), (2, "https://host/org/llama-x"), (3, "other/none")],
                                 "id long, ref string")
    got = {r.id: (r.match, r.match_kind) for r in match_model(refs, cat).collect()}
    assert got == {1: ("var/snap_1", "path"), 2: ("models/llama-x", "name"), 3: (None, None)}


def test_resubmission_of_the_same_raw_id_replaces_its_lines(spark, tmp_path):
    from convspark.sources.corpus import land_corpus, scan_corpus

    rows = [("a", 0, "old1", 0), ("a", 1, "old2", 0), ("a", 0, "new1", 1)]
    path = str(tmp_path / "corpora")
    land_corpus(spark.createDataFrame(rows, "request_id string, line_no long, value string, at int"), path, order_col="at")
    assert [r.value for r in scan_corpus(spark, path).collect()] == ["new1"]


def test_a_request_with_most_lines_lands_through_many_tasks(spark, tmp_path):
    path = f"{tmp_path}/corpus"
    lines = spark.range(4000).select(F.lit("big").alias("request_id"), F.col("id").alias("line_no"), F.lit("x").alias("value"),
                                     (F.col("id") % 2).alias("at"))
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        land_corpus(lines, path, order_col="at")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len([f for f in os.listdir(f"{path}/rid=big") if f.endswith(".parquet")]) >= 4
    assert scan_corpus(spark, path).filter("line_no % 2 = 1").count() == 2000 == scan_corpus(spark, path).count()


def test_only_files_that_are_asked_for_are_read(spark, tmp_path):
    from convspark.operators.prompts import load_images
    from convspark.sources.artifacts import read_artifacts, scan_artifacts

    odd = ["a.png", "b[1].png", "c*.png", "d {x}.png", "not asked.png"]
    for name in odd:
        (tmp_path / name).write_bytes(name.encode())
    listing = scan_artifacts(spark, str(tmp_path))
    paths = [*(f"{tmp_path}/{n}" for n in odd[:4]), f"{tmp_path}/a.png", f"{tmp_path}/missing.png", f"{tmp_path}/c1.png", None]
    asked = spark.createDataFrame(list(enumerate(paths)), "prompt_id long, path string")
    files = read_artifacts(listing, asked)
    assert len(files.inputFiles()) == 4
    got = {r.prompt_id: (bytes(r.content).decode() if r.content is not None else None, r.error) for r in load_images(asked, files).collect()}
    assert [got[i][0] for i in range(5)] == [*odd[:4], "a.png"] and all(got[i][1] is None for i in range(5))
    assert got[5][0] is None and "does not exist" in got[5][1] and got[6][0] is None
    none = load_images(asked, read_artifacts(listing, asked.filter("prompt_id = 5")))
    assert none.filter("content is not null").count() == 0 and none.count() == 8


def test_scan_log_decodes_and_parses_once(spark, tmp_path):
    from convspark.sources.log import append_log, scan_log

    frames = [(1, 1, '{"type": "start"}'), (1, 2, '{"type": NaN, "type": "token"}'), (1, 3, ""), (1, 4, "{broken"), (1, 5, '{"type": "done"}'),
              (2, 1, '[1]'), (2, 2, ' {"type": "ping"} ')]
    append_log(spark.createDataFrame(frames, "session_id long, seq long, frame string"), str(tmp_path / "log"), "relay")
    kept, _ = scan_log(spark, str(tmp_path / "log"), "relay")
    assert "ArrowEvalPython" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.session_id, r.seq, r.type) for r in kept.collect()) == [(1, 1, "start"), (1, 2, "token"), (2, 1, None), (2, 2, "ping")]
