"""End-to-end training batches: structural properties on real samples."""

from collections import defaultdict

from pyspark.sql import functions as F

from convspark.operators.batches import clamp_train_config
from convspark.operators.training import training_batches
from convspark.plans import queries as Q


def test_training_batches_properties(spark, sf):
    s = Q.samples(spark, sf)
    cfg = clamp_train_config(s.select("request_id").distinct().select(
        "request_id", F.lit(9).alias("max_steps"), F.lit(4).alias("batch_size"), F.lit(16).alias("max_seq_length"),  # clamped up to 32
        F.lit(2).alias("gradient_accumulation"), F.lit(3).alias("log_every")))
    rows = training_batches(s, cfg, seed=7).collect()
    by_step = defaultdict(list)
    for r in rows:
        by_step[(r.request_id, r.step)].append(r)
    requests = {r.request_id for r in rows}
    for req in requests:
        steps = sorted(st for (q, st) in by_step if q == req)
        assert steps == list(range(1, 10))
    for (req, step), rs in by_step.items():
        assert 1 <= len(rs) <= 4
        width = {len(r.input_ids) for r in rs}
        assert len(width) == 1 and width.pop() <= 32
        for r in rs:
            assert len(r.attention_mask) == len(r.labels) == len(r.input_ids)
            assert all((m == 0) == (lab == -100) for m, lab in zip(r.attention_mask, r.labels))
            assert r.update == (step % 2 == 0 or step == 9)
            assert r.log == (step % 3 == 0) and r.checkpoint is False
    # each epoch of a request uses a sample at most once
    seen = defaultdict(set)
    for r in rows:
        key = (r.request_id, r.epoch)
        assert r.sample_id not in seen[key]
        seen[key].add(r.sample_id)


def test_staged_equals_unstaged(spark, sf):
    s = Q.samples(spark, sf).filter(F.col("request_id").isin("conv", "bench"))
    cfg = clamp_train_config(s.select("request_id").distinct().select(
        "request_id", F.lit(5).alias("max_steps"), F.lit(8).alias("batch_size")))
    cols = ["request_id", "epoch", "step", "sample_id", "input_ids", "update"]
    a = sorted(tuple(map(str, r)) for r in training_batches(s, cfg).select(*cols).collect())
    b = sorted(tuple(map(str, r)) for r in training_batches(s, cfg, stage=True).select(*cols).collect())
    assert a == b and a


def test_write_training_batches_layout(spark, sf, tmp_path):
    from convspark.operators.training import write_training_batches

    s = Q.samples(spark, sf).filter(F.col("request_id") == "bench")
    cfg = clamp_train_config(s.select("request_id").distinct().select(
        "request_id", F.lit(6).alias("max_steps"), F.lit(16).alias("batch_size")))
    out = str(tmp_path / "batches")
    write_training_batches(training_batches(s, cfg), out)
    back = spark.read.parquet(out)
    assert set(back.columns) >= {"request_id", "epoch", "step", "input_ids", "labels"}
    assert sorted(r.step for r in back.select("step").distinct().collect()) == [1, 2, 3, 4, 5, 6]
    assert any(p.name.startswith("request_id=") for p in (tmp_path / "batches").iterdir())


def test_batches_from_landed_files_do_not_depend_on_splits(spark, tmp_path):
    from convspark.operators.corpus import to_samples
    from convspark.sources.corpus import land_corpus, scan_corpus

    lines = spark.range(600).select(F.lit("job").alias("request_id"), F.col("id").alias("line_no"),
                                    F.concat(F.lit("line "), F.col("id").cast("string")).alias("value"))
    path = str(tmp_path / "corpus")
    land_corpus(lines, path)
    cfg = clamp_train_config(spark.createDataFrame([("job", 40, 8)], "request_id string, max_steps int, batch_size int"))
    got, was = [], spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "2k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = training_batches(to_samples(scan_corpus(spark, path)), cfg).select("epoch", "step", "sample_id", "input_ids")
            got.append(sorted(map(str, rows.collect())))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got[0] == got[1] and len(got[0]) == 320


def test_cut_before_hashing_gives_the_same_ids(spark):
    from convspark.operators.batches import tokenize, truncate_tokens

    df = spark.createDataFrame([("a b  c a",), ("",), ("x",)], "text string")
    ids = [r[0] for r in tokenize(df, max_len=3).select("token_ids").collect()]
    assert ids == [r[0] for r in truncate_tokens(tokenize(df), 3).select("token_ids").collect()]
    assert [len(i) for i in ids] == [3, 0, 1] and max(ids[0]) > 2 ** 31


def test_step_plan_broadcasts_neither_steps_nor_settings(spark):
    from convspark.operators.batches import step_plan

    # three rows by the planner's guess, 3,000 steps
    raw = spark.range(3).select(F.col("id").alias("request_id"), F.lit(1000).alias("max_steps"), F.lit(7).alias("gradient_accumulation"))
    cfg = clamp_train_config(raw)
    steps = cfg.select("request_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("max_steps"))).alias("step"))
    out = step_plan(steps, cfg)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 3000 and out.filter("update").count() == 3 * 143 and out.filter("is_last").count() == 3
