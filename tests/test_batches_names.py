"""Shuffle/batching properties and the free-name assignment against a
sequential brute force."""

import hashlib

import pytest

from pyspark.sql import functions as F

from convspark.functions.names import repo_model_name, sanitize_dir_name_js, sanitize_name, sanitize_request_id
from convspark.operators.batches import pad_batch, repeat_epochs, shuffle_corpus
from convspark.operators.catalog import unique_names


def test_shuffle_rank_equals_global_sort(spark):
    df = spark.range(3000).select(F.lit("r").alias("request_id"), F.col("id").alias("sample_id"),
                                  F.lit("t").alias("text"))
    got = {r.sample_id: r.rank for r in shuffle_corpus(df, seed=9, bucket_hex_digits=2).collect()}
    order = sorted(range(3000), key=lambda i: (hashlib.md5(f"9:0:{i}".encode()).hexdigest(), i))
    assert got == {s: k + 1 for k, s in enumerate(order)}


def test_repeat_epochs_cuts_mid_epoch(spark):
    df = spark.range(10).select(F.lit("r").alias("request_id"), F.col("id").alias("sample_id"))
    plan = spark.createDataFrame([("r", 7, 3)], "request_id string, max_steps long, batch_size long")
    out = repeat_epochs(df, plan, seed=1).collect()
    steps = sorted({r.step for r in out})
    assert steps == list(range(1, 8))  # 4 batches per epoch, cut inside epoch 2
    assert len(out) == 10 + 3 * 3  # full epoch, then 3 full batches of 3


def test_pad_batch_masks(spark):
    df = spark.createDataFrame([("r", 0, 0, [1, 2, 3]), ("r", 0, 0, [4])],
                               "request_id string, epoch int, batch long, token_ids array<int>")
    rows = sorted(pad_batch(df).collect(), key=lambda r: -len(r.token_ids))
    assert rows[1].input_ids == [4, 0, 0] and rows[1].attention_mask == [1, 0, 0] and rows[1].labels == [4, -100, -100]


def test_unique_names_matches_sequential(spark):
    reqs = [(i, n) for i, n in enumerate(["a", "b", "a", "a", "c", "b", "a", "d"])]
    existing = ["a", "a_2", "b_1", "c_7"]
    rdf = spark.createDataFrame(reqs, "req_id long, name string")
    edf = spark.createDataFrame([(e,) for e in existing], "name string")
    got = {r.req_id: r.assigned for r in unique_names(rdf, edf).collect()}
    assert got == {0: 'a_1', 1: 'b', 2: 'a_3', 3: 'a_4', 4: 'c', 5: 'b_2', 6: 'a_5', 7: 'd'}


def sequential_names(reqs, existing, fold=lambda x: x):
    taken, out = {fold(e) for e in existing}, {}
    for i, name in sorted(reqs):
        k, full = 0, name
        while fold(full) in taken:
            k += 1
            full = f"{name}_{k}"
        taken.add(fold(full))
        out[i] = full
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_names_shared_by_several_bases(spark, seed):
    import random

    r = random.Random(seed)
    pool = ["a"] * 6 + ["a_1"] * 3 + ["a_2", "a_3", "a_4", "a_5", "a_1_1", "a_1_2", "a_1_1_1", "a_02", "b", "b", "b", "b_1", "b_2", "b_2_1", "A_2", "_1", "", "c_9"]
    reqs = [(i * 3 + 7, r.choice(pool)) for i in range(120)]
    existing = r.sample(["a", "a_2", "a_7", "a_1_1", "b_1", "b_3", "A_4", "c"], 4)
    rdf = spark.createDataFrame(reqs, "req_id long, name string").repartition(4)
    edf = spark.createDataFrame([(e,) for e in existing], "name string")
    fold = str.lower if seed == 3 else (lambda x: x)
    got = {x.req_id: x.assigned for x in unique_names(rdf, edf, case_insensitive=seed == 3).collect()}
    assert got == sequential_names(reqs, existing, fold)
    assert len(set(map(fold, got.values()))) == len(got)


def test_sanitizers(spark):
    raws = ["  a b / c-", "...", "  ", "ok_name.v1", "-x-", "ü/ö", "a..b--"]
    df = spark.createDataFrame([(r,) for r in raws], "raw string")
    got = df.select(sanitize_name("raw").alias("p"), sanitize_request_id("raw").alias("q"),
                    sanitize_dir_name_js("raw").alias("j")).collect()
    assert [r.p for r in got] == ['a-b-c', 'snapshot_0', 'snapshot_0', 'ok_name.v1', 'x', 'snapshot_0', 'a..b']
    assert got[1].q == "-".join([hashlib.md5(b"...").hexdigest()[i:j] for i, j in
                                 ((0, 8), (8, 12), (12, 16), (16, 20), (20, 32))])
    assert [r.j for r in got][:3] == ["a-b-c", "...", ""]


def test_repo_model_name(spark):
    urls = ["https://host.example/org/model?x=1#f", "org/model", "", "not a url", "https://h/a/b/", "http://h"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(repo_model_name("u")).collect()] == ["model", "model", "", "not a url", "b", ""]


def test_hosts_with_users_ports_and_brackets(spark):
    from convspark.functions.names import normalize_host

    raws = ["[::1]:8765", "h:99999", "ws://u:p@h:1", "h:80", "wss://h:0443/x", "u@h", "h:x"]
    df = spark.createDataFrame([(r,) for r in raws], "r string")
    assert [r[0] for r in df.select(normalize_host("r")).collect()] == [
        "ws://[::1]:8765", None, "ws://u:p@h:1", "ws://h", "wss://h", "ws://u@h", None]
