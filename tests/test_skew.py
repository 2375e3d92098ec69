"""One key holding every row must still be spread over many tasks."""

from collections import Counter

from pyspark.sql import functions as F

from convspark.operators.batches import shuffle_corpus
from convspark.operators.frames import segment_generations
from convspark.operators.scoring import number_positions


def spread(df, keep):
    """Share of rows in the fullest partition, and how many partitions hold
    rows (``keep`` stops the optimiser from pruning the computed column and
    with it the shuffle)."""
    c = Counter(r[0] for r in df.select(F.spark_partition_id(), keep).collect())
    return max(c.values()) / sum(c.values()), len(c)


def test_shuffle_rank_spreads_one_request(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(40000).select(F.lit("hot").alias("request_id"), F.col("id").alias("sample_id"))
        out = shuffle_corpus(df, seed=1, bucket_hex_digits=2)
        top, parts = spread(out, "rank")
        assert parts >= 6 and top < 0.3
        assert out.agg(F.countDistinct("rank"), F.min("rank"), F.max("rank")).collect()[0] == (40000, 1, 40000)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_running_scan_spreads_one_session(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        n = 30000
        frames = spark.range(n).select(
            F.lit(7).cast("long").alias("session_id"), F.col("id").alias("seq"),
            F.when(F.col("id") % 100 == 0, F.lit("start")).when(F.col("id") % 100 == 50, F.lit("done"))
            .otherwise(F.lit("token")).alias("type"))
        seg = segment_generations(frames, block_bits=10)
        top, parts = spread(seg, "gen")
        assert parts >= 6 and top < 0.3
        got = {r.seq: r.gen for r in seg.filter(F.col("seq").isin(0, 49, 50, 51, 29999)).collect()}
        assert got == {0: 1, 49: 1, 50: 1, 51: None, 29999: None}
        pos = number_positions(frames, "session_id", "seq", block_bits=10)
        assert pos.filter(F.col("pos") != F.col("seq")).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_sparse_seq_makes_few_blocks(spark, monkeypatch):
    """Time stamps as ``seq``: one hot session has as many blocks as there are
    quantile cells, far fewer than rows, and no block holds many rows."""
    from convspark.operators import prefix

    monkeypatch.setattr(prefix, "BLOCK_ROWS", 500)
    n = 30000
    frames = spark.range(n).select(
        F.when(F.col("id") % 10 == 0, F.lit(1)).otherwise(F.lit(7)).cast("long").alias("session_id"),
        (F.lit(1_700_000_000_000_000) + F.col("id") * 1_000_003 + F.pmod(F.xxhash64("id"), F.lit(900_000))).alias("seq"),
        F.when(F.col("id") % 100 == 5, F.lit("start")).when(F.col("id") % 100 == 55, F.lit("done")).otherwise(F.lit("token")).alias("type"))
    blocks = frames.withColumn("b", prefix.block_of(frames, "seq"))
    per = blocks.groupBy("session_id", "b").count().collect()
    assert 50 <= len({r.b for r in per}) <= prefix.CELLS and max(r["count"] for r in per) < 3 * n / prefix.CELLS
    monkeypatch.setattr(prefix, "BLOCK_ROWS", 100)      # even parts of the cells
    per = frames.withColumn("b", prefix.block_of(frames, "seq")).groupBy("b").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.count(F.lit(1)).alias("n"))
    per = sorted(per.collect(), key=lambda r: r.b)
    assert len(per) > 2 * prefix.CELLS and max(r.n for r in per) < 300 and all(a.hi < b.lo for a, b in zip(per, per[1:]))
    got = segment_generations(frames)
    assert got.exceptAll(segment_generations(frames, block_bits=40)).count() == 0 and got.count() == n
