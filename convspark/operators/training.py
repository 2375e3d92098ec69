"""The training-data side of a fine-tuning run, end to end:

samples -> word tokens, truncated (T1) -> seeded shuffled epochs cut at
``max_steps`` (O1-O3) -> right-padded batches with masks and labels (T2) ->
per-step optimiser/log/checkpoint flags (W8).

Tokens are computed once per sample, before the epochs multiply the rows;
the text itself never travels through the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convspark.operators.batches import attach, pad_batch, repeat_epochs, step_flags, tokenize


def training_batches(samples: DataFrame, cfg: DataFrame, seed: int = 42, pad_id: int = 0,
                     stage: bool = False) -> DataFrame:
    """One row per (request, step, sample) of the run.

    ``samples``: ``(request_id, sample_id, text)``; ``cfg``: clamped train
    config per request (T7): ``max_steps``, ``batch_size``,
    ``max_seq_length``, ``gradient_accumulation``, ``log_every``,
    ``save_every``.  Output: ``request_id, epoch, step, sample_id,
    input_ids, attention_mask, labels, update, update_id, log, checkpoint,
    is_last``.

    The tokenized samples feed three branches (counts, bucket offsets and
    the rows).  With ``stage=True`` they are written once to the shared
    checkpoint folder and read back, so at scale the parse runs once and a
    lost executor does not recompute it."""
    toks = (tokenize(attach(samples, cfg.select("request_id", "max_seq_length")), max_len="max_seq_length")
            .select("request_id", "sample_id", "token_ids"))
    if stage:
        from convspark.session import materialize

        toks = materialize(toks, "train-tokens")
    flags = ("max_steps", "gradient_accumulation", "log_every", "save_every")
    steps = repeat_epochs(toks, cfg.select("request_id", "batch_size", *flags), seed=seed, carry=flags)
    padded = pad_batch(steps, ("request_id", "step"), pad_id=pad_id)
    # a request with samples runs exactly steps 1..max_steps (the epochs are
    # sized to reach it), so the step flags follow from the row's own columns
    padded = padded.withColumn("is_last", F.col("step") == F.col("max_steps"))
    return padded.withColumns(step_flags(F.col("step"), F.col("is_last"))).select(
        "request_id", "epoch", "step", "sample_id", "input_ids", "attention_mask", "labels",
        "update", "update_id", "log", "checkpoint", "is_last")


def write_training_batches(batches: DataFrame, path: str) -> None:
    """Land the run for a trainer: parquet partitioned by request and epoch,
    rows sorted by step inside each file."""
    (batches.repartition("request_id", "epoch", "step").sortWithinPartitions("step", "sample_id")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("request_id", "epoch").parquet(path))
