"""Seeded shuffles, epochs, batches, padding and the training step plan.

Samples are ``(request_id, sample_id, text)``.  The shuffle is a global,
exact, repeatable permutation per ``(request_id, epoch)`` computed without
ever putting a whole request into one task (see ``shuffle_corpus``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Training defaults applied before the per-request overrides.
TRAIN_DEFAULTS = {
    "max_steps": 50,
    "batch_size": 1,
    "learning_rate": 5e-5,
    "max_seq_length": 2048,
    "log_every": 5,
    "save_every": 0,
    "gradient_accumulation": 1,
}
IGNORE_INDEX = -100  # fixed value: label of padded positions
TOKEN_RE = r"[^ \n\t]+"  # our word tokenizer (the model tokenizer is not built)


SALTS = 64    # parts that the rows of one request are dealt into when it meets its settings


def attach(df: DataFrame, settings: DataFrame, key: str = "request_id", spread: str = "sample_id", salts: int = SALTS) -> DataFrame:
    """``df`` with the columns of ``settings`` (one row per ``key``): an inner
    join on the key and a salt from ``spread``, so that rows of a key that most
    of them share are not shuffled to one task.  ``settings`` is repeated once
    per salt; where it is small, the planner broadcasts it."""
    dealt = settings.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(dealt, [key, "_salt"]).drop("_salt")


def shuffle_key(seed, epoch: Column, sample_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), sample_id.cast("string")))


def shuffle_corpus(samples: DataFrame, seed: int = 42, epoch_col: str | None = None,
                   bucket_hex_digits: int = 4, needed: str | None = None) -> DataFrame:
    """O1: exact rank of ``md5(seed:epoch:sample_id)`` within each
    ``(request_id, epoch)``; ties (none in practice) break on sample_id.

    A plain ``row_number()`` over a request would sort the whole request in
    one task.  Instead the key's first ``bucket_hex_digits`` hex digits pick a
    bucket; per-bucket counts (map-side combined, at most 16^d rows per
    request-epoch) give bucket offsets by a small prefix sum; each row's rank
    is its offset plus its row number inside its bucket.  The join and the
    bucket window share the ``(request_id, epoch, bucket)`` partitioning, so
    the big side is shuffled once.  A request holding a third of all rows is
    spread over 16^d buckets.

    ``needed`` names a column with the number of leading ranks of the row's
    request and epoch that are wanted (null: all).  Buckets that begin behind
    it are dropped before anything is ranked; the few rows behind it in the
    last bucket kept are still returned.
    """
    ep = F.col(epoch_col) if epoch_col else F.lit(0)
    keyed = (samples.withColumn("epoch", ep.cast("int"))
             .withColumn("_k", shuffle_key(seed, F.col("epoch"), F.col("sample_id")))
             .withColumn("_b", F.substr(F.col("_k"), F.lit(1), F.lit(bucket_hex_digits))))
    most = [F.max(needed).alias("_most")] if needed else []
    counts = keyed.groupBy("request_id", "epoch", "_b").agg(F.count(F.lit(1)).alias("_n"), *most)
    offsets = counts.withColumn(
        "_off",
        F.coalesce(F.sum("_n").over(Window.partitionBy("request_id", "epoch").orderBy("_b")
                                    .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).drop("_n")
    if needed:
        offsets = offsets.filter(F.col("_most").isNull() | (F.col("_off") < F.col("_most"))).drop("_most")
    w = Window.partitionBy("request_id", "epoch", "_b").orderBy("_k", "sample_id")
    return (keyed.join(offsets, ["request_id", "epoch", "_b"])
            .withColumn("rank", (F.col("_off") + F.row_number().over(w)).cast("long"))
            .drop("_k", "_b", "_off"))


def make_batches(ranked: DataFrame, batch_size) -> DataFrame:
    """O2: consecutive groups of ``batch_size`` in shuffled order; the short
    last batch is kept.  ``batch_size`` is an int or a column name."""
    bs = F.col(batch_size) if isinstance(batch_size, str) else F.lit(int(batch_size))
    return ranked.withColumn("batch", F.floor((F.col("rank") - 1) / bs).cast("long"))


def repeat_epochs(samples: DataFrame, plan: DataFrame, seed: int = 42, carry=()) -> DataFrame:
    """O3: cycle shuffled epochs until ``max_steps`` batches, cutting the last
    epoch mid-way.  ``plan``: ``(request_id, max_steps, batch_size)``.

    Output: ``(request_id, epoch, batch, step, sample_id, rank)``; ``step`` is
    1-based and global over epochs.  Each sample is repeated once per needed
    epoch by ``explode(sequence(..))`` (a generator, not a join); of the last
    epoch only the buckets that the run still reaches are ranked.  ``carry``
    names further columns of ``plan`` to keep.
    """
    counts = samples.groupBy("request_id").agg(F.count(F.lit(1)).alias("_n"))
    sized = (plan.join(counts, "request_id")
             .withColumn("_bpe", F.ceil(F.col("_n") / F.col("batch_size")).cast("long"))
             .withColumn("_epochs", F.ceil(F.col("max_steps") / F.col("_bpe")).cast("int")))
    own = {"batch_size", "max_steps"} - set(carry)
    expanded = (attach(samples, sized.select("request_id", "_bpe", "_epochs", *sorted({"batch_size", "max_steps"} | set(carry))))
                .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_epochs") - 1))))
    left = (F.col("max_steps") - F.col("epoch") * F.col("_bpe")) * F.col("batch_size")
    expanded = expanded.withColumn("_needed", F.when(F.col("epoch") == F.col("_epochs") - 1, left))
    ranked = make_batches(shuffle_corpus(expanded, seed, "epoch", needed="_needed"), "batch_size")
    return (ranked.withColumn("step", (F.col("epoch") * F.col("_bpe") + F.col("batch") + 1).cast("long"))
            .filter(F.col("step") <= F.col("max_steps"))
            .drop("_bpe", "_epochs", "_needed", *own))


def tokenize(df: DataFrame, text_col: str = "text", max_len=None) -> DataFrame:
    """Word tokens and their ids.  Ids come from a hash of the token, so no
    global vocabulary pass (and no single-task dense rank) is needed.

    ``max_len`` (T1; int or column name) cuts the token list before any id
    is computed, so a long text costs one regex pass and ``max_len`` hashes."""
    toks = F.regexp_extract_all(F.col(text_col), F.lit(TOKEN_RE), 0)
    if max_len is not None:
        toks = F.slice(toks, F.lit(1), F.col(max_len) if isinstance(max_len, str) else F.lit(int(max_len)))
    return (df.withColumn("tokens", toks)
            .withColumn("token_ids", F.transform("tokens", lambda t: token_id(t))))


def token_id(tok: Column) -> Column:
    """60 bits of the token's md5: no clash is expected below some 10^9
    distinct tokens."""
    return F.conv(F.substr(F.md5(tok), F.lit(1), F.lit(15)), 16, 10).cast("long")


def count_tokens(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Number of word tokens in each text."""
    return df.withColumn("n_tokens", F.size(F.regexp_extract_all(F.col(text_col), F.lit(TOKEN_RE), 0)))


def truncate_tokens(df: DataFrame, max_len, ids_col: str = "token_ids") -> DataFrame:
    """Keep the first ``max_len`` tokens (int or column name)."""
    n = F.col(max_len) if isinstance(max_len, str) else F.lit(int(max_len))
    return df.withColumn(ids_col, F.slice(F.col(ids_col), F.lit(1), n))


def pad_batch(df: DataFrame, batch_keys=("request_id", "epoch", "batch"), ids_col: str = "token_ids",
              pad_id: int = 0) -> DataFrame:
    """Right-pad each row to the longest row of its batch.

    ``input_ids``, ``attention_mask`` (1 real / 0 pad) and ``labels`` (ids,
    -100 on padding).  The window is one batch (``batch_size`` rows)."""
    L = F.max(F.size(ids_col)).over(Window.partitionBy(*batch_keys))
    n = F.size(ids_col)
    pad = L - n
    return (df.withColumn("_pad", pad)
            .withColumn("input_ids", F.concat(F.col(ids_col), F.array_repeat(F.lit(pad_id), F.col("_pad"))))
            .withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), F.size(ids_col)),
                                                   F.array_repeat(F.lit(0), F.col("_pad"))))
            .withColumn("labels", F.concat(F.col(ids_col), F.array_repeat(F.lit(IGNORE_INDEX), F.col("_pad"))))
            .drop("_pad"))


def clamp_train_config(cfg: DataFrame) -> DataFrame:
    """Defaults, then the request's overrides (null = not given), integer
    truncation, then the lower bounds: steps, batch, log interval and
    accumulation >= 1, sequence length >= 32, save interval >= 0."""
    def pick(name, typ):
        v = F.col(name) if name in cfg.columns else F.lit(None)
        return F.coalesce(v.cast("double"), F.lit(float(TRAIN_DEFAULTS[name]))).cast(typ)

    out = [F.col(c) for c in cfg.columns if c not in TRAIN_DEFAULTS]
    return cfg.select(
        *out,
        F.greatest(pick("max_steps", "long"), F.lit(1)).alias("max_steps"),
        F.greatest(pick("batch_size", "long"), F.lit(1)).alias("batch_size"),
        pick("learning_rate", "double").alias("learning_rate"),
        F.greatest(pick("max_seq_length", "long"), F.lit(32)).alias("max_seq_length"),
        F.greatest(pick("log_every", "long"), F.lit(1)).alias("log_every"),
        F.greatest(pick("save_every", "long"), F.lit(0)).alias("save_every"),
        F.greatest(pick("gradient_accumulation", "long"), F.lit(1)).alias("gradient_accumulation"),
    )


def step_flags(step: Column, is_last: Column, save: Column | None = None) -> dict[str, Column]:
    """W8 of one step, from the config's columns beside it: ``update``,
    ``update_id``, ``log`` and ``checkpoint`` (``save``: the save switch)."""
    ga = F.col("gradient_accumulation")
    due = (F.col("save_every") > 0) & (step % F.greatest(F.col("save_every"), F.lit(1)) == 0)
    return {"update": (step % ga == 0) | is_last, "update_id": F.ceil(step / ga).cast("long"),
            "log": step % F.col("log_every") == 0, "checkpoint": due if save is None else due & save}


def step_plan(steps: DataFrame, cfg: DataFrame, clock: int = 0) -> DataFrame:
    """Per step of a run, whether the optimiser updates, whether the loss
    is reported and which checkpoints are written.

    ``steps``: ``(request_id, step)``; ``cfg``: clamped config per request,
    with ``save_checkpoint`` (the save switch, default on) and
    ``checkpoint_name`` (default: none given) where it has them.  An update
    happens every ``gradient_accumulation`` steps, plus one final flush after
    the last step when a remainder is left.  ``checkpoint_name`` is the name of
    the step's periodic checkpoint, ``final_checkpoint`` (on the last step) that
    of the one written after the run, both null if none is written; ``clock``
    stands for the time in names that are not given.
    """
    from convspark.functions.names import UNSAFE_RUN, sanitize_name, sanitize_request_id

    save = F.coalesce(F.col("save_checkpoint"), F.lit(True)) if "save_checkpoint" in cfg.columns else F.lit(True)
    given = F.col("checkpoint_name") if "checkpoint_name" in cfg.columns else F.lit(None).cast("string")
    run = F.concat(F.lit("train_"), sanitize_request_id(F.col("request_id").cast("string")), F.lit(f"_{clock}"))
    cfg = cfg.select("request_id", "gradient_accumulation", "log_every", "save_every", save.alias("_save"),
                     sanitize_name(F.coalesce(given, F.lit("")), "train", clock).alias("_name"), given.alias("_given"), run.alias("_run"))
    # a name that is not usable gives train_<request>_<time>
    final = F.when(F.length(F.btrim(F.regexp_replace(F.coalesce("_given", F.lit("")), UNSAFE_RUN, "-"), F.lit("-."))) > 0,
                   F.col("_name")).otherwise(F.col("_run"))
    # the run's last step comes from a map-side-combined aggregate joined
    # back, not a window, so one huge run is never sorted in a single task
    last = steps.groupBy("request_id").agg(F.max("step").alias("_last"))
    # merge joins: the planner guesses the sizes of steps and settings from the
    # compressed columns below them, and would broadcast millions of rows
    settings = cfg.hint("merge").join(last, "request_id")
    x = attach(steps.hint("merge"), settings, spread="step", salts=4).withColumn("is_last", F.col("step") == F.col("_last"))
    x = x.withColumns(step_flags(F.col("step"), F.col("is_last"), F.col("_save")))
    return x.withColumns({
        "checkpoint_name": F.when(F.col("checkpoint"), F.concat(F.col("_name"), F.lit("_step_"), F.col("step").cast("string"))),
        "final_checkpoint": F.when(F.col("is_last") & F.col("_save"), final),
    }).drop("gradient_accumulation", "log_every", "save_every", "_last", "_save", "_name", "_given", "_run")


def latest_loss(losses: DataFrame, cfg: DataFrame) -> DataFrame:
    """The loss a run reports.  Only steps on the log interval publish a
    loss; ``last_loss`` is the one of the latest such step, null when the run
    is shorter than ``log_every``.

    ``losses``: ``(request_id, step, loss)``.  A grouped ``max_by`` with a
    filter: partial aggregation on the map side, skew-proof.
    """
    logged = F.col("step") % F.col("log_every") == 0
    return (losses.join(cfg.select("request_id", "log_every"), "request_id")
            .groupBy("request_id")
            .agg(F.max("step").alias("steps"),
                 F.count_if(logged).alias("n_logged"),
                 F.max_by(F.when(logged, F.col("loss")), F.when(logged, F.col("step"))).alias("last_loss")))
