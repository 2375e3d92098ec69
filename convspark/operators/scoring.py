"""Token scoring over a long-form logits table ``(seq_id, token_id, logit)``.

One row per vocabulary entry per decoding step; every window below is
partitioned by the step (``seq_id``), so its size is bounded by the
vocabulary, never by the data.  Top-k is applied first and Spark plans it
as a ``WindowGroupLimit``, so the softmax/nucleus windows only see k rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convspark.operators.prefix import running

IGNORE_INDEX = -100  # fixed value: label that is left out of the loss


def _by_seq(keys):
    return Window.partitionBy(*keys)


def softmax(logits: DataFrame, temperature: float | None = None, keys=("seq_id",), out: str = "prob") -> DataFrame:
    """``exp(l/T - max) / sum`` per step (``T`` None = greedy, no
    scaling).  Max-shifted, so large logits do not overflow."""
    w = _by_seq(keys)
    scaled = F.col("logit") / F.lit(float(temperature)) if temperature else F.col("logit")
    x = logits.withColumn("_z", scaled)
    x = x.withColumn("_e", F.exp(F.col("_z") - F.max("_z").over(w)))
    return x.withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_z", "_e")


def top_k_filter(logits: DataFrame, k: int, keys=("seq_id",)) -> DataFrame:
    """Drop logits strictly below the k-th largest (ties at k survive,
    hence ``rank`` and not ``row_number``); k <= 0 keeps everything."""
    if k is None or k <= 0:
        return logits
    w = _by_seq(keys).orderBy(F.col("logit").desc())
    return logits.withColumn("_r", F.rank().over(w)).filter(F.col("_r") <= k).drop("_r")


def nucleus_filter(logits: DataFrame, p: float, temperature: float | None = None, keys=("seq_id",),
                   digits: int = 9) -> DataFrame:
    """Sorted by logit (descending, then token id), keep a token when
    the probability mass strictly before it is <= p; the first token is
    always kept; p >= 1 keeps everything.  Probabilities are the softmax of
    the rows given (apply after top-k).  The running mass is rounded to
    ``digits`` so the cut does not depend on summation order."""
    if p is None or p >= 1.0:
        return logits
    x = softmax(logits, temperature, keys, "_p")
    w = _by_seq(keys).orderBy(F.col("logit").desc(), F.col("token_id")).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_before", F.coalesce(F.sum("_p").over(w), F.lit(0.0)))
    return x.filter(F.round("_before", digits) <= F.lit(float(p))).drop("_p", "_before")


def sample_filter(logits: DataFrame, temperature: float, k: int, p: float, keys=("seq_id",)) -> DataFrame:
    """W2+W3+W4 in the sampling order: temperature, top-k, nucleus, then the
    renormalised probability ``prob`` of every surviving token."""
    x = top_k_filter(logits, k, keys)
    x = nucleus_filter(x, p, temperature, keys)
    return softmax(x, temperature, keys, "prob")


def greedy_token(logits: DataFrame, keys=("seq_id",)) -> DataFrame:
    """Argmax per step; ties go to the lowest token id.  A grouped
    ``max_by`` on ``(logit, -token_id)``: map-side combined, no sort."""
    return logits.groupBy(*keys).agg(
        F.max_by("token_id", F.struct(F.col("logit"), (-F.col("token_id")).alias("neg"))).alias("token_id"))


def _uniform(key: str, seed: int):
    """A number in [0, 1) from ``md5(seed:key)``."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return F.conv(F.substr(h, F.lit(1), F.lit(8)), 16, 10).cast("double") / F.lit(4294967296.0)


def draw_token(probs: DataFrame, seed: int, keys=("seq_id",)) -> DataFrame:
    """One multinomial draw per step by inverse CDF over token-id order,
    with a uniform from ``md5(seed:seq_id)`` so reruns repeat the draw."""
    u = _uniform(keys[0], seed)
    w = _by_seq(keys).orderBy("token_id").rowsBetween(Window.unboundedPreceding, 0)
    x = probs.withColumn("_cum", F.sum("prob").over(w)).withColumn("_u", u)
    hit = x.filter(F.col("_cum") > F.col("_u"))
    first = hit.groupBy(*keys).agg(F.min("token_id").alias("token_id"))
    # mass lost to rounding at the very end: fall back to the last token
    last = probs.groupBy(*keys).agg(F.max("token_id").alias("_last"))
    return last.join(first, list(keys), "left").select(
        *keys, F.coalesce(F.col("token_id"), F.col("_last")).alias("token_id"))


def draw_tokens(logits: DataFrame, temperature: float, k: int, p: float, seed: int, keys=("seq_id",)) -> DataFrame:
    """W2-W4 and W6 in one pass: the token drawn per step.

    One grouped aggregate gathers a step's logits (as many as its vocabulary
    has) in falling order; top-k, nucleus and draw are scans of that array, so
    the logits are shuffled once.  Same rules as ``sample_filter`` and
    ``draw_token``: ties at k survive, the mass before a token is compared with
    ``p``, and the draw runs over token ids in rising order."""
    entry = F.struct((-F.col("logit")).alias("neg"), F.col("token_id"))
    x = logits.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_all"))
    kept = F.col("_all")
    if k and k > 0:
        least = F.get(F.col("_all"), F.least(F.lit(k), F.size("_all")) - 1)["neg"]
        kept = F.filter("_all", lambda e: e["neg"] <= least)
    x = x.withColumn("_kept", kept)
    top = F.get(F.col("_kept"), F.lit(0))["neg"]
    x = x.withColumn("_kept", F.transform("_kept", lambda e: F.struct(
        e["token_id"].alias("token_id"), F.exp((top - e["neg"]) / F.lit(float(temperature))).alias("e"))))
    mass = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, e: acc + e["e"])
    if p is not None and p < 1.0:
        x = x.withColumn("_mass", mass("_kept"))
        scan = F.aggregate("_kept", F.struct(F.lit(0.0).alias("before"), F.lit(0).alias("n")), lambda acc, e: F.struct(
            (acc["before"] + e["e"] / F.col("_mass")).alias("before"),
            (acc["n"] + F.when(F.round(acc["before"], 9) <= F.lit(float(p)), 1).otherwise(0)).alias("n")))
        x = x.withColumn("_kept", F.slice("_kept", F.lit(1), scan["n"]))
    x = x.withColumn("_kept", F.array_sort("_kept")).withColumn("_mass", mass("_kept")).withColumn("_u", _uniform(keys[0], seed))
    none = F.lit(None).cast("int")
    scan = F.aggregate("_kept", F.struct(F.lit(0.0).alias("cum"), none.alias("hit")), lambda acc, e: F.struct(
        (acc["cum"] + e["e"] / F.col("_mass")).alias("cum"),
        F.coalesce(acc["hit"], F.when(acc["cum"] + e["e"] / F.col("_mass") > F.col("_u"), e["token_id"].cast("int"))).alias("hit")))
    # mass lost to rounding at the very end: fall back to the last token
    return x.select(*keys, F.coalesce(scan["hit"], F.element_at("_kept", -1)["token_id"]).alias("token_id"))


def number_positions(rows: DataFrame, seq: str, order: str, out: str = "pos", block_bits: int = 12) -> DataFrame:
    """Dense 0-based position of each row inside its sequence, ordered by
    ``order`` (unique), computed with a skew-safe blocked running count."""
    x = running(rows, [seq], order, sums={"_c": (F.lit(1), True)}, block_bits=block_bits)
    return x.withColumn(out, (F.col("_c") - 1).cast("int")).drop("_c")


def shift_labels(positions: DataFrame, seq: str = "seq", pos: str = "pos", label: str = "label") -> DataFrame:
    """Position t is scored against the label of t + 1 (the last
    position has none).  An equi-join on ``(seq, pos + 1)`` rather than
    ``lead``: a long sequence is spread by the join's hash of both keys."""
    nxt = positions.select(F.col(seq).alias("_s"), (F.col(pos) - 1).alias("_p"), F.col(label).alias("target"))
    j = positions.join(nxt, (positions[seq] == nxt["_s"]) & (positions[pos] == nxt["_p"]), "left")
    return j.drop("_s", "_p")


def cross_entropy(logits: DataFrame, positions: DataFrame, seq: str = "seq") -> DataFrame:
    """Mean negative log-likelihood of the next label per sequence.

    ``logits``: ``(vec_id, token_id, logit)``; ``positions``: ``(seq, pos,
    vec_id, label)``.  Log-sum-exp is max-shifted per position; positions
    whose next label is -100 are left out; a sequence shorter than 2 is an
    error row (``status``)."""
    nll = _position_losses(logits, positions, seq)
    per_seq = nll.groupBy(seq).agg(F.count(F.lit(1)).alias("n_scored"), F.sum("nll").alias("loss_sum"))
    lengths = positions.groupBy(seq).agg(F.count(F.lit(1)).alias("length"))
    return lengths.join(per_seq, seq, "left").select(
        seq, "length", F.coalesce("n_scored", F.lit(0)).alias("n_scored"),
        F.when(F.col("length") >= 2, F.col("loss_sum") / F.col("n_scored")).alias("loss"),
        F.when(F.col("length") < 2, F.lit("Not enough tokens to compute training loss"))
        .otherwise(F.lit("ok")).alias("status"))


def _position_losses(logits: DataFrame, positions: DataFrame, seq: str) -> DataFrame:
    """``seq, nll`` of every scored position.  The targets join the logits by
    position, and the window and the grouping keep that partitioning: the
    logits are shuffled once."""
    shifted = shift_labels(positions, seq, "pos", "label").filter(F.col("target").isNotNull() & (F.col("target") != IGNORE_INDEX))
    wanted = shifted.select(F.col(seq).alias("_seq"), "vec_id", "target")
    x = logits.join(wanted, "vec_id").withColumn("_m", F.max("logit").over(Window.partitionBy("vec_id")))
    x = x.groupBy("vec_id").agg(F.first("_seq").alias("_seq"), (F.first("_m") + F.log(F.sum(F.exp(F.col("logit") - F.col("_m"))))).alias("_lse"),
                                F.max(F.when(F.col("token_id") == F.col("target"), F.col("logit"))).alias("_lt"))
    return x.filter(F.col("_lt").isNotNull()).select(F.col("_seq").alias(seq), (F.col("_lse") - F.col("_lt")).alias("nll"))


def batch_loss(losses: DataFrame, batch) -> DataFrame:
    """A8 of whole batches: the mean over all scored positions of a batch's
    sequences (not the mean of their means).  ``losses``: rows of
    ``cross_entropy``; ``batch``: the sequence's batch, a column expression.  A
    batch without a scored position has no loss."""
    total = F.col("loss") * F.col("n_scored")
    return losses.groupBy(batch.alias("batch")).agg(F.count(F.lit(1)).alias("n_seqs"), F.sum("n_scored").alias("n_scored"),
                                                    (F.sum(total) / F.sum(F.when(total.isNotNull(), F.col("n_scored")))).alias("loss"))
