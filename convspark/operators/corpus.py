"""Training-corpus operators: lines -> samples (P1-P4) and corpus resolution.

Input lines are ``(request_id, line_no, value)``; ``value`` is one physical
line of a JSONL (or plain-text) dataset.  P1-P3 are column expressions
(Python rereads only the JSON that the strict reader refuses): a corpus of any
size is processed in one scan without a shuffle.  P4
and J2 add one per-request aggregate each, joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convspark.functions.json import exact_json, number_text
from convspark.functions.text import PY_WS_CLASS, py_float_repr, py_is_blank, py_strip

PY_WS_RE = PY_WS_CLASS + "+"

# The keys looked up, in priority order, for the prompt side
# and the answer side of a training example.
INPUT_KEYS = ("input", "prompt", "user", "instruction", "question", "text")
TARGET_KEYS = ("target", "response", "assistant", "output", "answer", "completion", "label")


def _parse_stage(df: DataFrame, stripped: str, out: str) -> DataFrame:
    """Add ``out``: the variant of the line when it is exactly one JSON
    object as Python reads it, else null; and ``parse_note``: why the strict
    reader refused a line that Python takes (``duplicate_key``,
    ``non_finite``).  Each stage is its own column so the parse runs once per
    line."""
    df = exact_json(df, stripped, "_first", "parse_note")
    return df.withColumn(out, F.when(F.startswith(F.schema_of_variant("_first"), F.lit("OBJECT")), F.col("_first"))).drop("_first")


def render_scalar(v: Column, t: Column, stripped: Column) -> Column:
    """Python ``str()`` of a JSON scalar ``v`` whose variant type name is
    ``t``: non-blank strings (stripped, given as ``stripped``), numbers,
    booleans.  Null, blank strings, objects and arrays give null.  All three
    inputs should be staged column references."""
    return (
        F.when(t == "STRING", F.when(F.length(stripped) > 0, stripped))
        .when(t == "BOOLEAN", F.when(F.try_variant_get(v, "$", "boolean"), F.lit("True")).otherwise(F.lit("False")))
        .when(t.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.try_variant_get(v, "$", "string"))
        # integers that fit 64 bits arrive as BIGINT; a DECIMAL(p,0) below 19
        # digits is a float literal with a zero fraction (10.0), above it a
        # big integer literal
        .when(F.startswith(t, F.lit("DECIMAL")) & F.endswith(t, F.lit(",0)"))
              & (F.regexp_extract(t, r"DECIMAL\((\d+),", 1).cast("int") >= 19), F.try_variant_get(v, "$", "string"))
        .when(F.startswith(t, F.lit("DECIMAL")) | t.isin("DOUBLE", "FLOAT"),
              py_float_repr(F.try_variant_get(v, "$", "double")))
    )


_NUMERIC = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT", "BOOLEAN")


def _pick_stage(df: DataFrame, obj: str, keys, out: str, stripped: str = "_strip") -> DataFrame:
    """Add ``out`` = first key of ``keys`` with a usable value (P1); a NaN or
    Infinity is rendered as Python prints it.

    Per key only the value, its type name and its stripped text are staged
    (three ``withColumns`` for all keys); the first usable key is chosen as
    a struct, and only that one is rendered.  Keeping the per-key
    expressions small keeps plan building cheap."""
    n = len(keys)
    df = df.withColumns({f"_v{i}": F.try_variant_get(obj, f"$.{k}", "variant") for i, k in enumerate(keys)})
    df = df.withColumns({f"_t{i}": F.schema_of_variant(f"_v{i}") for i in range(n)})
    df = df.withColumns({f"_st{i}": F.when(F.col(f"_t{i}") == "STRING",
                                           py_strip(F.try_variant_get(f"_v{i}", "$", "string")))
                         for i in range(n)})

    def usable(i):
        t = F.col(f"_t{i}")
        return (((t == "STRING") & (F.length(f"_st{i}") > 0)) | t.isin(*_NUMERIC)
                | F.startswith(t, F.lit("DECIMAL")))

    first = F.coalesce(*[F.when(usable(i), F.struct(F.col(f"_v{i}").alias("v"), F.col(f"_t{i}").alias("t"),
                                                    F.col(f"_st{i}").alias("s"))) for i in range(n)])
    df = df.withColumn("_pick", first)
    df = df.withColumn(out, render_scalar(F.col("_pick.v"), F.col("_pick.t"), F.col("_pick.s")))
    df = df.withColumn(out, F.when(F.col("parse_note").isNotNull(), number_text(F.col(out), F.col(stripped))).otherwise(F.col(out)))
    return df.drop("_pick", *[f"_{p}{i}" for i in range(n) for p in ("v", "t", "st")])


def pick_first(df: DataFrame, keys=INPUT_KEYS, value_col: str = "value", out: str = "picked") -> DataFrame:
    """The first key, in list order, whose value is a non-blank string
    (stripped) or a number/bool (rendered as Python prints it)."""
    df = df.withColumn("_strip", py_strip(value_col))
    df = _parse_stage(df, "_strip", "_obj")
    return _pick_stage(df, "_obj", keys, out).drop("_strip", "_obj", "parse_note")


def pick_source_target(df: DataFrame, value_col: str = "value") -> DataFrame:
    """P1 for both sides at once: ``source`` (prompt keys) and ``target``
    (answer keys) from one strip and one parse of each line; and
    ``parse_note``, null unless the line is JSON that only Python reads
    (``duplicate_key``, ``non_finite``)."""
    df = df.withColumn("_strip", py_strip(value_col))
    df = _parse_stage(df, "_strip", "_obj")
    df = _pick_stage(df, "_obj", INPUT_KEYS, "source")
    return _pick_stage(df, "_obj", TARGET_KEYS, "target").drop("_strip", "_obj")


def drop_blank(df: DataFrame, value_col: str = "value") -> DataFrame:
    """Remove lines that are blank after a Python-style strip."""
    return df.filter(~py_is_blank(value_col))


def to_samples(lines: DataFrame, value_col: str = "value", notes: bool = False) -> DataFrame:
    """P2 (+P3): one training text per non-blank line.

    source + newline + target when both exist; else target; else source; else
    the stripped line itself (plain text, non-object JSON, no known key).
    Returns ``(request_id, sample_id, text)`` with ``sample_id = line_no``, and
    with ``notes`` the line's ``parse_note`` (see ``pick_source_target``).
    """
    df = lines.withColumn("_strip", py_strip(value_col)).filter(F.length("_strip") > 0)
    df = _parse_stage(df, "_strip", "_obj")
    df = _pick_stage(df, "_obj", INPUT_KEYS, "_src")
    df = _pick_stage(df, "_obj", TARGET_KEYS, "_tgt")
    src, tgt = F.col("_src"), F.col("_tgt")
    text = (
        F.when(src.isNotNull() & tgt.isNotNull(), F.concat(src, F.lit("\n"), tgt))
        .when(tgt.isNotNull(), tgt)
        .when(src.isNotNull(), src)
        .otherwise(F.col("_strip"))
    )
    return df.select("request_id", F.col("line_no").alias("sample_id"), text.alias("text"), *(["parse_note"] if notes else []))


def check_non_empty(requests: DataFrame, samples: DataFrame) -> DataFrame:
    """Every requested dataset with its sample count; none => 'empty'.

    ``requests`` holds ``request_id``; the count is a map-side-combined
    aggregate, so only one row per request crosses the shuffle.
    """
    counts = samples.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_samples"))
    return (requests.select("request_id").distinct()
            .join(counts, "request_id", "left")
            .select("request_id",
                    F.coalesce("n_samples", F.lit(0)).cast("long").alias("n_samples"),
                    F.when(F.coalesce("n_samples", F.lit(0)) > 0, F.lit("ok")).otherwise(F.lit("empty")).alias("status")))


def require_non_empty(requests: DataFrame, samples: DataFrame) -> DataFrame:
    """P4 for a batch job: fail when any requested dataset has no sample
    (the error names the first and says how many), else return the per-request counts.
    One count and one id reach the driver; ``check_non_empty`` lists them all."""
    status = check_non_empty(requests, samples)
    empty = status.filter(F.col("status") == "empty").agg(F.count(F.lit(1)).alias("n"), F.min("request_id").alias("first")).first()
    if empty.n:
        raise ValueError(f"Dataset is empty after parsing: {empty.first} ({empty.n} in all)")
    return status


def resolve_corpora(requests: DataFrame, landed: DataFrame, order_col: str | None = None) -> DataFrame:
    """Which corpus each training request uses.

    ``requests``: ``(request_id, dataset, resume)``; ``landed``: corpora already
    stored, ``(request_id, stored_key)`` keyed by the **raw** request id.
    Non-blank inline text wins (it is landed under the sanitised id); else a
    resume request reuses its own cached corpus; else the request is refused.

    With ``order_col`` (submission order), a corpus landed by an earlier
    inline request of the same raw id also counts as cached, and takes
    precedence over an older stored one, as the cache entry is replaced.
    That is one per-id ``min`` of the inline orders joined back, not a
    comparison of request pairs."""
    from convspark.functions.names import sanitize_request_id

    inline = ~py_is_blank("dataset")
    j = requests.join(landed.select("request_id", "stored_key"), "request_id", "left")
    earlier = F.lit(False)
    if order_col:
        first_inline = (requests.filter(~py_is_blank("dataset")).groupBy("request_id")
                        .agg(F.min(order_col).alias("_first_inline")))
        j = j.join(first_inline, "request_id", "left")
        earlier = F.coalesce(F.col(order_col) > F.col("_first_inline"), F.lit(False))
    resume = F.coalesce(F.col("resume"), F.lit(False))
    cached = resume & (earlier | F.col("stored_key").isNotNull())
    return j.select(
        *[F.col(c) for c in requests.columns],
        F.when(inline, F.lit("inline")).when(cached, F.lit("cached")).otherwise(F.lit("error")).alias("outcome"),
        F.when(inline | (resume & earlier), sanitize_request_id(F.col("request_id")))
        .when(cached, F.col("stored_key")).alias("corpus_key"),
    )
