"""Prompt handling as table jobs: parse (P5/P6), render (P7/P8), images
(P9/P10/S2/SRC7), per-request overrides (P16) and the context check
(P11/P17), plus the device roll-up feeding it (A4).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convspark.functions.json import exact_json
from convspark.functions.text import PY_WS_CLASS, col_of, py_strip, remove_ws

# Chat-prompt tags, the fallback template and image markers.
SYSTEM_TAG_RE = r"(?s)<\|system\|>(.*?)<\|end\|>"
USER_TAG_RE = r"(?s)<\|user\|>(.*?)<\|end\|>"
IMAGE_BLOCK_RE = r"(?is)\[IMAGE FILE:[^\]]*\](.*?)\[/IMAGE FILE\]"
DATA_URL_RE = r"data:image/[a-zA-Z0-9.+-]+;base64,[A-Za-z0-9+/=" + PY_WS_CLASS[1:-1] + r"]+"
DESCRIBE_IMAGES = "Describe the provided image(s)."
CONTEXT_TOO_LONG = "Context too long ({n} tokens). Max: {m}. Please retry with shorter input."
# Generation settings forced for requests that carry images.
IMAGE_SAMPLING_OVERRIDES = {"do_sample": False, "temperature": 1.0, "top_p": 1.0, "top_k": 50}
IMAGE_REPETITION_PENALTY = 1.0


# ------------------------------------------------------------------ P5/P6
def parse_tagged_prompt(raw) -> tuple[Column, Column]:
    """P5: first ``<|system|>..<|end|>`` and first ``<|user|>..<|end|>``
    (dot matches newline, shortest match), stripped; absent => ''."""
    r = col_of(raw)
    return (py_strip(F.regexp_extract(r, SYSTEM_TAG_RE, 1)), py_strip(F.regexp_extract(r, USER_TAG_RE, 1)))


def normalize_prompts(df: DataFrame, raw_col: str = "raw") -> DataFrame:
    """A JSON object prompt (the whole text, as Python reads it) gives its
    ``system``/``user`` (default ''); any other prompt is a tagged string
    parsed by P5.  The object form is
    not stripped here (the user text is stripped by P10 later)."""
    x = exact_json(df.withColumn("_s", py_strip(raw_col)), "_s", "_v").drop("_s")
    x = x.withColumn("_v", F.when(F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT")), F.col("_v")))
    ts, tu = parse_tagged_prompt(F.col(raw_col))
    is_obj = F.col("_v").isNotNull()
    return (x.withColumn("system", F.when(is_obj, F.coalesce(F.try_variant_get("_v", "$.system", "string"), F.lit("")))
                         .otherwise(ts))
            .withColumn("user", F.when(is_obj, F.coalesce(F.try_variant_get("_v", "$.user", "string"), F.lit("")))
                        .otherwise(tu))
            .drop("_v"))


# ------------------------------------------------------------------ P7/P8
def render_instruct(system, user) -> Column:
    """``[INST]<<SYS>>\\n{s}\\n<</SYS>>\\n\\n{u}[/INST]``, the system block
    only when the system text is non-empty."""
    s, u = col_of(system), col_of(user)
    sys_block = F.when(F.length(s) > 0, F.concat(F.lit("<<SYS>>\n"), s, F.lit("\n<</SYS>>\n\n"))).otherwise(F.lit(""))
    return F.concat(F.lit("[INST]"), sys_block, u, F.lit("[/INST]"))


def build_chat_messages(system, user, n_images) -> Column:
    """The multimodal chat message list as JSON text: a system message
    only when non-empty; the user message holds its text (or the stock
    describe-line when empty) plus one image slot per image."""
    s, u, n = col_of(system), col_of(user), col_of(n_images)
    text_part = F.struct(F.lit("text").alias("type"), F.when(F.length(u) > 0, u)
                         .otherwise(F.lit(DESCRIBE_IMAGES)).alias("text"))
    image_part = F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"))
    user_msg = F.struct(F.lit("user").alias("role"),
                        F.concat(F.array(text_part), F.array_repeat(image_part, n.cast("int"))).alias("content"))
    sys_msg = F.struct(F.lit("system").alias("role"),
                       F.array(F.struct(F.lit("text").alias("type"), s.alias("text"))).alias("content"))
    msgs = F.when(F.length(s) > 0, F.array(sys_msg, user_msg)).otherwise(F.array(user_msg))
    return F.to_json(msgs)


# ------------------------------------------------------------------ images
def strict_b64(text) -> Column:
    """Bytes of a base64 text read the way Python's default (non-strict)
    decoder reads it: characters outside the alphabet are skipped; a run of
    '=' that completes a quantum ends the input (later text is ignored);
    other '=' are skipped; a quantum left incomplete is an error (null).

    The text is cut into data runs and '=' runs by one regex; a small fold
    over those runs finds where the input ends."""
    t = F.regexp_replace(col_of(text), r"[^A-Za-z0-9+/=]", "")
    runs = F.regexp_extract_all(t, F.lit(r"[A-Za-z0-9+/]+|=+"), 0)
    start = F.struct(F.lit("").alias("data"), F.lit(False).alias("done"))

    def step(acc, x):
        quad = F.length(acc["data"]) % 4
        ends = F.startswith(x, F.lit("=")) & (((quad == 2) & (F.length(x) >= 2)) | (quad == 3))
        return (F.when(acc["done"], acc)
                .when(F.startswith(x, F.lit("=")), F.struct(acc["data"].alias("data"), ends.alias("done")))
                .otherwise(F.struct(F.concat(acc["data"], x).alias("data"), F.lit(False).alias("done"))))

    st = F.aggregate(runs, start, step)
    n = F.length(st["data"]) % 4
    padded = F.concat(st["data"], F.when(n == 2, F.lit("==")).when(n == 3, F.lit("=")).otherwise(F.lit("")))
    ok = (n == 0) | (st["done"] & (n >= 2))
    return F.when(ok, F.try_to_binary(padded, F.lit("base64")))


def decode_data_url(url) -> Column:
    """Payload bytes after the first comma, whitespace removed; null when
    there is no comma or the base64 is bad."""
    u = col_of(url)
    after_first = F.substr(u, F.instr(u, ",") + 1)
    return F.when(F.instr(u, ",") > 0, strict_b64(remove_ws(after_first)))


def extract_inline_images(df: DataFrame, user_col: str = "user") -> DataFrame:
    """P10: data URLs inside ``[IMAGE FILE: ..]..[/IMAGE FILE]`` blocks are
    decoded (undecodable ones skipped); the prompt loses every block and is
    stripped.  Adds ``user_clean`` and ``inline_images`` (array<binary>)."""
    u = F.col(user_col)
    inner = F.regexp_extract_all(u, F.lit(IMAGE_BLOCK_RE), 1)
    urls = F.flatten(F.transform(inner, lambda b: F.regexp_extract_all(b, F.lit(DATA_URL_RE), 0)))
    decoded = F.filter(F.transform(urls, lambda x: decode_data_url(x)), lambda b: b.isNotNull())
    cleaned = py_strip(F.regexp_replace(u, IMAGE_BLOCK_RE, ""))
    empty = u.isNull() | (F.length(u) == 0)
    return (df.withColumn("user_clean", F.when(empty, u).otherwise(cleaned))
            .withColumn("inline_images", F.when(empty, F.array().cast("array<binary>")).otherwise(decoded)))


def classify_images(entries: DataFrame, entry_col: str = "entry", files: DataFrame | None = None) -> DataFrame:
    """What each image entry is and where its bytes come from.

    ``entry`` is JSON text (a string or an object).  String: data URL ->
    existing path -> raw base64.  Object (``source`` object unwrapped):
    ``data_url`` -> ``base64`` -> ``data`` (data URL or base64) -> ``path``
    -> http(s) ``url`` -> error.  ``files`` (``path``) lists existing files;
    the existence test is a left join, not a per-row file probe.
    Output adds ``kind``, ``ref``, ``n_bytes`` and ``error``."""
    v = F.try_parse_json(F.col(entry_col))
    x = entries.withColumn("_v", v).withColumn("_t", F.schema_of_variant("_v"))
    src = F.try_variant_get("_v", "$.source", "variant")
    x = x.withColumn("_p", F.when(F.startswith(F.schema_of_variant(src), F.lit("OBJECT")), src).otherwise(F.col("_v")))
    x = x.withColumn("_s", F.when(F.col("_t") == "STRING", py_strip(F.try_variant_get("_v", "$", "string"))))

    def field(name):
        return F.when(F.schema_of_variant(F.try_variant_get("_p", f"$.{name}", "variant")) == "STRING",
                      F.try_variant_get("_p", f"$.{name}", "string"))

    for name in ("data_url", "base64", "data", "path", "url"):
        x = x.withColumn(f"_f_{name}", field(name))
    if files is not None:
        fl = files.select(F.col("path").alias("_fp"), F.lit(True).alias("_exists")).distinct()
        # a data URL names no file; everything else is looked up as written
        cand = F.coalesce(F.col("_s"), F.col("_f_path"))
        x = x.withColumn("_pk", F.when(~F.startswith(cand, F.lit("data:image/")), cand))
        x = x.join(fl, F.col("_pk") == F.col("_fp"), "left").drop("_fp", "_pk")
    else:
        x = x.withColumn("_exists", F.lit(None).cast("boolean"))
    exists = F.coalesce(F.col("_exists"), F.lit(False))
    s = F.col("_s")
    is_str, is_obj = F.col("_t") == "STRING", F.startswith(F.col("_t"), F.lit("OBJECT"))
    nonblank = lambda c: F.col(c).isNotNull() & (F.length(py_strip(F.col(c))) > 0)
    is_du = lambda c: F.startswith(F.col(c), F.lit("data:image/"))
    scheme = F.lower(F.regexp_extract(F.col("_f_url"), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    kind = (F.when(is_str & F.startswith(s, F.lit("data:image/")), F.lit("data_url"))
            .when(is_str & exists, F.lit("path"))
            .when(is_str, F.lit("base64"))
            .when(~is_obj, F.lit("error"))
            .when(F.col("_f_data_url").isNotNull() & is_du("_f_data_url"), F.lit("data_url"))
            .when(nonblank("_f_base64"), F.lit("base64"))
            .when(nonblank("_f_data") & is_du("_f_data"), F.lit("data_url"))
            .when(nonblank("_f_data"), F.lit("base64"))
            .when(nonblank("_f_path") & exists, F.lit("path"))
            .when(nonblank("_f_path"), F.lit("error"))
            .when(nonblank("_f_url") & scheme.isin("http", "https"), F.lit("url"))
            .otherwise(F.lit("error")))
    ref = (F.when(is_str, s)
           .when(F.col("_f_data_url").isNotNull() & is_du("_f_data_url"), F.col("_f_data_url"))
           .when(nonblank("_f_base64"), F.col("_f_base64"))
           .when(nonblank("_f_data"), F.col("_f_data"))
           .when(nonblank("_f_path"), F.col("_f_path"))
           .when(nonblank("_f_url"), F.col("_f_url")))
    x = x.withColumn("kind", kind).withColumn("ref", ref)
    payload = (F.when(F.col("kind") == "data_url", decode_data_url(F.col("ref")))
               .when(F.col("kind") == "base64", strict_b64(remove_ws(F.col("ref")))))
    x = x.withColumn("_bytes", payload)
    err = (F.when(~is_str & ~is_obj, F.concat(F.lit("unsupported type: "), F.lower(F.col("_t"))))
           .when(is_obj & nonblank("_f_path") & ~exists & (F.col("kind") == "error"),
                 F.concat(F.lit("path does not exist: "), F.col("_f_path")))
           .when(is_obj & nonblank("_f_url") & (F.col("kind") == "error"),
                 F.concat(F.lit("url scheme not supported: "), scheme))
           .when(F.col("kind") == "error", F.lit("missing image source (data_url/base64/path/url)"))
           .when(F.col("kind").isin("data_url", "base64") & F.col("_bytes").isNull(), F.lit("undecodable base64")))
    return (x.withColumn("n_bytes", F.length("_bytes").cast("long")).withColumn("error", err)
            .drop("_v", "_t", "_p", "_s", "_exists", "_bytes", *[f"_f_{n}" for n in
                                                                   ("data_url", "base64", "data", "path", "url")]))


def concat_images(df: DataFrame, prompt_col: str, message_col: str, inline_col: str) -> DataFrame:
    """Prompt images, then message images, then inline images, order
    kept; a null list counts as empty.  One row per image with its 0-based
    position ``idx`` and ``origin``."""
    def tag(c, origin):
        return F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")),
                           lambda e: F.struct(F.lit(origin).alias("origin"), e.alias("entry")))
    allx = F.concat(tag(prompt_col, "prompt"), tag(message_col, "message"), tag(inline_col, "inline"))
    keep = [c for c in df.columns if c not in (prompt_col, message_col, inline_col)]
    return (df.select(*keep, F.posexplode(allx).alias("idx", "_img"))
            .select(*keep, "idx", F.col("_img.origin").alias("origin"), F.col("_img.entry").alias("entry")))


def load_images(entries: DataFrame, files: DataFrame, path_col: str = "path") -> DataFrame:
    """SRC7: bytes of path entries from a ``binaryFile`` listing (left join
    on the path); a missing file is an error row, not a failure."""
    f = files.select(F.col("path").alias("_fp"), F.col("content").alias("content"))
    j = entries.join(f, F.col(path_col) == F.col("_fp"), "left")
    return j.select(*entries.columns, "content",
                    F.when(F.col("_fp").isNull(), F.concat(F.lit("path does not exist: "), F.col(path_col)))
                    .alias("error"))


# ------------------------------------------------------------------ P16
def request_overrides(df: DataFrame, n_images: str = "n_images") -> DataFrame:
    """Requests with images and sampling on switch to greedy with
    neutral settings; every image request gets repetition_penalty 1."""
    has_img = F.col(n_images) > 0
    samp = has_img & F.coalesce(F.col("do_sample"), F.lit(False))
    forced = {k: F.when(samp, F.lit(v)).otherwise(F.col(k)) for k, v in IMAGE_SAMPLING_OVERRIDES.items()}
    forced["repetition_penalty"] = F.when(has_img, F.lit(IMAGE_REPETITION_PENALTY)).otherwise(F.col("repetition_penalty"))
    return df.withColumns(forced)


# ------------------------------------------------------------------ A4/P17/P11
# Context estimate parameters.
BYTES_PER_TOKEN = ((15, 512), (40, 1024), (None, 1536))  # (params below, bytes) by model size in billions
USABLE_FRACTION = 0.7
CONFIG_MAX_CONTEXT = 128000
DEFAULT_MODEL_MAX = 128000
MIN_CONTEXT = 1000
PLENTY_FACTOR = 1.5


def device_rollup(devices: DataFrame) -> DataFrame:
    """A4: per host the summed total/allocated/reserved memory, free =
    total - reserved, the device count and the first device's name."""
    return devices.groupBy("host").agg(
        F.sum("total").alias("total_gb"), F.sum("allocated").alias("allocated_gb"),
        F.sum("reserved").alias("reserved_gb"), (F.sum("total") - F.sum("reserved")).alias("free_gb"),
        F.count(F.lit(1)).alias("num_gpus"), F.min_by("device", "idx").alias("device"))


def context_limit(free_gb, params_b, model_max) -> Column:
    """Usable context in tokens from free memory and model size."""
    f, p = col_of(free_gb).cast("double"), col_of(params_b).cast("double")
    known = col_of(model_max).cast("long")
    mm = F.coalesce(F.when(known != 0, known), F.lit(DEFAULT_MODEL_MAX))     # 0: not known
    bpt = (F.when(p < BYTES_PER_TOKEN[0][0], F.lit(BYTES_PER_TOKEN[0][1]))
           .when(p < BYTES_PER_TOKEN[1][0], F.lit(BYTES_PER_TOKEN[1][1]))
           .otherwise(F.lit(BYTES_PER_TOKEN[2][1])))
    est = (f * F.lit(USABLE_FRACTION) * F.lit(1024.0 ** 3) / bpt).cast("long")  # truncates toward zero
    capped = F.least(est, mm, F.lit(CONFIG_MAX_CONTEXT))
    return F.when(est > mm * F.lit(PLENTY_FACTOR), mm).otherwise(F.greatest(capped, F.lit(MIN_CONTEXT))).cast("long")


def filter_context(prompts: DataFrame, limits: DataFrame, key: str = "host") -> DataFrame:
    """Reject prompts with more tokens than their server allows; the
    rejection carries both numbers.  ``prompts``: ``(.., key, tokens_in)``;
    ``limits``: ``(key, max_context)`` (one row per server)."""
    j = prompts.join(limits.select(key, "max_context"), key, "left")
    too_long = F.col("max_context").isNotNull() & (F.col("tokens_in") > F.col("max_context"))
    msg = F.concat(F.lit("Context too long ("), F.col("tokens_in").cast("string"), F.lit(" tokens). Max: "),
                   F.col("max_context").cast("string"), F.lit(". Please retry with shorter input."))
    return j.withColumn("accepted", ~too_long).withColumn("error", F.when(too_long, msg))


def split_context(prompts: DataFrame, limits: DataFrame, key: str = "host") -> tuple[DataFrame, DataFrame]:
    """P11 as two outputs: the prompts that fit and the rejected ones (with
    both numbers in ``error``)."""
    checked = filter_context(prompts, limits, key)
    return checked.filter(F.col("accepted")).drop("error"), checked.filter(~F.col("accepted"))
