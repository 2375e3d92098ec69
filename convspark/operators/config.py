"""Layered configuration as long-form ``(scope, section, key, value)`` rows:
merge (J3), two-level default fill (J4), typed key=value pivot (A9) and the
config-file reader (SRC6 lives in :mod:`convspark.sources.config_file`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The server's default configuration, section -> key -> value
# (None = not set).
DEFAULT_CONFIG = {
    "server": {"host": "0.0.0.0", "port": 8765, "max_message_size": 16777216, "ping_interval": 30,
               "ping_timeout": 10},
    "model": {"path": None, "use_safetensors": True, "trust_remote_code": True, "device_map": "auto"},
    "optimization": {"use_flash_attention": True, "dtype": "auto", "compile": False},
    "generation_defaults": {"max_new_tokens": 2048, "do_sample": True, "temperature": 0.7, "top_p": 0.95,
                            "top_k": 50, "repetition_penalty": 1.1},
    "paths": {"models_dir": "models", "var_dir": "var", "sessions_dir": "var/sessions", "logs_dir": "var/logs",
              "datasets_dir": "var/datasets"},
    "limits": {"max_clients": 10, "queue_size_per_client": 1024, "max_context_length": 128000,
               "timeout_token_generation": 300},
}
GENERATION_DEFAULTS = DEFAULT_CONFIG["generation_defaults"]


def json_text(v) -> str:
    """A Python default rendered as JSON text (our long-form value)."""
    import json
    return json.dumps(v)


def defaults_array(section: str | None = None):
    """The defaults as an array literal of ``(section, key, value)`` structs,
    so they can be attached to every scope with ``explode`` (a generator)
    instead of a cross join."""
    rows = [(s, k, json_text(v)) for s, kv in DEFAULT_CONFIG.items() if section in (None, s) for k, v in kv.items()]
    return F.array(*[F.struct(F.lit(s).alias("section"), F.lit(k).alias("key"), F.lit(v).alias("value"))
                     for s, k, v in rows])


def merge_config(updates: DataFrame, scope: str = "session_id") -> DataFrame:
    """Effective generation config per scope: the defaults, then every
    update in order (later wins, extra keys kept), then the request layer.

    ``updates``: ``(scope, key, value, layer, seq)``; layer 1 = session
    updates, 2 = request overrides.  Defaults are layer 0."""
    return merge_settings(updates, scope).select(scope, F.inline("settings"))


def merge_settings(updates: DataFrame, scope: str = "session_id") -> DataFrame:
    """J3 with one row per scope: ``settings``, an array of its ``(key, value)``.

    One grouped maximum per key (map-side combined) of the updates alone; the
    defaults are a literal that each scope's row fills up from, so they take
    part in no shuffle."""
    at = F.struct(F.col("layer").cast("int").alias("layer"), F.col("seq").cast("long").alias("seq"))
    top = updates.groupBy(scope, "key").agg(F.max_by("value", at).alias("value"), F.max(at).alias("_at"))
    # an update below the defaults' layer does not count for their keys
    keys = F.array(*[F.lit(k) for k in GENERATION_DEFAULTS])
    counts = ~F.coalesce(F.array_contains(keys, F.col("key")), F.lit(False)) \
        | (F.col("_at") > F.struct(F.lit(0).alias("layer"), F.lit(-1).cast("long").alias("seq")))
    own = top.groupBy(scope).agg(F.collect_list(F.when(counts, F.struct("key", "value"))).alias("_own"))
    defaults = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(json_text(v)).alias("value")) for k, v in GENERATION_DEFAULTS.items()])
    unset = F.filter(defaults, lambda d: ~F.exists("_own", lambda o: o["key"].eqNullSafe(d["key"])))
    return own.select(scope, F.concat(unset, F.col("_own")).alias("settings"))


def request_config(events: DataFrame, scope: str = "session_id", block_bits: int | None = None) -> DataFrame:
    """J3 at request time: the generation config each inference request runs
    with = defaults, then the session's updates made before the request (later
    wins, extra keys kept), then the request's own overrides, which are not
    kept for later requests.

    ``events``: ``(scope, seq, kind, key, value)`` with kind ``update`` or
    ``request``.  A request is one row per override, all with its ``seq``, or
    one row without a key; a key that one event sets twice takes the greater
    value.  Output: ``scope, seq, config`` (a map of all keys), a row per
    request.

    As-of join in long form: a request asks for each key that its session ever
    sets (as many rows as its config has keys), and a skew-safe running scan
    per session and key (:mod:`convspark.operators.prefix`) brings the latest
    update before it, so a hot session is spread over its blocks."""
    from convspark.operators.prefix import running

    upd = events.filter((F.col("kind") == "update") & F.col("key").isNotNull()) \
        .groupBy(scope, "seq", "key").agg(F.max("value").alias("value"))
    req = events.filter(F.col("kind") == "request")
    asked = req.select(scope, "seq").distinct()
    keys = upd.select(scope, "key").distinct().groupBy(scope).agg(F.collect_list("key").alias("_keys"))
    wanted = asked.join(keys, scope).select(scope, "seq", F.explode("_keys").alias("key"), F.lit(None).cast("string").alias("value"),
                                            F.lit(True).alias("_asks"))
    both = upd.withColumn("_asks", F.lit(False)).unionByName(wanted)
    both = both.withColumn("_at", 2 * F.col("seq") + F.col("_asks").cast("int"))
    # a struct that orders by seq; the value may be null
    latest = F.when(~F.col("_asks"), F.struct(F.col("seq").alias("s"), F.col("value").alias("v")))
    known = running(both, [scope, "key"], "_at", maxes={"_u": (latest, True)}, block_bits=block_bits)
    known = known.filter(F.col("_asks") & F.col("_u").isNotNull()).select(scope, "seq", "key", F.col("_u.v").alias("value"), F.lit(1).alias("layer"))
    own = req.select(scope, "seq", "key", "value", F.lit(2).alias("layer"))     # without a key: only that the request is there
    layers = known.unionByName(own).repartition(scope, "seq")
    top = layers.groupBy(scope, "seq", "key").agg(F.max(F.struct("layer", "value")).alias("_v"))
    entry = F.when(F.col("key").isNotNull(), F.struct("key", F.col("_v.value").alias("value")))
    config = top.groupBy(scope, "seq").agg(F.map_from_entries(F.collect_list(entry)).alias("_set"))
    defaults = F.create_map(*[F.lit(x) for k, v in GENERATION_DEFAULTS.items() for x in (k, json_text(v))])
    unset = F.map_filter(defaults, lambda k, v: ~F.map_contains_key("_set", k))
    return config.select(scope, "seq", F.map_concat(unset, F.col("_set")).alias("config"))


def fill_defaults(config: DataFrame, scope: str = "file_id") -> DataFrame:
    """Two-level fill of a config file: a missing section or a missing
    key takes the default; present keys (and extra keys) are kept as they
    are.  ``config``: ``(scope, section, key, value)``, last row per key
    already chosen.  A row without a section only names a file (SRC6 gives one
    for a file without settings), which takes all defaults; where rows have a
    ``status``, ``broken`` files take none.  A section that is no object is
    kept as it is beside its defaults.  Output adds ``origin`` = file /
    default / extra."""
    if "status" in config.columns:
        config = config.filter(F.col("status") != "broken").drop("status")
    scopes = config.select(scope).distinct()
    config = config.filter(F.col("section").isNotNull())
    d = scopes.select(scope, F.explode(defaults_array()).alias("_d")).select(
        scope, F.col("_d.section").alias("section"), F.col("_d.key").alias("key"), F.col("_d.value").alias("_dv"))
    j = d.join(config, [scope, "section", "key"], "full_outer")
    return j.select(scope, "section", "key",
                    F.coalesce(F.col("value"), F.col("_dv")).alias("value"),
                    F.when(F.col("value").isNotNull() & F.col("_dv").isNotNull(), F.lit("file"))
                    .when(F.col("value").isNotNull(), F.lit("extra"))
                    .otherwise(F.lit("default")).alias("origin"))


def typed_value(v) -> tuple:
    """The client's ``/config key=value`` typing: true/false (any case) ->
    bool, text with '.' -> float, else int, else the text itself."""
    c = F.col(v) if isinstance(v, str) else v
    is_bool = F.lower(c).isin("true", "false")
    as_float = F.when(F.instr(c, ".") > 0, F.trim(c).try_cast("double"))
    as_int = F.when(F.instr(c, ".") == 0, F.trim(c).try_cast("long"))
    kind = (F.when(is_bool, F.lit("bool")).when(as_float.isNotNull(), F.lit("float"))
            .when(as_int.isNotNull(), F.lit("int")).otherwise(F.lit("str")))
    return kind, is_bool & (F.lower(c) == "true"), F.coalesce(as_float, as_int.cast("double"))


def config_pivot(settings: DataFrame, keys, scope: str = "session_id") -> DataFrame:
    """Last ``key=value`` per scope and key, one column per key: a struct
    ``(kind, bool, num, text)`` typed by the client's rule (``kind`` is
    ``bool``, ``float``, ``int`` or ``str``; ``text`` is the value as given).
    A key outside ``keys`` gets no column: :func:`last_settings` has them all."""
    return last_settings(settings, scope).groupBy(scope).pivot("key", list(keys)).agg(F.first("setting"))


def last_settings(settings: DataFrame, scope: str = "session_id") -> DataFrame:
    """A9 in long form, for keys not known in advance: the last typed
    ``setting`` of every ``(scope, key)`` (map-side combined)."""
    kind, flag, num = typed_value("value")
    typed = F.struct(kind.alias("kind"), F.when(kind == "bool", flag).alias("bool"), num.alias("num"),
                     F.col("value").alias("text"))
    return settings.groupBy(scope, "key").agg(F.max_by(typed, "seq").alias("setting"))
