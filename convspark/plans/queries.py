"""Registered queries: one per operator of the inventory, each reading the
given tables (or data Spark derives from them) in full.

Every builder has the signature ``(spark, sf_dir) -> DataFrame``.  Column
names match the DuckDB statements in :mod:`convspark.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convspark.functions import codec as K
from convspark.functions import names as NM
from convspark.operators import batches as B
from convspark.operators import catalog as CA
from convspark.operators import chunks as CH
from convspark.operators import config as CF
from convspark.operators import corpus as C
from convspark.operators import frames as FR
from convspark.operators import jobs as JB
from convspark.operators import prompts as PR
from convspark.operators import scoring as SC
from convspark.plans import fixtures as FX
from convspark.session import scratch_path
from convspark.sources import config_file as SCF
from convspark.sources import corpus as SCO
from convspark.sources import log as SLG
from convspark.sources.artifacts import read_artifacts, scan_artifacts
from convspark.streaming import frames as ST
from convspark.streaming import sinks as SK

QUERIES: dict = {}
LOG_KEY = "relay"  # the queries' own log key


def register(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def csv(c):
    """arrays are compared as comma-joined text"""
    return F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), ",")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return C.to_samples(FX.f_jsonl(spark, sf))


# ------------------------------------------------------------------ corpus
@register("p3_drop_blank")
def q_drop_blank(spark, sf):
    return C.drop_blank(FX.f_jsonl(spark, sf)).select("request_id", "line_no")


@register("p1_pick_first")
def q_pick_first(spark, sf):
    return C.pick_source_target(FX.f_jsonl(spark, sf)).select("request_id", "line_no", "source", "target")


@register("p2_to_samples")
def q_to_samples(spark, sf):
    return samples(spark, sf)


@register("p1_odd_json")
def q_odd_json(spark, sf):
    return C.pick_source_target(FX.f_odd_lines(spark, sf)).select("line_no", "source", "target", "parse_note")


@register("p2_odd_json")
def q_odd_samples(spark, sf):
    return C.to_samples(FX.f_odd_lines(spark, sf), notes=True)


@register("p12_odd_json")
def q_odd_route(spark, sf):
    return FR.route_frames(FX.f_odd_msgs(spark, sf)).select("session_id", "seq", "route", "msg_type", "error")


@register("p4_check_non_empty")
def q_check_non_empty(spark, sf):
    lines = FX.f_jsonl(spark, sf)
    return C.check_non_empty(lines.select("request_id"), C.to_samples(lines))


@register("j2_resolve_corpora")
def q_resolve_corpora(spark, sf):
    out = C.resolve_corpora(FX.f_requests(spark, sf), FX.f_landed(spark, sf), order_col="o_orderkey")
    return out.select("request_id", "o_orderkey", "outcome", "corpus_key")


@register("o1_shuffle_corpus")
def q_shuffle(spark, sf):
    return B.shuffle_corpus(samples(spark, sf), seed=42).select("request_id", "sample_id", "rank")


@register("o2_make_batches")
def q_batches(spark, sf):
    return B.make_batches(B.shuffle_corpus(samples(spark, sf), seed=42), 8) \
        .select("request_id", "sample_id", "rank", "batch")


@register("corpus_batches")
def q_corpus_batches(spark, sf):
    """Flagship: corpus lines -> samples -> seeded shuffle -> batches of 16 ->
    rows, characters and word tokens per batch."""
    b = B.make_batches(B.shuffle_corpus(samples(spark, sf), seed=42), 16)
    b = B.count_tokens(b)
    return b.groupBy("request_id", "batch").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.sum(F.length("text")).cast("long").alias("n_chars"),
        F.sum("n_tokens").cast("long").alias("n_tokens"))


def _epochs_and_a_half(batch_size: int):
    """Steps of one and a half epochs (rounded up) of a request's samples."""
    return F.ceil(F.ceil(F.count(F.lit(1)) / batch_size) * 3 / 2).cast("long")


@register("o3_repeat_epochs")
def q_repeat_epochs(spark, sf):
    s = samples(spark, sf)
    plan = s.groupBy("request_id").agg(_epochs_and_a_half(16).alias("max_steps")) \
        .withColumn("batch_size", F.lit(16).cast("long"))
    return B.repeat_epochs(s, plan, seed=42).select("request_id", "epoch", "sample_id", "rank", "batch", "step")


@register("t3_count_tokens")
def q_count_tokens(spark, sf):
    return B.count_tokens(samples(spark, sf)).select("request_id", "sample_id", "n_tokens")


@register("t1_truncate_tokens")
def q_truncate(spark, sf):
    x = B.tokenize(samples(spark, sf), max_len=64)
    return x.select("request_id", "sample_id", csv("token_ids").alias("token_ids"))


@register("t2_pad_batch")
def q_pad(spark, sf):
    # cut and hashed first: only the kept ids travel through the shuffle
    x = B.tokenize(samples(spark, sf), max_len=32).select("request_id", "sample_id", "token_ids")
    x = B.make_batches(B.shuffle_corpus(x, seed=42), 4)
    x = B.pad_batch(x, ("request_id", "epoch", "batch"))
    return x.select("request_id", "batch", "sample_id", csv("input_ids").alias("input_ids"),
                    csv("attention_mask").alias("attention_mask"), csv("labels").alias("labels"))


@register("t7_clamp_train_config")
def q_clamp(spark, sf):
    return B.clamp_train_config(FX.f_train_cfg(spark, sf))


@register("w8_step_plan")
def q_step_plan(spark, sf):
    cfg = B.clamp_train_config(FX.f_train_cfg(spark, sf))
    k = F.col("request_id")
    cfg = cfg.withColumn("save_checkpoint", k % 5 != 0).withColumn(
        "checkpoint_name", F.when(k % 3 == 0, F.concat(F.lit(" my model "), k.cast("string"), F.lit("/"))).when(k % 3 == 1, F.lit(" .-")))
    steps = cfg.select("request_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("max_steps"))).alias("step"))
    return B.step_plan(steps, cfg)


@register("w9_latest_loss")
def q_latest_loss(spark, sf):
    cfg = B.clamp_train_config(FX.f_train_cfg(spark, sf))
    losses = FX.f_train(spark, sf).filter(F.col("type") == "train_progress").select("request_id", "step", "loss")
    return B.latest_loss(losses, cfg)


# ------------------------------------------------------------------ frames


def _answers(spark, sf):
    """Answers, every other one with a tail that no separator ends."""
    k = F.col("conv_id")
    return FX.conv_pairs(spark, sf).select(k.alias("session_id"), "turn", F.when(
        k % 2 == 0, F.concat("assistant", F.lit(" tail"), k.cast("string"))).otherwise(F.col("assistant")).alias("assistant"))


@register("t4_chunk_text")
def q_chunk_text(spark, sf):
    p = _answers(spark, sf)
    return CH.chunk_text(p, "assistant", flush_tail=True).select("session_id", "turn", "k", "chunk")


@register("t4_chunk_text_budget")
def q_chunk_text_budget(spark, sf):
    p = _answers(spark, sf)
    return CH.chunk_text(p, "assistant", flush_tail=False).select("session_id", "turn", "k", "chunk")


@register("t5_stitch_overlaps")
def q_stitch(spark, sf):
    return CH.stitch_overlaps(FX.f_windows(spark, sf), "sent", "window").select("doc_id", "i", "overlap")


@register("t5_stitch_overlaps_eos")
def q_stitch_eos(spark, sf):
    """the end-of-stream search looks back 50 characters, not 100"""
    w = FX.f_windows(spark, sf)
    return CH.stitch_overlaps(w, "sent", "window", limit=CH.EOS_OVERLAP).select("doc_id", "i", "overlap")


@register("t6_encode_log")
def q_encode(spark, sf):
    f = FX.f_frames(spark, sf).filter(F.col("type") == "token")
    return f.select("session_id", "seq", K.encode_log(F.col("data"), LOG_KEY).alias("encoded"))


@register("t6_decode_log")
def q_decode(spark, sf):
    f = FX.f_frames(spark, sf).filter(F.col("type") == "token")
    good = f.select("session_id", "seq", K.decode_log(K.encode_log(F.col("data"), LOG_KEY), LOG_KEY).alias("decoded"))
    junk = FX.t(spark, sf, "benchmark").select(F.lit(-1).cast("long").alias("session_id"),
                                               F.col("item_id").alias("seq"),
                                               K.decode_log(F.col("text"), LOG_KEY).alias("decoded"))
    return good.unionByName(junk)


@register("w1_segment_generations")
def q_segment(spark, sf):
    return FR.segment_generations(FX.f_frames(spark, sf), block_bits=22).select("session_id", "seq", "type", "gen")


@register("a1_rebuild_transcripts")
def q_transcripts(spark, sf):
    return FR.rebuild_transcripts(FR.segment_generations(FX.f_frames(spark, sf), block_bits=22))


@register("a1_rebuild_transcripts_js")
def q_transcripts_js(spark, sf):
    return FR.rebuild_transcripts(FR.segment_generations(FX.f_frames(spark, sf), block_bits=22), js_errors=True)


@register("a2_generation_stats")
def q_gen_stats(spark, sf):
    return FR.generation_stats(FR.segment_generations(FX.f_frames(spark, sf), block_bits=22))


@register("p12_route_frames")
def q_route(spark, sf):
    return FR.route_frames(FX.f_msgs(spark, sf)).select("session_id", "seq", "route", "msg_type", "error")


@register("x3_replay")
def q_replay(spark, sf):
    # some token frames are errors instead, every other one of a training run
    p, err = FX.f_proto(spark, sf), (F.col("type") == "token") & (F.col("seq") % 7 == 0)
    p = p.withColumn("request_id", F.when(err & (F.col("seq") % 2 == 0), F.concat(F.lit("job-"), F.col("seq").cast("string"))))
    return FR.replay(p.withColumn("type", F.when(err, F.lit("error")).otherwise(F.col("type")))).select("session_id", "seq", "type", "request_id")


@register("x4_dedupe_frames")
def q_dedupe(spark, sf):
    log = FX.f_proto(spark, sf).filter(F.col("type").isin(*FR.BUFFERED_TYPES))
    again = FR.replay(FX.f_proto(spark, sf))
    lines = log.select("id", "session_id", "seq", "type").unionByName(again.select("id", "session_id", "seq", "type"))
    return FR.dedupe_frames(lines, "id")


@register("j1_resolve_sessions")
def q_resolve_sessions(spark, sf):
    e = FX.t(spark, sf, "events")
    k = F.col("event_id")
    hellos = e.filter(F.col("event_type") == "click").select(
        k.alias("hello_id"), "user_id",
        F.when(k % 3 == 1, F.col("user_id")).when(k % 3 == 2, F.col("user_id") + 1000).alias("session_id"))
    sessions = e.filter(F.col("event_type") == "signup").select(F.col("user_id").alias("session_id"))
    return FR.resolve_sessions(hellos, sessions)


@register("x7_purge_sessions")
def q_purge(spark, sf):
    e = FX.t(spark, sf, "events")
    sessions = e.filter(F.col("event_type") == "signup").select(
        F.col("event_id").alias("session_id"), "user_id", F.col("ts").alias("created"))
    restarts = e.filter((F.col("event_type") == "purchase") & (F.col("value") > 360)).select("ts")
    return FR.purge_sessions(sessions, restarts).select("session_id", "user_id")


# ------------------------------------------------------------------ scoring


@register("w2_softmax")
def q_softmax(spark, sf):
    return SC.softmax(FX.f_logits(spark, sf), 0.7).select("seq_id", "token_id", F.round("prob", 6).alias("prob"))


@register("w3_top_k_filter")
def q_top_k(spark, sf):
    return SC.top_k_filter(FX.f_logits(spark, sf), 50).select("seq_id", "token_id")


@register("w4_nucleus_filter")
def q_nucleus(spark, sf):
    x = SC.sample_filter(FX.f_logits(spark, sf), 0.7, 50, 0.95)
    return x.select("seq_id", "token_id", F.round("prob", 6).alias("prob"))


@register("w5_greedy_token")
def q_greedy(spark, sf):
    return SC.greedy_token(FX.f_logits(spark, sf))


@register("w6_draw_token")
def q_draw(spark, sf):
    return SC.draw_tokens(FX.f_logits(spark, sf), 0.7, 50, 0.95, seed=42)


@register("w7_shift_labels")
def q_shift(spark, sf):
    return SC.shift_labels(FX.f_seq_positions(spark, sf)).select("seq", "pos", "label", "target")


@register("a8_cross_entropy")
def q_xent(spark, sf):
    logits = FX.f_logits(spark, sf).select(F.col("seq_id").alias("vec_id"), "token_id", "logit")
    out = SC.cross_entropy(logits, FX.f_seq_positions(spark, sf))
    return out.withColumn("loss", F.round("loss", 6))


@register("a8_batch_loss")
def q_batch_loss(spark, sf):
    logits = FX.f_logits(spark, sf).select(F.col("seq_id").alias("vec_id"), "token_id", "logit")
    out = SC.batch_loss(SC.cross_entropy(logits, FX.f_seq_positions(spark, sf)), F.floor(F.col("seq") / 4))
    return out.withColumn("loss", F.round("loss", 6))


# ------------------------------------------------------------------ prompts


@register("p5_parse_tagged_prompt")
def q_parse_tagged(spark, sf):
    s, u = PR.parse_tagged_prompt(F.col("raw"))
    return FX.f_prompts(spark, sf).select("prompt_id", s.alias("system"), u.alias("user"))


@register("p6_normalize_prompts")
def q_normalize(spark, sf):
    return PR.normalize_prompts(FX.f_prompts(spark, sf)).select("prompt_id", "system", "user")


@register("p7_render_instruct")
def q_render(spark, sf):
    p = PR.extract_inline_images(PR.normalize_prompts(FX.f_prompts(spark, sf)))
    return p.select("prompt_id", PR.render_instruct("system", "user_clean").alias("rendered"))


@register("p8_build_chat_messages")
def q_chat_messages(spark, sf):
    p = PR.extract_inline_images(PR.normalize_prompts(FX.f_prompts(spark, sf)))
    return p.select("prompt_id", PR.build_chat_messages("system", "user_clean", F.col("prompt_id") % 3).alias("messages"))


@register("p10_extract_inline_images")
def q_inline_images(spark, sf):
    x = PR.extract_inline_images(FX.f_images(spark, sf))
    return x.select("prompt_id", "user_clean", F.size("inline_images").alias("n_images"),
                    F.aggregate("inline_images", F.lit(0).cast("long"),
                                lambda acc, b: acc + F.length(b)).alias("image_bytes"))


def _entries(spark, sf):
    return FX.f_images(spark, sf).select("prompt_id", F.posexplode("entries").alias("idx", "entry"))


@register("p9_classify_images")
def q_classify(spark, sf):
    files = scan_artifacts(spark, sf, glob="*.parquet")
    return PR.classify_images(_entries(spark, sf), "entry", files).select("prompt_id", "idx", "kind", "n_bytes", "error")


@register("s2_concat_images")
def q_concat_images(spark, sf):
    x = FX.f_images(spark, sf).withColumn(
        "inline", F.flatten(F.transform(F.regexp_extract_all("user", F.lit(PR.IMAGE_BLOCK_RE), 1),
                                        lambda b: F.regexp_extract_all(b, F.lit(PR.DATA_URL_RE), 0))))
    return PR.concat_images(x.select("prompt_id", "entries", "message", "inline"), "entries", "message", "inline")


@register("src7_load_images")
def q_load_images(spark, sf):
    files = scan_artifacts(spark, sf, glob="*.parquet")
    paths = _entries(spark, sf).select(
        "prompt_id", "idx", F.try_variant_get(F.try_parse_json("entry"), "$.path", "string").alias("path")) \
        .filter(F.col("path").isNotNull())
    out = PR.load_images(paths, read_artifacts(files, paths))
    return out.select("prompt_id", "idx", F.length("content").cast("long").alias("n_bytes"),
                      F.when(F.col("error").isNotNull(), F.lit("missing")).alias("error"))


@register("p16_request_overrides")
def q_overrides(spark, sf):
    x = PR.extract_inline_images(FX.f_images(spark, sf))
    req = x.select("prompt_id", (F.size("entries") + F.size("inline_images")).alias("n_images"),
                   (F.col("conv_id") % 2 == 0).alias("do_sample"), F.lit(0.7).alias("temperature"),
                   F.lit(0.95).alias("top_p"), F.lit(40).alias("top_k"), F.lit(1.1).alias("repetition_penalty"))
    return PR.request_overrides(req)


def devices(spark, sf):
    p = FX.t(spark, sf, "part")
    return p.select(F.col("p_brand").alias("host"), F.col("p_partkey").alias("idx"), F.col("p_name").alias("device"),
                    F.col("p_retailprice").alias("total"), (F.col("p_size") / 2).alias("allocated"),
                    F.col("p_size").cast("double").alias("reserved"), "p_size")


@register("a4_device_rollup")
def q_rollup(spark, sf):
    out = PR.device_rollup(devices(spark, sf))
    return out.select("host", *[F.round(c, 4).alias(c) for c in ("total_gb", "allocated_gb", "reserved_gb", "free_gb")],
                      "num_gpus", "device")


def host_limits(spark, sf):
    d = devices(spark, sf)
    roll = PR.device_rollup(d)
    size = d.groupBy("host").agg(F.avg("p_size").alias("params_b"))
    n = F.regexp_extract("host", r"#(\d+)", 1).cast("int")
    model_max = F.when(n % 2 == 0, F.lit(None).cast("long")).otherwise((F.lit(4096) * (n % 8 + 1)).cast("long"))
    j = roll.join(size, "host")
    return j.select("host", PR.context_limit("free_gb", "params_b", model_max).alias("max_context"))


@register("p17_context_limit")
def q_context_limit(spark, sf):
    return host_limits(spark, sf)


@register("p11_filter_context")
def q_filter_context(spark, sf):
    docs = FX.t(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("Brand#"), (F.col("doc_id") % 25 + 1).cast("string")).alias("host"),
        F.size(F.regexp_extract_all(PR.render_instruct(F.lit(""), F.col("text")), F.lit(B.TOKEN_RE), 0))
        .alias("tokens_in"))
    return PR.filter_context(docs, host_limits(spark, sf)).select("doc_id", "host", "tokens_in", "max_context",
                                                                   "accepted", "error")


# ------------------------------------------------------------------ catalogue, config, jobs


def catalog(spark, sf):
    return CA.catalog_sizes(FX.f_files(spark, sf))


@register("a3_catalog_sizes")
def q_catalog_sizes(spark, sf):
    return catalog(spark, sf).select("source", "name", "path", F.round("size_mb", 6).alias("size_mb"))


@register("s1_union_roots")
def q_union_roots(spark, sf):
    files = FX.f_files(spark, sf)
    listings = {src: files.filter(F.col("source") == src).drop("source") for src in ("models", "var")}
    u = CA.union_roots(listings)
    return u.groupBy("source", "name").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes"))


@register("o5_auto_select")
def q_auto_select(spark, sf):
    return CA.auto_select(catalog(spark, sf))


@register("a5_fleet_counts")
def q_fleet(spark, sf):
    return CA.fleet_counts(FX.f_conns(spark, sf), catalog(spark, sf))


@register("a6_count_parameters")
def q_params(spark, sf):
    shapes = FX.t(spark, sf, "part").select(F.array(F.col("p_size"), F.lit(64)).alias("shape"))
    return CA.count_parameters(shapes)


@register("j5_match_model")
def q_match(spark, sf):
    d = FX.t(spark, sf, "documents")
    m = F.col("doc_id") % 3
    root = F.when(F.col("doc_id") % 20 % 2 == 0, F.lit("models")).otherwise(F.lit("var"))
    ref = (F.when(m == 0, F.concat_ws("/", root, F.col("source")))
           .when(m == 1, F.concat(F.lit("elsewhere/"), F.col("source"), F.lit("/")))
           .otherwise(F.concat(F.lit("x/nomodel"), F.col("doc_id").cast("string"))))
    refs = d.select("doc_id", ref.alias("ref"))
    return CA.match_model(refs, catalog(spark, sf))


@register("p13_sanitize_names")
def q_sanitize(spark, sf):
    n = FX.f_names(spark, sf)
    return n.select("id", NM.sanitize_name("raw", "snapshot", 0).alias("py_name"),
                    NM.sanitize_request_id("raw").alias("rid_name"),
                    NM.sanitize_dir_name_js("raw").alias("js_name"))


@register("j6_unique_names")
def q_unique(spark, sf):
    n = FX.f_names(spark, sf).withColumn("name", NM.sanitize_name("raw", "snapshot", 0))
    existing = n.filter(F.col("p_retailprice") > 1900).select("name")
    req = n.select(F.col("id").alias("req_id"), "name")
    return CA.unique_names(req, existing, "name", "req_id")


@register("j6_unique_names_js")
def q_unique_js(spark, sf):
    n = FX.f_names(spark, sf).withColumn("name", NM.sanitize_dir_name_js("raw"))
    existing = n.filter(F.col("p_retailprice") > 1900).select(F.upper("name").alias("name"))
    req = n.select(F.col("id").alias("req_id"), "name")
    return CA.unique_names(req, existing, "name", "req_id", case_insensitive=True)


@register("p14_repo_model_name")
def q_repo_name(spark, sf):
    return FX.f_urls(spark, sf).select("id", NM.repo_model_name("url").alias("model_name"))


@register("p15_normalize_hosts")
def q_hosts(spark, sf):
    h = FX.f_hosts(spark, sf).select("event_id", NM.normalize_host("host").alias("uri"))
    return h.select("event_id", "uri", NM.display_host(F.col("uri")).alias("display"))


@register("o4_recent_distinct")
def q_recent(spark, sf):
    h = FX.f_hosts(spark, sf).select("user_id", "ts", NM.normalize_host("host").alias("uri"))
    uses = h.select("user_id", "ts", F.regexp_replace("uri", "^ws://", "").alias("host"))
    return CA.recent_distinct(uses, 12).select("user_id", "host", "pos")


@register("j3_merge_config")
def q_merge(spark, sf):
    c = FX.f_config(spark, sf)
    upd = c.select("session_id", "key", "value", F.lit(1).alias("layer"), "seq")
    return CF.merge_config(upd)


@register("j3_request_config")
def q_request_config(spark, sf):
    c = FX.f_config(spark, sf)
    req, seq = F.col("event_type") == "click", F.col("seq")
    kind = F.when(req, F.lit("request")).otherwise(F.lit("update")).alias("kind")
    ev = c.select("session_id", "seq", kind, "key", "value")
    # keys that no default has: set by some updates, or for one request
    notes = c.filter(~req & (seq % 10 == 3)).select("session_id", "seq", kind, F.concat(F.lit("note_"), (seq % 3).cast("string")).alias("key"),
                                                    F.concat(F.lit("n"), "value").alias("value"))
    stops = c.filter(req & (seq % 4 == 0)).select("session_id", "seq", kind, F.lit("stop").alias("key"),
                                                  F.concat(F.lit("s"), "value").alias("value"))
    conf = CF.request_config(ev.unionByName(notes).unionByName(stops))
    known = list(CF.GENERATION_DEFAULTS)
    extra = F.array_sort(F.map_entries(F.map_filter("config", lambda k, v: ~k.isin(known))))
    return conf.select("session_id", "seq", *[F.col("config")[k].alias(k) for k in known],
                       F.array_join(F.transform(extra, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("extras"))


@register("j4_fill_defaults")
def q_fill(spark, sf):
    return CF.fill_defaults(FX.f_config_file(spark, sf))


@register("a9_config_pivot")
def q_pivot(spark, sf):
    keys = list(FX.CONFIG_KEYS.values())
    c, seq = FX.f_config(spark, sf), F.col("seq")
    rest = ["session_id", "seq", "event_type"]
    flags = c.filter(seq % 4 == 1).select(*rest, F.lit("do_sample").alias("key"), F.when(seq % 8 == 1, F.lit("True")).otherwise(F.lit("FALSE")).alias("value"))
    notes = c.filter(seq % 4 == 2).select(*rest, F.lit("note").alias("key"), F.concat(F.lit("v"), seq.cast("string")).alias("value"))
    x = CF.config_pivot(c.unionByName(flags).unionByName(notes), [*keys, "do_sample", "note"])
    return x.select("session_id", *[F.col(f"{k}.num").alias(k) for k in keys], F.col("temperature.kind").alias("temperature_kind"),
                    F.col("top_k.kind").alias("top_k_kind"), F.col("do_sample.kind").alias("do_sample_kind"),
                    F.col("do_sample.bool").alias("do_sample"), F.col("note.kind").alias("note_kind"), F.col("note.text").alias("note"))


def _job_columns(status):
    return status.select("request_id", "running", F.col("started_at").cast("string").alias("started_at"), "steps_done",
                         "max_steps", "last_loss", "checkpoint", "error")


def train_events(spark, sf):
    return FX.f_train(spark, sf).withColumn(
        "message", F.when(F.col("type") == "error", F.concat(F.lit("Training failed: step "), F.col("step"))))


@register("a7_job_status")
def q_job_status(spark, sf):
    return _job_columns(JB.job_status(train_events(spark, sf)))


def locks(spark, sf):
    e = FX.t(spark, sf, "events")
    jobs = e.filter((F.col("event_type") == "purchase") & (F.col("value") > 300)).select(
        F.col("ts").alias("start"),
        (F.col("ts") + F.make_dt_interval(mins=F.floor("value").cast("int"))).alias("end"))
    reqs = e.filter(F.col("event_type").isin("click", "signup")).select(
        F.col("event_id").alias("req_id"), "ts",
        F.when(F.col("event_type") == "click", F.lit("inference")).otherwise(F.lit("train")).alias("kind"))
    return reqs, jobs


@register("j7_blocked_requests")
def q_blocked(spark, sf):
    reqs, jobs = locks(spark, sf)
    return JB.blocked_requests(reqs, jobs).select("req_id", "kind", "blocked", "outcome")


# ------------------------------------------------------------------ sources


def _corpus_stats(lines):
    return lines.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(F.length(F.regexp_replace("value", C.PY_WS_RE, "")) == 0).alias("n_blank"),
        F.sum(F.length("value")).cast("long").alias("n_chars"))


@register("src1_scan_corpus")
def q_scan_corpus(spark, sf):
    path = scratch_path(spark, "corpus")
    SCO.land_corpus(FX.f_jsonl(spark, sf), path)
    return _corpus_stats(SCO.scan_corpus(spark, path))


@register("src2_land_corpus")
def q_land_corpus(spark, sf):
    path = scratch_path(spark, "corpus")
    lines = FX.f_jsonl(spark, sf).withColumn("submitted", F.lit(0))
    # the nation names re-submitted later under a raw id that sanitises to 'docs'
    again = lines.filter(F.col("request_id") == "plain").withColumn("request_id", F.lit("docs/")) \
        .withColumn("submitted", F.lit(1))
    SCO.land_corpus(lines.unionByName(again), path, order_col="submitted")
    return _corpus_stats(SCO.scan_corpus(spark, path))


def frames_json(spark, sf):
    f = FX.f_frames(spark, sf)
    corrupt = (f["session_id"] % 9 == 4) & (f["seq"] % 1048576 == 5) & (f["type"] == "token")
    js = F.to_json(F.struct("type", "data", "tokens_in", "total_tokens", "message"))
    # frames that Python's reader takes and a strict one does not: the last type counts, a NaN is a number
    odd = F.substr(js, F.lit(2))
    js = (F.when(f["session_id"] % 9 == 5, F.concat(F.lit('{"type":"ack",'), odd))
          .when(f["session_id"] % 9 == 6, F.concat(F.lit('{"score":NaN,'), odd)).otherwise(js))
    return f.select("session_id", "seq", F.when(corrupt, F.concat(F.lit("{"), js)).otherwise(js).alias("frame"))


@register("src4_scan_log")
def q_scan_log(spark, sf):
    path = scratch_path(spark, "log")
    SLG.append_log(frames_json(spark, sf), path, LOG_KEY)
    kept, _dead = SLG.scan_log(spark, path, LOG_KEY)
    return kept.select("session_id", "seq", "type")


@register("src3_append_log")
def q_append_log(spark, sf):
    path = scratch_path(spark, "log")
    fj = frames_json(spark, sf)
    SLG.append_log(fj, path, LOG_KEY)
    SLG.append_log(fj.filter(F.col("session_id") % 2 == 0), path, LOG_KEY)  # a retried append: same ids again
    raw = spark.read.schema(SLG.LOG_SCHEMA).json(path)
    return raw.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_lines"),
                                         F.count_distinct("id").alias("n_ids"))


@register("src5_scan_artifacts")
def q_scan_artifacts(spark, sf):
    return scan_artifacts(spark, sf, glob="*.parquet").select("rel", "length")


@register("src6_scan_config")
def q_scan_config(spark, sf):
    path = scratch_path(spark, "config")
    conf = FX.f_config_file(spark, sf)
    SCF.write_config_files(conf, path)
    out = SCF.scan_config(spark, path)
    return out.select(F.regexp_extract("file", r"file_id=(\d+)", 1).cast("long").alias("file_id"),
                      "section", "key", "value")


# ------------------------------------------------------------------ streaming


def staged_stream(spark, df, name):
    """A table that Spark derives from the given ones, written once and read as
    a file stream."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return SK.table_stream(spark, path)


def _landed(spark, sdf, name, mode="append", split=None):
    """Runs a stream to its end; the folder of its sink."""
    work = scratch_path(spark, name)
    SK.run_available(sdf, f"{work}/sink", f"{work}/checkpoint", mode, split)
    return f"{work}/sink"


@register("x1_stream_frames")
def q_stream_frames(spark, sf):
    routed = ST.stream_frames(FX.f_msgs(spark, sf, FX.events_stream(spark, sf)))
    routed = routed.select("session_id", "seq", "route", "msg_type", "error")
    sink = _landed(spark, routed, "x1", split=ST.frame_outputs())
    return SK.read_sink(spark, sink, "dispatch").unionByName(SK.read_sink(spark, sink, "dead_letter")).drop("batch")


def _session_stream(spark, sf):
    out = ST.stream_sessions(FX.f_conns(spark, sf, FX.events_stream(spark, sf)))
    return _landed(spark, out, "x2", "update", ST.session_outputs())


@register("x2_stream_sessions")
def q_stream_sessions(spark, sf):
    return SK.read_upserts(spark, _session_stream(spark, sf), ["session_id"], "sessions").select(*ST.SESSION_COLUMNS)


@register("x2_stream_session_errors")
def q_stream_session_errors(spark, sf):
    return SK.read_sink(spark, _session_stream(spark, sf), "errors").select("session_id", "seq", "message")


@register("x2_sessions_batch")
def q_sessions_batch(spark, sf):
    return ST.sessions_batch(FX.f_conns(spark, sf))


@register("x4_stream_dedupe")
def q_stream_dedupe(spark, sf):
    p = FX.f_proto(spark, sf)
    log = p.filter(F.col("type").isin(*FR.BUFFERED_TYPES))
    again = FR.replay(p)
    lines = log.select("id", "session_id", "seq", "type", "ts").unionByName(
        again.select("id", "session_id", "seq", "type", "ts"))
    sink = _landed(spark, ST.stream_dedupe(staged_stream(spark, lines, "x4")), "x4", split=ST.late_outputs())
    return SK.read_sink(spark, sink).select("id", "session_id", "seq", "type")


@register("x5_stream_job_status")
def q_stream_job_status(spark, sf):
    sink = _landed(spark, ST.stream_job_status(staged_stream(spark, train_events(spark, sf), "x5")), "x5", "update")
    return _job_columns(SK.read_upserts(spark, sink, ["request_id"]))


@register("x6_stream_transcripts")
def q_stream_transcripts(spark, sf):
    # event time: one second per seq step, so an abandoned generation times out
    f = FX.f_frames(spark, sf).select("session_id", "seq", "type", "data", F.timestamp_seconds("seq").alias("ts"))
    out = ST.stream_transcripts(staged_stream(spark, f, "x6"), ts_col="ts")
    sink = _landed(spark, out, "x6", split=ST.late_outputs())
    return SK.read_sink(spark, sink).select("session_id", "gen", "text", "outcome")


@register("src3_stream_append_log")
def q_stream_append_log(spark, sf):
    path = scratch_path(spark, "log")
    frames = staged_stream(spark, frames_json(spark, sf), "src3")
    ST.stream_append_log(frames, path, LOG_KEY, scratch_path(spark, "src3")).awaitTermination()
    kept, _dead = SLG.scan_log(spark, path, LOG_KEY)
    return kept.select("session_id", "seq", "type")


@register("train_batches")
def q_train_batches(spark, sf):
    """The whole training-data path for every corpus: tokens, shuffled
    epochs cut at max_steps, padded batches and step flags."""
    from convspark.operators.training import training_batches

    s = samples(spark, sf)
    cfg = B.clamp_train_config(s.groupBy("request_id").agg(_epochs_and_a_half(8).alias("max_steps")).select(
        "request_id", "max_steps", F.lit(8).alias("batch_size"), F.lit(48).alias("max_seq_length"),
        F.lit(4).alias("gradient_accumulation"), F.lit(5).alias("log_every"), F.lit(10).alias("save_every")))
    out = training_batches(s, cfg, seed=42)
    return out.select("request_id", "epoch", "step", "sample_id", csv("input_ids").alias("input_ids"),
                      csv("attention_mask").alias("attention_mask"), csv("labels").alias("labels"),
                      "update", "log", "checkpoint")
