"""Model catalogue as tables: directory sizes (A3), roots (S1), selection
(O5), counts (A5, A6), reference matching (J5), free names (J6), recent
servers (O4) and the name/URL/host normalisers applied to whole columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convspark.functions.names import repo_model_name  # noqa: F401  (re-exported)

BYTES_PER_MB = 1024 * 1024
MODEL_MARKER = "config.json"  # fixed value: a directory is a model when it holds this file at its top


def union_roots(listings: dict) -> DataFrame:
    """Concatenate per-root listings, each tagged with its source name
    (UNION ALL, no de-duplication)."""
    out = None
    for source, df in listings.items():
        d = df.withColumn("source", F.lit(source))
        out = d if out is None else out.unionByName(d)
    return out


def catalog_sizes(files: DataFrame) -> DataFrame:
    """A3: one row per model directory: ``size_mb`` = sum of all file sizes
    below it / 2^20; only directories with a top-level config file count.

    ``files``: ``(source, name, rel, size)`` with ``rel`` relative to the
    directory.  One grouped aggregate (partial on the map side)."""
    return (files.groupBy("source", "name")
            .agg((F.sum("size") / F.lit(float(BYTES_PER_MB))).alias("size_mb"),
                 F.bool_or(F.col("rel") == MODEL_MARKER).alias("_is_model"))
            .filter("_is_model").drop("_is_model")
            .withColumn("path", F.concat_ws("/", "source", "name")))


def listing_to_files(listing: DataFrame) -> DataFrame:
    """SRC5 -> A3 input: a ``scan_artifacts`` listing ``(root, path, rel,
    length)`` as ``(source, name, rel, size)``: the first folder under the
    root is the model directory, the rest of the path is relative to it.
    Files directly under a root belong to no directory and are dropped."""
    parts = F.split(F.col("rel"), "/", 2)
    return (listing.filter(F.size(parts) == 2)
            .select(F.col("root").alias("source"), parts[0].alias("name"), parts[1].alias("rel"),
                    F.col("length").alias("size")))


def auto_select(catalog: DataFrame) -> DataFrame:
    """The model to load at start-up: the only entry; else the first in
    ``models``; else the first; none => null.  Directory order is not
    defined, so "first" is by name.  A single global ``min_by``."""
    return catalog.agg(F.min_by("path", F.struct((F.col("source") != "models").alias("o"), F.col("name"))).alias("path"),
                       F.count(F.lit(1)).alias("n_models"))


def fleet_counts(sessions: DataFrame, catalog: DataFrame) -> DataFrame:
    """A5: live sessions and models, overall and per catalogue source.
    ``sessions``: frames ``(session_id, type, ..)``; an ``ack`` has ended its
    session.  Two aggregates, the sessions' as a scalar subquery (no join)."""
    ended = sessions.groupBy("session_id").agg(F.bool_or(F.col("type") == "ack").alias("_ended"))
    n_sessions = ended.agg(F.count_if(~F.col("_ended"))).scalar()
    return catalog.agg(
        F.count(F.lit(1)).alias("n_models"),
        F.count_if(F.col("source") == "models").alias("n_models_dir"),
        F.count_if(F.col("source") == "var").alias("n_var_dir"),
    ).withColumn("n_sessions", n_sessions)


def count_parameters(shapes: DataFrame, shape_col: str = "shape") -> DataFrame:
    """Sum over tensors of the product of their dimensions, and the same
    in billions."""
    numel = F.aggregate(F.col(shape_col), F.lit(1).cast("long"), lambda acc, x: acc * x.cast("long"))
    return shapes.agg(F.sum(numel).alias("n_params")).withColumn("params_b", F.col("n_params") / F.lit(1e9))


def match_model(refs: DataFrame, catalog: DataFrame, ref_col: str = "ref") -> DataFrame:
    """Catalogue entry a reference points at: exact path match, else the
    first entry whose name equals the reference's last path segment, else
    none.  Both lookups are equi-joins against one row per key."""
    order = F.struct((F.col("source") != "models").alias("o"), F.col("name"), F.col("path"))
    by_path = catalog.groupBy("path").agg(F.min_by("path", order).alias("_exact"))
    by_name = catalog.groupBy("name").agg(F.min_by("path", order).alias("_byname"))
    # the page's short name: last non-empty '/' segment, no URL parsing
    segs = F.filter(F.split(F.col(ref_col).cast("string"), "/"), lambda x: x != "")
    r = refs.withColumn("_base", F.coalesce(F.try_element_at(segs, F.lit(-1)), F.col(ref_col)))
    j = (r.join(by_path, r[ref_col] == by_path["path"], "left").drop("path")
         .join(by_name, F.col("_base") == by_name["name"], "left").drop("name"))
    return j.select(*refs.columns, F.coalesce("_exact", "_byname").alias("match"),
                    F.when(F.col("_exact").isNotNull(), F.lit("path"))
                    .when(F.col("_byname").isNotNull(), F.lit("name")).alias("match_kind"))


CHILD_NAME = r"(?s)^(.*)_([1-9][0-9]{0,17})\z"     # a name that the base in group 1 may come to


def unique_names(requests: DataFrame, existing: DataFrame, name_col: str = "name", order_col: str = "req_id",
                 case_insensitive: bool = False) -> DataFrame:
    """Give each request a free directory name, in request order (unique):
    its base name if free, else the smallest ``base_k`` (k >= 1) that is neither
    an existing directory nor given to an earlier request.

    Set form: a base's slots are ``[base] + [base_k]`` without the existing
    names and those that another base gets first; its i-th request takes the
    i-th slot.  Slots are generated per base (``sequence``, bounded by that
    base's request and collision counts) and ranked with skew-safe blocked
    running counts; no pair of requests is ever compared.  Which base gets a
    name that two of them can come to is settled first, see ``_contests``."""
    from convspark.operators.scoring import number_positions

    norm = (lambda c: F.lower(c)) if case_insensitive else (lambda c: c)
    req = requests.withColumn("_base", F.col(name_col)).withColumn("_bkey", norm(F.col(name_col)))
    ex = existing.select(norm(F.col(name_col)).alias("_ename")).distinct()
    # existing names that belong to a requested base: b itself or b_<k>
    child = F.regexp_extract("_ename", CHILD_NAME, 2)
    ex_b = ex.select("_ename", F.col("_ename").alias("_bkey"), F.lit(0).cast("long").alias("_k")).unionByName(
        ex.filter(child != "").select("_ename", F.regexp_extract("_ename", CHILD_NAME, 1).alias("_bkey"), child.cast("long").alias("_k")))
    per_base = req.groupBy("_bkey").agg(F.count(F.lit(1)).alias("_m"), F.min(order_col).alias("_t1"))
    ex_b = ex_b.join(per_base.select("_bkey"), "_bkey", "left_semi")
    lost = _contests(req, per_base, ex, ex_b, order_col)
    more = ex_b.select("_bkey").unionByName(lost.select("_bkey")).groupBy("_bkey").agg(F.count(F.lit(1)).alias("_e"))
    # candidate slots 0..m+e per base, generated in chunks of 2^16 that are
    # spread over tasks first, so a base with a huge request count is not
    # expanded by a single task
    span = per_base.join(more, "_bkey", "left").select("_bkey", (F.col("_m") + F.coalesce("_e", F.lit(0))).alias("_hi"))
    chunks = span.select("_bkey", "_hi", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright("_hi", 16))).alias("_c"))
    chunks = chunks.repartition("_bkey", "_c")
    slots = chunks.select("_bkey", F.explode(F.sequence(F.shiftleft("_c", 16),
                                                        F.least(F.shiftleft(F.col("_c") + 1, 16) - 1, "_hi"))).alias("_k"))
    free = slots.join(ex_b.select("_bkey", "_k").unionByName(lost), ["_bkey", "_k"], "left_anti")
    free = number_positions(free, "_bkey", "_k", "_slot")
    ranked = number_positions(req, "_bkey", order_col, "_slot")
    j = ranked.join(free.select("_bkey", "_slot", "_k"), ["_bkey", "_slot"])
    return j.select(*requests.columns, F.when(F.col("_k") == 0, F.col("_base"))
                    .otherwise(F.concat(F.col("_base"), F.lit("_"), F.col("_k").cast("string"))).alias("assigned"))


def _contests(req: DataFrame, per_base: DataFrame, ex: DataFrame, ex_b: DataFrame, order_col: str) -> DataFrame:
    """``_bkey, _k``: the slots that a base loses to another one.

    A name is contested by two bases at most: the base of that name (slot 0),
    whose first request, at time t, takes it if it is still free, and the base
    before its ``_k``.  The latter comes to its slot k, the j-th of its slots
    that do not exist, with its request number j - s, if it has lost s slots
    before; it loses slot k too exactly if that request is later than t, that
    is if j - s is above n, its requests before t.  So s follows from j and n
    by running counts, round by round until no slot changes hands; names are
    settled from the shorter to the longer chains ``a``, ``a_1``, ``a_1_2``,
    as a base that lost its slot 0 has one slot less.  Only contested names
    take part, and every round is written to the shared folder."""
    from convspark.operators.prefix import running
    from convspark.session import materialize

    names = per_base.join(ex, F.col("_bkey") == F.col("_ename"), "left_anti").filter(F.regexp_extract("_bkey", CHILD_NAME, 2) != "")
    names = names.select(F.col("_bkey").alias("_child"), F.col("_t1").alias("_t"), F.regexp_extract("_bkey", CHILD_NAME, 1).alias("_bkey"),
                         F.regexp_extract("_bkey", CHILD_NAME, 2).cast("long").alias("_k"))
    names = materialize(names.join(per_base.select("_bkey"), "_bkey", "left_semi"), "j6-names")
    lost = names.select("_bkey", "_k").limit(0)
    if names.isEmpty():
        return lost
    # n: requests of the parent before t; j: its slots up to k that do not exist
    mine = req.join(names.select("_bkey"), "_bkey", "left_semi").select(
        "_bkey", F.col(order_col).alias("_at"), F.lit(1).alias("_one"), F.lit(None).cast("string").alias("_child"))
    marks = names.select("_bkey", F.col("_t").alias("_at"), F.lit(0).alias("_one"), "_child")
    before = running(mine.unionByName(marks), ["_bkey"], "_at", sums={"_n": (F.col("_one"), False)}, block_bits=12).filter("_one = 0").select("_child", "_n")
    there = ex_b.join(names.select("_bkey"), "_bkey", "left_semi").select("_bkey", "_k", F.lit(1).alias("_one"), F.lit(None).cast("string").alias("_child"))
    marks = names.select("_bkey", "_k", F.lit(0).alias("_one"), "_child")
    below = running(there.unionByName(marks), ["_bkey"], "_k", sums={"_e": (F.col("_one"), False)}, block_bits=12).filter("_one = 0").select("_child", "_e")
    names = materialize(names.join(before, "_child").join(below, "_child").select(
        "_bkey", "_k", "_child", "_n", (F.col("_k") + 1 - F.col("_e")).alias("_j")), "j6-names")

    done = names.select(F.col("_child").alias("_name")).limit(0)          # bases whose slot 0 went to their parent
    open_ = names
    while not open_.isEmpty():
        # parents that no longer wait for a contest about their own name
        waits = open_.select(F.col("_child").alias("_w"))
        now = open_.join(waits, F.col("_bkey") == F.col("_w"), "left_anti")
        now = now.join(done.withColumnRenamed("_name", "_d"), F.col("_bkey") == F.col("_d"), "left")
        now = now.withColumn("_j", F.col("_j") - F.col("_d").isNotNull().cast("long")).drop("_d").withColumn("_lost", F.lit(0))
        while True:
            was = running(now, ["_bkey"], "_k", sums={"_s": (F.col("_lost"), False)}, block_bits=12)
            now = materialize(was.withColumn("_next", (F.col("_j") - F.col("_s") > F.col("_n")).cast("int")), "j6-round")
            settled = now.filter("_next <> _lost").isEmpty()
            now = now.withColumn("_lost", F.col("_next")).drop("_next", "_s")
            if settled:
                break
        lost = materialize(lost.unionByName(now.filter("_lost = 1").select("_bkey", "_k")).unionByName(
            now.filter("_lost = 0").select(F.col("_child").alias("_bkey"), F.lit(0).cast("long").alias("_k"))), "j6-lost")
        done = materialize(done.unionByName(now.filter("_lost = 0").select(F.col("_child").alias("_name"))), "j6-done")
        open_ = materialize(open_.join(now.select("_child"), "_child", "left_anti"), "j6-open")
    return lost


def recent_distinct(uses: DataFrame, n: int = 12, key: str = "user_id", value: str = "host",
                    ts: str = "ts") -> DataFrame:
    """Most recent first, duplicates collapse to their latest use, keep
    ``n``.  A grouped max, then a rank limit that Spark plans as a
    ``WindowGroupLimit`` (partial top-n before the shuffle)."""
    last = uses.filter(F.col(value).isNotNull() & (F.col(value) != "")) \
        .groupBy(key, value).agg(F.max(ts).alias("last_used"))
    w = Window.partitionBy(key).orderBy(F.col("last_used").desc(), F.col(value))
    return last.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= n)
