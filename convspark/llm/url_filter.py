"""Operator 7, URL filters: host/path rules, and gradient-boosted trees for
the URLs that no rule decides.

Rules name a host and a path prefix (``example.org/es/``); one fits its host
and all subdomains if the URL's path starts with its path, and the longest
rule wins.  URLs a rule decides are the labelled URLs: boosted trees are
trained on their lexical features (lengths, depth, digit ratio, entropy,
parameter counts, suffix statistics over all URLs) and judge the rest.

Training uses at most ``MAX_LABELLED`` distinct labelled URLs (a documented
bound: those of the smallest hashes); every URL is judged.

Defined cases
    * a null URL, or one without ``://``, has an empty host and path, fits no
      rule and is judged by its features (zeros for null);
    * only A-Z of the host are lower-cased; ports and user parts stay in it;
    * equally long rules: the longer host, then ``block``, wins;
    * with labelled URLs of one verdict only that verdict holds for the rest,
      without any, ``allow``;
    * repeated rows are judged one by one; the label set has distinct URLs;
    * an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convspark.llm.common import materialize

#: The contract's rules: verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
MAX_LABELLED = 100_000
ROUNDS, DEPTH, SEED = 12, 4, 11

FEATURES = ("len", "host_len", "path_len", "host_labels", "depth", "digit_ratio", "host_digit_ratio", "hyphens",
            "params", "has_fragment", "entropy", "suffix_len", "suffix_share", "domain_share")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_columns(rules, host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) columns, null where no rule fits."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in reversed(ranked):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Bits per character of the text's own character counts."""
    chars = F.split(text, "")
    n = F.length(text).cast("double")
    counts = F.transform(F.array_distinct(chars), lambda c: n - F.length(F.replace(text, c, F.lit(""))))
    bits = F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + F.when(c > 0, -(c / n) * F.log2(c / n)).otherwise(0.0))
    return F.when(n > 0, bits).otherwise(0.0)


def _digits(c: Column) -> Column:
    return (F.length(c) - F.length(F.translate(c, string.digits, ""))) / F.greatest(F.length(c), F.lit(1))


def lexical(df: DataFrame) -> DataFrame:
    """``_url, host, path`` rows with their own lexical features."""
    u = F.coalesce(F.col("_url"), F.lit(""))
    host, path = F.col("host"), F.col("path")
    suffix = F.substring_index(host, ".", -1)
    domain = F.substring_index(host, ".", -2)
    d = "double"
    count = lambda c, ch: (F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))).cast(d)
    query = F.when(F.instr(u, "?") > 0, F.substring_index(F.substring_index(u, "#", 1), "?", -1)).otherwise("")
    return df.withColumns({
        "len": F.length(u).cast(d), "host_len": F.length(host).cast(d), "path_len": F.length(path).cast(d),
        "host_labels": count(host, ".") + 1.0, "depth": count(path, "/"), "digit_ratio": _digits(u).cast(d),
        "host_digit_ratio": _digits(host).cast(d), "hyphens": count(u, "-"),
        "params": F.when(query == "", 0.0).otherwise(count(query, "&") + 1.0),
        "has_fragment": (F.instr(u, "#") > 0).cast(d), "entropy": _entropy(u),
        "suffix_len": F.length(suffix).cast(d), "suffix": suffix, "domain": domain})


def judge_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES,
               max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``id, url, host, path, rule, verdict, p_block`` of every row."""
    rows = df.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"))
    host, path = host_and_path(F.col("_url"))
    rows = lexical(rows.withColumns({"host": host, "path": path}))
    rule, verdict = rule_columns(rules, F.col("host"), F.col("path"))
    rows = materialize(rows.withColumns({"rule": rule, "by_rule": verdict}), "op7_rows")
    # suffix statistics: shares over all URLs (one small row per value)
    total = float(max(rows.count(), 1))
    for key in ("suffix", "domain"):
        shares = materialize(rows.groupBy(key).agg((F.count(F.lit(1)) / total).alias(f"{key}_share")), f"op7_{key}")
        rows = rows.join(shares, key)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    rows = rows.select("_id", "_url", "host", "path", "rule", "by_rule", "features")
    known = rows.filter("by_rule is not null").groupBy("_url").agg(
        F.first("features").alias("features"), F.max((F.col("by_rule") == "block").cast("double")).alias("label"))
    known = materialize(known, "op7_known")
    n = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    if len(n) < 2:
        p_block = F.lit(float(1.0 in n))
        judged = rows.withColumn("p_block", p_block)
    else:
        if sum(n.values()) > max_labelled:
            known = known.filter(F.pmod(F.xxhash64("_url"), F.lit(2 ** 32)) < int(2 ** 32 * max_labelled / sum(n.values())))
        train = materialize(known.select("features", "label").coalesce(4), "op7_train")
        model = GBTClassifier(labelCol="label", maxIter=ROUNDS, maxDepth=DEPTH, seed=SEED).fit(train)
        judged = model.transform(rows).withColumn("p_block", vector_to_array("probability")[1])
    by_model = F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")
    return judged.select(F.col("_id").alias("id"), F.col("_url").alias("url"), "host", "path", "rule",
                         F.coalesce("by_rule", by_model).alias("verdict"), "p_block")


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    from convspark.sources.tables import read_table

    out = judge_urls(read_table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")
