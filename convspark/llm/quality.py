"""Operator 6, quality classifier as a sparse rule ensemble.

Statistics of each text are Spark columns.  A shallow random forest is grown
on the labelled statistics; every path of its trees becomes a conjunctive
rule (``upper_share > 0.2 AND distinct_words <= 0.6``).  A lasso logistic
regression over the rules' 0/1 values keeps few of them, and the kept rules
are compiled back into one Spark column expression, so scoring is an ordinary
projection over all texts.

Training uses at most ``MAX_LABELLED`` labelled rows outside the held-out
quarter (a documented bound: the rows of the smallest id hashes); scoring uses
whole texts of all rows.  Labels, ids, language and source are no inputs.

Defined cases
    * null text counts as empty and has a score like any other text;
    * labels with a null id or value are not used; an id labelled twice counts
      with its smallest value; labels without a document are ignored;
    * with labels of one class only (or none) every score is that class's
      smoothed share (0.5 without labels);
    * repeated rows are scored one by one; further columns are not read; an
      empty table gives an empty result.
"""

from __future__ import annotations

import math
import string

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convspark.llm.common import materialize, safe_text

THRESHOLD = 0.7
MAX_LABELLED = 200_000
TREES, DEPTH, LASSO, SEED = 24, 3, 0.002, 7

_UPPER = string.ascii_uppercase
_DIGITS = string.digits
_MARKS = "!#$%&*@^~|<>{}[]=+\\_/"
_STOPS = ".,;:?"


def _without(t: Column, chars: str) -> Column:
    """Length of the text without these characters."""
    return F.length(F.translate(t, chars, ""))


def statistics(df: DataFrame, text_col: str = "text", prefix: str = "s_") -> tuple[DataFrame, list[str]]:
    """``df`` with the text statistics as further double columns."""
    t = safe_text(text_col)
    words, lines = F.split(t, "[ \\n\\t]+"), F.split(t, "\\n")
    base = df.withColumns({f"{prefix}chars": F.length(t).cast("double"), f"{prefix}words": words, f"{prefix}lines": lines})
    n = F.greatest(F.col(f"{prefix}chars"), F.lit(1.0))
    w, ln = F.col(f"{prefix}words"), F.col(f"{prefix}lines")
    n_words, n_lines = F.size(w).cast("double"), F.size(ln).cast("double")
    stats = {
        "log_chars": F.log1p(F.col(f"{prefix}chars")),
        "word_chars": n / n_words,
        "line_words": n_words / n_lines,
        "distinct_words": F.size(F.array_distinct(w)) / n_words,
        "distinct_lines": F.size(F.array_distinct(ln)) / n_lines,
        "longest_word": F.array_max(F.transform(w, F.length)).cast("double"),
        "upper_share": (F.col(f"{prefix}chars") - _without(t, _UPPER)) / n,
        "digit_share": (F.col(f"{prefix}chars") - _without(t, _DIGITS)) / n,
        "mark_share": (F.col(f"{prefix}chars") - _without(t, _MARKS)) / n,
        "stop_share": (F.col(f"{prefix}chars") - _without(t, _STOPS)) / n,
    }
    names = [prefix + k for k in stats]
    out = base.withColumns({prefix + k: v for k, v in stats.items()})
    return out.drop(f"{prefix}chars", f"{prefix}words", f"{prefix}lines"), names


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


class RuleModel:
    """Intercept and weighted conjunctive rules over named statistics."""

    def __init__(self, intercept: float, rules: list[tuple[tuple[tuple[str, str, float], ...], float]]):
        self.intercept, self.rules = intercept, rules

    def score(self) -> Column:
        """The probability of label 1 as a column expression."""
        z = F.lit(float(self.intercept))
        for conditions, weight in self.rules:
            z = z + F.when(rule_column(conditions), float(weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-z))

    def __str__(self) -> str:
        lines = [f"{w:+.3f}  " + " AND ".join(f"{f} {op} {v:.6g}" for f, op, v in c) for c, w in self.rules]
        return "\n".join([f"intercept {self.intercept:+.3f}", *lines])


def rule_column(conditions) -> Column:
    out = F.lit(True)
    for feature, op, value in conditions:
        out = out & (F.col(feature) <= value if op == "<=" else F.col(feature) > value)
    return out


def tree_rules(forest, names: list[str]) -> list[tuple[tuple[str, str, float], ...]]:
    """Every path from a root to a node below it, as a conjunction."""
    found: dict = {}

    def walk(node, path):
        if path:
            tight: dict = {}
            for f, op, v in path:
                old = tight.get((f, op), v)
                tight[(f, op)] = min(old, v) if op == "<=" else max(old, v)
            found.setdefault(tuple(sorted((f, op, v) for (f, op), v in tight.items())))
        if node.subtreeDepth() > 0:
            split = node.split()
            f, v = names[split.featureIndex()], split.threshold()
            walk(node.leftChild(), [*path, (f, "<=", v)])
            walk(node.rightChild(), [*path, (f, ">", v)])

    for tree in forest.trees:
        walk(tree._call_java("rootNode"), [])
    return list(found)


def fit_rules(train: DataFrame, names: list[str], label: str = "label") -> RuleModel:
    """Forest -> rules -> lasso weights, all in Spark ML."""
    n = {r[0]: r[1] for r in train.groupBy(label).count().collect()}
    ones, total = n.get(1.0, 0), sum(n.values())
    if min(ones, total - ones) == 0:
        p = (ones + 1) / (total + 2)
        return RuleModel(math.log(p / (1 - p)), [])
    vec = VectorAssembler(inputCols=names, outputCol="features").transform(train).select("features", label)
    forest = RandomForestClassifier(labelCol=label, numTrees=TREES, maxDepth=DEPTH, seed=SEED, bootstrap=False,
                                    featureSubsetStrategy="onethird").fit(vec)
    rules = tree_rules(forest, names)
    fired = train.select(label, *[F.when(rule_column(c), 1.0).otherwise(0.0).alias(f"r{i}") for i, c in enumerate(rules)])
    fired = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(fired)
    lasso = LogisticRegression(labelCol=label, elasticNetParam=1.0, regParam=LASSO, maxIter=60).fit(fired.select("features", label))
    kept = [(c, float(w)) for c, w in zip(rules, lasso.coefficients) if w]
    return RuleModel(float(lasso.intercept), kept)


def training_rows(stats: DataFrame, labels: DataFrame, names: list[str], id_col: str, label_col: str,
                  max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Statistics and label of the rows to learn from, a bounded number."""
    known = labels.select(F.col(id_col).alias("_lid"), F.col(label_col).cast("double").alias("label")).dropna()
    known = known.groupBy("_lid").agg(F.min("label").alias("label")).filter(~held_out("_lid"))
    total = known.count()
    if total > max_labelled:
        cut = int(2 ** 32 * max_labelled / total)
        known = known.filter(F.pmod(F.xxhash64("_lid"), F.lit(2 ** 32)) < cut)
    return stats.join(known, F.col(id_col) == F.col("_lid")).select("label", *names)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "quality") -> tuple[RuleModel, DataFrame, list[str]]:
    """The model, and the (narrow, materialised) statistics of all rows."""
    stats, names = statistics(docs.select(id_col, text_col), text_col)
    stats = materialize(stats.drop(text_col), "op6_stats")
    train = materialize(training_rows(stats, labels, names, id_col, label_col).coalesce(4), "op6_train")
    return fit_rules(train, names), stats, names


def drop_low_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score reaches the threshold."""
    model, _, _ = fit_quality(docs, labels, id_col, text_col)
    prefix = "s_" + "_" * max(map(len, docs.columns))   # longer than, so clear of, any column
    scored, _ = statistics(docs, text_col, prefix)
    renamed = RuleModel(model.intercept, [(tuple((prefix + f[2:], op, v) for f, op, v in c), w) for c, w in model.rules])
    return scored.filter(renamed.score() >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_quality(spark, sf_dir: str) -> DataFrame:
    from convspark.sources.tables import read_table

    model, stats, _ = fit_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    score = model.score()
    return stats.select("doc_id", held_out("doc_id").alias("held_out"), score.alias("score"),
                        F.when(score >= THRESHOLD, 1).otherwise(0).alias("predicted"))
