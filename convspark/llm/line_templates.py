"""Operator 8, line dedup by a log-template tree (DataFrame functions only).

A line's words are parsed down a tree of fixed depth: first by word count,
then by its leading words; words with a digit are variable fields (``<*>``)
from the start.  In a leaf, the most frequent word of each position (counted
over the lines of all documents) makes a template, and a position where no
word has a majority becomes ``<*>`` as well.  A line belongs to the template
if it agrees in enough of the positions that are not ``<*>``.  The lines that
do not fit are grouped around the next template, and so on until none is left;
lines too mixed for a template are first parted by the words of a position.
A line that no other joins is a template of its own.

Two rules drop a line, wherever it stands:
    * its template recurs in at least ``min_docs`` documents (any length);
    * it has over ``long_words`` words and the same line, white space aside,
      stands in a second document.
The same text under several ids counts as one document in both.

The tree's levels are grouping keys, so the parse is a few aggregations with
map-side combine, and joins of them; no leaf is gathered in one task.

Defined cases
    * null text counts as empty; an empty text has no lines to drop;
    * blank lines are kept and never counted;
    * a line that repeats in one document counts once for it;
    * repeated rows (same id, same text) each get the same result; null ids
      are ids like any other; other columns are not read;
    * ties in a position's most frequent word: the greater word; an empty
      table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convspark.llm.common import materialize, safe_text

LEADING = 3
SIMILARITY = 0.75
MIN_DOCS = 10
#: Lines of more words are passages: they go if two documents hold them.
LONG_WORDS = 50
WILDCARD = "<*>"


def _even(line: Column) -> Column:
    """The line in single spaces."""
    uneven = line.contains("\t") | line.contains("\r") | line.contains("  ")
    return F.trim(F.when(uneven, F.regexp_replace(line, "[ \\t\\r]+", " ")).otherwise(line))


def _masked(line: Column) -> Column:
    """The line in single spaces, words with a digit as a variable field."""
    even = _even(line)
    return F.when(even.rlike("[0-9]"), F.regexp_replace(even, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*", WILDCARD)).otherwise(even)


def _lines(df: DataFrame, id_col: str, text_col: str, leading: int, long_words: int) -> DataFrame:
    """``id, th, no, masked, leaf, h1, h2, p1, p2`` of every line that isn't
    blank; ``p1, p2`` are null unless it is long."""
    rows = df.select(F.col(id_col).alias("id"), safe_text(text_col).alias("t"))
    rows = rows.select("id", F.xxhash64("t").alias("th"), F.posexplode(F.split("t", "\\n")).alias("no", "line"))
    # by the raw line: a filter on the masked one would mask each line a second time
    rows = rows.filter(F.col("line").rlike("[^ \\t\\r]")).select("id", "th", "no", "line", _masked(F.col("line")).alias("masked"))
    words = F.split("masked", " ")
    # a line of n words has 2 n - 1 characters at least
    long = (F.length("line") > 2 * long_words) & (F.size(words) > long_words)
    return rows.withColumn("leaf", F.xxhash64(F.size(words), F.slice(words, 1, leading))).withColumns(
        {"h1": F.xxhash64("masked"), "h2": F.hash("masked"),
         "p1": F.when(long, F.xxhash64(_even(F.col("line")))), "p2": F.when(long, F.hash(_even(F.col("line"))))}).drop("line")


def repeated_passages(narrow: DataFrame) -> DataFrame:
    """``id, th, no`` of the long lines that stand in two documents or more."""
    long = narrow.filter(F.col("p1").isNotNull())
    twice = long.groupBy("p1", "p2").agg(F.min("th").alias("a"), F.max("th").alias("b")).filter("a <> b")
    twice = materialize(twice.select(F.col("p1").alias("q1"), F.col("p2").alias("q2")), "op8_passages")
    return long.join(twice, (F.col("p1") == F.col("q1")) & (F.col("p2") == F.col("q2"))).select("id", "th", "no")


def _centres(held: DataFrame, similarity: float, leading: int, name: str) -> DataFrame:
    """Per group: its template ``centre``, whether that is one (``sound``) and
    the position with the fewest words (but more than one) to part it by."""
    word = held.select("g", "n", F.posexplode(F.split("masked", " ")).alias("pos", "w"))
    votes = word.groupBy("g", "pos", "w").agg(F.sum("n").alias("n"))
    top = votes.groupBy("g", "pos").agg(F.max(F.struct("n", "w")).alias("top"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"))
    major = 2 * F.col("top.n") > F.col("all")
    top = top.select("g", "pos", "all", "kinds", major.alias("major"), F.when(major, F.col("top.w")).otherwise(WILDCARD).alias("w"))
    fixed = F.col("w") != WILDCARD
    # leading words agree in any leaf, so of the others half must be fixed
    later = F.col("pos") >= leading
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    # a group's lines have one length, so this array is as long as one line
    centre = top.groupBy("g").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]).alias("centre"), F.max("all").alias("weight"),
        F.min(F.when(F.col("kinds") > 1, F.struct("kinds", "pos"))).alias("part"), count(F.col("major")).alias("agreed"),
        count(fixed).alias("fixed"), count(fixed & later).alias("own"), count(~F.col("major") & later).alias("free"))
    sound = (F.col("fixed") > 0) & ((F.col("agreed") >= F.lit(similarity) * F.size("centre")) | ((F.col("own") > 0) & (F.col("own") >= F.col("free"))))
    return materialize(centre.select(F.col("g").alias("cg"), "centre", "weight", "fixed", F.col("part.pos").alias("part"), sound.alias("sound")), name)


def leaf_templates(lines: DataFrame, narrow: DataFrame, min_docs: int, similarity: float, leading: int = LEADING) -> DataFrame:
    """``h1, h2, template`` of the lines that fit a template of their leaf, for
    leaves that many documents share; ``template`` is its text."""
    seen = materialize(narrow.groupBy("leaf", "h1", "h2").agg(F.count(F.lit(1)).alias("n")), "op8_seen")
    # a template's lines are all in one leaf: fewer lines than min_docs cannot recur
    busy = materialize(seen.groupBy("leaf").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"))
                       .filter((F.col("n") >= min_docs) & (F.col("kinds") > 1)).select(F.col("leaf").alias("bleaf")), "op8_busy")
    held = lines.select("leaf", "masked", "h1", "h2").join(busy, F.col("leaf") == F.col("bleaf"))
    held = materialize(held.groupBy(F.col("leaf").alias("g"), "masked", "h1", "h2").agg(F.count(F.lit(1)).alias("n")), "op8_held")
    words = F.split("masked", " ")
    same = F.aggregate(F.zip_with(words, "centre", lambda a, b: F.when((b != WILDCARD) & (a == b), 1).otherwise(0)), F.lit(0), lambda a, x: a + x)
    found = []
    # each round takes lines out of every group or parts it by a position with
    # several words; a group stays whole only if half its lines have gone
    while not held.isEmpty():
        centre = _centres(held, similarity, leading, "op8_centre")
        tried = held.join(centre, F.col("g") == F.col("cg")).withColumn("fits", F.col("sound") & (same >= F.lit(similarity) * F.col("fixed")))
        tried = materialize(tried.withColumn("template", F.when(F.col("fits"), F.array_join("centre", " "))).withColumn(
            "w", F.when(~F.col("fits") & F.col("part").isNotNull(), F.get(words, F.col("part")))).drop("centre", "cg"), "op8_tried")
        # groups of a leaf that come to the same text share the template
        found.append(tried.filter("fits").select("h1", "h2", "template"))
        rest = tried.filter("not fits")
        left = rest.groupBy("g").agg(F.sum("n").alias("rest")).withColumnRenamed("g", "rg")
        rest = rest.join(left, F.col("g") == F.col("rg"))
        parted = F.when(2 * F.col("rest") > F.col("weight"), F.xxhash64("g", "part", "w")).otherwise(F.col("g"))
        rest = materialize(rest.select(parted.alias("g"), "masked", "h1", "h2", "n"), "op8_rest")
        # what cannot recur, or is one line, is its own template
        live = rest.groupBy("g").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"))
        live = live.filter((F.col("all") >= min_docs) & (F.col("kinds") > 1)).select(F.col("g").alias("lg"))
        held = materialize(rest.join(live, F.col("g") == F.col("lg"), "left_semi"), "op8_held")
    if not found:
        return held.select("h1", "h2", F.col("masked").alias("template"))
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def recurring_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS,
                    similarity: float = SIMILARITY, leading: int = LEADING, long_words: int = LONG_WORDS) -> DataFrame:
    """``id, th, no`` of every line to drop (``th``: hash of its text), twice
    if both rules drop it."""
    lines = _lines(df, id_col, text_col, leading, long_words)
    # parsed once; the words are read again for leaves that need them only
    narrow = materialize(lines.drop("masked"), "op8_narrow")
    fits = leaf_templates(lines, narrow, min_docs, similarity, leading).select(
        F.col("h1").alias("f1"), F.col("h2").alias("f2"), F.xxhash64("template").alias("t1"))
    fits = materialize(fits, "op8_fits")
    own = narrow.drop("leaf", "p1", "p2").join(fits, (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")), "left")
    own = own.select("id", "th", "no", F.coalesce("t1", "h1").alias("k1"), F.when(F.col("t1").isNull(), F.col("h2")).alias("k2"))
    own = materialize(own, "op8_lines")
    docs = own.select("th", "k1", "k2").distinct().groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("docs"))
    many = materialize(docs.filter(F.col("docs") >= min_docs).select(F.col("k1").alias("m1"), F.col("k2").alias("m2")), "op8_many")
    own = own.join(many, (F.col("k1") == F.col("m1")) & F.col("k2").eqNullSafe(F.col("m2"))).select("id", "th", "no")
    return own.unionAll(repeated_passages(narrow))


def drop_recurring_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``id, text, n_lines, n_dropped`` per row, the text without the lines
    whose template recurs and without repeated passages."""
    lost = recurring_lines(df, id_col, text_col, **options)
    lost = lost.groupBy("id", "th").agg(F.array_sort(F.collect_set("no")).alias("lost"))
    lost = materialize(lost.select(F.col("id").alias("lid"), F.col("th").alias("lth"), "lost"), "op8_lost")
    rows = df.select(F.col(id_col).alias("id"), safe_text(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    rows = rows.join(lost, F.col("id").eqNullSafe(F.col("lid")) & (F.col("th") == F.col("lth")), "left")
    rows = rows.select("id", "text", F.split("text", "\\n").alias("all"), F.coalesce("lost", F.array().cast("array<int>")).alias("lost"))
    # what lies between neighbouring dropped lines is kept in one slice
    marks = F.concat(F.array(F.lit(-1)), "lost", F.array(F.size("all")))
    rows = rows.withColumn("marks", marks)
    kept = F.expr("array_join(flatten(transform(sequence(1, size(marks) - 1), j -> "
                  "slice(all, marks[j - 1] + 2, marks[j] - marks[j - 1] - 1))), '\\n')")
    return rows.select("id", F.when(F.size("lost") > 0, kept).otherwise(F.col("text")).alias("text"),
                       F.when(F.col("text") == "", 0).otherwise(F.size("all")).alias("n_lines"), F.size("lost").alias("n_dropped"))


def op8_line_templates(spark, sf_dir: str) -> DataFrame:
    from convspark.sources.tables import read_table

    out = drop_recurring_lines(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
