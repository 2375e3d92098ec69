"""op12: document fingerprints by spot signatures (SpotSigs), in DataFrame
functions only.

A signature is an anchor, one of a list of common words, and the chain of the
next ``CHAIN`` content words (words that are no anchors) behind it; the start
of a text is an anchor too.  A text's fingerprint is its set of distinct
signatures, as 64-bit hashes in rising order.  Common words stand all over
running prose, so a passage that is moved or cut keeps its signatures, while
lists, menus and boilerplate give few.  Texts in which fewer than one word in
``SPARSE`` is an anchor (other languages, lists) take every word as one.

Fingerprints are compared by the Jaccard similarity of their sets.
``near_pairs`` partitions sets by length: ranges whose bounds grow by the factor
1 / threshold, so sets that can reach the threshold lie in the same range or in
neighbouring ones.  Within those, only sets that share one of their least
signatures meet (a set of n must share one of its first
n - ceil(threshold * n) + 1), and a pair is dropped by its lengths before its
sets are intersected.

``next_documents`` finds each document's follower in falling order of ids
without a global sort in one task: narrow rows (id, hash and length) are range
partitioned, a window leads within each range, and each range's last row takes
the head of the next one.  Of a text, one copy moves to its own key and at most
as much as is asked for to its predecessor's.

Null and empty texts, and texts without any word, have an empty set; two empty
sets are alike (1.0), an empty and another one are not (0.0).  Rows that repeat
an id and a text count as one document and give a row each with the same
values; equal ids with different texts are ordered by their texts' hashes, null
ids come last.  A single document follows itself.  An empty table gives none.
Other columns, of whatever names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convspark.llm.common import materialize, parts_for, safe_text
from convspark.sources.tables import read_table

# the commonest words of running prose in English, French, German and Spanish
ANCHORS = ("the of and to a in is that it for was on with as be by this are at from "
           "de la le et les des en un du une que pour est par qui dans "
           "der die und den von zu das mit sich auf für ist im nicht "
           "el y los se del las por con no su").split()
CHAIN = 3           # content words of a signature
SPARSE = 32         # words to an anchor, from which on every word is one
LINK_ROWS = 500_000     # narrow rows to a range


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often it is used."""
    return F.get(F.transform(F.array(value), body), 0)


def signatures(text: Column, anchors=ANCHORS, chain: int = CHAIN, sparse: int = SPARSE) -> Column:
    """The text's distinct signatures (hashes), in rising order."""
    anchors = list(anchors)
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")

    def marked(w: Column) -> Column:
        # positions of the anchors and the content words around them: content
        # word number i - t follows the anchor number t, which is word i
        spots = F.filter(F.transform(w, lambda x, i: F.when(x.isin(anchors), i)), lambda i: i.isNotNull())
        content = F.filter(w, lambda x: ~x.isin(anchors))
        follow = lambda c, k: [F.get(c, k + j) for j in range(chain)]

        def sign(found: Column) -> Column:
            at, c = found["spots"], found["content"]
            first = F.when(F.size(c) > 0, F.array(F.xxhash64(F.lit(""), *follow(c, F.lit(0)))))
            spotted = F.transform(at, lambda i, t: F.when(i - t < F.size(c), F.xxhash64(F.get(w, i), *follow(c, i - t))))
            every = F.transform(w, lambda x, i: F.xxhash64(x, *follow(w, i + 1)))
            return F.when(F.size(at) * sparse < F.size(w), every).otherwise(
                F.concat(F.coalesce(first, F.array().cast("array<bigint>")), F.filter(spotted, lambda s: s.isNotNull())))

        return let(F.struct(spots.alias("spots"), content.alias("content")), sign)

    return F.array_sort(F.array_distinct(let(words, marked)))


def fingerprint_text(sigs: Column) -> Column:
    """The set as text: hexadecimal hashes in rising order, joined by spaces."""
    return F.array_join(F.transform(sigs, lambda s: F.lower(F.hex(s))), " ")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets; 0 below ``least``, and then the sets are
    not intersected if their lengths alone show it."""
    few, many = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    exact = let(both, lambda n: n / (few + many - n))
    if least:
        exact = let(exact, lambda s: F.when(s >= least, s).otherwise(0.0))
    return F.when(many == 0, 1.0).when((few == 0) | (few < least * many), 0.0).otherwise(exact)


# ------------------------------------------------------------------ near documents
def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``id, sigs`` per row."""
    return docs.select(F.col(f"`{id_col}`").alias("id"), signatures(safe_text(f"`{text_col}`"), **options).alias("sigs"))


def fingerprint_classes(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``class, sigs`` of the distinct sets (a class is named by its least id)
    and ``id, class`` of all rows, nulls left out of neither."""
    classes = prints.groupBy("sigs").agg(F.min("id").alias("class"))
    members = prints.join(classes.withColumnRenamed("sigs", "csigs"), F.col("sigs") == F.col("csigs")).select("id", "class")
    return classes, members


def near_pairs(queries: DataFrame, classes: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``query, class, likeness`` of all pairs of a query (``id, sigs``) and a
    class (``class, sigs``) whose likeness reaches ``threshold`` (above 0)."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    n = F.size("sigs")
    prefix = F.slice("sigs", 1, n - F.ceil(F.lit(threshold) * n - F.lit(1e-9)).cast("int") + 1)
    band = F.floor(F.log(n) / F.lit(-_log(threshold))) if threshold < 1 else n

    def listed(rows: DataFrame, name: str, bands: Column) -> DataFrame:
        rows = rows.filter(n > 0).select(F.col(name), "sigs", prefix.alias("prefix"), F.explode(bands).alias("band"))
        return rows.select(name, "band", F.explode("prefix").alias("sig"))

    # rounding may put a set on the wrong side of a bound by one band
    near = F.array(*[band + j for j in ((-2, -1, 0, 1, 2) if threshold < 1 else (0,))])
    met = listed(queries.withColumnRenamed("id", "query"), "query", F.array(band)).join(listed(classes, "class", near), ["band", "sig"])
    met = met.select("query", "class").distinct()
    both = met.join(queries.select(F.col("id").alias("query"), F.col("sigs").alias("qs")), "query") \
        .join(classes.select("class", F.col("sigs").alias("cs")), "class")
    found = both.select("query", "class", likeness(F.col("qs"), F.col("cs"), threshold).alias("likeness")).filter(F.col("likeness") >= threshold)
    empty = queries.filter(n == 0).select(F.col("id").alias("query")).withColumn("none", F.lit(0)) \
        .join(classes.filter(n == 0).select("class").withColumn("none", F.lit(0)), "none")     # at most one such class
    return found.unionByName(empty.select("query", "class", F.lit(1.0).alias("likeness")))


def _log(x: float) -> float:
    import math

    return math.log(x)


# ------------------------------------------------------------------ followers
def next_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, th, n_chars, next_id, next_th``: each distinct document and the next
    one by falling id (the first one after the last); ``th`` hashes the text."""
    spark = docs.sparkSession
    t = safe_text(f"`{text_col}`")
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(t).alias("th"), F.length(t).cast("long").alias("n_chars"))
    narrow = materialize(narrow.distinct(), "op12_ids")
    by = [F.desc_nulls_last("id"), F.asc("th"), F.asc("n_chars")]
    parts = parts_for(spark, narrow.count(), LINK_ROWS)
    rows = materialize(narrow.repartitionByRange(parts, *by).withColumn("block", F.spark_partition_id()), "op12_blocks")
    w = Window.partitionBy("block").orderBy(*by)
    led = rows.select("*", F.row_number().over(w).alias("no"), F.lead(F.struct("id", "th")).over(w).alias("next"))
    heads = led.filter("no = 1").select("block", F.struct("id", "th").alias("head"))
    # one row for each range
    over = Window.orderBy("block")
    after = heads.select("block", F.coalesce(F.lead("head").over(over), F.first("head").over(over)).alias("after"))
    out = led.filter("next is not null").drop("no").unionByName(
        led.filter("next is null").drop("no", "next").join(after, "block").withColumnRenamed("after", "next"))
    return out.select("id", "th", "n_chars", F.col("next.id").alias("next_id"), F.col("next.th").alias("next_th"))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row ``id, n_chars, edited`` (the text, its last half replaced by as
    much of the next document), ``sigs, edited_sigs, near_edited, near_next``."""
    links = materialize(next_documents(docs, id_col, text_col), "op12_links")
    t = safe_text(f"`{text_col}`")
    key = lambda i, th: F.concat_ws(":", F.col(th).cast("string"), F.col(i).cast("string"))  # noqa: E731  of a null id the hash alone
    # the two joins read the same two columns, so the texts are shuffled once
    every = docs.select(F.col(f"`{id_col}`").alias("id"), t.alias("text"), F.xxhash64(t).alias("th")).select(key("id", "th").alias("key"), "text")
    own = links.select("id", key("id", "th").alias("own"), key("next_id", "next_th").alias("key"), F.expr("n_chars div 2").cast("int").alias("half"))
    lent = every.join(own, "key").select("own", "id", "half", F.substring("text", F.lit(1), F.col("half")).alias("head"),
                                         signatures(F.col("text"), **options).alias("next_sigs"))
    # a follower that stands in several rows lends its text once
    lent = lent.dropDuplicates(["own"]).withColumnRenamed("own", "key")
    rows = every.join(lent, "key").select(
        "id", "text", F.length("text").cast("long").alias("n_chars"), "next_sigs",
        F.concat(F.substring("text", F.lit(1), F.length("text") - F.col("half")), "head").alias("edited"))
    rows = rows.select("id", "n_chars", "edited", "next_sigs", signatures(F.col("text"), **options).alias("sigs"),
                       signatures(F.col("edited"), **options).alias("edited_sigs"))
    return rows.withColumns({"near_edited": likeness(F.col("sigs"), F.col("edited_sigs")),
                             "near_next": likeness(F.col("sigs"), F.col("next_sigs"))}).drop("next_sigs")


# ------------------------------------------------------------------ the query
def op12_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document of ``documents`` and of its edited text."""
    rows = compare_with_next(read_table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                       fingerprint_text(F.col("sigs")).alias("fingerprint"),
                       fingerprint_text(F.col("edited_sigs")).alias("edited_fingerprint"), "near_edited", "near_next")
