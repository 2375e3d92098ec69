"""op11: collocations of two and more words, by top-order marginalisation.

Only one kind of n-gram is counted: every word opens one window of ``order``
words, made of the word columns led by 1, 2, ... places, and padded where its
piece of text ends.  The count of a shorter phrase is the sum over all windows
that begin with it, so Spark's ROLLUP over the word columns yields every
shorter order, down to the number of words.

1. Tasks count the windows of slices of their texts: words become codes, the
   led code columns are sorted and counted.  A slice sends each distinct window
   once, so a frequent word or phrase costs a row per slice, not per use.
2. Window counts are range partitioned by (language, window).  Equal windows
   meet, and a prefix that a third of all windows share is spread over as many
   tasks as it fills.
3. Each range sums its windows.  A window below ``min_count`` can be neither a
   candidate nor part of one, so its count is moved to its next shorter prefix,
   and so on for prefixes that begin and end inside the range (one that reaches
   its edge may go on next door and is left as it is).  No count is lost.
4. ROLLUP sums what is left, all phrases that reach ``min_count`` and the rest.
5. A candidate's cuts join the counts of their two parts; scores are exact
   (38-digit decimals), the lowest cut counts.  Candidates inside a longer one
   of nearly their count go, and each language's first ``top`` stay, chosen in
   two steps.

The ranges are placed by Spark's sampling of step 1, which runs that step twice
but only decides which task sums what.  Counts are written to the shared folder
before they are joined, so a lost executor repeats files of one step.

Null and empty texts have no words; a null language is ``und``.  Rows are taken
as they come, repeated ones count again.  A language without candidates has no
row, nor has an empty table.  Other columns, of whatever names, are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convspark.llm.common import materialize, parts_for
from convspark.sources.tables import read_table

SLICE_WORDS = 1_000_000         # words whose windows are counted together
BLOCK_BYTES = 1 << 20           # of a text, split into words at once
RANGE_BYTES = 8 << 20           # of text whose windows make up one range
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
PAD = b"\xff"                   # between pieces; no UTF-8 text holds this byte

_TABLE = bytearray(range(256))
_TABLE[0x41:0x5B] = range(0x61, 0x7B)           # A-Z to a-z, no other letters
_TABLE[0x09] = 0x20
for _b in SEPARATORS:
    _TABLE[_b] = PAD[0]
_TABLE = bytes(_TABLE)


# ------------------------------------------------------------------ step 1
def words_of(text: bytes):
    """The words of a text, a block at a time, with ``PAD`` between pieces."""
    clean = text.translate(_TABLE).replace(PAD, b" \xff ")
    at = 0
    while at < len(clean):
        end = clean.find(b" ", at + BLOCK_BYTES)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


def count_windows(words: list[bytes], order: int, starts: int | None = None) -> tuple[pa.Array, np.ndarray]:
    """Distinct windows that begin at the first ``starts`` words (all, if None)
    and their counts.  A window is its words joined by spaces, padded with
    empty ones, in byte order."""
    coded = pa.array(words, pa.binary()).dictionary_encode()
    by = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(by), np.int64)
    rank[by.to_numpy()] = np.arange(1, len(by) + 1)
    vocabulary = pa.concat_arrays([pa.array([b""], pa.binary()), coded.dictionary.take(by)])
    if vocabulary[-1].as_py() == PAD:           # the greatest, if there
        rank[rank == len(by)] = 0
    code = np.concatenate([rank[coded.indices.to_numpy()], np.zeros(order - 1, np.int64)])
    n = len(words) if starts is None else starts
    columns = [code[:n]]
    for j in range(1, order):                   # led by j places, empty once the piece has ended
        columns.append(np.where(columns[-1] == 0, 0, code[j:n + j]))
    some = columns[0] != 0
    columns = [c[some] for c in columns]
    key = columns[0]
    for c in columns[1:]:
        if len(key) and int(key.max()) + 1 > (1 << 62) // len(vocabulary):
            key = np.unique(key, return_inverse=True)[1]        # dense again, same order
        key = key * len(vocabulary) + c
    at = np.argsort(key)
    heads = np.flatnonzero(np.diff(key[at], prepend=-1))
    first = at[heads]
    parts = [vocabulary.take(pa.array(c[first])) for c in columns]
    return pc.binary_join_element_wise(*parts, b" "), np.diff(heads, append=len(at))


def _window_counts(order: int):
    def run(batches):
        held: dict[str, list[bytes]] = {}

        def send(lang, words, starts=None):
            windows, counts = count_windows(words, order, starts)
            langs = pa.array([lang]).take(pa.array(np.zeros(len(windows), np.int8)))
            whole = pa.RecordBatch.from_arrays([langs, windows.cast(pa.string()), pa.array(counts, pa.int64())], ["lang", "win", "n"])
            for at in range(0, len(whole), 50_000):
                yield whole.slice(at, 50_000)

        for batch in batches:
            body = batch.column(1).cast(pa.binary())
            for lang, text in zip(batch.column(0).to_pylist(), body):
                words = held.setdefault(lang, [])
                for block in words_of(text.as_py()):
                    words += block
                    if len(words) >= SLICE_WORDS:       # the last words' windows go on in the next block
                        yield from send(lang, words, len(words) - order + 1)
                        del words[:len(words) - order + 1]
                words.append(PAD)
                if sum(map(len, held.values())) >= SLICE_WORDS:
                    for k, v in held.items():
                        yield from send(k, v)
                    held = {}
        for k, v in held.items():
            yield from send(k, v)

    return run


# ------------------------------------------------------------------ step 3
def _fold_ranges(order: int, min_count: int):
    names = ["lang", *[f"w{j}" for j in range(1, order + 1)], "n"]

    def dense(above, code, size):
        return np.unique(above * size + code, return_inverse=True, return_index=True)[1:]

    def run(batches):
        got = list(batches)
        if not sum(map(len, got)):
            return
        table = pa.Table.from_batches(got).group_by(["lang", "win"]).aggregate([("n", "sum")]).combine_chunks()
        langs, windows = (table.column(c).combine_chunks() for c in ("lang", "win"))
        n = table.column("n_sum").to_numpy()
        coded = langs.dictionary_encode()
        lang = coded.indices.to_numpy().astype(np.int64)
        edge = set()                            # rows of the range's first and last window
        for side in (pc.min, pc.max):
            rows = pc.indices_nonzero(pc.equal(langs, side(langs)))
            ours = windows.take(rows)
            edge.add(rows[pc.index(ours, side(ours)).as_py()].as_py())
        edge = list(edge)
        flat = pc.list_flatten(pc.split_pattern(windows, " ")).dictionary_encode()
        words = flat.dictionary
        codes = flat.indices.to_numpy().astype(np.int64).reshape(-1, order)
        empty = pc.index(words, "").as_py()

        # group[j]: number of each row's prefix of j words; first[j]: a row of each prefix
        first, group = [np.unique(lang, return_index=True)[1]], [lang]
        for j in range(order):
            f, g = dense(group[-1], codes[:, j], len(words))
            first.append(f)
            group.append(g)
        rest = np.bincount(group[order], weights=n)     # exact below 2**53 a range
        total = rest
        for j in range(order, -1, -1):
            row = first[j]
            # bincount of a prefix's own windows, moved up where it cannot count itself
            stays = np.ones(len(row), bool)
            if j:
                stays = total >= min_count
                if j < order:
                    stays[group[j][edge]] = True
                stays &= codes[row, j - 1] != empty
            some = stays & (rest > 0)
            at = row[some]
            columns = [coded.dictionary.take(pa.array(lang[at]))]
            for i in range(order):
                columns.append(words.take(pa.array(codes[at, i])) if i < j else pa.nulls(len(at), pa.string()))
            columns.append(pa.array(rest[some].astype(np.int64)))
            if len(at):
                yield pa.RecordBatch.from_arrays(columns, names)
            if j:
                up = group[j - 1][row]
                size = len(first[j - 1])
                rest = np.bincount(up, weights=np.where(stays, 0, rest), minlength=size)
                total = np.bincount(up, weights=total, minlength=size)

    return run


def phrase_counts(docs: DataFrame, order: int = 3, min_count: int = 10, lang_col: str = "lang",
                  text_col: str = "text") -> DataFrame:
    """``lang, phrase, size, f``: every phrase of up to ``order`` words that
    occurs ``min_count`` times in its language, and (size 0, phrase empty) the
    number of words of each language."""
    if order < 2 or min_count < 1:
        raise ValueError("order must be at least 2 and min_count at least 1")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).head()[0] or 0
    parts = parts_for(spark, size, RANGE_BYTES)
    windows = texts.mapInArrow(_window_counts(order), "lang string, win string, n long")
    words = [f"w{j}" for j in range(1, order + 1)]
    folded = windows.repartitionByRange(parts, "lang", "win").mapInArrow(
        _fold_ranges(order, min_count),
        T.StructType([T.StructField("lang", T.StringType()), *[T.StructField(w, T.StringType()) for w in words],
                      T.StructField("n", T.LongType())]))
    sums = folded.rollup("lang", *words).agg(F.sum("n").alias("f"), F.grouping_id().alias("gid"))
    # the grouping id of the prefix of m words has its last order - m bits set
    level = {m: (1 << (order - m)) - 1 for m in range(order + 1)}
    kept = F.col("gid") == level[0]
    kind = F.when(kept, 0)
    for m in range(1, order + 1):
        real = (F.col("gid") == level[m]) & F.col(words[m - 1]).isNotNull() & (F.col("f") >= min_count)
        kept, kind = kept | real, kind.when(F.col("gid") == level[m], m)
    return sums.filter(kept).select("lang", F.concat_ws(" ", *words).alias("phrase"), kind.cast("int").alias("size"), "f")


# ------------------------------------------------------------------ step 5
def _digits(c: str):
    return F.col(c).cast("decimal(15,0)")


def collocations(docs: DataFrame, order: int = 3, min_count: int = 10, inside_percent: int = 50, top: int = 2000,
                 lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each language's first ``top`` phrases of 2 to ``order`` words by score:
    ``lang, rank, phrase, a, l, r, n, score``.  A phrase inside a longer
    candidate with ``inside_percent`` of its count or more is left out."""
    counts = materialize(phrase_counts(docs, order, min_count, lang_col, text_col), "op11_counts")
    single = counts.filter("size > 0").select("lang", "phrase", "f")
    found = counts.filter("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    def part(start, length):
        return F.array_join(F.slice("w", start, length), " ")

    cuts = found.select("lang", "phrase", "a", "size", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"),
                       part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    cuts = cuts.join(single.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(single.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    exact = {c: _digits(c) for c in ("a", "l", "r")}
    cuts = cuts.withColumn("top", exact["a"] * exact["a"] * F.lit(1_000_000).cast("decimal(7,0)")) \
        .withColumn("under", exact["l"] * exact["r"]).withColumn("score", F.expr("top div under"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    spans = F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), "
                   "s -> array_join(slice(w, s, m), ' '))))")
    inside = found.filter("size > 2").select("lang", F.explode(spans).alias("phrase"), F.col("a").alias("longer")) \
        .groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    out = scored.join(inside, ["lang", "phrase"], "left") \
        .filter(F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("a"))) \
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    spark = docs.sparkSession
    salts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    first = out.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts))) \
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*by))).filter(F.col("rank") <= top)
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).filter(F.col("rank") <= top)
    words = counts.filter("size = 0").select("lang", F.col("f").alias("n"))
    return first.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


# ------------------------------------------------------------------ the query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of every language of ``documents``."""
    return collocations(read_table(spark, sf_dir, "documents"))


ORACLE = {
    "op11_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, 1 AS size, unnest(w) AS phrase FROM worded
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM worded
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
  FROM worded),
f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
cand AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size >= 2 AND f >= 10),
cut AS (SELECT c.*, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp
        FROM cand c, (VALUES (1), (2)) t(k) WHERE k < size),
scored AS (
  SELECT cut.lang, cut.phrase, a, k, fl.f AS l, fr.f AS r,
         ((1000000::HUGEINT * a * a) // (fl.f::HUGEINT * fr.f))::BIGINT AS score
  FROM cut JOIN f fl ON fl.lang = cut.lang AND fl.phrase = lp JOIN f fr ON fr.lang = cut.lang AND fr.phrase = rp),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS m FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM cand WHERE size = 3
    UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM cand WHERE size = 3) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score
FROM best b JOIN total ON total.lang = b.lang LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase
WHERE g.m IS NULL OR 100 * g.m < 50 * a
QUALIFY rank <= 2000"""
}
