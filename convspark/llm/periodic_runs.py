"""op13: stretches of a text that repeat themselves with a fixed period.

A *run* is a stretch of consecutive words with smallest period q (words q
apart are identical) and a length of at least ``max(min_length, 3 * q)``, that
no neighbouring word extends with the same period.

Method: a suffix automaton is grown word by word.  A link-cut tree over its
suffix links keeps, for each class of substrings, the word at which it last
ended; states with the same last end form one path of the tree.  Appending
word i accesses the path from the new state to the root: every segment of it
with last end j and substring lengths in (lo, hi] yields the distance d = i - j,
and lo < d <= hi holds exactly if a square with primitive root of length d ends
at i.  The accessed path is then recoloured with i.  Squares of one d at
consecutive words make up one run; it starts 2d - 1 words before the first.
The tree costs O(log n) amortised a word, and a word ends O(log n) squares.

Before that, words that no run can hold are set aside, without loss.  In a run
of length L >= max(24, 3q) every window of 8 words recurs q words further on or
back within the run (``window`` is a third of ``min_length``).  So a run lies in
a stretch whose windows all recur in that same stretch.  Such stretches are
found for many texts at once with window hashes (equal hashes of different
windows only keep words that need not be kept), again and again until nothing
changes, and the automaton is built over each of them.

Texts never leave their row: one ``mapInArrow``, no shuffle, nothing kept
beside the rows of a slice, so a lost executor repeats its own files.  Memory
follows ``SLICE_WORDS`` and the longest stretch that may hold a run (about
600 bytes a word of it), not the table.

Null and empty texts have no words and no runs.  Rows are taken as they come:
repeated ids and rows each give a row, null ids stay null.  Other columns, of
whatever names, are not read.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convspark.sources.tables import read_table

MIN_LENGTH = 24         # words in the shortest run
MIN_PERIODS = 3         # periods in the shortest run
SLICE_WORDS = 400_000   # words whose windows are hashed together

_RUN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                                 T.StructField("period", T.LongType())]))


# ------------------------------------------------------------------ one sequence
def primitive_squares(words):
    """``(i, d)`` for every square with primitive root of length d that ends at
    word i, by i: suffix automaton and link-cut access."""
    step, link, size = [{}], [0], [0]           # the automaton; state 0 is its root
    left, right, up, colour = [0], [0], [0], [0]  # the link-cut tree; 0 is none.  A path's colour is at its splay root
    cur = 0

    def splay(x):
        """Brings x to the root of its path's splay tree, and the path's colour to x."""
        p = up[x]
        if not p or (left[p] != x and right[p] != x):
            return
        while p and (left[p] == x or right[p] == x):
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                if (left[g] == p) == (left[p] == x):
                    turn(p, g)
                else:
                    turn(x, p)
                    p = g
                    turn(x, p)
                    p = up[x]
                    continue
            turn(x, p)
            p = up[x]

    def turn(x, p):
        g = up[p]
        if left[p] == x:
            inner = left[p] = right[x]
            right[x] = p
        else:
            inner = right[p] = left[x]
            left[x] = p
        if inner:
            up[inner] = p
        up[x], up[p] = g, x
        if g and left[g] == p:
            left[g] = x
        elif g and right[g] == p:
            right[g] = x
        else:                       # p was the root
            colour[x] = colour[p]

    for i, w in enumerate(words):
        new = len(step)
        step.append({})
        size.append(i + 1)
        link.append(0)
        left.append(0)
        right.append(0)
        up.append(0)
        colour.append(i)
        p, q = cur, None
        while True:
            q = step[p].get(w)
            if q is not None:
                break
            step[p][w] = new
            if not p:
                break
            p = link[p]
        cur = new
        if q is None:
            continue                # the word is new: nothing above it but the root
        if size[p] + 1 != size[q]:  # split q: the shorter substrings get a state of their own
            c = len(step)
            step.append(step[q].copy())
            size.append(size[p] + 1)
            link.append(link[q])
            link[q] = c
            splay(q)
            above = left[q]         # the copy stands just above q on q's path
            left.append(above)
            right.append(0)
            up.append(q)
            colour.append(0)
            if above:
                up[above] = c
            left[q] = c
            while step[p].get(w) == q:
                step[p][w] = c
                if not p:
                    break
                p = link[p]
            q = c
        link[new] = up[new] = q
        below, x = new, q           # access: segments of the path from the new state to the root
        while x:
            splay(x)
            last = colour[x]
            if right[x]:
                colour[right[x]] = last     # what lies below keeps its last end as a path of its own
            right[x] = below
            above = up[x]
            d = i - last
            if size[above] < d <= size[x]:
                yield i, d
            below, x = x, above
        colour[below] = i


def runs_of(words, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run, by start and period."""
    found, open_ = [], {}

    def close(d, first, last):
        start = first - 2 * d + 1
        length = last - start + 1
        if length >= max(min_length, min_periods * d):
            found.append((start, length, d))

    for i, d in primitive_squares(words):
        was = open_.get(d)
        if was is None:
            open_[d] = [i, i]
        elif was[1] == i - 1:
            was[1] = i
        else:
            close(d, *was)
            open_[d] = [i, i]
    for d, was in open_.items():
        close(d, *was)
    return sorted(found, key=lambda r: (r[0], r[2]))


# ------------------------------------------------------------------ many texts
def stretches(hashes: np.ndarray, owner: np.ndarray, window: int, least: int) -> list[tuple[int, int]]:
    """``[from, to)`` of the stretches of at least ``least`` words all of whose
    windows of ``window`` words recur within the same stretch, by the words'
    64-bit hashes.  ``owner`` numbers the text each word is of."""
    n = len(hashes) - window + 1
    if n <= 0:
        return []
    mixed = hashes.view(np.uint64)
    grams = np.zeros(n, np.uint64)
    for j in range(window):
        grams = grams * np.uint64(0xBF58476D1CE4E5B9) + mixed[j:j + n]
    at = np.flatnonzero(owner[:n] == owner[window - 1:])        # starts of windows within one text
    part = owner[at].astype(np.uint64)
    while len(at):
        key = (grams[at] ^ (part * np.uint64(0x94D049BB133111EB))) * np.uint64(0xD6E8FEB86659FD93)
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        kept, own = at[again], part[again]
        # consecutive starts of one text make up a stretch
        head = np.ones(len(kept), bool)
        head[1:] = (np.diff(kept) != 1) | (own[1:] != own[:-1])
        number = np.cumsum(head) - 1
        long_ = np.bincount(number) >= least - window + 1 if len(kept) else np.zeros(0, bool)
        mask = long_[number] if len(kept) else np.zeros(0, bool)
        kept, number = kept[mask], number[mask]
        if len(kept) == len(at):
            edges = np.flatnonzero(np.diff(number)) + 1
            return [(int(s[0]), int(s[-1]) + window) for s in np.split(kept, edges)]
        at, part = kept, number.astype(np.uint64)
    return []


def slice_runs(texts: list[list], min_length: int, min_periods: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each text (a list of words), found together."""
    out = [[] for _ in texts]
    sizes = [len(t) for t in texts]
    starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    # a hash only has to be the same for the same word, and only here
    hashes = np.fromiter(map(hash, chain.from_iterable(texts)), np.int64, int(starts[-1]))
    owner = np.repeat(np.arange(len(texts)), sizes)
    # windows up to a third of the shortest run recur in every run (of three periods or more)
    window = max(1, min_length // 3) if min_periods >= 3 else 1
    for a, b in stretches(hashes, owner, window, min_length):
        t = int(owner[a])
        base = int(a - starts[t])
        out[t] += [(base + s, n, q) for s, n, q in runs_of(texts[t][base:base + b - a], min_length, min_periods)]
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def kept_words(n: int, runs) -> np.ndarray:
    """Which of n words stay: of every run the first period."""
    cover = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        cover[start + period] += 1
        cover[start + length] -= 1
    return np.cumsum(cover[:-1]) == 0


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
              min_periods: int = MIN_PERIODS, rewrite=None) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_words``, ``runs`` (array of
    start, length, period; by start, then period) and ``collapsed``, the text
    with of every run only its first period, words joined by one space.
    ``rewrite(id, n)``, if given, names for each of a text's n words the word
    that takes its place (an index array), or None to leave the text alone."""
    if min_length < 3 or min_periods < 2:
        raise ValueError("min_length must be at least 3 and min_periods at least 2")
    id_type = docs.select(F.col(f"`{id_col}`")).schema[0].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("n_words", T.LongType()),
                           T.StructField("runs", _RUN), T.StructField("collapsed", T.StringType())])

    def rows(ids, texts):
        found = slice_runs(texts, min_length, min_periods)
        whole = []
        for words, runs in zip(texts, found):
            if runs:
                stay = kept_words(len(words), runs)
                words = [words[j] for j in np.flatnonzero(stay).tolist()]
            whole.append(b" ".join(words))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        runs = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found], kind)
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([len(t) for t in texts], pa.int64()), runs, pa.array(whole, pa.binary()).cast(pa.string())],
            ["id", "n_words", "runs", "collapsed"])

    def run(batches):
        for batch in batches:
            body = batch.column(1).cast(pa.binary())
            texts, first, total = [], 0, 0
            for at in range(batch.num_rows):
                words = (body[at].as_py() or b"").split()
                if rewrite is not None and words:
                    index = rewrite(batch.column(0)[at].as_py(), len(words))
                    if index is not None:
                        words = [words[j] for j in index.tolist()]
                texts.append(words)
                total += len(words)
                if total >= SLICE_WORDS:
                    yield rows(batch.column(0).slice(first, len(texts)), texts)
                    texts, first, total = [], at + 1, 0
            if texts:
                yield rows(batch.column(0).slice(first, len(texts)), texts)

    out = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``id_col`` and the text without the repeats of its runs; texts without a
    run keep their words (white space is evened out)."""
    return find_runs(docs, id_col, text_col, **options).select(F.col(f"`{id_col}`"), F.col("collapsed").alias(text_col))


# ------------------------------------------------------------------ the query
def repeat_tail(doc_id, n: int) -> np.ndarray | None:
    """The query's rewriting: in every tenth document (by the crc32 of its id)
    the words from a on repeat with period p.  A null id leaves its text alone."""
    if doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    index = np.arange(n)
    index[a:] = a + (index[a:] - a) % p
    return index


def _strongest(runs: Column) -> Column:
    """The run of greatest length / period; ties: smallest start, then period."""
    def order(x, y):
        more = y["length"] * x["period"] - x["length"] * y["period"]
        by = F.when(more != 0, more).when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["period"] - y["period"])
        return F.signum(by).cast("int")

    return F.get(F.array_sort(runs, order), 0)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document after the contract's rewriting, with digests."""
    found = find_runs(read_table(spark, sf_dir, "documents"), rewrite=repeat_tail)
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    best = found.withColumn("best", _strongest(F.col("runs")))
    return best.select(
        "doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
