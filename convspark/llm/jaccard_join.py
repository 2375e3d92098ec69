"""Operator 9, n-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds the hashes of its distinct word shingles.  All sets
are sorted by one global order: shingles that are frequent (by counts over all
documents) come last, the rest by hash.  So a passage that many documents
share stays out of the prefixes of those that differ enough besides it, even
if no single batch holds it often.  Two
sets with Jaccard of at least t share l shingles within the first
``n - ceil(t n) + l`` of each (l = 1, 2, ...).  A document whose short prefix
would meet many candidates takes a longer one, by estimated cost, and then l
shared prefix shingles are required before a pair is verified on whole sets:
for a pair, the smaller l of the two holds.

Skew.  Documents with equal sets form one class, and only its smallest id is
joined.  Prefix shingles of many documents are first verified as stars: every
document against a few central members of its shingles' lists, which merges groups of
near copies into components, round by round.  Only then are pairs formed,
between different components alone, for every shingle that still has two and
within the prefixes that the two sizes call for.  So a group of copies never turns into all its pairs, and no candidate
is dropped: what the stars left open, the pairs cover in full.

Defined cases
    * null, empty and blank texts have the empty set and link with nothing;
    * with fewer words than a shingle takes, the whole sequence is one;
    * repeated rows link by their equal sets; rows with a null id are linked
      with nothing and have a null component;
    * an id with several texts links if any of them does;
    * an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convspark.llm.common import materialize, materialize_by, slices, thrifty
from convspark.llm.components import components

#: Text bytes hashed at a time inside a task (arrays of eight bytes for each),
#: and text bytes of the rows signed or packed at a time.
SLICE, ROWS_SLICE = 1 << 18, 1 << 21
#: Text bytes of the rows whose shingles are counted at a time.
COUNT_SLICE = 1 << 23
#: Shingles that so many documents hold are frequent (those of which a slice
#: has so many are reported with their number), and so many of the most
#: frequent ones enter the global order (an order hint of bounded size: any
#: order is exact).
BATCH_REPEATS, ORDER_HINTS = 4, 200_000
#: Shingles are counted by the first 44 bits of their hashes, in parts by the
#: first 12 of them, so that four bytes of each are moved.
KEY_SHIFT, PART_SHIFT = 20, 52
#: Longest extension of a prefix, the weight of one verification against one
#: list entry, and the further documents expected to hold an unlisted shingle.
MAX_EXTRA, VERIFY_COST, CHANCE = 8, 16.0, 0.05
#: Shingle lists from this size go through stars; draws per document; rounds.
HOT, DRAWS, ROUNDS = 3, 2, 2
#: Bits of the parity map that bounds the difference of two sets from below.
PARITY = 1024

_POWERS: dict = {}


def _powers(n: int):
    """Powers of the word polynomial's base and of its inverse, modulo 2**64."""
    import numpy as np

    if len(_POWERS.get("up", ())) < n:
        n = max(n, SLICE + 1)
        for name, step in (("up", 0x9E3779B97F4A7C15), ("down", pow(0x9E3779B97F4A7C15, -1, 2 ** 64))):
            x = np.full(n, step, np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x)
        _POWERS["table"] = np.random.default_rng(20240229).integers(0, 2 ** 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    return _POWERS["up"], _POWERS["down"], _POWERS["table"]


def hash_words(data: bytes):
    """64-bit hashes and start offsets of the words of a text in which white
    space is single spaces or runs of them."""
    import numpy as np

    hashes, starts, at = [], [], 0
    while at < len(data):
        cut = len(data)
        if cut - at > SLICE:         # cut between words
            cut = data.rfind(b" ", at, at + SLICE)
            if cut <= at:
                cut = data.find(b" ", at + SLICE)
                cut = len(data) if cut < 0 else cut
        raw = np.frombuffer(data, np.uint8, cut - at, at)
        powers, inverses, table = _powers(len(raw) + 1)
        edge = np.diff(np.concatenate(([1], (raw == 32).view(np.int8), [1])))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(table[raw] * powers[:len(raw)], out=total[1:])
        hashes.append((total[last] - total[first]) * inverses[first] + (last - first).astype(np.uint64))
        starts.append(first + at)
        at = cut
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def mixed(x):
    """Bit mixer (the published splitmix64 finaliser)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A-Z to a-z, and the six white-space bytes to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def shingle_sets(texts, k: int):
    """One sorted array of distinct shingle hashes per text."""
    import numpy as np

    out, group, size = [], [], 0

    def flush():
        data = b" ".join(group)
        ends = np.cumsum([len(g) + 1 for g in group])
        h, starts = hash_words(data)
        h = mixed(h)
        doc = np.searchsorted(ends, starts, "right")
        first = np.searchsorted(doc, np.arange(len(group) + 1))
        n = max(0, len(h) - k + 1)
        s = np.zeros(n, np.uint64)
        for j in range(k):
            s = s * np.uint64(0xD6E8FEB86659FD93) + h[j:j + n]
        s = mixed(s).view(np.int64)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= k:
                x = np.sort(s[a:b - k + 1])
                out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
            elif b > a:
                whole = np.full(1, b - a, np.uint64)     # arrays wrap silently
                for j in range(a, b):
                    whole = whole * np.uint64(0xD6E8FEB86659FD93) + h[j:j + 1]
                out.append(mixed(whole).view(np.int64))
            else:
                out.append(np.empty(0, np.int64))

    for t in texts:
        raw = (t or "").encode().translate(_FOLD)
        if group and size + len(raw) > SLICE:
            flush()
            group, size = [], 0
        group.append(raw)
        size += len(raw) + 1
    if group:
        flush()
    return out


def _ids(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def distinct(x):
    """The values of an array, which is sorted in place, and their numbers."""
    import numpy as np

    x.sort()
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1])))
    return x[first], np.diff(first, append=len(x))


def frequent_shingles(docs: DataFrame, k: int):
    """(key, documents) arrays of the most frequent shingles; a key is the
    first 44 bits of a hash."""
    import numpy as np

    def count(batches):
        import pyarrow as pa

        names = ["h", "n", "part", "rest"]
        for b in slices(batches, 0, COUNT_SLICE):
            sets = shingle_sets((t.as_py() for t in b.column(0)), k)
            if not sets:
                continue
            h, n = distinct(np.concatenate(sets))
            del sets
            often = n >= BATCH_REPEATS
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[often]), pa.array(n[often]), pa.array((h[often] >> PART_SHIFT).astype(np.int32)), pa.nulls(int(often.sum()), pa.binary())], names=names)
            h = np.repeat(h[~often], n[~often])
            parts, at = np.unique(h >> PART_SHIFT, return_index=True)
            ends = np.append(at, len(h)).astype(np.int32) * 4
            h = (h >> KEY_SHIFT).astype(np.uint32)        # the part has the bits before these
            rest = pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(ends), pa.py_buffer(h)])
            none = pa.nulls(len(parts), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(parts.astype(np.int32)), rest], names=names)

    def total(rows):
        import pyarrow as pa

        rest, n = distinct(np.frombuffer(b"".join(x for x in rows.column("rest").to_pylist() if x), np.uint32).copy())
        some = rows.column("h").drop_null().to_numpy()
        low = (some >> KEY_SHIFT).astype(np.uint32)
        kept = (n >= BATCH_REPEATS) | np.isin(rest, low)
        low, at = np.unique(np.concatenate((rest[kept], low)), return_inverse=True)
        n = np.bincount(at, np.concatenate((n[kept], rows.column("n").drop_null().to_numpy())), len(low)).astype(np.int64)
        key = (np.int64(rows.column("part")[0].as_py()) << np.int64(PART_SHIFT - KEY_SHIFT)) | low.astype(np.int64)
        return pa.table({"key": key, "n": n})

    got = docs.select("text").mapInArrow(thrifty(count), "h long, n long, part int, rest binary")
    got = materialize(got.groupBy("part").applyInArrow(total, "key long, n long"), "op9_often", drop_shuffles=True)
    top = got.orderBy(F.desc("n"), "key").limit(ORDER_HINTS).toPandas().sort_values("key")
    return top["key"].to_numpy(np.int64), top["n"].to_numpy(np.int64)


def choose_prefix(df, n: int, percent: int):
    """(length, l): the extension of least estimated cost; ``df`` are the
    estimated document counts of the set's shingles in the global order."""
    least = -(-percent * n // 100)
    # a partner of the same size meets this set in a shorter part of the prefix
    even = -(-2 * percent * n // (100 + percent))
    extra = df - 1.0
    best = None
    for l in range(1, min(MAX_EXTRA, least) + 1):  # noqa: E741
        size = n - least + l
        others = float(extra[:n - even + l].sum())
        cost = size + others * (1 + VERIFY_COST / l)
        if best is None or cost < best[0]:
            best = (cost, size, l)
    return best[1], best[2]


_SIGNED = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("f1", T.LongType()),
                        T.StructField("f2", T.LongType()), T.StructField("need", T.IntegerType()),
                        T.StructField("parity", T.ArrayType(T.LongType())), T.StructField("prefix", T.ArrayType(T.LongType()))])


def signatures(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Per row: set size, a 128-bit sum of the set, required l, parity map and
    prefix."""
    keys, counts = frequent_shingles(docs, k)
    sent = docs.sparkSession.sparkContext.broadcast((keys, counts))     # at most ORDER_HINTS entries

    def sign(batches):
        import numpy as np
        import pyarrow as pa

        known, often = sent.value

        def lists(arrays):
            off = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
            return pa.ListArray.from_arrays(off, pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64)))

        for b in slices(batches, 1, ROWS_SLICE):
            sets = shingle_sets(b.column(1).to_pylist(), k)
            f1, f2, need, parity, prefix = [], [], [], [], []
            for s in sets:
                u = s.view(np.uint64)
                f1.append(int(u.sum().view(np.int64)))
                f2.append(int(mixed(u + np.uint64(0x9E3779B97F4A7C15)).sum().view(np.int64)))
                odd = np.bincount(s & (PARITY - 1), minlength=PARITY) & 1
                parity.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                if not len(s):
                    need.append(0)
                    prefix.append(s)
                    continue
                df = np.full(len(s), 1 + CHANCE)
                if len(known):
                    key = s >> KEY_SHIFT
                    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                    hit = known[at] == key
                    df[hit] = often[at[hit]]
                order = np.argsort(df, kind="stable")       # hashes are sorted already
                size, l = choose_prefix(df[order], len(s), percent)  # noqa: E741
                need.append(l)
                prefix.append(s[order[:size]])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()),
                 pa.array(need, pa.int32()), lists(parity), lists(prefix)], names=[f.name for f in _SIGNED])

    return docs.mapInArrow(thrifty(sign), _SIGNED)


def _possible(pairs: DataFrame, meta: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and parity maps allow the threshold: sets differ at
    least where their maps differ."""
    side = lambda x: meta.select(F.col("id").alias(f"i{x}"), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"p{x}"))
    p = pairs.join(side("a"), F.col("a") == F.col("ia")).join(side("b"), F.col("b") == F.col("ib"))
    differ = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return p.filter((100 + percent) * differ <= (100 - percent) * (F.col("na") + F.col("nb"))).select("a", "b").distinct()


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` with compressed texts, since only those are moved between tasks."""
    def pack(batches):
        import pyarrow as pa
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in slices(batches, 1, ROWS_SLICE):
            texts = [None if t is None else squeeze(t.encode()) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary())], names=["id", "text"])

    return docs.mapInArrow(thrifty(pack), "id long, text binary")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""
    def compare(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            hit = []
            for x, y in zip(b.column(2), b.column(3)):
                s, t = shingle_sets([unpack(x.as_py()).decode(), unpack(y.as_py()).decode()], k)
                common = len(np.intersect1d(s, t, assume_unique=True))
                hit.append(100 * common >= percent * (len(s) + len(t) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(hit, pa.bool_()))

    pairs = materialize(pairs, f"{name}_pairs")
    met = materialize(pairs.select(F.explode(F.array("a", "b")).alias("mid")).distinct(), f"{name}_met")
    # the texts stay in their buckets; the few met ones are then spread anew, so that a hot one can be split
    texts = materialize(texts.join(met, F.col("id") == F.col("mid"), "left_semi"), f"{name}_met_texts")
    side = lambda x: texts.select(F.col("id").alias(f"i{x}"), F.col("text").alias(f"t{x}"))
    both = pairs.join(side("a"), F.col("a") == F.col("ia")).drop("ia").join(side("b"), F.col("b") == F.col("ib")).drop("ib")
    hit = both.select("a", "b", "ta", "tb").mapInArrow(thrifty(compare), "a long, b long").distinct()
    return materialize(hit, f"{name}_links")


def _with_component(shared: DataFrame, comp: DataFrame) -> DataFrame:
    """Postings with their component, of shingles that still have two."""
    p = shared.join(comp, F.col("id") == F.col("node"), "left").select(
        "tok", "id", "pos", "n", "need", "df", F.coalesce("comp", "id").alias("comp"))
    p = materialize(p, "op9_postings")
    open_ = p.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select(F.col("tok").alias("otok"))
    open_ = materialize(open_, "op9_open")
    return p.join(open_, F.col("tok") == F.col("otok")).drop("otok")


def shared_prefixes(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """``tok, id, pos, n, need, df``: prefix shingles that several representatives
    share, of those that share enough of them to be in a pair."""
    postings = rows.select("id", F.posexplode("prefix").alias("pos", "tok"))
    lists = materialize(postings.groupBy("tok").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("tok").alias("ltok")), "op9_lists")
    some = postings.join(lists, F.col("tok") == F.col("ltok")).select("tok", "id", "pos").distinct()
    some = materialize(some.join(meta.select(F.col("id").alias("mid"), "n", "need").distinct(), F.col("id") == F.col("mid")).drop("mid"), "op9_some")
    lists = some.groupBy("tok").agg(F.count(F.lit(1)).alias("df"), F.min("need").alias("least")).filter("df > 1")
    lists = materialize(lists.withColumnRenamed("tok", "ltok"), "op9_lists")
    some = materialize_by(some.join(lists, F.col("tok") == F.col("ltok")).drop("ltok"), "op9_listed", "id")
    enough = some.groupBy("id").agg(F.count(F.lit(1)).alias("met"), F.min(F.least("need", "least")).alias("least"))
    enough = materialize(enough.filter("met >= least").select(F.col("id").alias("eid")), "op9_enough")
    return materialize(some.join(enough, F.col("id") == F.col("eid")).select("tok", "id", "pos", "n", "need", "df"), "op9_shared")


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85):
    """``(rows, comp)``: ``id, n, rep`` per row (``rep``: smallest id with the
    same set) and ``node, comp`` of the representatives that have links."""
    spark = docs.sparkSession
    docs = _ids(docs, id_col, text_col)
    rows = materialize(signatures(docs, k, percent), "op9_rows")
    same = materialize(rows.filter("n > 0").groupBy("n", "f1", "f2").agg(F.min("id").alias("rep")).select(
        F.col("n").alias("sn"), F.col("f1").alias("s1"), F.col("f2").alias("s2"), "rep"), "op9_same")
    on = (F.col("n") == F.col("sn")) & (F.col("f1") == F.col("s1")) & (F.col("f2") == F.col("s2"))
    held = materialize(rows.drop("prefix").join(same, on, "left"), "op9_members")
    meta = materialize(held.filter("id = rep").select("id", "n", "need", "parity").distinct(), "op9_meta")
    shared = shared_prefixes(rows, meta)
    wanted = materialize(shared.select(F.col("id").alias("wid")).distinct(), "op9_wanted")
    texts = materialize_by(packed(docs).join(wanted, F.col("id") == F.col("wid"), "left_semi"), "op9_texts", "id")

    comp = spark.createDataFrame([], "node long, comp long")
    # a pair's own bound: both share l shingles within n - overlap + l of each,
    # where overlap is what the threshold takes of two sets of these sizes
    overlap = F.ceil(F.lit(percent) * (F.col("n") + F.col("on")) / F.lit(100.0 + percent) - F.lit(1e-9))
    l = F.least("need", "oneed")  # noqa: E741
    near = ((100 * F.least("n", "on") >= percent * F.greatest("n", "on"))
            & (F.col("pos") < F.col("n") - overlap + l) & (F.col("opos") < F.col("on") - overlap + l))
    hot = shared.filter(F.col("df") >= HOT)
    for r in range(ROUNDS):
        p = _with_component(hot, comp)
        # of each shingle's list, a member with few rarer shingles before it: it
        # is close to what the list's documents have in common
        draw = p.groupBy("tok").agg(F.min(F.struct(F.col("pos").alias("opos"), F.xxhash64("id", F.lit(r)).alias("o"), F.col("id").alias("oid"),
                                                   F.col("n").alias("on"), F.col("need").alias("oneed"), F.col("comp").alias("oc"))).alias("d"))
        draw = materialize(draw.select(F.col("tok").alias("dtok"), "d.*"), "op9_draw")
        star = p.join(draw, F.col("tok") == F.col("dtok")).filter((F.col("comp") != F.col("oc")) & near)
        # the partners that a document meets most often
        star = star.groupBy("id", "oid").agg(F.count(F.lit(1)).alias("met")).groupBy("id").agg(
            F.slice(F.sort_array(F.collect_list(F.struct("met", F.xxhash64("id", "oid", F.lit(r)).alias("o"), "oid")), False), 1, DRAWS).alias("os"))
        star = star.select("id", F.explode("os").alias("o")).select(F.least("id", "o.oid").alias("a"), F.greatest("id", "o.oid").alias("b")).distinct()
        found = _verified(_possible(star, meta, percent), texts, k, percent, "op9_star")
        if not found.limit(1).count():
            break
        comp = materialize(components(comp.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(found)), "op9_comp")
    p = _with_component(shared, comp)
    other = p.select(F.col("tok").alias("otok"), F.col("id").alias("oid"), F.col("pos").alias("opos"), F.col("n").alias("on"), F.col("need").alias("oneed"),
                     F.col("comp").alias("oc"))
    pairs = p.join(other, (F.col("tok") == F.col("otok")) & (F.col("comp") < F.col("oc")) & near)
    pairs = pairs.groupBy(F.col("id").alias("a"), F.col("oid").alias("b")).agg(
        F.count(F.lit(1)).alias("met"), F.min(F.least("need", "oneed")).alias("need"))
    pairs = pairs.filter("met >= need").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    found = _verified(_possible(pairs, meta, percent), texts, k, percent, "op9")
    comp = components(comp.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(found))
    return held.select("id", "n", "rep"), materialize(comp, "op9_comp")


def linked_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """``id, n, component`` per row: the smallest id reachable by links."""
    rows, comp = jaccard_links(docs, id_col, text_col, k, percent)
    out = rows.join(comp, F.col("rep") == F.col("node"), "left")
    return out.select("id", "n", F.coalesce("comp", "rep", "id").alias("component"))


def keep_one_of_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those that are near copies of a row with a
    smaller id; rows that repeat one id stay together."""
    gone = linked_components(docs, id_col, text_col, k, percent).filter("component < id").select(F.col("id").alias("_gone")).distinct()
    gone = materialize(gone, "op9_gone")
    return docs.join(gone, F.col(f"`{id_col}`").cast("long") == F.col("_gone"), "left_anti")


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    from convspark.sources.tables import read_table

    out = linked_components(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
