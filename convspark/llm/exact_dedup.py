"""Operator 3, exact dedup by composable polynomial fingerprints.

A text is cut into byte segments and each segment into chunks.  A chunk's
hash is its bytes read as a polynomial in a fixed base, modulo two primes.
Hashes of neighbouring chunks combine by length-shifted arithmetic,
``H(ab) = H(a) * r**len(b) + H(b)``, so every chunk can be hashed anywhere and
the document's fingerprint is a plain sum of shifted chunk hashes, which
Spark adds up with map-side combine.  Texts with equal length and fingerprint
are candidates only: each is compared, chunk by chunk, with its group's
representative, and rows that differ are grouped anew until none are left.

Defined cases
    * null text counts as the empty text; empty texts equal each other;
    * repeated rows (same id, same text) count in ``group_size`` and exactly
      one of them stays; the same id with two texts is two documents;
    * a null id is smaller than every id, so it stays only in a group
      without any id;
    * an empty table gives an empty result; columns other than the id and
      the text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convspark.llm.common import materialize, safe_text, thrifty

#: Primes below 2**31 and the bases of the two polynomial lanes.
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
#: Bytes of one row sent to a task, and of one chunk hashed or compared.
SEGMENT = 1 << 22
CHUNK = 1 << 16
#: Members of a group compared with one copy of its representative.
FAN_IN = 512

_TERM = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("sha", T.StringType()),
    T.StructField("n", T.LongType()), T.StructField("seg", T.LongType()),
    T.StructField("t0", T.LongType()), T.StructField("t1", T.LongType()),
])


def chunk_terms(primes=PRIMES, bases=BASES, chunk: int = CHUNK, segment: int = SEGMENT):
    """Arrow function: segment rows -> their shifted hashes in both lanes."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        powers = []
        for p, r in zip(primes, bases):
            w = np.empty(chunk, np.uint64)
            x = 1
            for i in range(chunk):
                w[chunk - 1 - i] = x
                x = x * r % p
            powers.append(w)

        def value(data, lane):
            """Horner over chunks: shift what is known, add the next chunk."""
            p, r, w = primes[lane], bases[lane], powers[lane]
            h = 0
            for at in range(0, len(data), chunk):
                part = data[at:at + chunk]
                h = (h * pow(r, len(part), p) + int(np.dot(part, w[chunk - len(part):]))) % p
            return h

        for b in batches:
            pieces, n, seg = b.column("piece"), b.column("n").to_pylist(), b.column("seg").to_pylist()
            lanes: list[list[int]] = [[], []]
            for i, piece in enumerate(pieces):
                data = np.frombuffer(piece.as_buffer(), np.uint8).astype(np.uint64)
                after = n[i] - seg[i] * segment - len(data)
                for lane in (0, 1):
                    lanes[lane].append(value(data, lane) * pow(bases[lane], after, primes[lane]) % primes[lane])
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("sha"), b.column("n"), b.column("seg"),
                 pa.array(lanes[0], pa.int64()), pa.array(lanes[1], pa.int64())],
                names=["id", "sha", "n", "seg", "t0", "t1"])

    return run


def _cut(bytes_col: str, size: int):
    """Array of (seg, piece) of a binary column; an empty text has one."""
    last = f"greatest(cast(ceil(octet_length({bytes_col}) / {size}D) as bigint), 1L) - 1L"
    return F.expr(f"transform(sequence(0L, {last}), s -> struct(s as seg, "
                  f"substring({bytes_col}, cast(s * {size} + 1 as int), {size}) as piece))")


def fingerprints(df: DataFrame, id_col: str, text_col: str, primes=PRIMES, bases=BASES,
                 segment: int = SEGMENT, chunk: int = CHUNK) -> DataFrame:
    """One row per distinct (id, text): id, sha, n bytes, f0, f1, n_rows."""
    body = df.select(F.col(id_col).cast("long").alias("id"), safe_text(text_col).alias("t"))
    body = body.select("id", F.sha2("t", 256).alias("sha"), F.col("t").cast("binary").alias("b"))
    cut = body.select("id", "sha", F.octet_length("b").cast("long").alias("n"),
                      F.explode(_cut("b", segment)).alias("s")).select("id", "sha", "n", "s.seg", "s.piece")
    terms = cut.mapInArrow(thrifty(chunk_terms(primes, bases, chunk, segment)), _TERM)
    summed = terms.groupBy("id", "sha", "n").agg(
        F.count_if(F.col("seg") == 0).alias("n_rows"), F.sum("t0").alias("s0"), F.sum("t1").alias("s1"))
    # repeated rows add the same terms n_rows times over
    return summed.select("id", "sha", "n", "n_rows",
                         F.expr(f"(s0 div n_rows) % {primes[0]}L").alias("f0"),
                         F.expr(f"(s1 div n_rows) % {primes[1]}L").alias("f1"))


def _groups(units: DataFrame) -> DataFrame:
    return units.groupBy("n", "f0", "f1").agg(
        F.max("id").alias("keep_id"), F.sum("n_rows").alias("group_size"), F.count(F.lit(1)).alias("n_units"),
        F.max_by("sha", F.struct("id", "sha")).alias("keep_sha"))


def _differing(df: DataFrame, units: DataFrame, groups: DataFrame, id_col: str, text_col: str,
               chunk: int, name: str) -> DataFrame:
    """Units whose bytes differ from their group's representative."""
    many = groups.filter("n_units > 1").select(
        F.col("n").alias("gn"), F.col("f0").alias("g0"), F.col("f1").alias("g1"), "keep_id", "keep_sha", "n_units")
    member = units.join(many, (F.col("n") == F.col("gn")) & (F.col("f0") == F.col("g0")) & (F.col("f1") == F.col("g1")))
    member = member.select(
        F.col("id").alias("mid"), F.col("sha").alias("msha"), "n", "f0", "f1",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("sha") == F.col("keep_sha"))).alias("is_rep"),
        F.ceil(F.col("n_units") / FAN_IN).cast("int").alias("salts"))
    member = materialize(member, f"{name}_members")
    body = df.select(F.col(id_col).cast("long").alias("id"), safe_text(text_col).alias("t")).select(
        "id", F.sha2("t", 256).alias("sha"), F.col("t").cast("binary").alias("b"))
    # a merge join at any size: members grow with the documents, whatever their files' size
    texts = body.join(member.hint("merge"), F.col("id").eqNullSafe(F.col("mid")) & (F.col("sha") == F.col("msha")))
    pieces = texts.select("id", "sha", "n", "f0", "f1", "is_rep", "salts", F.explode(_cut("b", chunk)).alias("s")).select(
        "id", "sha", "n", "f0", "f1", "is_rep", "salts", "s.seg", "s.piece")
    rep = pieces.filter("is_rep").select(
        F.col("n").alias("rn"), F.col("f0").alias("r0"), F.col("f1").alias("r1"), F.col("seg").alias("rseg"),
        F.explode(F.expr("sequence(0, salts - 1)")).alias("rsalt"), F.col("piece").alias("rpiece"))
    other = pieces.filter("not is_rep").withColumn("salt", F.expr("cast(pmod(xxhash64(id, sha), salts) as int)"))
    paired = other.join(rep, (F.col("n") == F.col("rn")) & (F.col("f0") == F.col("r0")) & (F.col("f1") == F.col("r1"))
                        & (F.col("seg") == F.col("rseg")) & (F.col("salt") == F.col("rsalt")))
    return paired.filter("piece <> rpiece").select("id", "sha").distinct()


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", primes=PRIMES, bases=BASES,
                 segment: int = SEGMENT, chunk: int = CHUNK) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, sha, copy``.

    ``kept`` marks the one row of each class of equal texts with the largest
    id (``copy`` 0 of it, where that row is repeated)."""
    pending = materialize(fingerprints(df, id_col, text_col, primes, bases, segment, chunk), "op3_units")
    settled = None
    while True:
        groups = materialize(_groups(pending), "op3_groups")
        bad = materialize(_differing(df, pending, groups, id_col, text_col, chunk, "op3"), "op3_bad")
        clash = bad.limit(1).count() > 0
        same = pending
        if clash:
            # a collision of fingerprints: the texts that differ wait for the next round
            hit = bad.select(F.col("id").alias("bid"), F.col("sha").alias("bsha"))
            on = F.col("id").eqNullSafe(F.col("bid")) & (F.col("sha") == F.col("bsha"))
            same = materialize(pending.join(hit, on, "left_anti"), "op3_same")
            pending = materialize(pending.join(hit, on, "left_semi"), "op3_pending")
            groups = materialize(_groups(same), "op3_groups")
        g = groups.filter("group_size > 1").select(
            F.col("n").alias("gn"), F.col("f0").alias("g0"), F.col("f1").alias("g1"), "keep_id", "keep_sha", "group_size")
        done = same.join(g, (F.col("n") == F.col("gn")) & (F.col("f0") == F.col("g0")) & (F.col("f1") == F.col("g1")), "left")
        done = done.select(
            "id", F.coalesce("keep_id", "id").alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
            (F.col("keep_sha").isNull() | (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("sha") == F.col("keep_sha")))).alias("is_rep"),
            "sha", "n_rows")
        settled = done if settled is None else settled.unionByName(done)
        if not clash:
            break
    rows = settled.withColumn("copy", F.explode(F.expr("sequence(0L, n_rows - 1L)")))
    return rows.select("id", "keep_id", "group_size", (F.col("is_rep") & (F.col("copy") == 0)).alias("kept"), "sha", "copy")


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the copies: of equal texts, one row of the largest id."""
    g = exact_groups(df, id_col, text_col).filter("copy = 0").groupBy("id", "sha").agg(F.max("kept").alias("kept"),
                                                                                      F.max("group_size").alias("gs"))
    keep = materialize(g.filter("kept").select(F.col("id").alias("_keep_id"), F.col("sha").alias("_keep_sha"),
                                               F.col("gs").alias("_keep_size")), "op3_keep")
    cols = [F.col(f"`{c}`") for c in df.columns]
    hit = df.join(keep, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("_keep_id"))
                  & (F.sha2(safe_text(text_col), 256) == F.col("_keep_sha")))
    once = hit.filter("_keep_size = 1").select(*cols)
    again = hit.filter("_keep_size > 1").dropDuplicates(["_keep_id", "_keep_sha"]).select(*cols)
    return once.unionByName(again)


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from convspark.sources.tables import read_table

    g = exact_groups(read_table(spark, sf_dir, "documents"))
    return g.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


ORACLE = {"op3_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""}
