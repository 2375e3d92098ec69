"""Operator 2, substring dedup by a suffix array built block by block with
difference-cover ranks.

A byte goes if a string of ``WINDOW`` bytes around it also starts in a
document with a smaller id.  Equal strings stand next to each other in a
suffix array, which is built one bucket of suffixes at a time:

1.  Whole copies of a text are found by digest; their texts need no suffixes.
2.  Every window of the other texts is given the least hash among its 16-byte
    grams as its bucket, so equal windows share a bucket.  Spark range-sorts
    (bucket, document, position) and keeps buckets that several documents
    meet in; windows elsewhere cannot repeat.
3.  Segments of the kept windows are dealt to tasks by bucket.  A task sorts
    one block of buckets at a time: suffixes by their first ``PERIOD`` bytes,
    then ties by the ranks of difference-cover samples.  Positions in
    ``COVER`` modulo ``PERIOD`` are ranked beforehand; for any two suffixes
    some shift below ``PERIOD`` takes both to ranked positions, so one rank
    comparison settles a tie of any length.  Memory is bounded by the block.
    Equal segments of a block are sorted once.
4.  A bucket of more than ``HOT_BUCKET`` segments, or one that a boundary of
    the range sort cuts, is dealt out in parts of at most so many.  A part
    settles what repeats inside it and hands on, once for each distinct window,
    the windows that are least in it; a minimum over equal windows, as many
    rows as parts at most, settles those.

Defined cases
    * null text counts as empty; texts below ``WINDOW`` bytes lose nothing;
    * a null id is greater than every id; rows of the same id never take from
      each other, so repeated rows get the same result each;
    * only bytes count: a removal may cut a character in two, so the kept text
      is binary;
    * an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convspark.llm.common import materialize, parts_for, safe_text

WINDOW, GRAM = 50, 16
#: A difference cover: every difference modulo 13 is one of two members'.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Suffixes sorted at a time, segments of a bucket that one block may hold,
#: anchors in a partition of the range sort.
BLOCK, HOT_BUCKET, ANCHORS = 400_000, 10_000, 4_000_000
NO_ID = 2 ** 63 - 1
#: Bits of a position, above which the number of a bucket's part stands.
PART = 31


def words_at(raw, size: int = 8):
    """Big-endian integers of the eight bytes at every position."""
    import numpy as np

    padded = np.concatenate([raw, np.zeros(size, np.uint8)])
    return np.ndarray((len(raw),), ">u8", padded, strides=(1,)).astype(np.uint64)


def window_runs(raw, window: int = WINDOW):
    """Runs of neighbouring windows with one bucket: (bucket, anchor, first
    start, last start) arrays."""
    import numpy as np

    n = len(raw) - window + 1
    if n < 1:
        return (np.empty(0, np.int64),) * 4
    w = words_at(raw)
    grams = len(raw) - GRAM + 1
    x = w[:grams] * np.uint64(0x9E3779B97F4A7C15) + w[8:8 + grams] * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    # low six bits hold the position, which a span below 64 determines
    x = (x & np.uint64(2 ** 64 - 64)) | (np.arange(grams, dtype=np.uint64) & np.uint64(63))
    span, have = window - GRAM + 1, 1
    least = x
    while have * 2 <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[:len(least) - (span - have)], least[span - have:])
    start = np.arange(n)
    anchor = start + (((least & np.uint64(63)).astype(np.int64) - start) & 63)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    last = np.concatenate((first[1:] - 1, [n - 1]))
    return (least[first] >> np.uint64(6)).astype(np.int64), anchor[first], first, last


def cover_shift():
    """shift[a][b]: least d with a + d and b + d both in the cover."""
    import numpy as np

    table = np.zeros((PERIOD, PERIOD), np.int64)
    for a in range(PERIOD):
        for b in range(PERIOD):
            table[a, b] = next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER)
    return table


def suffix_order(text, starts, window: int = WINDOW):
    """``starts`` sorted by the text that follows, at least ``window`` bytes
    deep, and a flag per place: equal to the place before in ``window`` bytes.

    ``text`` must go on for ``window`` + ``PERIOD`` bytes after every start (what
    follows a piece of it only orders suffixes that are equal in the piece)."""
    import numpy as np

    w = words_at(text)
    # ranks of the cover's positions, as deep as ties are looked at
    sample = np.flatnonzero(np.isin(np.arange(len(text)) % PERIOD, COVER))
    sample = sample[sample + window <= len(text)]
    depth = [w[sample + d] for d in range(0, window - 7, 8)] + [w[sample + window - 8]]
    order = np.lexsort(depth[::-1])
    new = np.zeros(len(sample), bool)
    for key in depth:
        k = key[order]
        new[1:] |= k[1:] != k[:-1]
    rank = np.zeros(len(text), np.int64)
    rank[sample[order]] = np.cumsum(new)
    # the first PERIOD bytes: eight, and eight that end with the period
    first, second = w[starts], w[starts + PERIOD - 8]
    order = np.lexsort((second, first))
    s = starts[order]
    a, b = first[order], second[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    group = np.cumsum(new) - 1
    shift = cover_shift()
    # ties: every member meets its group's pivot in one rank comparison, and a
    # group falls into less, equal and greater, until all are equal
    open_ = np.flatnonzero(np.bincount(group)[group] > 1)
    while len(open_):
        g, t = group[open_], s[open_]
        head = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        size = np.diff(np.concatenate((head, [len(g)])))
        pivot = np.repeat(t[head + size // 2], size)
        d = shift[t % PERIOD, pivot % PERIOD]
        side = np.sign(rank[t + d] - rank[pivot + d])
        again = np.lexsort((side, g))
        s[open_], side, g = t[again], side[again], g[again]
        cut = np.concatenate(([True], (g[1:] != g[:-1]) | (side[1:] != side[:-1])))
        new[open_] |= cut
        group = np.cumsum(new) - 1
        # members equal to their pivot are settled
        left = side != 0
        open_ = open_[left]
        open_ = open_[np.bincount(group)[group[open_]] > 1] if len(open_) else open_
    same = np.zeros(len(s), bool)
    if len(s) > 1:
        same[1:] = True
        for d in [*range(0, window - 7, 8), window - 8]:
            key = w[s + d]
            same[1:] &= key[1:] == key[:-1]
    return s, same


def least_in_block(data, sizes, ids, window: int = WINDOW):
    """(flags, classes, firsts) per window start of the pieces (``data`` is
    their bytes in one line): whether the window also starts in a piece of a
    smaller id, the number of its text, and where each row's starts begin."""
    import numpy as np

    # equal pieces have equal windows: the one of the least id is sorted
    body, ends = data.tobytes(), np.cumsum(sizes)
    number: dict[bytes, int] = {}
    kind = np.fromiter((number.setdefault(body[a:b], len(number)) for a, b in zip((ends - sizes).tolist(), ends.tolist())), np.int64, len(sizes))
    owners = np.full(len(number), NO_ID)
    np.minimum.at(owners, kind, ids)
    text = np.concatenate([np.frombuffer(b"".join(number), np.uint8), np.zeros(window + PERIOD, np.uint8)])
    lengths = np.fromiter(map(len, number), np.int64, len(number))
    n = lengths - window + 1
    begin = np.cumsum(n) - n
    starts = np.repeat(np.cumsum(lengths) - lengths - begin, n) + np.arange(int(n.sum()))
    s, same = suffix_order(text, starts, window)
    place = np.zeros(len(text), np.int64)
    place[starts] = np.arange(len(starts))
    at = place[s]
    head = np.flatnonzero(~same)
    least = np.minimum.reduceat(np.repeat(owners, n)[at], head)
    cls = np.empty(len(starts), np.int64)
    cls[at] = np.cumsum(~same) - 1
    # back to the pieces as they came
    m = n[kind]
    first = np.cumsum(m) - m
    cls = cls[np.repeat(begin[kind] - first, m) + np.arange(int(m.sum()))]
    return least[cls] < np.repeat(ids, m), cls, first


def repeats_in_block(data, sizes, ids, window: int = WINDOW):
    """Flags per window start of the pieces: whether the window also starts in
    a piece of a smaller id."""
    return least_in_block(data, sizes, ids, window)[0]


def binary_parts(column):
    """(bytes in one line, sizes) of an Arrow binary array."""
    import numpy as np

    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[off[0]:off[-1]] if body else np.empty(0, np.uint8)
    return data, np.diff(off)


_ANCHOR = "bucket long, id long, pos int"


def _anchors(batches):
    import numpy as np
    import pyarrow as pa

    for b in batches:
        out: list[list] = [[], [], []]
        for i, body in zip(b.column(0).to_pylist(), b.column(1)):
            bucket, anchor, _, _ = window_runs(np.frombuffer(body.as_buffer(), np.uint8))
            out[0].append(bucket)
            out[1].append(np.full(len(bucket), i, np.int64))
            out[2].append(anchor.astype(np.int32))
        if out[0]:
            cols = [np.concatenate(x) for x in out]
            for at in range(0, len(cols[0]), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(c[at:at + (1 << 18)]) for c in cols], names=["bucket", "id", "pos"])


def _met(batches, hot: int):
    """Of rows sorted by (bucket, id): those of buckets with several ids, each
    as its position and, above it, the number of the part that it is dealt to:
    0 for whole buckets.  The partition's first and last bucket may go on next
    door; they and large ones are kept in numbered parts."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    number = 1 + (TaskContext.get().partitionId() << 16)
    held: list = []          # rows of the last bucket
    last, size, cut = None, 0, True

    def part(rows):
        nonlocal number
        ids, pos = (np.concatenate([r[i] for r in rows]) for i in (0, 1))
        for at in range(0, len(ids), hot):
            yield ids[at:at + hot], pos[at:at + hot] + (number << PART)
            number += 1

    def ended():
        if held and (size > hot or cut):
            yield from part(held)
        elif held and held[0][0][0] != held[-1][0][-1]:         # sorted by id within a bucket
            yield from held

    for b in batches:
        if not b.num_rows:
            continue
        bucket, ids, pos = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().astype(np.int64)
        head = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        end = np.concatenate((head[1:], [len(bucket)]))
        out = []
        k = 0
        if last == bucket[0]:
            held.append((ids[:end[0]], pos[:end[0]]))
            size += int(end[0])
            k = 1
        if k < len(head):
            out += ended() if last is not None else []
            held, size, cut = [], 0, last is None
            if cut and len(head) > 1:                            # the partition's first bucket
                out += part([(ids[:end[0]], pos[:end[0]])])
                k, cut = 1, False
            whole = slice(k, len(head) - 1)
            many = (ids[head[whole]] != ids[end[whole] - 1]) & (end[whole] - head[whole] <= hot)
            take = np.zeros(len(ids), bool)
            if len(many):
                take[head[k]:end[-2]] = np.repeat(many, (end - head)[whole])
            if take.any():
                out.append((ids[take], pos[take]))
            for j in np.flatnonzero(end[whole] - head[whole] > hot) + k:
                out += part([(ids[head[j]:end[j]], pos[head[j]:end[j]])])
            held, size = [(ids[head[-1]:], pos[head[-1]:])], int(end[-1] - head[-1])
        if size > hot:
            out += part(held)
            held, cut = [], True                                 # what follows of it is in parts too
            size = 0
        last = bucket[-1]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["id", "pos"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*part(held))], names=["id", "pos"])


def _segments(batches):
    """Of each text, the bytes of its runs whose anchors are wanted."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        out: list[list] = [[], [], [], [], []]
        bodies, sizes = [], []
        for i, th, body, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
            raw = np.frombuffer(body.as_buffer(), np.uint8)
            bucket, anchor, first, last = window_runs(raw)
            at = np.asarray(wanted.values)
            at, number = at & ((1 << PART) - 1), at >> PART
            j = np.searchsorted(anchor, at)
            known = j < len(anchor)              # an id may have several texts
            known[known] = anchor[j[known]] == at[known]
            j, number = j[known], number[known]
            n = last[j] - first[j] + WINDOW
            sizes.append(n)
            bodies.append(raw[np.repeat(first[j] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
            for k, x in enumerate((bucket[j], number, np.full(len(j), i, np.int64), np.full(len(j), th, np.int64), first[j].astype(np.int32))):
                out[k].append(x)
        if not sizes:
            continue
        sizes, data = np.concatenate(sizes), np.concatenate(bodies)
        cols = [np.concatenate(x) for x in out]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        for at in range(0, len(sizes), 1 << 16):
            e = ends[at:at + (1 << 16) + 1]
            piece = pa.Array.from_buffers(pa.binary(), len(e) - 1, [None, pa.py_buffer((e - e[0]).astype(np.int32)),
                                                                    pa.py_buffer(np.ascontiguousarray(data[e[0]:e[-1]]))])
            yield pa.RecordBatch.from_arrays([*(pa.array(c[at:at + (1 << 16)]) for c in cols), piece],
                                             names=["bucket", "part", "id", "th", "at", "piece"])


_RUN = "id long, th long, lo int, hi int, win binary, spots array<struct<th:long,lo:int>>"


def _sorted_blocks(batches):
    """Rows sorted by bucket and part -> runs of repeated window starts, and
    each window that is least in its part of a bucket with all its starts."""
    import numpy as np
    import pyarrow as pa

    spot = pa.list_(pa.struct([("th", pa.int64()), ("lo", pa.int32())]))
    names = ["id", "th", "lo", "hi", "win", "spots"]

    def flush(parts):
        number, ids, th, first = (np.concatenate([p.column(i).to_numpy() for p in parts]) for i in (1, 2, 3, 4))
        data, sizes = zip(*(binary_parts(p.column(5)) for p in parts))
        data, sizes = np.concatenate(data), np.concatenate(sizes)
        flags, cls, begin = least_in_block(data, sizes, ids)
        n = sizes - WINDOW + 1
        row = np.repeat(np.arange(len(n)), n)
        edge = np.flatnonzero(flags)          # runs end where flags or pieces do
        if len(edge):
            new = np.concatenate(([True], (edge[1:] != edge[:-1] + 1) | (row[edge[1:]] != row[edge[:-1]])))
            lo, hi = edge[new], edge[np.concatenate((new[1:], [True]))]
            r = row[lo]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[r]), pa.array(th[r]), pa.array((first[r] + lo - begin[r]).astype(np.int32)),
                 pa.array((first[r] + hi - begin[r]).astype(np.int32)), pa.nulls(len(r), pa.binary()), pa.nulls(len(r), spot)], names=names)
        # in a part of a bucket, what is least here may repeat elsewhere
        left = np.flatnonzero(~flags & np.repeat(number > 0, n))
        if not len(left):
            return
        left = left[np.lexsort((left, cls[left]))]
        head = np.flatnonzero(np.concatenate(([True], cls[left[1:]] != cls[left[:-1]])))
        ends = np.concatenate((head, [len(left)])).astype(np.int32)
        r = row[left]
        spots = pa.StructArray.from_arrays([pa.array(th[r]), pa.array((first[r] + left - begin[r]).astype(np.int32))], ["th", "lo"])
        spots = pa.ListArray.from_arrays(pa.array(ends), spots).cast(spot)
        one = left[head]
        at = (np.cumsum(sizes) - sizes)[row[one]] + one - begin[row[one]]
        for x in range(0, len(one), 1 << 14):
            o, a = one[x:x + (1 << 14)], at[x:x + (1 << 14)]
            wins = pa.Array.from_buffers(pa.binary(), len(o), [None, pa.py_buffer(np.arange(len(o) + 1, dtype=np.int32) * WINDOW),
                                                               pa.py_buffer(np.ascontiguousarray(data[a[:, None] + np.arange(WINDOW)]))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[row[o]]), pa.nulls(len(o), pa.int64()), pa.nulls(len(o), pa.int32()), pa.nulls(len(o), pa.int32()),
                 wins, spots.slice(x, len(o))], names=names)

    parts: list = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        bucket, number = b.column(0).to_numpy(), b.column(1).to_numpy()
        _, sizes = binary_parts(b.column(5))
        # blocks end between buckets or their parts
        head = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (number[1:] != number[:-1]))))
        have = np.concatenate(([0], np.cumsum(sizes - WINDOW + 1)))
        at = 0
        for h in [*head.tolist(), b.num_rows]:
            goes_on = h == 0 and parts and [parts[-1].column(i)[-1].as_py() for i in (0, 1)] == [bucket[0], number[0]]
            if size + have[h] - have[at] >= BLOCK and not goes_on and h < b.num_rows:
                if h > at:
                    parts.append(b.slice(at, h - at))
                yield from flush(parts)
                parts, size, at = [], 0, h
        if at < b.num_rows:
            parts.append(b.slice(at))
            size += have[-1] - have[at]
    if parts:
        yield from flush(parts)


def _least_of_parts(left: DataFrame) -> DataFrame:
    """Runs among the windows that were least in their parts of a bucket."""
    met = left.withColumn("least", F.min("id").over(Window.partitionBy("win"))).filter("least < id")
    met = met.select("id", F.explode("spots").alias("s"))
    return met.select("id", "s.th", "s.lo", F.col("s.lo").alias("hi"))


def repeated_runs(rows: DataFrame) -> DataFrame:
    """``id, th, lo, hi``: runs of window starts that also start in a smaller
    id, for rows ``id, th, body`` of distinct texts."""
    spark = rows.sparkSession
    long_ = rows.filter(F.octet_length("body") >= WINDOW)
    # anchors are about 2 / (WINDOW - GRAM + 2) of the bytes
    total = long_.agg(F.sum(F.octet_length("body"))).head()[0] or 0
    parts = parts_for(spark, int(total * 2 / (WINDOW - GRAM + 2)), ANCHORS)
    anchors = long_.select("id", "body").mapInArrow(_anchors, _ANCHOR)
    met = anchors.repartitionByRange(parts, "bucket", "id", "pos").sortWithinPartitions("bucket", "id", "pos").mapInArrow(
        lambda batches, hot=HOT_BUCKET: _met(batches, hot), "id long, pos long")
    wanted = met.groupBy("id").agg(F.collect_set("pos").alias("wanted"))
    wanted = materialize(wanted.withColumnRenamed("id", "wid"), "op2_wanted", drop_shuffles=True)
    pieces = long_.join(wanted, F.col("id") == F.col("wid")).select("id", "th", "body", "wanted").mapInArrow(
        _segments, "bucket long, part long, id long, th long, at int, piece binary")
    found = pieces.repartition(parts, "bucket", "part").sortWithinPartitions("bucket", "part").mapInArrow(_sorted_blocks, _RUN)
    found = materialize(found, "op2_found", drop_shuffles=True)
    runs = found.filter("win is null").select("id", "th", "lo", "hi")
    return runs.unionByName(_least_of_parts(found.filter("win is not null").select("id", "win", "spots")))


_OUT = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
                     T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
                     T.StructField("kept", T.BinaryType())])


def _cut_out(batches):
    """(id, body, whole, runs) -> what stays of each body."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        out: list[list] = [[], [], [], []]
        for body, whole, runs in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
            data = body.as_buffer()
            n = len(data)
            spans = []
            if whole:
                spans = [[0, n]]
            elif runs:
                for r in sorted(runs, key=lambda r: r["lo"]):
                    if spans and r["lo"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r["hi"] + WINDOW)
                    else:
                        spans.append([r["lo"], r["hi"] + WINDOW])
            at, kept = 0, []
            for x, y in spans:
                kept.append(data.slice(at, x - at).to_pybytes())
                at = y
            kept.append(data.slice(at, n - at).to_pybytes())
            out[0].append(n)
            out[1].append(sum(y - x for x, y in spans))
            out[2].append([{"start": x, "end": y} for x, y in spans])
            out[3].append(b"".join(kept))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
             pa.array(out[2], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(out[3], pa.binary())],
            names=[f.name for f in _OUT])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_removed, spans, kept`` for every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("own"), safe_text(text_col).alias("t"))
    rows = rows.select("own", F.coalesce("own", F.lit(NO_ID)).alias("id"), F.xxhash64("t").alias("th"), F.col("t"))
    digests = materialize(rows.select("id", "th", F.sha2("t", 256).alias("sha"), F.octet_length("t").alias("n")).filter(
        F.col("n") >= WINDOW).groupBy("sha", "id", "th").agg(F.count(F.lit(1)).alias("c")), "op2_digests", drop_shuffles=True)
    groups = materialize(digests.groupBy("sha").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("ids")).filter("ids > 1")
                         .select(F.col("sha").alias("gsha"), "least"), "op2_groups", drop_shuffles=True)
    copies = digests.join(groups, F.col("sha") == F.col("gsha")).filter("id > least").select(F.col("id").alias("cid"), F.col("th").alias("cth"))
    copies = materialize(copies.distinct(), "op2_copies", drop_shuffles=True)
    same = (F.col("id") == F.col("cid")) & (F.col("th") == F.col("cth"))
    bodies = rows.select("id", "th", F.col("t").cast("binary").alias("body"))
    runs = repeated_runs(bodies.join(copies, same, "left_anti"))
    runs = runs.groupBy("id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    lost = copies.select(F.col("cid").alias("rid"), F.col("cth").alias("rth"), F.lit(True).alias("whole"),
                         F.lit(None).cast("array<struct<lo:int,hi:int>>").alias("runs"))
    lost = lost.unionByName(runs.select(F.col("id").alias("rid"), F.col("th").alias("rth"), F.lit(False).alias("whole"), "runs"))
    lost = materialize(lost, "op2_lost", drop_shuffles=True)
    every = rows.join(lost, (F.col("id") == F.col("rid")) & (F.col("th") == F.col("rth")), "left")
    return every.select("own", F.col("t").cast("binary").alias("body"), F.coalesce("whole", F.lit(False)).alias("whole"), "runs").mapInArrow(_cut_out, _OUT)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    from convspark.sources.tables import read_table

    out = remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))
