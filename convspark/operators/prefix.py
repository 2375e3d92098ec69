"""Running maxima and counts over a key's ordered rows that stay parallel
when one key holds a large share of all rows.

``Window.partitionBy(key).orderBy(seq)`` sorts each key in one task.  Here
rows are cut into blocks of consecutive ``seq``, by the quantiles of ``seq``
over all rows (or ``seq >> block_bits``, where ``seq`` is known to be dense):
per-block aggregates are map-side combined, a small window over the blocks
of a key carries the aggregate of all earlier blocks, and the running value
inside a block is a window over ``(key, block)``.  The join that brings the
carried value in and that window share one partitioning, so the rows are
shuffled once and a hot key is spread over its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 64                # quantiles of seq
BLOCK_ROWS = 1 << 16      # rows (of all keys) to a block


def block_of(df: DataFrame, seq: str) -> Column | None:
    """A block number that rises with ``seq``, or None for a table that fits
    one block: the quantile cell of the row
    and, for tables of more than ``CELLS * BLOCK_ROWS`` rows, its even part of
    that cell.

    The quantiles are those of all rows, so a block holds about a ``CELLS``-th
    of them at most, whatever keys they have: no key's part of a block can be
    larger, and a key has no more blocks than there are, however sparse its
    ``seq`` (time stamps, say).  One narrow aggregate, of which a few numbers
    reach the driver."""
    v = F.col(seq).cast("long")
    at = F.percentile_approx(v, [i / CELLS for i in range(1, CELLS)], 10_000)
    got = df.agg(at.alias("q"), F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).head()
    cells = min(CELLS, -(-got.n // BLOCK_ROWS))
    if cells <= 1:
        return None
    bounds = sorted({got.q[CELLS * i // cells - 1] for i in range(1, cells)})
    cell = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda q: q <= v)).cast("long")
    parts = -(-got.n // (CELLS * BLOCK_ROWS))
    if parts == 1:
        return cell
    edges = F.array(*map(F.lit, [got.lo, *bounds, got.hi + 1]))
    low, high = F.get(edges, cell.cast("int")), F.get(edges, cell.cast("int") + 1)
    return cell * parts + F.least(F.lit(parts - 1), F.floor((v - low) / F.greatest(high - low, F.lit(1)) * parts))


def running(df: DataFrame, keys, seq: str, maxes: dict | None = None, sums: dict | None = None,
            block_bits: int | None = None, block: Column | bool | None = None) -> DataFrame:
    """Add running aggregates per ``keys`` ordered by ``seq`` (unique per key,
    not null).

    ``maxes`` / ``sums``: ``name -> (expr, inclusive)``; the value is the max
    (nulls ignored, null if none) or the sum (0 if none) of ``expr`` over the
    rows with ``seq`` <= (inclusive) or < this row's ``seq``.  ``block_bits``
    cuts blocks by a shift of ``seq`` instead of its quantiles, which saves
    their pass over the table; only for a dense ``seq``.  ``block`` is a result
    of ``block_of`` to use again (False: the table fits one block)."""
    keys = list(keys)
    maxes, sums = maxes or {}, sums or {}
    if block is None:
        block = block_of(df, seq) if block_bits is None else F.shiftright(F.col(seq).cast("long"), block_bits)
    if block is None or block is False:       # no more rows than a block holds
        w = Window.partitionBy(*keys).orderBy(seq)
        within = lambda incl: w.rowsBetween(Window.unboundedPreceding, 0 if incl else -1)
        return df.withColumns({**{n: F.max(e).over(within(incl)) for n, (e, incl) in maxes.items()},
                               **{n: F.coalesce(F.sum(e).over(within(incl)), F.lit(0)) for n, (e, incl) in sums.items()}})
    x = df.withColumn("_blk", block)
    for n, (e, _) in {**maxes, **sums}.items():
        x = x.withColumn(f"_v_{n}", e)
    per_block = x.groupBy(*keys, "_blk").agg(
        *[F.max(f"_v_{n}").alias(f"_m_{n}") for n in maxes],
        *[F.sum(f"_v_{n}").alias(f"_m_{n}") for n in sums])
    wb = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_block.select(
        *keys, "_blk",
        *[F.max(f"_m_{n}").over(wb).alias(f"_c_{n}") for n in maxes],
        *[F.coalesce(F.sum(f"_m_{n}").over(wb), F.lit(0)).alias(f"_c_{n}") for n in sums])
    y = x.join(carry, [*keys, "_blk"])

    def frame(incl):
        return Window.partitionBy(*keys, "_blk").orderBy(seq).rowsBetween(Window.unboundedPreceding,
                                                                          0 if incl else -1)
    for n, (_, incl) in maxes.items():
        y = y.withColumn(n, F.greatest(F.col(f"_c_{n}"), F.max(f"_v_{n}").over(frame(incl))))
    for n, (_, incl) in sums.items():
        y = y.withColumn(n, F.col(f"_c_{n}") + F.coalesce(F.sum(f"_v_{n}").over(frame(incl)), F.lit(0)))
    names = list(maxes) + list(sums)
    return y.drop("_blk", *[f"_v_{n}" for n in names], *[f"_c_{n}" for n in names])


def running_max(df: DataFrame, keys, seq: str, values: dict, inclusive: bool = True,
                block_bits: int | None = None) -> DataFrame:
    """Shorthand: running maxima of ``name -> expr`` (all with one bound)."""
    return running(df, keys, seq, maxes={n: (e, inclusive) for n, e in values.items()}, block_bits=block_bits)


def last_value_before(df: DataFrame, keys, seq: str, marker: Column, value: Column, name: str,
                      inclusive: bool = True, block_bits: int | None = None) -> DataFrame:
    """``value`` of the latest row (by ``seq``) where ``marker`` holds: a
    running ``max(struct(seq, value))``; null when there is none."""
    packed = F.when(marker, F.struct(F.col(seq).cast("long").alias("s"), value.alias("v")))
    out = running(df, keys, seq, maxes={"_pk": (packed, inclusive)}, block_bits=block_bits)
    return out.withColumn(name, F.col("_pk.v")).drop("_pk")
