"""Operator 1, benchmark decontamination by pigeonhole edit matching.

An item of m characters may occur in a document with up to
``k = floor(error_rate * m)`` edits.  It is split into k + 1 pieces: k edits
cannot touch them all, so at least one piece occurs unchanged.  One
Aho-Corasick pass over a text finds all exact piece hits; each hit fixes the
window the item could fill.  Myers' bit-parallel distance verifies it, from
the piece upwards: of j neighbouring pieces with fewer than j edits, one half
has fewer edits than pieces as well, so a hit that fails on two pieces with
one edit needs no check of the whole item.  Windows that stay are merged and
decided by the whole item's distance.  Nothing is missed or guessed.

Case and runs of white space are evened out on both sides before matching.

The benchmark is the stated query set; the texts never shuffle.  Items are
cut into blocks of at most ``BLOCK_CHARS`` characters; each block is sent to
the tasks once and scanned over all rows, block after block, so what is
broadcast at a time has a fixed bound however long the benchmark is.

Defined cases
    * null or empty texts match nothing; null items, and items that are
      shorter than ``MIN_CHARS`` once evened out, are no test items;
    * repeated items (same id) are searched once each; a document that holds
      an item several times reports it once with the smallest distance;
    * repeated rows are judged row by row; all columns are carried through;
    * an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convspark.llm.common import thrifty

ERROR_RATE = 0.1
MIN_CHARS = 40
#: Characters of benchmark text that one broadcast block holds at most
#: (plus the one item that crosses the mark).
BLOCK_CHARS = 1_000_000


def even_out(text: str) -> str:
    return " ".join(text.lower().split())


def pieces_of(item: str, error_rate: float) -> tuple[int, list[tuple[int, str]]]:
    """Error budget and the budget + 1 (offset, piece) parts of an item."""
    k = int(error_rate * len(item))
    cuts = [len(item) * j // (k + 1) for j in range(k + 2)]
    return k, [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers_best(masks: dict[str, int], m: int, text: str, limit: int) -> tuple[int, int] | None:
    """Smallest edit distance of the whole item to any substring of ``text``
    and that substring's end, if the distance is within ``limit``."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best = None
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up) & full
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full          # a match may start anywhere: no carry in
        mh = mh << 1 & full
        up = mh | ~(xv | ph) & full
        down = ph & xv
        if score <= limit and (best is None or score < best[0]):
            best = (score, j + 1)
            if score == 0:
                break
    return best


def myers_within(masks: dict[str, int], m: int, text: str, limit: int) -> bool:
    """Whether any substring of ``text`` is within ``limit`` edits."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    for left, c in zip(range(len(text) - 1, -1, -1), text):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up) & full
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score <= limit:
                return True
        if score - left > limit:     # what is left cannot make up for it
            return False
        ph = ph << 1 & full
        mh = mh << 1 & full
        up = mh | ~(xv | ph) & full
        down = ph & xv
    return False


def climb(cuts: list[int], leaf: int) -> list[tuple[int, int, int]]:
    """(start, end, budget) in the item of the nodes above a piece, lowest
    first.  A node over j pieces has budget j - 1: if it holds at most j - 1
    edits, one of its halves keeps within its own budget, down to a piece
    without any."""
    path, a, b = [], 0, len(cuts) - 1
    while b - a > 1:
        path.append((cuts[a], cuts[b], b - a - 1))
        mid = (a + b) // 2
        a, b = (a, mid) if leaf < mid else (mid, b)
    return path[::-1]


class Matcher:
    """The automaton over one block of items."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        import ahocorasick

        self.items, self.paths, self.masks = [], {}, {}
        where: dict[str, list[tuple[int, int, int]]] = {}
        for item_id, text in items:
            k, pieces = pieces_of(text, error_rate)
            for leaf, (offset, piece) in enumerate(pieces):
                where.setdefault(piece, []).append((len(self.items), leaf, offset))
            self.items.append((item_id, text, k, [o for o, _ in pieces] + [len(text)]))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def _masks(self, i: int, a: int, b: int) -> dict[str, int]:
        if (i, a, b) not in self.masks:
            self.masks[i, a, b] = myers_masks(self.items[i][1][a:b])
        return self.masks[i, a, b]

    def _path(self, i: int, leaf: int) -> list[tuple]:
        """The nodes to check above a piece (the item itself comes last,
        elsewhere); next to a piece's only sibling, the sibling's halves."""
        if (i, leaf) not in self.paths:
            item, cuts = self.items[i][1], self.items[i][3]
            nodes = climb(cuts, leaf)
            halves = None
            if nodes and nodes[0][2] == 1:
                a, b, _ = nodes[0]
                x, y = (cuts[leaf + 1], b) if cuts[leaf] == a else (a, cuts[leaf])
                halves = (item[x:(x + y) // 2], item[(x + y) // 2:y])
            self.paths[i, leaf] = (halves, nodes[:-1])
        return self.paths[i, leaf]

    def find(self, raw: str) -> list[tuple[int, int, int]]:
        """(item id, distance, end) of every item in the text, best each."""
        if not self.items:
            return []
        text = even_out(raw)
        windows: dict[int, set[tuple[int, int]]] = {}
        for end, (size, places) in self.automaton.iter(text):
            start = end + 1 - size
            for i, leaf, offset in places:
                _, item, k, _ = self.items[i]
                at = start - offset          # where the item would start
                whole = (max(0, at - k), at + len(item) + k)
                if whole in windows.get(i, ()):
                    continue
                halves, nodes = self._path(i, leaf)
                for a, b, e in nodes:
                    near = text[max(0, at + a - e):at + b + e]
                    if e == 1 and halves and not (halves[0] in near or halves[1] in near):
                        break                # one edit leaves a half untouched
                    if not myers_within(self._masks(i, a, b), b - a, near, e):
                        break
                else:
                    windows.setdefault(i, set()).add(whole)
        out = []
        for i, spans in windows.items():
            item_id, item, k, _ = self.items[i]
            merged: list[list[int]] = []
            for a, b in sorted(spans):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            best = None
            for a, b in merged:
                hit = myers_best(self._masks(i, 0, len(item)), len(item), text[a:b], k)
                if hit and (best is None or hit[0] < best[0]):
                    best = (hit[0], a + hit[1])
            if best:
                out.append((item_id, *best))
        return out


_HITS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType()),
                                  T.StructField("end", T.IntegerType())]))


def _item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int):
    """Evened-out items in blocks of bounded size, one at a time."""
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).filter(
        "t is not null").distinct()
    total = items.agg(F.sum(F.length("t"))).head()[0] or 0
    n = max(1, -(-2 * total // block_chars))
    for j in range(n):
        block, size = [], 0
        for r in items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == j).toLocalIterator():
            text = even_out(r["t"])
            if len(text) < MIN_CHARS:
                continue
            block.append((r["i"], text))
            size += len(text)
            if size >= block_chars:
                yield block
                block, size = [], 0
        if block:
            yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id",
                       item_text: str = "text", error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS,
                       hits_col: str = "hits") -> DataFrame:
    """``docs`` with a column ``hits``: the items each text holds, with their
    smallest distance and where (in the evened-out text) that match ends."""
    spark = docs.sparkSession
    if hits_col in docs.columns:
        raise ValueError(f"docs has a column {hits_col!r} already")
    schema = T.StructType(docs.schema.fields + [T.StructField(hits_col, _HITS)])
    at = docs.columns.index(text_col)
    out = docs.withColumn(hits_col, F.array().cast(_HITS))
    for items in _item_blocks(benchmark, item_id, item_text, block_chars):
        sent = spark.sparkContext.broadcast(items)

        def scan(batches, sent=sent):
            import pyarrow as pa

            matcher = Matcher(sent.value, error_rate)
            for b in batches:
                hits = b.column(len(schema) - 1)
                if not pa.types.is_large_string(b.column(at).type) and not pa.types.is_string(b.column(at).type):
                    raise TypeError("the text column must be a string")
                had = hits.to_pylist()
                for i, text in enumerate(b.column(at)):
                    if text := text.as_py():
                        had[i] += [{"item_id": x, "distance": d, "end": e} for x, d, e in matcher.find(text)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(had, hits.type)], schema=b.schema)

        out = out.mapInArrow(thrifty(scan), schema)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no test item."""
    name = "hits" if "hits" not in docs.columns else "_".join(["hits", *docs.columns])
    return find_contamination(docs, benchmark, hits_col=name, **options).filter(F.size(F.col(name)) == 0).drop(name)


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    from convspark.sources.tables import read_table

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, read_table(spark, sf_dir, "benchmark"))
    best = F.array_min(F.transform("hits", lambda h: h["distance"]))
    return found.select("doc_id", (F.size("hits") > 0).alias("contaminated"),
                        F.array_sort(F.transform("hits", lambda h: h["item_id"])).alias("item_ids"),
                        best.alias("min_distance"))
