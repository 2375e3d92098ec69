"""Operator 4, byte-level BPE encoding and decoding with DuckDB queries inside
each partition.

A text is split by the tokenizer's pattern; words never merge across their
borders, so each distinct word of a batch is encoded once.  DuckDB holds the
merge table and runs one recursive query over (word, position, token) rows:
neighbouring positions join the merge table, the leftmost pair of the
smallest rank of each word is contracted, and words without a pair are at
their fixpoint.  The query holds the rows of all steps, at most the square of
a word's bytes, so words over ``SHORT`` bytes are contracted in a table that
each step replaces, all pairs of their smallest rank at once.  Decoding joins (document, position, id) rows with the
vocabulary and aggregates the pieces in order.

Spark deals out the documents; nothing shuffles.  Memory in a task is bounded
by the Arrow batch, by slices of ``SLICE`` characters (or one longer text), by
``ROWS`` rows of short words, ``BYTES`` bytes of other words (or one longer
word) or ``TOKENS`` ids in one query and by ``CACHE`` remembered words of
``CACHE_BYTES``.  What DuckDB cannot hold in memory it spills to the task's
temporary folder.  Workers outlive their tasks, so each task ends by giving
the words' memory back: the executor needs it for what runs next.

Defined cases
    * null and empty texts give no ids and decode to no bytes;
    * text that looks like a special token is ordinary text;
    * very long words are encoded whole (positions are 64-bit);
    * rows are encoded one by one, so repeated rows, ties and further columns
      change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convspark.llm import common

#: Bytes of a short word, squared bytes of the short words and bytes of the
#: other words in one encoding, ids in one decoding query, words (and bytes of
#: them and their ids) a task remembers between slices, characters of a slice.
SHORT = 64
ROWS = 1_000_000
BYTES = 400_000
TOKENS = 100_000
CACHE = 300_000
CACHE_BYTES = 64_000_000
SLICE = 500_000

#: Short words in one query, which holds the rows of all steps: neighbours join
#: the merge table; of each word's mergeable pairs the one of least rank, then
#: least position, is contracted; the others close up.
ENCODE = """
WITH RECURSIVE state(step, word, pos, tok) AS (
  SELECT 0::INT, word, pos, tok FROM bytes_in
  UNION ALL
  (WITH pick AS (
     SELECT a.word, min(m.merged::BIGINT * 2147483648 + a.pos) AS best
     FROM state a JOIN state b ON b.word = a.word AND b.pos = a.pos + 1
     JOIN merges m ON m.l = a.tok AND m.r = b.tok GROUP BY a.word)
   SELECT s.step + 1, s.word,
          (CASE WHEN s.pos > (p.best & 2147483647) THEN s.pos - 1 ELSE s.pos END)::INT,
          CASE WHEN s.pos = (p.best & 2147483647) THEN (p.best >> 31)::INT ELSE s.tok END
   FROM state s JOIN pick p ON p.word = s.word WHERE s.pos <> (p.best & 2147483647) + 1)
)
SELECT s.word, s.tok FROM state s
JOIN (SELECT word, max(step) AS step FROM state GROUP BY word) f ON f.word = s.word AND f.step = s.step
ORDER BY s.word, s.pos
"""

#: Other words by steps, of which one is held at a time.  In ``state`` a row is a token at its first byte ``pos``, ``nxt``
#: is the next token's (null at the word's end), so rows that stay never move.
#: Neighbours join the merge table.
PAIRS = """
CREATE OR REPLACE TABLE pairs AS
SELECT a.word, a.pos, a.nxt, b.nxt AS nxt2, m.merged, m.alone
FROM state a JOIN state b ON b.pos = a.nxt JOIN merges m ON m.l = a.tok AND m.r = b.tok
"""

#: Of each word's pairs those of least rank are contracted from left to right,
#: every other one where they overlap; of an ``alone`` rank the leftmost only.
PICK = """
CREATE OR REPLACE TABLE pick AS
WITH best AS (SELECT word, min(merged) AS merged FROM pairs GROUP BY word),
least AS (SELECT p.*, row_number() OVER w AS nth, lag(p.nxt) OVER w IS DISTINCT FROM p.pos AS opens
          FROM pairs p JOIN best USING (word, merged) WINDOW w AS (PARTITION BY word ORDER BY p.pos)),
runs AS (SELECT *, max(CASE WHEN opens THEN nth END) OVER (PARTITION BY word ORDER BY nth ROWS UNBOUNDED PRECEDING) AS first FROM least)
SELECT pos, nxt, nxt2, merged FROM runs WHERE CASE WHEN alone THEN nth = 1 ELSE (nth - first) % 2 = 0 END
"""

#: Words without a pair are at their fixpoint and leave the state.
FINISH = """
INSERT INTO finished SELECT word, pos, tok FROM state WHERE word NOT IN (SELECT DISTINCT word FROM pairs)
"""
CONTRACT = """
CREATE OR REPLACE TABLE state AS
SELECT s.word, s.pos, CASE WHEN p.pos IS NULL THEN s.nxt ELSE p.nxt2 END AS nxt, coalesce(p.merged, s.tok) AS tok
FROM state s LEFT JOIN pick p ON p.pos = s.pos
WHERE s.word IN (SELECT DISTINCT word FROM pairs) AND s.pos NOT IN (SELECT nxt FROM pick)
"""

#: Ordered aggregation in two levels: runs of 512 positions, then documents.
DECODE = """
SELECT doc, string_agg(run, '' ORDER BY blk) AS body FROM (
  SELECT doc, pos // 512 AS blk, string_agg(piece, '' ORDER BY pos) AS run
  FROM ids_in JOIN vocab USING (id) GROUP BY doc, pos // 512)
GROUP BY doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken file: base64 token, rank."""
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """One worker's DuckDB session with the merge table and vocabulary."""

    def __init__(self, path: str, pattern: str):
        import tempfile

        import duckdb
        import numpy as np
        import pyarrow as pa
        import regex

        self.find = regex.compile(pattern).findall
        ranks = read_ranks(path)
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        # where a token takes part in a pair of lower rank than its own, contracting
        # one pair can bring up a better one: such ranks are contracted one by one
        alone = {part for x, y, m in zip(left, right, merged) for part in (x, y) if m < part}
        i32 = pa.int32()
        self.spill = tempfile.TemporaryDirectory(prefix="byte_bpe_")
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": self.spill.name,
                                          # freed memory goes back to the system after each query
                                          "allocator_flush_threshold": "1MB", "allocator_bulk_deallocation_flush_threshold": "1MB"})
        self.con.register("m", pa.table({"l": pa.array(left, i32), "r": pa.array(right, i32), "merged": pa.array(merged, i32),
                                         "alone": [m in alone for m in merged]}))
        self.con.execute("CREATE TABLE merges AS SELECT * FROM m")
        # one character per byte, so that text aggregation is byte aggregation
        self.con.register("v", pa.table({"id": pa.array(list(ranks.values()), i32),
                                         "piece": [t.decode("latin-1") for t in ranks]}))
        self.con.execute("CREATE TABLE vocab AS SELECT * FROM v")
        self.ranks = ranks
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _encode_words(self, words: list[str], short: bool) -> None:
        """Remember the ids (little-endian 32 bit) of these words."""
        import numpy as np
        import pyarrow as pa

        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(raw), np.uint8)
        word = np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
        at = np.arange(len(data))
        if short:
            self.con.register("bytes_in", pa.table({
                "word": word, "pos": (at - np.repeat(ends - sizes, sizes)).astype(np.int32), "tok": self.byte_ids[data]}))
            got = self.con.execute(ENCODE).fetchnumpy()
            self.con.unregister("bytes_in")
        else:
            last = np.zeros(len(data), bool)
            last[ends - 1] = True
            self.con.register("bytes_in", pa.table({
                "word": word, "pos": at, "nxt": pa.array(at + 1, mask=last), "tok": self.byte_ids[data]}))
            self.con.execute("CREATE OR REPLACE TABLE state AS SELECT * FROM bytes_in")
            self.con.unregister("bytes_in")
            self.con.execute("CREATE OR REPLACE TABLE finished (word INTEGER, pos BIGINT, tok INTEGER)")
            while True:
                pairs = self.con.execute(PAIRS).fetchone()[0]
                self.con.execute(FINISH)
                if not pairs:
                    break
                self.con.execute(PICK)
                self.con.execute(CONTRACT)
            got = self.con.execute("SELECT word, tok FROM finished ORDER BY pos").fetchnumpy()
        ids = np.asarray(got["tok"]).astype("<u4")
        at = np.searchsorted(np.asarray(got["word"]), np.arange(len(raw) + 1)) * 4
        flat = ids.tobytes()
        for w, a, b in zip(words, at[:-1].tolist(), at[1:].tolist()):
            self.known[w] = flat[a:b]
        self.held += len(data) + len(flat)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian unsigned 32 bit."""
        split = [self.find(t) for t in texts]
        todo = set().union(*split).difference(self.known) if split else set()
        if len(self.known) + len(todo) > CACHE or self.held > CACHE_BYTES:
            self.known = {w: self.known[w] for w in set().union(*split).intersection(self.known)}
            self.held = sum(4 * len(w) + len(ids) for w, ids in self.known.items())
        parts: dict[bool, list] = {True: [], False: []}
        sizes = {True: 0, False: 0}
        for w in todo:
            # a word that is a token as a whole is that token
            raw = w.encode()
            if (rank := self.ranks.get(raw)) is not None:
                self.known[w] = rank.to_bytes(4, "little")
                continue
            short = len(raw) <= SHORT
            size = len(raw) ** 2 if short else len(raw)
            if parts[short] and sizes[short] + size > (ROWS if short else BYTES):
                self._encode_words(parts[short], short)
                parts[short], sizes[short] = [], 0
            parts[short].append(w)
            sizes[short] += size
        for short, part in parts.items():
            if part:
                self._encode_words(part, short)
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each id sequence; long ones are decoded in parts."""
        import numpy as np
        import pyarrow as pa

        out: list[list[bytes]] = [[] for _ in ids]
        part: list[tuple[int, object]] = []
        size = 0

        def flush():
            sizes = [len(a) for _, a in part]
            flat = np.concatenate([a for _, a in part])
            self.con.register("ids_in", pa.table({
                "doc": np.repeat(np.arange(len(part), dtype=np.int32), sizes),
                "pos": np.arange(len(flat)), "id": flat}))
            for doc, body in self.con.execute(DECODE).fetchall():
                out[part[doc][0]].append(body.encode("latin-1"))
            self.con.unregister("ids_in")

        for i, seq in enumerate(ids):
            a = np.frombuffer(seq, "<u4").astype(np.int32)
            for at in range(0, len(a), TOKENS):
                if part and (size + len(a) - at > TOKENS):
                    flush()
                    part, size = [], 0
                part.append((i, a[at:at + TOKENS]))
                size += len(part[-1][1])
        if part:
            flush()
        return [b"".join(x) for x in out]


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec; Python workers live through many tasks."""
    import sys

    kept = sys.modules.setdefault("_byte_bpe_codecs", type(sys)("_byte_bpe_codecs")).__dict__
    if (path, pattern) not in kept:
        kept[(path, pattern)] = Codec(path, pattern)
    return kept[(path, pattern)]


def give_back(c: Codec) -> None:
    """Forget the words and what is left of the last query, and return free
    memory to the system."""
    c.known, c.held = {}, 0
    for table in ("state", "finished", "pairs", "pick"):
        c.con.execute(f"DROP TABLE IF EXISTS {table}")
    common.give_back()


def texts_of(column):
    """The texts of an Arrow column, one at a time."""
    return (t.as_py() for t in column)


def batches_of(rows, limit: int = SLICE):
    """Slices of the rows whose texts have about ``limit`` characters."""
    part, size = [], 0
    for t in rows:
        part.append(t or "")
        size += len(part[-1])
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with the token ids of its text (array of int) in place of it."""
    keep = [f for f in df.schema.fields if f.name != text_col]
    if ids_col in [f.name for f in keep]:
        raise ValueError(f"df has a column {ids_col!r} already")
    schema = T.StructType([*keep, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False))])
    names = [f.name for f in keep]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        c = codec(path, pattern)
        try:
            for b in batches:
                at = 0
                for texts in batches_of(texts_of(b.column(text_col))):
                    ids = c.encode(texts)
                    off = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                    flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
                    cols = [b.column(n).slice(at, len(texts)) for n in names]
                    yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(off, flat)], names=[*names, ids_col])
                    at += len(texts)
        finally:
            give_back(c)

    return df.select(*[F.col(f"`{n}`") for n in names], F.col(f"`{text_col}`")).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "body") -> DataFrame:
    """``df`` with the bytes its ids stand for in a further binary column."""
    if bytes_col in df.columns:
        raise ValueError(f"df has a column {bytes_col!r} already")
    schema = T.StructType([*df.schema.fields, T.StructField(bytes_col, T.BinaryType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        c = codec(path, pattern)
        try:
            for b in batches:
                col = b.column(b.schema.get_field_index(ids_col))
                seqs = [(np.asarray(x.values).astype("<u4").tobytes() if x.is_valid else b"") for x in col]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(c.decode(seqs), pa.binary())],
                                                 names=[f.name for f in schema])
        finally:
            give_back(c)

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass and keep only digests: the ids of a
    corpus are larger than its texts, so they need not leave the task."""
    schema = T.StructType([df.schema[id_col], T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        import hashlib

        import pyarrow as pa

        c = codec(path, pattern)
        try:
            for b in batches:
                at = 0
                for texts in batches_of(texts_of(b.column(1))):
                    ids = c.encode(texts)
                    back = c.decode(ids)
                    digest = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs])
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(at, len(texts)), pa.array([len(x) // 4 for x in ids], pa.int64()), digest(ids), digest(back)],
                        names=[f.name for f in schema])
                    at += len(texts)
        finally:
            give_back(c)

    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, schema)


def default_tokenizer() -> tuple[str, str]:
    """Path and pattern of the public 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    from convspark.sources.tables import read_table

    return round_trip(read_table(spark, sf_dir, "documents"), *default_tokenizer())
