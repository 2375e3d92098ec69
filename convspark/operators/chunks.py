"""Streaming text chunks (T4) and overlap stitching (T5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convspark.functions.text import col_of

# The characters after which streamed text is cut, in the
# order they are listed (whitespace, ASCII punctuation, CJK, Spanish,
# Arabic); 27 distinct characters.
SEPARATORS = (
    " ", "\t", "\n",
    ",", ".", "!", "?", ";", ":",
    "，", "。", "！", "？", "；", "：", "、", "…", "—", "～", "-",
    "¡", "¿", "｡", "·", "‧", "؟", "؛",
)
STREAM_OVERLAP = 100  # fixed value: longest overlap searched while streaming
EOS_OVERLAP = 50      # fixed value: longest overlap searched at end of stream


def _char_class(chars, negate=False) -> str:
    body = "".join("\\x{%x}" % ord(ch) for ch in chars)
    return "[" + ("^" if negate else "") + body + "]"


SEP_CLASS = _char_class(SEPARATORS)
NON_SEP_CLASS = _char_class(SEPARATORS, negate=True)
CHUNK_RE = NON_SEP_CLASS + "*" + SEP_CLASS          # a piece ending at a separator
CHUNK_TAIL_RE = CHUNK_RE + "|" + NON_SEP_CLASS + r"+\z"  # plus the unterminated tail


def chunk_array(text, flush_tail: bool) -> Column:
    """Pieces of ``text``, each ending right after a separator; the tail with
    no separator is kept only when ``flush_tail`` (end of stream)."""
    return F.regexp_extract_all(col_of(text), F.lit(CHUNK_TAIL_RE if flush_tail else CHUNK_RE), 0)


def chunk_text(df: DataFrame, text_col: str = "text", flush_tail: bool = True) -> DataFrame:
    """T4: one row per chunk, ``k`` = 1-based position in the text.

    When generation stops on the token budget the reference never sends the
    pending tail, which is ``flush_tail=False``."""
    return (df.select(*[c for c in df.columns if c != text_col],
                      F.posexplode(chunk_array(text_col, flush_tail)).alias("_pos", "chunk"))
            .withColumn("k", (F.col("_pos") + 1).cast("int")).drop("_pos"))


def overlap_len(sent, window, limit: int = STREAM_OVERLAP) -> Column:
    """Longest n <= min(limit, |window|, |sent tail|) with sent ending in the
    first n characters of ``window``; 0 when none.

    One backtracking regex over ``tail NUL window``: the lazy prefix makes
    the captured suffix of the tail as long as possible, and the
    back-reference requires the window to start with it, so the first match
    is the longest overlap (a handful of JIT-compiled steps per window, no
    per-length loop)."""
    s, w = col_of(sent), col_of(window)
    tail = F.substr(s, F.greatest(F.length(s) - limit + 1, F.lit(1)))
    hit = F.regexp_extract(F.concat(tail, F.lit("\u0000"), w), r"^[^\x{0}]*?([^\x{0}]++)\x{0}\1", 1)
    # texts holding NUL themselves take the per-length search instead
    hi = F.least(F.length(tail), F.length(w))
    cand = F.filter(F.sequence(F.lit(1), F.greatest(hi, F.lit(1))),
                    lambda n: (n <= hi) & F.endswith(tail, F.substr(w, F.lit(1), n)))
    has_nul = (F.instr(tail, "\u0000") > 0) | (F.instr(w, "\u0000") > 0)
    return F.when(has_nul, F.coalesce(F.array_max(cand), F.lit(0))).otherwise(F.length(hit))


def stitch_overlaps(df: DataFrame, sent_col: str, window_col: str, limit: int = STREAM_OVERLAP) -> DataFrame:
    """T5: the part of each window that is new: the window minus its longest
    prefix already at the end of the sent text."""
    n = overlap_len(sent_col, window_col, limit)
    return (df.withColumn("overlap", n.cast("int"))
            .withColumn("new_text", F.substr(F.col(window_col), F.col("overlap") + 1)))
