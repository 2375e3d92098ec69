"""JSON as Python's reader takes it, as a variant column.

``try_parse_json`` is stricter than Python in two ways: it refuses objects with
a repeated key (Python: the last one wins) and the numbers ``NaN``,
``Infinity`` and ``-Infinity``; and it is laxer in one: it ignores text behind
the value.  ``exact_json`` parses every text once in the JVM; only texts that it
refuses and that look like JSON go through Python's own reader, which hands
them back as strict JSON (an Arrow-batched function over a column that is null
for all other rows).
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "\ue000float:"        # then the text's md5, a colon and nan, inf or -inf


def _strict(text: str):
    """``(strict JSON, note)`` of a text that Python reads, else nulls.  A
    number that JSON has no form for becomes a string that the text cannot
    hold itself, as it holds the text's hash."""
    notes = set()
    mark = MARK + hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest() + ":"

    def constant(name):
        notes.add("non_finite")
        return mark + {"NaN": "nan", "Infinity": "inf", "-Infinity": "-inf"}[name]

    def pairs(items):
        out = dict(items)
        if len(out) < len(items):
            notes.add("duplicate_key")
        return out

    try:
        value = json.loads(text, parse_constant=constant, object_pairs_hook=pairs)
        return json.dumps(value), ",".join(sorted(notes)) or None
    except (ValueError, RecursionError):
        return None, None


def _reread(texts: pd.Series) -> pd.DataFrame:
    # nearly all texts are null: rows are made for the others only
    out = {"json": np.full(len(texts), None, object), "note": np.full(len(texts), None, object)}
    for i in np.flatnonzero(texts.notna().to_numpy()):
        out["json"][i], out["note"][i] = _strict(texts.iat[i])
    return pd.DataFrame(out)


def exact_json(df: DataFrame, text: str, out: str, note: str | None = None) -> DataFrame:
    """``out``: the variant of column ``text`` (already stripped) when the whole
    text is one JSON value by Python's rules, else null.  ``note`` names a
    column for why the strict reader refused it: ``duplicate_key``,
    ``non_finite`` or both, null for all other texts.

    Wrapping the text in an array with a second element that it cannot hold
    (its own 64-bit hash) turns text behind the value into an error or a visible
    third element."""
    s = F.col(text)
    x = df.withColumn("_jsons", F.xxhash64(s))
    x = x.withColumn("_jsonw", F.try_parse_json(F.concat(F.lit("["), s, F.lit(","), F.col("_jsons").cast("string"), F.lit("]"))))
    exact = (F.try_variant_get("_jsonw", "$[1]", "bigint") == F.col("_jsons")) & F.try_variant_get("_jsonw", "$[2]", "variant").isNull()
    x = x.withColumn("_json0", F.when(exact, F.try_variant_get("_jsonw", "$[0]", "variant")))
    odd = F.col("_json0").isNull() & F.coalesce(s.rlike(r'(?s)\A(?:\{.*\}|\[.*\]|NaN|-?Infinity)\z'), F.lit(False))
    reread = F.pandas_udf(_reread, "json string, note string")
    x = x.withColumn("_jsonp", reread(F.when(odd, s)))
    x = x.withColumn(out, F.coalesce("_json0", F.try_parse_json("_jsonp.json")))
    return (x.withColumn(note, F.col("_jsonp.note")) if note else x).drop("_jsons", "_jsonw", "_json0", "_jsonp")


def number_text(value: Column, text: Column) -> Column:
    """``value`` (a string out of ``exact_json`` of ``text``), or ``nan``,
    ``inf`` or ``-inf`` if it stands for such a number."""
    mark = F.concat(F.lit(MARK), F.md5(text), F.lit(":"))
    return F.when(F.startswith(value, F.lit(MARK)) & F.startswith(value, mark), F.substr(value, F.length(mark) + 1)).otherwise(value)


def json_numbers(value: Column, text: Column) -> Column:
    """JSON text out of ``exact_json`` of ``text`` with such numbers as Python
    writes them."""
    mark = F.concat(F.lit('"' + MARK), F.md5(text), F.lit(":"))
    out = value
    for name, written in (("nan", "NaN"), ("inf", "Infinity"), ("-inf", "-Infinity")):
        out = F.replace(out, F.concat(mark, F.lit(name + '"')), F.lit(written))
    return F.when(value.contains(MARK), out).otherwise(value)
