"""JSON as Python's reader takes it."""

import json
import math

from pyspark.sql import functions as F

from convspark.functions.json import MARK, exact_json
from convspark.operators.corpus import pick_source_target, to_samples
from convspark.operators.frames import route_frames
from convspark.operators.prompts import normalize_prompts

TEXTS = ['{"a": 1}', '{"a": 1, "a": 2}', '{"a": {"b": 1, "b": [2]}}', '{"a": NaN}', '{"a": [Infinity, -Infinity]}', "NaN", "-Infinity", "[1, 2",
         '{"a": 1} x', '{"a": 1, "a": 2} x', '{"a": 01}', "{'a': 1}", '{"a": "x\ty"}', "plain", "", '"text"', "7", "null", "nan", '{"a": .5}', "[" * 3000 + "]" * 3000,
         '{"a": "float:nan"}', '{"a": "x", "a": "float:0:nan"}', "[NaN] ]", '{"é": "漢", "é": "\\u00e9"}']


def plain(x):
    """NaN and infinities as text, for comparing."""
    if isinstance(x, float) and not math.isfinite(x):
        return {"nan": "nan", "inf": "inf", "-inf": "-inf"}[str(x)]
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    return [plain(v) for v in x] if isinstance(x, list) else x


def unmark(x):
    if isinstance(x, str) and x.startswith(MARK):
        return x.rsplit(":", 1)[1]
    if isinstance(x, dict):
        return {k: unmark(v) for k, v in x.items()}
    return [unmark(v) for v in x] if isinstance(x, list) else x


def test_equals_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "i int, t string")
    got = exact_json(df, "t", "v", "note").select("i", F.to_json(F.struct("v")).alias("v"), "note", F.col("v").isNull().alias("no")).collect()
    for r in got:
        text = [*TEXTS, None][r.i]
        try:
            want = json.loads(text)
        except (TypeError, ValueError, RecursionError):
            assert r.no, text
            continue
        if len(text) > 3000:
            continue        # deeper than the variant reader goes
        assert unmark(json.loads(r.v).get("v")) == plain(want), text
    notes = {TEXTS[r.i]: r.note for r in got if r.note}
    assert notes == {'{"a": 1, "a": 2}': "duplicate_key", '{"a": {"b": 1, "b": [2]}}': "duplicate_key", '{"a": NaN}': "non_finite",
                     '{"a": [Infinity, -Infinity]}': "non_finite", "NaN": "non_finite", "-Infinity": "non_finite",
                     '{"a": "x", "a": "float:0:nan"}': "duplicate_key", '{"é": "漢", "é": "\\u00e9"}': "duplicate_key"}


def test_samples_of_odd_lines(spark):
    rows = ['{"prompt": "a", "prompt": " b ", "answer": NaN}', '{"text": -Infinity}', '{"text": "x"} y', "NaN", '{"text": "float:nan", "k": 1, "k": 2}']
    df = spark.createDataFrame([("r", i, t) for i, t in enumerate(rows)], "request_id string, line_no long, value string")
    got = [(r.text, r.parse_note) for r in to_samples(df, notes=True).orderBy("sample_id").collect()]
    assert got == [("b\nnan", "duplicate_key,non_finite"), ("-inf", "non_finite"), ('{"text": "x"} y', None), ("NaN", "non_finite"), ("float:nan", "duplicate_key")]
    assert [r.parse_note for r in pick_source_target(df).orderBy("line_no").collect()][:2] == ["duplicate_key,non_finite", "non_finite"]


def test_messages_and_prompts(spark):
    msgs = ['{"type":"ping","type":"config"}', '{"data":NaN}', "NaN", '{"type":"ping"} x', '{"type":NaN}']
    df = spark.createDataFrame([(1, i, m) for i, m in enumerate(msgs)], "session_id long, seq long, raw string")
    got = [(r.route, r.msg_type, r.error) for r in route_frames(df).orderBy("seq").collect()]
    assert got == [("dispatch", "config", None), ("dispatch", "inference", None), ("dead_letter", None, "'float' object has no attribute 'get'"),
                   ("dead_letter", None, "Invalid JSON"), ("ignored", None, None)]
    raws = ['{"system": "s", "user": "u"} <|user|>t<|end|>', '{"user": "a", "user": "b"}', '{"user": "a", "system": "s"}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "prompt_id long, raw string")
    assert [(r.system, r.user) for r in normalize_prompts(df).orderBy("prompt_id").collect()] == [("", "t"), ("", "b"), ("s", "a")]
