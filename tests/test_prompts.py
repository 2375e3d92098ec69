"""Prompt parsing, templates and image handling on edge rows, against the
rules restated in plain Python."""

import base64


from convspark.operators.chunks import chunk_array
from convspark.operators.prompts import (build_chat_messages, classify_images, context_limit,
                                         extract_inline_images, normalize_prompts, render_instruct)


PROMPTS = ["<|system|> S <|end|><|user|>\n U \n<|end|>", "<|user|>only user<|end|>", "<|user|>no end",
           "<|user|>a<|end|><|user|>b<|end|>", "", "plain", '{"system": " keep ", "user": "u"}', '{"user": "x"}']


def test_normalize_prompts(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(PROMPTS)], "prompt_id long, raw string")
    got = [(r.system, r.user) for r in normalize_prompts(df).orderBy("prompt_id").collect()]
    want = [("S", "U"), ("", "only user"), ("", ""), ("", "a"), ("", ""), ("", ""), (" keep ", "u"), ("", "x")]
    assert got == want


def test_templates(spark):
    df = spark.createDataFrame([("", "hi", 2), ("sys", "", 0)], "s string, u string, n int")
    r = df.select(render_instruct("s", "u").alias("t"), build_chat_messages("s", "u", "n").alias("m")).collect()
    assert r[0].t == "[INST]hi[/INST]"
    assert r[1].t == "[INST]<<SYS>>\nsys\n<</SYS>>\n\n[/INST]"
    assert r[0].m == '[{"role":"user","content":[{"type":"text","text":"hi"},{"type":"image"},{"type":"image"}]}]'
    assert '"Describe the provided image(s)."' in r[1].m and r[1].m.startswith('[{"role":"system"')


USERS = ["", "no images", "a [IMAGE FILE: x.png]data:image/png;base64,aGk=[/IMAGE FILE] b",
         "[image file: y]data:image/jpeg;base64,aG k=\n data:image/png;base64,abc[/Image File]",
         "[IMAGE FILE: z] nothing here [/IMAGE FILE] tail", "[IMAGE FILE: open]data:image/png;base64,aGk="]


def test_inline_images(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(USERS)], "id long, user string")
    got = [(r.user_clean, [bytes(b) for b in r.inline_images]) for r in
           extract_inline_images(df).orderBy("id").collect()]
    assert got == [('', []),
                    ('no images', []),
                    ('a  b', [b'hi']),
                    ('', [b'hi']),
                    ('tail', []),
                    ('[IMAGE FILE: open]data:image/png;base64,aGk=', [])]


def test_classify_images(spark):
    entries = ['"data:image/png;base64,aGk="', '"aGk="', '{"source": {"base64": "aGk="}}', '{"data": "bad!"}',
               '{"path": "/nope.png"}', '{"url": "ftp://x"}', '{"url": "https://x/y.png"}', "5", "{}"]
    df = spark.createDataFrame([(i, e) for i, e in enumerate(entries)], "idx long, entry string")
    got = [(r.kind, r.n_bytes, r.error) for r in classify_images(df).orderBy("idx").collect()]
    assert got == [("data_url", 2, None), ("base64", 2, None), ("base64", 2, None),
                   ("base64", None, "undecodable base64"), ("error", None, "path does not exist: /nope.png"),
                   ("error", None, "url scheme not supported: ftp"), ("url", None, None),
                   ("error", None, "unsupported type: bigint"),
                   ("error", None, "missing image source (data_url/base64/path/url)")]


def test_context_limit(spark):
    cases = [(0.001, 7.0, None), (0.5, 20.0, 4096), (80.0, 70.0, None), (0.0, 5.0, 8192), (2.0, 39.9, 200000),
             (80.0, 7.0, 0)]
    df = spark.createDataFrame(cases, "f double, p double, m long")
    got = [r[0] for r in df.select(context_limit("f", "p", "m")).collect()]
    assert got == [1468, 4096, 128000, 1000, 200000, 128000]


def test_chunks_round_trip(spark):
    texts = ["Hello, world! How are you?", "无分隔符", "a—b…c؟ d", "trailing words"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(chunk_array("t", True).alias("c"), chunk_array("t", False).alias("n")).collect()
    assert ["".join(r.c) for r in rows] == texts
    assert rows[3].n == ["trailing "] and rows[1].n == []


def test_split_context_and_require_non_empty(spark):
    import pytest

    from convspark.operators.corpus import require_non_empty
    from convspark.operators.prompts import split_context

    prompts = spark.createDataFrame([(1, "h", 10), (2, "h", 5000), (3, "x", 99999)],
                                    "id long, host string, tokens_in int")
    limits = spark.createDataFrame([("h", 4096)], "host string, max_context long")
    ok, rejected = split_context(prompts, limits)
    assert sorted(r.id for r in ok.collect()) == [1, 3]
    assert [r.error for r in rejected.collect()] == [
        "Context too long (5000 tokens). Max: 4096. Please retry with shorter input."]
    req = spark.createDataFrame([("a",), ("b",)], "request_id string")
    smp = spark.createDataFrame([("a", 1, "t")], "request_id string, sample_id long, text string")
    with pytest.raises(ValueError, match="b"):
        require_non_empty(req, smp)
    assert require_non_empty(req.filter("request_id = 'a'"), smp).count() == 1
