"""Randomised properties, each checked on one batch of generated values."""

import base64
import random
import struct

from convspark.functions.codec import decode_log, encode_log
from convspark.functions.text import py_float_repr, py_strip
from convspark.operators.chunks import chunk_array, overlap_len

WS = [" ", "\t", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", " ",
      " ", " ", " ", " ", "　"]
CHARS = list("ab é漢,.!?—") + WS + ["\x00"]

KEY = "relay"


def rand_text(rng, n):
    return "".join(rng.choice(CHARS) for _ in range(rng.randint(0, n)))


def test_strip_random(spark):
    rng = random.Random(11)
    texts = [rand_text(rng, 12) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(py_strip("t")).collect()] == [t.strip() for t in texts]


def test_float_repr_random(spark):
    rng = random.Random(5)
    vals = []
    while len(vals) < 400:
        d = struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0]
        if d == d and abs(d) != float("inf") and (d == 0 or abs(d) > 1e-300):
            vals.append(d)
    vals += [rng.uniform(-1e6, 1e6) for _ in range(200)] + [round(rng.uniform(0, 100), 2) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in vals], "d double")
    got = [r[0] for r in df.select(py_float_repr("d")).collect()]
    # Java 17 may print a longer digit string than Python for a few values;
    # those must still denote the same double
    for g, v in zip(got, vals):
        assert g == repr(v) or float(g) == v


def test_codec_round_trip_random(spark):
    rng = random.Random(3)
    texts = [rand_text(rng, 60) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(encode_log("t", KEY).alias("e"), decode_log(encode_log("t", KEY), KEY).alias("d")).collect()
    assert [r.d for r in rows] == texts
    for r, t in zip(rows, texts):
        if t:
            raw = base64.b64decode(r.e)
            assert bytes(b ^ KEY.encode()[i % 5] for i, b in enumerate(raw)).decode() == t


def test_chunks_and_overlaps_random(spark):
    rng = random.Random(8)
    texts = [rand_text(rng, 80) for _ in range(200)]
    pairs = [(rand_text(rng, 30), rand_text(rng, 30)) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert ["".join(r[0]) for r in df.select(chunk_array("t", True)).collect()] == texts
    pdf = spark.createDataFrame(pairs, "s string, w string")
    got = [r[0] for r in pdf.select(overlap_len("s", "w", 20)).collect()]

    def brute(s, w):
        tail = s[-20:] if s else ""
        for n in range(min(len(tail), len(w)), 0, -1):
            if tail.endswith(w[:n]):
                return n
        return 0
    assert got == [brute(s, w) for s, w in pairs]


NAME_CHARS = list("aZ09._-/ !é漢") + [" ", "\t", "　"]


def test_name_sanitizers_random(spark):
    import re

    from convspark.functions.names import sanitize_dir_name_js, sanitize_name, sanitize_request_id

    rng = random.Random(21)
    raws = ["".join(rng.choice(NAME_CHARS) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame([(r,) for r in raws], "r string")
    got = df.select(sanitize_name("r", "snap", 5).alias("p"), sanitize_request_id("r").alias("q"),
                    sanitize_dir_name_js("r").alias("j")).collect()

    allowed = re.compile(r"[A-Za-z0-9._-]+")
    for r in got:
        assert allowed.fullmatch(r.p) and r.p[0] not in "-." and r.p[-1] not in "-."
        assert allowed.fullmatch(r.q) and r.q[0] not in "-." and r.q[-1] not in "-."
        assert r.j == "" or (allowed.fullmatch(r.j) and r.j[0] != "-" and r.j[-1] != "-")
    # names that are already clean stay as they are
    again = spark.createDataFrame([(r.p, r.q, r.j) for r in got], "p string, q string, j string").select(
        sanitize_name("p", "snap", 5).alias("p"), sanitize_request_id("q").alias("q"), sanitize_dir_name_js("j").alias("j"))
    assert sorted(tuple(r) for r in again.collect()) == sorted(tuple(r) for r in got)
