"""op13 against a brute-force search for maximal repetitions."""

import hashlib
import random
import zlib
from fractions import Fraction

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, runs int, id string"


def brute(words, least=24, periods=3):
    found, seen = [], {}
    for q in range(1, len(words) // periods + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, periods * q) and not any(q % p == 0 for p in seen.get((i, j + q), [])):
                seen.setdefault((i, j + q), []).append(q)       # smallest periods come first
                found.append((i, j + q - i, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def repetitive(r, n, k):
    words = []
    while len(words) < n:
        if r.random() < 0.5:
            words += [r.randrange(k) for _ in range(r.randint(1, 6))]
        else:
            words += [r.randrange(k) for _ in range(r.randint(1, 7))] * r.randint(1, 8)
    return words


def test_runs_of_random_sequences():
    from convspark.llm.periodic_runs import runs_of, slice_runs

    r = random.Random(3)
    for _ in range(400):
        words = repetitive(r, r.randint(0, 80), r.choice([1, 2, 2, 3, 5]))
        for least, periods in ((24, 3), (4, 2), (6, 3)):
            assert runs_of(words, least, periods) == brute(words, least, periods)
        assert slice_runs([words, [], words[::-1]], 24, 3) == [brute(words), [], brute(words[::-1])]
        assert slice_runs([words], 4, 2) == [brute(words, 4, 2)]


def test_runs_of_long_sequences():
    from convspark.llm.periodic_runs import runs_of

    r = random.Random(5)
    block = [r.randrange(3000) for _ in range(3000)]
    assert runs_of(block * 5 + block[:7]) == [(0, 15007, 3000)]
    assert runs_of(["a"] * 30_000) == [(0, 30_000, 1)]
    a, b = [0], [0, 1]                      # a word rich in repetitions
    while len(b) < 600:
        a, b = b, b + a
    assert runs_of(b, 4, 2) == brute(b, 4, 2)


def expected(doc_id, text):
    """The contract, word by word."""
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, n, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()),
            sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def low(row):
    return tuple((x is not None, x) for x in row)


def test_query_equals_brute_force(spark, sf, monkeypatch):
    from convspark.llm import periodic_runs as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = [tuple(x) for x in P.op13_periodic_runs(spark, sf).collect()]
    assert sorted(got, key=low) == sorted((expected(x.doc_id, x.text) for x in docs.collect()), key=low)
    assert sum(x[2] > 0 for x in got) > 5

    r = random.Random(9)
    texts = [None, "", " \t\n", "one", "x " * 24, "x " * 23, "a b c d e f g h " * 3, "a b c d e f g h i " * 3, "é ü " * 30,
             "y" * 5000 + " ", " ".join(map(str, range(1500))) + " " + "tail end " * 600,
             "a b " * 15 + "c d e " * 10]      # two runs that meet
    texts += [" ".join(map(str, repetitive(r, 300, 3))) for _ in range(60)]
    rows = [(i, t, 1, "clash") for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, texts[4], None, None), (2, texts[5], 7, "same id")]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    monkeypatch.setattr(P, "read_table", lambda *a: table)
    monkeypatch.setattr(P, "SLICE_WORDS", 500)      # several slices a batch
    got = [tuple(x) for x in P.op13_periodic_runs(spark, "").collect()]
    assert sorted(got, key=low) == sorted((expected(i, t) for i, t, *_ in rows), key=low)
    none = table.limit(0)
    monkeypatch.setattr(P, "read_table", lambda *a: none)
    assert P.op13_periodic_runs(spark, "").count() == 0


def test_collapse(spark):
    from convspark.llm.periodic_runs import collapse_runs

    docs = spark.createDataFrame([("k", "say " + "la di da " * 20 + "end"), ("n", None)], "id string, text string")
    got = dict(collapse_runs(docs, "id").select("id", F.col("text")).collect())
    assert got == {"k": "say la di da end", "n": ""}
