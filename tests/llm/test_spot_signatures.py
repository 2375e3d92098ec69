"""op12 against plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F


def sig_words(text, chain=3, sparse=32):
    """The signatures as tuples of words."""
    from convspark.llm.spot_signatures import ANCHORS

    anchors = set(ANCHORS)
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    spots = [i for i, w in enumerate(words) if w in anchors]
    if len(spots) * sparse < len(words):
        return {tuple(words[i:i + 1 + chain]) for i in range(len(words))}
    out = set()
    for i in [-1, *spots]:
        c = [w for w in words[i + 1:] if w not in anchors][:chain]
        if c:
            out.add((words[i] if i >= 0 else "", *c))
    return out


def alike(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def texts(seed, n):
    r = random.Random(seed)
    vocab = [f"word{i}" for i in range(300)] + ["the", "of", "and", "a"] * 40
    base = [" ".join(r.choice(vocab) for _ in range(r.randint(1, 200))) for _ in range(n)]
    near = [b.replace("word7", "other", 1) for b in base[:n // 2]]
    odd = [None, "", "... !", "one", "The", "the the of", "Ünï cödé, 漢字 words; the END", "alone " * 60, " ".join(f"k{i}" for i in range(500)),
           " ".join(r.choice(vocab) for _ in range(9000))]
    return base + near + odd


def test_signatures_and_likeness(spark):
    from convspark.llm.spot_signatures import fingerprint_text, fingerprints, likeness

    rows = texts(1, 40)
    got = fingerprints(spark.createDataFrame([(i, t, "c") for i, t in enumerate(rows)], "doc_id long, text string, sigs string"))
    sigs = {x.id: x.sigs for x in got.collect()}
    for i, t in enumerate(rows):
        assert len(sigs[i]) == len(sig_words(t)) and sigs[i] == sorted(sigs[i])
    pairs = spark.createDataFrame([(i, j) for i in range(len(rows)) for j in range(0, len(rows), 3)], "i long, j long")
    both = pairs.join(got.withColumnRenamed("id", "i").withColumnRenamed("sigs", "a"), "i").join(
        got.withColumnRenamed("id", "j").withColumnRenamed("sigs", "b"), "j")
    for x in both.select("i", "j", likeness(F.col("a"), F.col("b")).alias("s"), likeness(F.col("a"), F.col("b"), 0.8).alias("least")).collect():
        want = alike(sig_words(rows[x.i]), sig_words(rows[x.j]))
        assert x.s == pytest.approx(want) and x.least == pytest.approx(want if want >= 0.8 else 0.0)
    prints = dict(got.select("id", fingerprint_text(F.col("sigs"))).collect())
    assert prints[0] == " ".join(f"{s & (2**64 - 1):x}" for s in sigs[0])


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_near_pairs(spark, threshold):
    from convspark.llm.spot_signatures import fingerprint_classes, fingerprints, near_pairs

    rows = texts(2, 60)
    rows += rows[:20]
    prints = fingerprints(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    classes, members = fingerprint_classes(prints)
    sets = [sig_words(t) for t in rows]
    want_class = {i: min(j for j, b in enumerate(sets) if a == b) for i, a in enumerate(sets)}
    assert {x.id: x["class"] for x in members.collect()} == want_class
    got = {(x.query, x["class"]): x.likeness for x in near_pairs(prints.filter("id % 5 = 0"), classes, threshold).collect()}
    want = {(i, j): alike(sets[i], sets[j]) for i in range(0, len(rows), 5) for j in set(want_class.values()) if alike(sets[i], sets[j]) >= threshold}
    assert got == pytest.approx(want) and len(want) > 20


def test_query(spark, monkeypatch):
    from convspark.llm import spot_signatures as S

    monkeypatch.setattr(S, "LINK_ROWS", 7)      # several ranges
    rows = [(i, t, 1, "x") for i, t in enumerate(texts(3, 20))]
    rows += [rows[3], rows[3], (3, "another text of the same id", 2, "y"), (None, "no id", 3, "z"), (1000, rows[4][1], 3, "far id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int, half string").repartition(5)
    monkeypatch.setattr(S, "read_table", lambda *a: docs)
    link = {(x.id, x.th): (x.next_id, x.next_th) for x in S.next_documents(docs).collect()}
    hashes = {(x.doc_id, x.th): x.text or "" for x in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")).collect()}
    order = sorted(hashes, key=lambda k: (k[0] is None, -(k[0] or 0), k[1]))
    assert link == {k: order[(i + 1) % len(order)] for i, k in enumerate(order)}
    want = []
    for k in [(x.doc_id, x.th) for x in docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")).collect()]:
        text, follow = hashes[k], hashes[link[k]]
        half = len(text) // 2
        edited = text[:len(text) - half] + follow[:half]
        want.append((k[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), alike(sig_words(text), sig_words(edited)),
                     alike(sig_words(text), sig_words(follow))))
    got = S.op12_spot_signatures(spark, "").collect()
    low = lambda x: (x[0] is not None, x)
    assert sorted(((x.doc_id, x.n_chars, x.edited_sha256, pytest.approx(x.near_edited), pytest.approx(x.near_next)) for x in got),
                  key=lambda x: (x[0] is not None, x[:3])) == sorted(want, key=lambda x: (x[0] is not None, x[:3]))
    prints = {}
    for x in got:
        prints.setdefault(next(t for (i, _), t in hashes.items() if i == x.doc_id and len(t) == x.n_chars), set()).add(x.fingerprint)
    assert all(len(v) == 1 for v in prints.values())
    one = docs.filter("doc_id = 1000")
    monkeypatch.setattr(S, "read_table", lambda *a: one)
    assert [x.near_next for x in S.op12_spot_signatures(spark, "").collect()] == [1.0]
    none = docs.limit(0)
    monkeypatch.setattr(S, "read_table", lambda *a: none)
    assert S.op12_spot_signatures(spark, "").count() == 0
