"""op11 against a plain count of all n-grams."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, order=3, least=10, percent=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, order + 1):
                f[lang].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) >= 2 and a >= least}
        longest = {}
        for p, a in cand.items():
            for m in range(2, len(p)):
                for s in range(len(p) - m + 1):
                    longest[p[s:s + m]] = max(longest.get(p[s:s + m], 0), a)
        got = []
        for p, a in cand.items():
            if 100 * longest.get(p, -1) >= percent * a:
                continue
            cuts = [(int(Fraction(1_000_000 * a * a, counts[p[:k]] * counts[p[k:]])), k) for k in range(1, len(p))]
            score, k = min(cuts)
            got.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(got)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def rows_of(seed, n):
    r = random.Random(seed)
    vocab = ["new", "york", "City", "the", "of", "é", "Über", "x\x01y", "　z", "w" * 300, "end"]
    out = []
    for _ in range(n):
        words = []
        for _ in range(r.randint(0, 40)):
            words += r.choice([["New", "York", "city"], ["of", "the"], [r.choice(vocab)], [r.choice(vocab)]])
        text = "".join(w + r.choice([" ", " ", "\t", "  ", ", ", ".\n", "\x0b", ":"]) for w in words)
        out.append((r.choice(["en", "en", "en", "fr", None, ""]), text))
    return out + [("en", None), ("en", ""), ("de", " .,; \n"), ("fr", "solo"), ("en", "a b c d " * 6000), ("en", "a b c d " * 40), ("en", "a b c d " * 40)]


def test_windows_are_counted_once():
    from convspark.llm.collocations import PAD, count_windows, words_of

    words = [w for block in words_of("A b. c\td E!f".encode()) for w in block]
    assert words == [b"a", b"b", PAD, b"c", b"d", b"e", PAD, b"f"]
    got = dict(zip(*(x.tolist() if hasattr(x, "tolist") else x.to_pylist() for x in count_windows(words * 2, 3))))
    assert got == {b"a b ": 2, b"b  ": 2, b"c d e": 2, b"d e ": 2, b"e  ": 2, b"f  ": 1, b"f a b": 1}
    got, n = count_windows([b"a"] * 5, 4)
    assert got.to_pylist() == [b"a   ", b"a a  ", b"a a a ", b"a a a a"] and n.tolist() == [1, 1, 1, 2]
    assert len(count_windows([PAD, PAD], 3)[0]) == 0
    wide = [b"%d" % i for i in range(3000)]     # more codes than six columns of one integer hold
    assert count_windows(wide, 6)[1].sum() == 3000


def test_against_brute_force(spark, monkeypatch):
    from convspark.llm import collocations as C

    monkeypatch.setattr(C, "SLICE_WORDS", 400)      # slices that cut texts
    monkeypatch.setattr(C, "BLOCK_BYTES", 50)
    monkeypatch.setattr(C, "RANGE_BYTES", 4000)     # prefixes that lie over several ranges
    rows = rows_of(1, 150)
    docs = spark.createDataFrame([(a, b, 1, "w1") for a, b in rows], "lang string, text string, n int, phrase string").repartition(3)
    for options in ({}, {"order": 4, "min_count": 3, "inside_percent": 80, "top": 25}, {"order": 2, "top": 3}):
        plain = dict(zip(("order", "min_count", "inside_percent", "top"), ("order", "least", "percent", "top")))
        want = brute(rows, **{plain[k]: v for k, v in options.items()})
        got = sorted(tuple(x) for x in C.collocations(docs, **options).collect())
        assert got == want and want
    counts = C.phrase_counts(docs, 3, 5)
    assert counts.filter("size = 0").agg(F.sum("f")).head()[0] == sum(len(re.findall(r"[^ \t\n\x0b\x0c\r.,;:!?]+", t or "")) for _, t in rows)
    assert C.collocations(docs.limit(0)).count() == 0


def test_counts_beyond_64_bits(spark, monkeypatch):
    from convspark.llm import collocations as C

    big = 3_000_000_019
    counts = spark.createDataFrame([("en", "", 0, 9 * big), ("en", "a", 1, 2 * big), ("en", "b", 1, big + 1), ("en", "a b", 2, big)],
                                   "lang string, phrase string, size int, f long")
    monkeypatch.setattr(C, "phrase_counts", lambda *a: counts)
    got = C.collocations(spark.createDataFrame([], "lang string, text string")).collect()
    assert [tuple(x) for x in got] == [("en", 1, "a b", big, 2 * big, big + 1, 9 * big, 1_000_000 * big * big // (2 * big * (big + 1)))]
