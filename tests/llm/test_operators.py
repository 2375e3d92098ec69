"""Every operator against a brute-force version on a small table with nulls,
empty texts, repeated rows, ties, a long text and a clashing extra column."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, id string, hits int"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    words = lambda n: [r.choice(vocab) for _ in range(n)]
    texts = []
    for _ in range(12):
        base = words(r.randint(30, 120))
        for _ in range(5):
            w = list(base)
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = r.choice(vocab)
            texts.append(" ".join(w) if r.random() < 0.6 else "\n".join([" ".join(w[:20]), " ".join(w[20:])]))
    texts += [None, "", "", "one", "ONE", "one two three", "é ü\tß 漢字 <|endoftext|>", " \n\t ", "x" * 3000, " ".join(words(6000)), texts[0], texts[0]]
    out = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    return out + [out[0], out[3], (None, texts[1], None, None), (2, "another text of the same id " * 4, "clash", 2)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_exact_dedup(docs, rows, none):
    from convspark.llm.exact_dedup import drop_copies, exact_groups

    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(-1 if i is None else i)
    want = sorted((-1 if i is None else i, max(groups[t or ""]), len(groups[t or ""]), sha((t or "").encode())) for i, t, *_ in rows)
    for weak in ({}, {"primes": (5, 3), "bases": (2, 2), "segment": 700, "chunk": 64}):     # weak: fingerprints collide
        got = exact_groups(docs, **weak).collect()
        low = lambda x: -1 if x is None else x
        assert sorted((low(r.id), low(r.keep_id), r.group_size, r.sha) for r in got) == want
        assert sum(r.kept for r in got) == len(groups)
    kept = drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_groups(none).count() == 0 and drop_copies(none).count() == 0


def test_fingerprints_combine():
    import numpy as np

    from convspark.llm.exact_dedup import BASES, PRIMES

    data = np.arange(5000) % 251
    whole = lambda x, p, r: sum(int(b) * pow(r, len(x) - 1 - i, p) for i, b in enumerate(x)) % p
    for p, r in zip(PRIMES, BASES):
        a, b = data[:1234], data[1234:]
        assert whole(data, p, r) == (whole(a, p, r) * pow(r, len(b), p) + whole(b, p, r)) % p


def test_shards(docs, rows, none):
    from convspark.llm.shard import assign_shards, jump_numpy

    def jump(key, n):
        key %= 2 ** 64
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % 2 ** 64
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    keys = [0, 1, -1, 2 ** 63 - 1, -2 ** 63, 123456789, -987654321]
    for n in (1, 2, 16, 17, 1000):
        assert jump_numpy(keys, n).tolist() == [jump(k, n) for k in keys]
    got = assign_shards(docs, 5).collect()
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown in (r.shard, 5)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({(r.id, r.shard) for r in got}) == len({r.id for r in got})
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    assert sorted((r.size, r.crc) for r in got) == want
    assert assign_shards(none, 5).count() == 0


def test_byte_bpe(docs, rows, none):
    import numpy as np
    import tiktoken

    from convspark.llm import byte_bpe

    path, pattern = byte_bpe.default_tokenizer()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    ids = lambda t: enc.encode_ordinary(t or "")
    got = byte_bpe.round_trip(docs, path, pattern).collect()
    want = sorted((-1 if i is None else i, len(ids(t)), sha(np.array(ids(t), "<u4").tobytes()), sha((t or "").encode())) for i, t, *_ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    back = byte_bpe.decode(byte_bpe.encode(docs, path, pattern), path, pattern)
    assert sorted(bytes(r.body) for r in back.collect()) == sorted((t or "").encode() for _, t, *_ in rows)
    assert byte_bpe.round_trip(none, path, pattern).count() == 0


def test_byte_bpe_long_words():
    import numpy as np
    import tiktoken

    from convspark.llm import byte_bpe

    path, pattern = byte_bpe.default_tokenizer()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    r = random.Random(7)
    cjk = ["".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(20)) for _ in range(20_000)]
    texts = ["a" * 100_000, "-" * 100_001, " " * 30_000 + "x", "".join(r.choice("ACGT") for _ in range(8_000)),
             "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3_000)), "ab" * 501 + "aab" * 333, " ".join(cjk)]
    for t, got in zip(texts, byte_bpe.Codec(path, pattern).encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == enc.encode_ordinary(t)


@pytest.mark.parametrize("short", (0, 64))
def test_byte_bpe_ranks_below_their_parts(tmp_path, monkeypatch, short):
    import base64
    from itertools import product

    import numpy as np
    import tiktoken

    from convspark.llm import byte_bpe

    monkeypatch.setattr(byte_bpe, "SHORT", short)
    # "aba" ranks below "ab" and "bab" below "ba": a contraction can bring up a better pair
    tokens = [bytes([i]) for i in range(256)] + [b"bab", b"aba", b"ab", b"abab", b"ba", b"aa"]
    path = tmp_path / "ranks.tiktoken"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(tokens)))
    pattern = r"[a-z]+|[^a-z]+"
    enc = tiktoken.Encoding("odd", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(str(path)), special_tokens={})
    texts = ["".join(x) for n in range(1, 11) for x in product("ab", repeat=n)]
    for t, got in zip(texts, byte_bpe.Codec(str(path), pattern).encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == enc.encode_ordinary(t)


def test_jaccard_join(docs, rows, none):
    import numpy as np

    from convspark.llm.jaccard_join import keep_one_of_group, linked_components, shingle_sets

    for k, percent in ((4, 85), (5, 80)):
        fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        sets = []
        for _, t, *_ in rows:
            w = (t or "").translate(fold).split()
            sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
        assert [len(s) for s in shingle_sets([t for _, t, *_ in rows], k)] == [len(s) for s in sets]
        up = {}

        def find(x):
            while up.get(x, x) != x:
                x = up[x]
            return x

        for a, (i, *_) in enumerate(rows):
            for b, (j, *_) in enumerate(rows[:a]):
                common = len(sets[a] & sets[b])
                if i is not None and j is not None and common and 100 * common >= percent * len(sets[a] | sets[b]):
                    x, y = find(i), find(j)
                    up[max(x, y)] = min(x, y)
        got = {(r.id, r.n, r.component) for r in linked_components(docs, k=k, percent=percent).collect() if r.id is not None}
        assert got == {(i, len(s), find(i)) for (i, *_), s in zip(rows, sets) if i is not None}
    kept = keep_one_of_group(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {None} | {i for i, *_ in rows if i is not None and find(i) == i}
    assert linked_components(none).count() == 0
    assert np.array_equal(shingle_sets(["A b\tC  d e"], 4)[0], shingle_sets(["a b c d e"], 4)[0])


def test_suffix_dedup(docs, rows, none, monkeypatch):
    import numpy as np

    from convspark.llm import suffix_dedup

    low = lambda i: suffix_dedup.NO_ID if i is None else i
    first = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for s in range(len(b) - 49):
            first[b[s:s + 50]] = min(first.get(b[s:s + 50], low(i)), low(i))
    want = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 49):
            if first[b[s:s + 50]] < low(i):
                gone[s:s + 50] = True
        spans = int((np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1).sum())
        want.append((low(i), len(b), int(gone.sum()), spans, sha(np.frombuffer(b, np.uint8)[~gone].tobytes())))
    for hot in (10_000, 2):
        monkeypatch.setattr(suffix_dedup, "HOT_BUCKET", hot)
        got = [(low(r.id), r.n_bytes, r.n_removed, len(r.spans), sha(bytes(r.kept))) for r in suffix_dedup.remove_repeats(docs).collect()]
        assert sorted(got) == sorted(want)
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_decontamination(spark, docs, none):
    from convspark.llm import decontam

    r = random.Random(2)
    items = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(30)) for _ in range(20)]
    bench = spark.createDataFrame([*enumerate(items), (3, items[3]), (90, None), (91, "short")], "item_id long, text string")

    def edited(s, k):
        s = list(s)
        for _ in range(k):
            p, op = r.randrange(len(s)), r.choice("sid")
            s[p:p + (op != "i")] = [] if op == "d" else [r.choice("xyz")]
        return "".join(s)

    budget = [int(decontam.ERROR_RATE * len(t)) for t in items]
    planted = [(i, f"before {edited(t, r.randint(0, b))} after", None, 7) for i, (t, b) in enumerate(zip(items, budget))]
    clean = [(100 + i, f"before {edited(t, 4 * b)}", None, 7) for i, (t, b) in enumerate(zip(items, budget))]
    df = spark.createDataFrame([*planted, *clean, (200, None, None, 1), (201, items[0].upper().replace(" ", "\n"), None, 1)], SCHEMA)
    for block in (1_000_000, 300):       # 300: an item a block, scanned one after the other
        got = {x.doc_id: sorted(h.item_id for h in x.found) for x in decontam.find_contamination(df, bench, hits_col="found", block_chars=block).collect()}
        assert all(i in got[i] for i in range(20)) and got[200] == [] and 0 in got[201]
        assert sum(bool(got[100 + i]) for i in range(20)) == 0
    kept = decontam.drop_contaminated(df, bench)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {*range(100, 120), 200}
    assert decontam.drop_contaminated(none, bench).count() == 0
    assert decontam.drop_contaminated(docs, bench.limit(0)).count() == docs.count()


def test_quality(spark, docs, none):
    from convspark.llm import quality

    r = random.Random(1)
    good = lambda: ". ".join(" ".join("".join(r.choice("etaoin") for _ in range(r.randint(2, 8))) for _ in range(9)) for _ in range(6))
    bad = lambda: " ".join(["BUY!! $$$ NOW!!"] * r.randint(5, 40))
    data = [(i, good() if i % 3 else bad(), "en", 0) for i in range(300)]
    df = spark.createDataFrame(data, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, quality int")
    kept = quality.drop_low_quality(df, labels)
    assert kept.columns == df.columns
    assert sum((x.doc_id % 3 > 0) for x in kept.collect()) >= 196 and kept.count() <= 204
    one_class = quality.fit_quality(docs, labels.filter("quality = 1"))[0]
    assert one_class.rules == []
    assert quality.drop_low_quality(none, labels.limit(0)).count() == 0
    assert docs.select(quality.held_out("doc_id").alias("h")).filter("h is null").count() == 0


def test_url_rules(spark):
    from convspark.llm import url_filter

    urls = ["http://a.org/x", "http://x.example.org/es/1?q", "https://example.org/en/12", "http://EXAMPLE.org/en/2", "http://b.com/fr/1",
            "http://b.com/de/1#t", "http://b.net/de/1", "http://org", "no scheme", None, "http://c.com", "http://notexample.org/es/"] * 3
    want = {"http://a.org/x": "org/", "http://x.example.org/es/1?q": "example.org/es/", "https://example.org/en/12": "example.org/en/1",
            "http://EXAMPLE.org/en/2": "org/", "http://b.com/fr/1": "com/fr/", "http://b.com/de/1#t": "com/de/", "http://notexample.org/es/": "org/"}
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.judge_urls(df).collect()
    assert len(got) == len(urls)
    for r in got:
        assert r.rule == want.get(r.url) and r.verdict in ("allow", "block")
        assert r.rule is None or r.verdict == ("allow" if r.rule in ("org/", "com/fr/") else "block")
    assert {(r.host, r.path) for r in got if r.url in (None, "no scheme")} == {("", "")}
    assert {(r.host, r.path) for r in got if r.url == "http://org"} == {("org", "")}
    assert url_filter.judge_urls(df.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(df.filter("url like '%.net%'")).collect()} == {"allow"}


def test_line_templates(spark, docs, none):
    from convspark.llm.line_templates import drop_recurring_lines

    data = [(i, f"own words number {chr(97 + i) * 3} stay\nUser {i} logged in from host {i * 7}\n\nall rights are kept by us", None, 0) for i in range(15)]
    data += [(50, None, None, 0), (51, "", None, 0), data[0], (60, data[0][1], None, 0)]
    got = drop_recurring_lines(spark.createDataFrame(data, SCHEMA), min_docs=10).collect()
    assert len(got) == len(data)
    for r in got:
        if r.id in (50, 51):
            assert (r.text, r.n_lines, r.n_dropped) == ("", 0, 0)
        else:
            assert r.n_lines == 4 and "logged in" not in r.text and "rights" not in r.text
    assert drop_recurring_lines(docs, min_docs=1000).agg(F.sum("n_dropped")).head()[0] == 0
    assert drop_recurring_lines(none).count() == 0


def test_line_templates_long_passages(spark):
    from convspark.llm.line_templates import drop_recurring_lines

    word = lambda i: chr(97 + i // 26) + chr(97 + i % 26)
    passage, dated = " ".join(map(word, range(51))), " ".join(["in 1999"] * 30)
    short = " ".join(map(word, range(100, 150)))
    data = [(0, f"one\n{passage}\n{short}\n{dated}", None, 0), (1, f"two\n{short}\n {passage.replace(' ', '  ')}", None, 0), (2, "two words", None, 0),
            (3, dated.replace("1999", "2001"), None, 0), (4, "copy of " + passage, None, 0), (5, "copy of " + passage, None, 0)]
    got = {r.id: (r.text, r.n_dropped) for r in drop_recurring_lines(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == {0: (f"one\n{short}\n{dated}", 1), 1: (f"two\n{short}", 1), 2: ("two words", 0), 3: (data[3][1], 0),
                   4: (data[4][1], 0), 5: (data[5][1], 0)}


def test_line_templates_share_a_leaf(spark):
    from convspark.llm.line_templates import drop_recurring_lines

    word = lambda i: chr(97 + i // 26) + chr(97 + i % 26)
    prose = lambda i: " ".join(word((i * 37 + j * 11 + i * j * 5) % 600) for j in range(6))
    data = []
    for i in range(12):
        even = f"1 2 {i} User {word(i)} opened report from {word(50 + i)}\n7 8 {i} Disk {word(i)} passed limit of {word(90 + i)}"
        hot = "\n".join(f"at the time job {word(i)} ended well on {word(j)}" for j in range(9)) + f"\nat the time key {word(i)} expired too early {word(i * 3)}"
        data.append((i, f"{even}\n{hot}\n1 2 3 {prose(i)}\nat the time {prose(i)}", None, 0))
    for r in drop_recurring_lines(spark.createDataFrame(data, SCHEMA)).collect():
        assert (r.text, r.n_dropped) == (f"1 2 3 {prose(r.id)}\nat the time {prose(r.id)}", 12)


def test_licences(spark, none):
    from convspark.llm import licences

    data = [(0, "first\nReleased under the MIT License.\nlast", None, 0), (1, "Licensed under the Apache License, Version 2.0.", None, 0),
            (2, "He had a licence to fish under the bridge.", None, 0), (3, None, None, 0), (4, "", None, 0), (5, "All rights reserved.", None, 0),
            (6, "This work is licensed under the GNU General Public License, version 3.", None, 0), (0, "Licensed under CC BY-NC 4.0.", None, 0)]
    df = spark.createDataFrame(data, SCHEMA)
    model = licences.fit_licences(spark, [f"plain words number {i} go on and on" for i in range(200)])
    got = sorted((r.id, tuple(x.family for x in r.found)) for r in licences.scan_licences(df, model).collect())
    assert got == [(0, ("CC-BY-NC",)), (0, ("MIT",)), (1, ("Apache-2.0",)), (2, ()), (3, ()), (4, ()), (5, ("reserved",)), (6, ("GPL",))]
    assert licences.scan_licences(none, model).count() == 0
    assert licences.unknown_paragraphs(none, "text") == []


def test_licences_wrapped_dual_and_spdx(spark):
    from textwrap import fill

    from convspark.llm import licences

    plain = "the river went over its banks and nobody in the village had seen it coming " * 40
    bsd, gpl, reserved = (licences.FAMILIES[f][1][0] for f in ("BSD", "GPL", "reserved"))
    want = [("MIT License or Apache License 2.0", ["Apache-2.0", "MIT"]), ("// SPDX-License-Identifier: MIT", ["MIT"]),
            ("SPDX-License-Identifier: GPL-2.0-only OR MIT", ["GPL", "MIT"]), ("SPDX-License-Identifier: CC-BY-SA-4.0", ["CC-BY-SA"]),
            *((fill(x, n, initial_indent=" * ", subsequent_indent=" * "), [f]) for f, x in (("BSD", bsd), ("GPL", gpl), ("reserved", reserved)) for n in (40, 75)),
            (f"{plain}Released under the MIT License. {plain}Licensed under CC BY-NC 4.0. {plain}{bsd} {plain}", ["BSD", "CC-BY-NC", "MIT"]),
            ("Released under the\n\nMIT", []), ("GNU Lesser General Public License, version 3", ["LGPL"]),
            ("Creative Commons Attribution-ShareAlike 4.0 International License", ["CC-BY-SA"]), (plain, []),
            (f"The MIT License\n{plain}\nApache License 2.0\n\nAll rights reserved.", ["Apache-2.0", "MIT", "reserved"])]
    df = spark.createDataFrame([(i, t, None, 0) for i, (t, _) in enumerate(want)], SCHEMA)
    model = licences.fit_licences(spark, [f"plain words number {i} go on and on" for i in range(200)])
    got = {r.id: sorted(x.family for x in r.found) for r in licences.scan_licences(df, model).collect()}
    assert got == {i: families for i, (_, families) in enumerate(want)}


def test_components_of_a_long_path(spark):
    from convspark.llm.components import components

    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 102), (102, 101), (5, 5)], "a long, b long")
    got = {r.node: r.comp for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


def test_op3_texts_meet_members_by_a_merge_join(spark):
    from convspark.llm import exact_dedup as X

    df = spark.createDataFrame([(1, "a"), (2, "a"), (None, "a"), (3, "b"), (4, None), (5, "")], "doc_id long, text string")
    units = X.materialize(X.fingerprints(df, "doc_id", "text"), "units")
    # a wrong group of texts of one length: every unit but its representative differs
    wrong = units.filter("n = 1").withColumns({"f0": F.lit(1).cast("long"), "f1": F.lit(1).cast("long")})
    out = X._differing(df, wrong, X.materialize(X._groups(wrong), "groups"), "doc_id", "text", X.CHUNK, "t")
    assert "SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id is None, r.id) for r in out.collect()) == [(False, 1), (False, 2), (True, None)]
