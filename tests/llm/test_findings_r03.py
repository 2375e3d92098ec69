"""Cases of the third round's findings on the training-data operators."""

import random


def test_ordinary_paragraphs_are_not_scored_gram_by_gram(monkeypatch):
    from convspark.llm import licences as L

    classes = ["unknown", *sorted(L.FAMILIES)]
    rng, weights = random.Random(3), {}
    for family, text in L.notices():
        for g in sorted(L.grams(L.words_of(text))):
            row = weights.setdefault(g, [0.0] * len(classes))
            row[classes.index(family)] += rng.uniform(0, 0.6)
    model = L.LicenceModel(classes, weights, [3.0] + [0.0] * len(L.FAMILIES), 0.7)
    texts = [t for _, t in L.notices()][::3]
    words = L.words_of(" ".join(texts))
    texts += [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(300)]
    texts += ["Licensed under the MIT License or the Apache License 2.0, see GNU LGPL v2.1.", "SPDX-License-Identifier: MIT OR Apache-2.0", ""]
    scored = []
    full = L.LicenceModel.probabilities
    monkeypatch.setattr(L.LicenceModel, "probabilities", lambda self, w: scored.append(1) or full(self, w))
    got = [model.judge(t) for t in texts]
    assert any(len(x) > 1 for x in got)
    # with every paragraph scored in full the answers are the same
    monkeypatch.setattr(L.LicenceModel, "may_name", lambda self, w, unknown: True)
    assert [model.judge(t) for t in texts] == got
    monkeypatch.undo()
    monkeypatch.setattr(L.LicenceModel, "probabilities", lambda self, w: scored.append(1) or full(self, w))
    scored.clear()
    assert model.judge("crowded village rivers kept painted boats " * 20) == [] and not scored


def test_tokenizer_tasks_give_their_words_back():
    """A worker outlives its task: what a task remembered must not stay."""
    import pyarrow as pa

    from convspark.llm import byte_bpe as B

    c, tasks = B.codec(*B.default_tokenizer()), []

    class Rows:
        schema = {"doc_id": __import__("pyspark").sql.types.StructField("doc_id", __import__("pyspark").sql.types.LongType())}

        def select(self, *cols):
            return self

        def mapInArrow(self, run, schema):
            tasks.append(run)
            return self

    from unittest import mock

    with mock.patch.object(B, "F", mock.MagicMock()):
        B.round_trip(Rows(), *B.default_tokenizer())
    texts = [f"pzqword{i} xk{i}qu vrelm{i}" for i in range(500)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    first = [b.to_pylist() for b in tasks[0](iter([batch, batch]))]
    assert first[0] == first[1] and not c.known and not c.held
    assert [b.to_pylist() for b in tasks[0](iter([batch]))] == first[:1]


def test_tokenizer_slices_are_small():
    from convspark.llm.byte_bpe import batches_of

    rows = ["x" * 300_000] * 20 + [None, "y" * 3_000_000]
    parts = list(batches_of(rows))
    assert [t for p in parts for t in p] == [t or "" for t in rows]
    assert all(sum(map(len, p)) <= 1_300_000 for p in parts[:-1]) and len(parts) >= 5


def test_large_buckets_are_dealt_out_in_parts():
    """No part is larger than asked for, and nothing that meets is lost."""
    import numpy as np
    import pyarrow as pa
    from unittest import mock

    from convspark.llm import suffix_dedup as S

    rng = random.Random(5)
    rows = sorted((b, rng.randrange(40), p) for b, n in enumerate([9, 1, 30, 2, 4, 25, 3]) for p in range(n))
    owners = {b: {i for c, i, _ in rows if c == b} for b in range(7)}
    bucket_of = {(i, p): {b for b, j, q in rows if (j, q) == (i, p)} for _, i, p in rows}
    for step in (1, 3, 7, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[a:a + step])], names=["bucket", "id", "pos"])
                   for a in range(0, len(rows), step)]
        with mock.patch("pyspark.TaskContext.get") as get:
            get.return_value.partitionId.return_value = 2
            got = [(r["id"], r["pos"]) for b in S._met(iter(batches), 5) for r in b.to_pylist()]
        sizes = {}
        for _, key in got:
            sizes[key >> S.PART] = sizes.get(key >> S.PART, 0) + 1
        assert max(n for k, n in sizes.items() if k) <= 5 and len(sizes) > 10
        kept = {(i, key & (1 << S.PART) - 1) for i, key in got}
        # the first and the last bucket may go on next door
        assert all((i, p) in kept for b, i, p in rows if len(owners[b]) > 1 or b in (0, 6))
        assert all(any(len(owners[b]) > 1 or b in (0, 6) for b in bucket_of[x]) for x in kept)


def test_equal_pieces_are_sorted_once(monkeypatch):
    import numpy as np

    from convspark.llm import suffix_dedup as S

    rng, sorted_bytes, order = random.Random(8), [], S.suffix_order
    monkeypatch.setattr(S, "suffix_order", lambda text, starts, window=S.WINDOW: sorted_bytes.append(len(starts)) or order(text, starts, window))
    kinds = [bytes(rng.choices(b"ab", k=rng.randint(50, 84))) for _ in range(20)] + [b"a" * 70, b"a" * 60]
    pieces = [rng.choice(kinds) for _ in range(400)]
    ids = [rng.randrange(30) for _ in pieces]
    got = S.repeats_in_block(np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces]), np.array(ids))
    windows = [(p[a:a + 50], i) for p, i in zip(pieces, ids) for a in range(len(p) - 49)]
    least = {}
    for w, i in windows:
        least[w] = min(i, least.get(w, i))
    assert got.tolist() == [least[w] < i for w, i in windows]
    assert sorted_bytes == [sum(len(k) - 49 for k in set(pieces))]


def test_shuffle_files_go_with_the_write(spark):
    from convspark.llm import common

    before = spark.conf.get(common._CLEANUP)
    df = spark.range(1000).repartition(4, "id")
    assert common.materialize(df, "test_drop", drop_shuffles=True).count() == 1000
    assert spark.conf.get(common._CLEANUP) == before


def _task(operator, *args, name="docs"):
    """The Arrow function that an operator gives to ``mapInArrow``."""
    tasks = []

    class Rows:
        def select(self, *cols):
            return self

        def mapInArrow(self, run, schema):
            tasks.append(run)
            raise StopIteration

        class sparkSession:
            class sparkContext:
                broadcast = staticmethod(lambda x: type("Sent", (), {"value": x}))

    try:
        operator(Rows(), *args)
    except StopIteration:
        return tasks[0]


def test_shingling_tasks_hold_little(monkeypatch):
    """Beside a JVM that fills its heap, a worker has few hundred MB."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from convspark.llm import jaccard_join as J

    rng = random.Random(11)
    words = [f"w{rng.randrange(10 ** 6)}" for _ in range(4000)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(2000)]
    texts += texts[:60] * 5 + [None, "", "one two"]
    count, sets = _task(J.frequent_shingles, 4), J.shingle_sets(texts, 4)
    monkeypatch.setattr(J, "frequent_shingles", lambda docs, k: (np.empty(0, np.int64), np.empty(0, np.int64)))
    sign = _task(J.signatures, 4, 85)
    J._POWERS.clear()
    text = pa.array(texts)
    tracemalloc.start()
    counted = list(count(iter([pa.RecordBatch.from_arrays([text], names=["text"])])))
    signed = list(sign(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), text], names=["id", "text"])])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48e6 and max(b.num_rows for b in signed) < len(texts) / 2
    rows = [r for b in signed for r in b.to_pylist()]
    assert [(r["id"], r["n"]) for r in rows] == [(i, len(s)) for i, s in enumerate(sets)]
    values, n = np.unique(np.concatenate(sets), return_counts=True)
    often = n >= J.BATCH_REPEATS
    assert counted[0].column(0).to_pylist() == values[often].tolist() and often.any()
    assert counted[0].column(1).to_pylist() == n[often].tolist()


def test_slices_keep_every_row():
    import pyarrow as pa

    from convspark.llm.common import slices

    texts = ["a" * 9, None, "", "b" * 30, "cc", "d" * 8, None, "é" * 5]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    parts = list(slices(iter([batch, batch.slice(0, 0), batch.slice(2)]), 1, 10))
    assert [r for p in parts for r in p.to_pylist()] == batch.to_pylist() + batch.to_pylist()[2:]
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= 10 for p in parts)
    assert len(parts) < 2 * len(texts) - 2


def test_tokenizer_tasks_leave_no_tables():
    """Long words are contracted in tables, which must not stay with the worker."""
    import pyarrow as pa
    from unittest import mock

    from convspark.llm import byte_bpe as B

    class Rows:
        schema = {"doc_id": __import__("pyspark").sql.types.StructField("doc_id", __import__("pyspark").sql.types.LongType())}
        select = lambda self, *cols: self
        mapInArrow = lambda self, run, schema: run

    with mock.patch.object(B, "F", mock.MagicMock()):
        run = B.round_trip(Rows(), *B.default_tokenizer())
    texts = ["xq" * 90 + "zv" * 40, "plain words", None]
    out = list(run(iter([pa.RecordBatch.from_arrays([pa.array(range(3)), pa.array(texts)], names=["doc_id", "text"])])))
    assert sum(b.num_rows for b in out) == 3
    tables = B.codec(*B.default_tokenizer()).con.execute("SHOW TABLES").fetchall()
    assert sorted(t for t, in tables) == ["merges", "vocab"] or sorted(t for t, in tables) == ["m", "merges", "v", "vocab"]


def test_passages_shared_by_few_documents_of_each_batch_come_last(spark, monkeypatch):
    """A passage that many documents share, but no batch of them often, does
    not pair documents that differ enough besides it."""
    import numpy as np
    from pyspark.sql import functions as F

    from convspark.llm import jaccard_join as J

    rng = random.Random(23)
    new = lambda n: " ".join(f"w{rng.randrange(10 ** 9)}" for _ in range(n))
    shared = new(60)
    texts = [f"{new(40)} {shared}" for _ in range(60)] + [new(100) for _ in range(60)]
    near = new(100)
    texts += [f"{near} {new(2)}" for _ in range(3)] + [None, "", "one"]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(60, "doc_id")
    sets = J.shingle_sets(texts, 5)
    values, n = np.unique(np.concatenate(sets), return_counts=True)
    key, counts = J.frequent_shingles(docs, 5)
    assert (key.tolist(), counts.tolist()) == ((values[n >= 4] >> J.KEY_SHIFT).tolist(), n[n >= 4].tolist()) and len(key) >= 56
    tried = []
    verified = J._verified
    monkeypatch.setattr(J, "_verified", lambda pairs, *rest: tried.append(pairs.count()) or verified(pairs, *rest))
    got = {r.id: r.component for r in J.linked_components(docs, k=5, percent=80).collect()}
    same = [i for i, t in enumerate(texts) if t and t.startswith(near)]
    assert got == {i: min(same) if i in same else i for i in range(len(texts))}
    assert sum(tried) < 20


def test_counts_of_frequent_shingles_add_up(spark, monkeypatch):
    """Often in some batches, seldom in others, in one batch only, and never."""
    import numpy as np

    from convspark.llm import jaccard_join as J

    texts = ["a b c d"] * 9 + ["e f g h i"] * 3 + [None, ""] * 2 + ["a b c d e"] + ["x y"] * 5 + ["b c d e"]
    want = {}
    for s in J.shingle_sets(texts, 4):
        for h in s.tolist():
            want[h >> J.KEY_SHIFT] = want.get(h >> J.KEY_SHIFT, 0) + 1
    want = {h: n for h, n in want.items() if n >= J.BATCH_REPEATS}
    for parts in (1, 3, 30):
        docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(parts)
        key, n = J.frequent_shingles(docs, 4)
        assert dict(zip(key.tolist(), n.tolist())) == want and len(want) == 2 and np.all(np.diff(key) > 0)
    key, n = J.frequent_shingles(docs.limit(0), 4)
    assert not len(key) and not len(n)
