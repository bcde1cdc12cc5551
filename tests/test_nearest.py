"""Exact nearest items against brute force, and the hashing embedding in both its forms."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groundwork.operators import corpus, nearest


def brute(queries, items, k, digits=None):
    out = []
    for qid, q in queries:
        scored = []
        for iid, v in items:
            if q is None or v is None or len(v) != len(q) or None in v or None in q:
                continue
            n, m = (math.sqrt(sum(x * x for x in a)) for a in (v, q))
            if 0 < n < math.inf and 0 < m < math.inf:
                s = sum(x * y for x, y in zip(v, q, strict=True)) / (n * m)
                scored.append((-(s if digits is None else round(s, digits)), iid))
        out += [(qid, iid, rank) for rank, (_, iid) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_topk_equals_brute_force(spark, spread):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8))
    items = [(f"i{j:04}", (centres[j % 12] + spread * rng.normal(size=8)).tolist()) for j in range(1500)]
    items += [(f"copy{j}", items[7][1]) for j in range(40)]  # many equal vectors
    items += [("null", None), ("zero", [0.0] * 8), ("short", [1.0]), ("hole", [1.0, None] * 4), ("far", [math.inf] + [1.0] * 7), ("i0003", [1.0] * 8)]
    queries = [(q, (centres[q % 12] + spread * rng.normal(size=8)).tolist()) for q in range(60)] + [(100, items[7][1]), (101, [0.0] * 8), (102, None), (103, [2.0])]
    i = spark.createDataFrame(items, "item_id string, v array<double>").repartition(3)
    q = spark.createDataFrame(queries, "query_id long, q array<double>")
    want = brute(queries, items, 5)
    for options in ({}, {"block_bytes": 1000}, {"chunk_bytes": 1}):
        found = corpus.vector_topk(q, i, 5, **options)
        assert sorted((r.query_id, r.item_id, r["rank"]) for r in found.collect()) == want
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    rounded = corpus.vector_topk(q, i, 5, digits=2)
    assert sorted((r.query_id, r.item_id, r["rank"]) for r in rounded.collect()) == brute(queries, items, 5, 2)
    assert corpus.vector_topk(q.limit(0), i, 5).count() == corpus.vector_topk(q, i.limit(0), 5).count() == 0


def test_the_angle_bound_leaves_groups_out():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(32, 16))
    items = np.concatenate([centres[g] + 0.02 * rng.normal(size=(200, 16)) for g in range(32)])
    rng.shuffle(items)
    queries = centres[:10] + 0.02 * rng.normal(size=(10, 16))
    low = np.full(10, -np.inf)
    q, i, _, left_out = nearest.top(queries, nearest.unit(queries)[1], items, np.arange(len(items)), 4, low)
    exact = nearest.unit(queries)[0] @ nearest.unit(items)[0].T
    assert [sorted(i[q == k].tolist()) for k in range(10)] == [sorted(np.argsort(-exact[k])[:4].tolist()) for k in range(10)]
    assert left_out > 0.8 * len(items) * 10


def test_embedding_equals_its_definition(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["a", "B2", "c", "é", "word"], k=rng.randrange(0, 12))) for _ in range(40)] + [None, "", "?", "word " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    dense = {r.doc_id: r.v for r in corpus.hash_vectors(df, dim=32).collect()}
    sparse = {}
    for r in corpus.hash_embed(df, dim=32).collect():
        sparse.setdefault(r.doc_id, {})[r.bucket] = r.weight
    for key, text in enumerate(texts):
        words = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in (text or "").lower()).split()
        want = Counter()
        for g in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]:
            d = hashlib.sha256(g.encode()).digest()
            want[int.from_bytes(d[:8], "big") % 32] += 1 if d[8] % 2 == 0 else -1
        norm = math.sqrt(sum(n * n for n in want.values())) or 1
        assert dense[key] == pytest.approx([want[b] / norm for b in range(32)])
        assert sparse.get(key, {}) == pytest.approx({b: n / norm for b, n in want.items() if n})


def test_each_gram_is_hashed_once_and_forgotten_in_time(monkeypatch):
    rng = random.Random(4)
    rows = [[rng.choice("abcdefgh") for _ in range(rng.randrange(9))] for _ in range(200)] + [[], None, ["a"]]
    texts, calls = pa.array([None if w is None else "-é ".join(w) for w in rows], pa.string()), []
    real = hashlib.sha256
    monkeypatch.setattr(corpus.hashlib, "sha256", lambda b: (calls.append(b), real(b))[1])
    for dim in (16, 1 << 20):
        for sizes in ((1,), (2,), (1, 2), (1, 3)):
            want = Counter()
            for r, words in enumerate(w or [] for w in rows):
                for n in sizes:
                    for g in (" ".join(words[i : i + n]) for i in range(len(words) - n + 1)):
                        d = real(g.encode()).digest()
                        want[r * dim + int.from_bytes(d[:8], "big") % dim] += 1 - 2 * (d[8] & 1)
            want = {k: v for k, v in want.items() if v}
            calls.clear()
            grams = corpus.Grams(dim, sizes)
            for known in (corpus.KNOWN_GRAMS, corpus.KNOWN_GRAMS, 0):
                monkeypatch.setattr(corpus, "KNOWN_GRAMS", known)
                assert dict(zip(*(x.tolist() for x in grams.sums(texts)), strict=True)) == want
                times = Counter(calls).values()
                assert set(times) == {1 if known else 2}
            monkeypatch.undo()
            monkeypatch.setattr(corpus.hashlib, "sha256", lambda b: (calls.append(b), real(b))[1])
            assert corpus.Grams(dim, sizes).sums(texts.slice(200, 2))[0].tolist() == []


def test_words_are_parted_by_blanks_of_any_script(spark):
    text = "\x1c a b　c\x85d e\x1ff \n"
    df = spark.createDataFrame([(1, text), (2, " "), (3, ""), (4, None)], "doc_id long, text string")
    got = corpus.chunk_words(df, window=2, overlap=0).orderBy("chunk_index").collect()
    assert [r.content for r in got] == ["a b", "c d", "e f"] and text.split() == list("abcdef")
    assert corpus.chunk_words(df.where(F.col("doc_id") > 1)).count() == 0
