"""Phrases, source divergence and chat formatting against brute force, and on odd and empty tables."""

import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from groundwork.llm import chat, divergence, phrases
from groundwork.llm import queries as Q
from tests.compare import same

LONG = "lorem ipsum dolor " * 20_000
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_phrases", "op12_source_divergence", "op13_chat_format"])
def test_sql(spark, sf_dir, duck, name):
    same(Q.QUERIES[name](spark, sf_dir), duck, Q.ORACLE[name])


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names the operators use themselves."""
    data = [(None, "en", "a"), ("", "en", None), (LONG, "en", "a"), (LONG, "en", "b"), ("Same text, same text! ÉTÉ été", None, "a"), ("Same text, same text! ÉTÉ été", None, "a"), ("12 34 !!", "de", "a"), (None, None, None), ("a a a a a a", "xx", "only")]
    d = spark.createDataFrame(data, "text string, lang string, source string")
    return d.withColumns({c: F.lit("clash") for c in ("term", "n", "documents", "prefix", "phrase", "size", "part", "rank", "item", "value", "a", "l", "place", "vector", "doc_id")})


# --- phrases ----------------------------------------------------------------


def brute_phrases(rows, least, most, longest=4, share=80):
    count, total = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            count.update((lang or "und", tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    wanted = {k: n for k, n in count.items() if len(k[1]) > 1 and n >= least}
    out = defaultdict(list)
    for (lang, w), a in wanted.items():
        cuts = [(2_000_000 * a // (count[lang, w[:k]] + count[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        longer = [n for (x, q), n in wanted.items() if x == lang and len(q) > len(w) and any(q[i : i + len(w)] == w for i in range(len(q)))]
        if not any(100 * n >= share * a for n in longer):
            out[lang].append((-score, -a, " ".join(w).encode(), count[lang, w[:k]], count[lang, w[k:]]))
    return sorted((lang, rank, p.decode(), -a, left, right, total[lang], -score) for lang, found in out.items() for rank, (score, a, p, left, right) in enumerate(sorted(found)[:most], 1))


def mined(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_phrases_equal_brute_force(spark, monkeypatch):
    # Small containers, so that they burst and leave as runs; so few bits that wrong phrases are let through.
    for name, value in (("BURST", 3), ("HELD", 20), ("WORDS", 12), ("TOKENS", 7)):
        monkeypatch.setattr(phrases, name, value)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)] + ["É", "#", "\x1c", "Straße"]
    data = [(" ".join(rng.choices(words, weights=range(1, 17), k=rng.randrange(0, 60))) + rng.choice([".", "\n", "  \t", ",x"]) + "the old red fox ran", rng.choice(["en", "de", None])) for _ in range(300)]
    df = spark.createDataFrame(data, "text string, lang string").repartition(3)
    for bits in (1024, 1 << 31):
        assert mined(phrases.mine_phrases(df, least=6, most=40, most_bits=bits)) == brute_phrases(data, 6, 40)
    assert mined(phrases.mine_phrases(df, least=6, most=10**6, longest=3, share=50)) == brute_phrases(data, 6, 10**6, 3, 50)
    assert mined(phrases.mine_phrases(df, least=6, most=5, longest=2)) == brute_phrases(data, 6, 5, 2)


def test_trie_bursts_and_spills_whole_subtrees(monkeypatch):
    monkeypatch.setattr(phrases, "BURST", 4)
    rng, trie, want = random.Random(1), phrases.Trie(4), Counter()
    for _ in range(60):
        batch = Counter(tuple(rng.randrange(1, 6) for _ in range(rng.choice([2, 3, 4]))) for _ in range(50))
        some = np.array([list(p) + [0] * (4 - len(p)) for p in sorted(batch)])
        trie.add(some[:, 0], trie.pack(some[:, 1:]), np.array([batch[p] for p in sorted(batch)]))
        want += batch
    assert trie.size == len(want) and isinstance(trie.root[1], phrases.Node) and any(isinstance(x, phrases.Node) for x in trie.root[1].values())
    got: Counter = Counter()
    for down_to in (trie.size // 2, 0):
        for first, packed, counts in trie.spill(down_to, 10):
            ids = zip(*(x.tolist() for x in trie.unpack(first, packed)), strict=True)
            for p, n in zip(ids, counts.tolist(), strict=True):
                assert p[0] not in trie.root
                got[tuple(i for i in p if i)] += n
        assert trie.size <= down_to
    assert got == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=4))
def test_hashes_of_one_and_of_many_agree(hs):
    x, y = None, None
    for h in hs:
        x, y = phrases.mixed(np.array([h], np.uint64), x), phrases.mixed_one(h, y)
    assert int(x[0]) == y


def test_phrases_on_odd_and_empty_tables(spark, odd):
    found = mined(phrases.mine_phrases(odd, least=2))
    assert found == brute_phrases([(r.text, r.lang) for r in odd.collect()], 2, 2000)
    assert ("und", 1, "same text", 4, 4, 4, 12, 1_000_000) in found
    assert phrases.mine_phrases(odd.limit(0)).count() == 0
    assert phrases.mine_phrases(odd.limit(0)).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_scores_pass_64_bits(spark, monkeypatch):
    big = 2**62
    made = spark.createDataFrame([("en", "a", big, 1), ("en", "b", big - 1, 1), ("en", "a b", big - 2, 2), ("en", None, big, 0)], "lang string, phrase string, n long, size int")
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *a: made)
    (r,) = phrases.mine_phrases(made.withColumn("text", F.lit(""))).collect()
    assert r.score == 2_000_000 * (big - 2) // (2 * big - 1)


# --- divergence -------------------------------------------------------------


def brute_divergence(rows, least, most):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        have = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in have.items() if n >= least)
        counts = {s: Counter(t for d in mine if d[1] == s for t in d[2]) for s in {d[1] for d in mine}}
        whole = sum(counts.values(), Counter())

        def scaled(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: scaled(c) for s, c in counts.items()}, scaled(whole)
        for s in counts:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in counts if o != s]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:most])):
                out += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


def audited(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_divergence_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"x{chr(97 + i)}y" for i in range(26)] + ["Été", "日本"]
    data = [(" ".join(rng.choices(words, weights=[1 + i // (1 + j % 4) for i in range(28)], k=rng.randrange(0, 40))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None])) for j in range(300)]
    data.append(("nothing kept here", "fr", "lonely"))
    df = spark.createDataFrame(data, "text string, lang string, source string").repartition(3)
    assert audited(divergence.source_divergence(df, least_documents=20, most_terms=4)) == brute_divergence(data, 20, 4)
    monkeypatch.setattr(divergence, "BLOCK", 5)  # many blocks in a partition, and many counts a task
    monkeypatch.setattr(divergence, "HELD", 10)
    assert audited(divergence.source_divergence(df, least_documents=20, most_terms=4)) == brute_divergence(data, 20, 4)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0, 0, 1, 2, 9]), st.sampled_from([0, 3, 3, 9])), min_size=1, max_size=40))
def test_common_runs_give_the_sum_of_differences(columns):
    a, b = (np.array(c) for c in zip(*columns, strict=True))
    runs = [divergence.run_lengths(np.flatnonzero(c), c[c > 0], len(c)) for c in (a, b)]
    assert divergence.run_difference(*runs) == np.abs(a - b).sum()
    assert all(len(v) < 2 or (np.diff(v) != 0).all() for _, v in runs)


def test_scaled_counts_pass_64_bits(spark):
    counts, total, kept = [0, 7, 10**12, 2**61], 2**62, 1000
    want = [1 + 1_000_000_000 * (c + 5) // (total + 5 * kept) for c in counts]
    assert divergence.scaled_runs(np.array(counts), total, kept).tolist() == want
    df = spark.createDataFrame([(c, total, kept) for c in counts], "c long, t long, v long")
    assert [r[0] for r in df.select(divergence.scaled("c", F.col("t"), F.col("v"))).collect()] == want


def test_divergence_on_odd_and_empty_tables(odd):
    found = audited(divergence.source_divergence(odd, least_documents=2))
    assert found == brute_divergence([(r.text, r.lang, r.source) for r in odd.collect()], 2, 50)
    assert divergence.source_divergence(odd.limit(0)).count() == 0
    with pytest.raises(ValueError, match="most_groups"):
        divergence.source_divergence(odd, most_groups=2)


# --- chat -------------------------------------------------------------------

MARKS = st.lists(st.sampled_from(["#", "### ", "\\", "</turn>", "</turn>\n", "<", "/turn>", ": ", ":", "assistant", "é", "\n", "x"]), max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(MARKS, MARKS), max_size=5))
def test_template_is_reversible(turns):
    pieces = [chat.written_turn(role, text) for role, text in turns]
    assert chat.read_turns("".join(p for p, _, _ in pieces)) == turns
    for (one, start, end), (_, text) in zip(pieces, turns, strict=True):
        assert chat.unescaped(one[start:end]) == text and "###" not in one[start:end] and "</turn>" not in one[start:end]


RECORDS = [
    ({"prompt": "hi", "completion": "yo"}, "prompt_completion", [("user", "hi"), ("assistant", "yo")]),
    ({"prompt": "hi", "completion": None}, "prompt_completion", [("user", "hi")]),
    ({"system": "be", "prompt": "hi", "response": "yo"}, "prompt_response", [("system", "be"), ("user", "hi"), ("assistant", "yo")]),
    ({"question": "q", "answer": 42}, "question_answer", [("user", "q"), ("assistant", "42")]),
    ({"instruction": "do", "input": "this", "output": "done"}, "instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"instruction": "do", "output": "done"}, "instruction", [("user", "do"), ("assistant", "done")]),
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, "messages", [("user", "a"), ("assistant", "b")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}, "message_parts", [("user", "ab")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}, {"value": "c"}]}, "from_value", [("user", "a"), ("assistant", "b"), ("", "c")]),
    ({"messages": []}, "messages", []),
    ({"prompt": "hi", "other": {"deep": [1]}}, None, []),
    ([1, 2], None, []),
    (None, None, []),
]


def test_fingerprints_choose_mappings(spark):
    data = [(i, None if r is None else json.dumps(r)) for i, (r, _, _) in enumerate(RECORDS)] + [(99, "{no json")]
    got = defaultdict(list)
    for r in chat.canonical_turns(spark.createDataFrame(data, "key long, record string")).collect():
        got[r.key].append(r)
    for i, (_, layout, turns) in enumerate([*RECORDS]):
        assert {r.layout for r in got[i]} == {layout}
        assert [(r.role, r.text) for r in sorted(got[i], key=lambda r: r.position or 0) if r.role is not None] == turns
    assert got[99][0].fingerprint is None and got[99][0].text is None
    extra = spark.createDataFrame([("k", json.dumps({"id": 7, "meta": {"a": [1]}, "prompt": "p", "completion": "c"}))], "key string, record string")
    assert [r.layout for r in chat.canonical_turns(extra, ignored=("id", "meta")).collect()] == ["prompt_completion"] * 2


def test_paths_tell_lists_from_fields_and_skip_nulls():
    assert chat.field_paths({"a": [{"b": 1}, {"c": {"d": None, "e": 2}}], "f": None, "g": {}}) == {"a[]", "a[].b", "a[].c.e"}
    prints = [f for x in chat.LAYOUTS for f in x.fingerprints()]
    assert len(prints) - len(set(prints)) <= 1  # only the prompt alone is told apart by order


def test_conversations_equal_brute_force_on_odd_rows(spark):
    data = [(1, 1, "assistant", "é\n### x"), (1, 0, "user", None), (1, None, "system", "first"), (1, 1, "assistant", "é\n### x"), (1, 1, "assistant", "a"), (None, 0, None, "no key"), (2, 0, "assistant", ""), (3, 5, "assi: stant", LONG)]
    data += [(4, i, "assistant" if i % 2 else "user", f"turn {i} </turn> \\") for i in range(400)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(5)
    records = df.select(F.col("conv_id").alias("key"), F.to_json(F.struct("turn", "role", "text")).alias("record"), F.lit(1).alias("part"), F.lit("x").alias("formatted"))
    turns = chat.canonical_turns(records)
    want = {}
    for key in {d[0] for d in data}:
        mine = sorted(((t is not None, t or 0, r or "", x or "") for k, t, r, x in data if k == key), key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        loss = "".join(x[3] for x in mine if x[2] == "assistant")
        want[key] = (len(mine), hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in mine).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for size in (1 << 20, 100):  # one part for each conversation, and many
        formatted = chat.format_turns(turns, part_chars=size)
        got = {r.key: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(formatted).collect()}
        assert got == want
        assert (formatted.groupBy("key").count().where("count > 1").count() > 0) == (size == 100)
    assert chat.read_back(chat.format_turns(chat.canonical_turns(records.limit(0)))).count() == 0
