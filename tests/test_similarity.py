"""Word-sorted similarity and the fuzzy FAQ against brute force."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from groundwork.operators import facts, similarity

ABC = st.text("ab cé", max_size=40)


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            here = row[j + 1]
            row[j + 1] = before + 1 if x == y else max(row[j + 1], row[j])
            before = here
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(ABC, max_size=6), ABC)
def test_a_block_gives_common_subsequences(texts, text):
    assert similarity.Block(texts).common(text).tolist() == [common(t, text) for t in texts]


@settings(max_examples=200, deadline=None)
@given(ABC, ABC, st.sampled_from([50, 80, 95]))
def test_lengths_bound_the_score(a, b, threshold):
    if a and b and round(float(similarity.Block([a]).scores(b)[0])) >= threshold:
        assert min(len(a), len(b)) >= similarity.shortest_share(threshold) * max(len(a), len(b))


def test_words_are_sorted_in_any_script():
    assert similarity.sorted_words("Zur_Straße, ÉTÉ?! 日本 10%") == "10 zur_straße été 日本"
    assert similarity.sorted_words(None) == similarity.sorted_words("?!") == ""


def brute(questions, faq, priority, threshold, blocked):
    out = []
    for qid, text in questions:
        hit = next((q for w, q in priority.items() if text and w in text.lower() and q in faq), None)
        if hit:
            out.append((qid, hit, 100))
            continue
        qs, best = similarity.sorted_words(text), None
        for f in sorted({f for f in faq if f}):
            fs = similarity.sorted_words(f)
            if qs and fs:
                score = (1 - (len(qs) + len(fs) - 2 * common(qs, fs)) / (len(qs) + len(fs))) * 100
                if best is None or score > best[0]:
                    best = (score, f)
        if best and round(best[0]) >= threshold and best[1] not in blocked:
            out.append((qid, best[1], round(best[0])))
    return sorted(out)


def test_fuzzy_faq_equals_brute_force(spark):
    rng = random.Random(4)
    words = ["refund", "price", "how", "do", "i", "the", "claim", "token", "été", "übung"]
    faq = [" ".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(60)] + [None, "", "?!", "How do refunds work?", "the the price?"]
    questions = [(i, " ".join(rng.choices([*words, "x"], k=rng.randrange(0, 9))).upper()) for i in range(150)] + [(200, None), (201, "..."), (202, "any REFUNDS here"), (203, "x" * 5000), (202, "any REFUNDS here")]
    priority, blocked = {"claim": "not listed", "refunds": "How do refunds work?"}, [faq[0], faq[1]]
    q, f = spark.createDataFrame(questions, "query_id long, text string"), spark.createDataFrame([(x,) for x in faq], "question string")
    want = brute(questions, faq, priority, 80, blocked)
    assert len(want) > 40
    for options in ({}, {"block_chars": 60, "part_rows": 30}):  # many blocks, cut lengths, many parts
        got = facts.fuzzy_faq(q, f, priority, 80, blocked, **options)
        assert sorted((r.query_id, r.question, r.score) for r in got.collect()) == want
        assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    assert facts.fuzzy_faq(q, f.limit(0), priority).count() == 0
    assert facts.fuzzy_faq(q.limit(0), f, priority).count() == 0
