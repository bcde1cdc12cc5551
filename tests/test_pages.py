"""Line alignment against the standard library's matcher, and pages against what their markup says."""

import difflib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from groundwork.operators import alignment, corpus, drift, markup

PAGE = "slug string, text string"


def random_pages(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        alphabet = rng.choice(["ab", "abc", "abcdefgh", "abcdefghijklmnopqrstuvwxyz"])
        a = [rng.choice(alphabet) for _ in range(rng.randrange(30))]
        b = list(a) if rng.random() < 0.6 else [rng.choice(alphabet) for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(4)):
            if b and rng.random() < 0.5:
                b.insert(rng.randrange(len(b)), b.pop(rng.randrange(len(b))))
            elif b and rng.random() < 0.5:
                b.pop(rng.randrange(len(b)))
            else:
                b.insert(rng.randrange(len(b) + 1), rng.choice(alphabet))
        yield a, b


def test_opcodes_equal_the_standard_matcher():
    for a, b in random_pages(1, 5000):
        want = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
        x, y = ([ord(c) for c in s] for s in (a, b))
        assert alignment.between(alignment.blocks(x, y), len(a), len(b)) == want
        assert alignment.opcodes(a, b) == want
        for context in (0, 1, 3):
            assert alignment.unified(a, b, want, ("x", "y"), context) == "\n".join(difflib.unified_diff(a, b, "x", "y", lineterm="", n=context))


def test_pages_that_differ_at_their_ends_need_no_search(monkeypatch):
    rng = random.Random(8)
    pages = [[rng.choice(letters) for _ in range(rng.randrange(12))] for letters in ("a", "ab", "abc", "abcdefghij") for _ in range(200)]
    edits = (lambda p: ["x", *p[1:]], lambda p: ["x", *p], lambda p: p[1:], lambda p: p[1:] + p[:1], lambda p: ["x", *p[1:], "y"], lambda p: p[:-1] + ["x"], lambda p: p[2:])
    cases = [(p, edit(p)) for p in pages for edit in edits]
    want = [difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() for a, b in cases]
    assert [alignment.opcodes(a, b) for a, b in cases] == want
    monkeypatch.setattr(alignment, "SequenceMatcher", None)
    long = [str(i) for i in range(100_000)]
    for edit in edits:
        assert [c for c in alignment.opcodes(long, edit(long)) if c[0] == "equal" and c[2] - c[1] > 99_000]


def test_lines_in_one_pass_equal_python(spark):
    rng = random.Random(9)
    blanks = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u3000"
    texts = ["".join(rng.choice("ab" + blanks if i % 3 else "abcdef  \n\t") for _ in range(rng.randrange(30))) for i in range(4000)] + ["", " ", "\n", "a\r\n\r\nb ", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    lines = lambda t: "\n".join(x for x in (re.sub("[ \t]+", " ", y).strip() for y in t.splitlines()) if x)
    assert {r.i: r.text for r in drift.normalize_lines(rows).collect()} == {i: None if t is None else lines(t) for i, t in enumerate(texts)}


def test_many_equal_lines_take_the_automaton():
    a, b = ["x"] * 20_000 + ["y"], ["x"] * 9_000 + ["z"] + ["x"] * 10_000
    assert alignment.opcodes(a, b) == [("insert", 0, 0, 0, 9001), ("equal", 0, 10_000, 9001, 19_001), ("delete", 10_000, 20_001, 19_001, 19_001)]


def test_hunks_of_pages(spark):
    cases = list(random_pages(2, 300))
    old = spark.createDataFrame([(f"p{i}", "\n".join(a)) for i, (a, _) in enumerate(cases)], PAGE).repartition(3)
    new = spark.createDataFrame([(f"p{i}", "\n".join(b)) for i, (_, b) in enumerate(cases)], PAGE)
    got = {}
    for r in drift.page_hunks(old, new).orderBy("slug", "hunk").collect():
        got.setdefault(r.slug, []).append((r.op, r.old_lines, r.new_lines))
        assert r.hunk == len(got[r.slug])
    for i, (a, b) in enumerate(cases):
        want = [(op, a[i1:i2], b[j1:j2]) for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if op != "equal"]
        assert got.get(f"p{i}", []) == want


def test_a_moved_line_is_deleted_and_inserted(spark):
    old = spark.createDataFrame([("p", "a\nb\nc"), ("q", "same"), ("gone", "x"), ("end", "a\nb")], PAGE)
    new = spark.createDataFrame([("p", "c\na\nb"), ("q", "same"), ("new", "x"), ("end", "a\nb\n")], PAGE)
    got = [tuple(r) for r in drift.page_hunks(old, new).orderBy("hunk").collect()]
    assert got == [("p", 1, "insert", [], ["c"]), ("p", 2, "delete", ["c"], [])]
    # Sentinels of the very frames that are compared, and a page named twice.
    sentinels = old.select("slug").union(old.select("slug"))
    parity = {r.slug: (r.matches, r.diff) for r in drift.source_parity(new, old, sentinels).collect()}
    assert parity == {"p": (False, "--- repo:p\n+++ live:p\n@@ -1,3 +1,3 @@\n+c\n a\n b\n-c"), "q": (True, None), "end": (True, None)}
    for _ in range(3):
        assert drift.source_parity(new, old, sentinels).count() == 3
    assert drift.page_hunks(old.limit(0), new).count() == 0


def text(html):
    return markup.body_text(html, frozenset(drift.CHROME_TAGS), frozenset(drift.CHROME_CLASSES), frozenset(drift.CHROME_ATTRIBUTES))


@pytest.mark.parametrize(
    "html, want",
    [
        ("<nav><nav>x</nav>gone</nav>a", "a"),
        ("<ul class='nav'><li>x</ul>a", "a"),
        ('<p class="site-footer big">x<p>y</p></p>a', "a"),
        ("<p class=navigation>a</p>", "a"),
        ("<div data-nav>x</div><div data-navy>a</div>", "a"),
        ("caf&eacute; &#233;&#x41; &copy 2020 &amp &unknown; a&b", "café éA © 2020 & &unknown; a&b"),
        ("one <b>two</b> three<!-- no -->four", "one\ntwo\nthree\nfour"),
        ("<title>no</title><body class=x>a<p>b</body>no", "a\nb"),
        ("<title>t</title>a</p></b>b", "t\na\nb"),
        ('<script>var t="</p><nav>";</script>a<style>p{}</style><svg/>b', "a\nb"),
        ("<div/>a<br>b<img alt=x>c", "a\nb\nc"),
        ("<header>x<p>y</header>a", "a"),
        ("a < b \t\f c d\x85e ", "a < b\nc\nd\ne"),
        ("", ""),
        ("<nav>never closed", ""),
    ],
)
def test_body_text(html, want):
    assert text(html) == want


def test_pages_keep_their_columns_and_nulls(spark):
    pages = spark.createDataFrame([(1, "<p>a</p>", "x"), (2, None, "y"), (3, "<p>word </p>" * 20_000, None)], "page_id long, html string, html_body string")
    got = {r.page_id: (r.text, r.html_body) for r in drift.html_body_text(pages).collect()}
    assert got[1] == ("a", "x") and got[2] == (None, "y") and got[3] == ("\n".join(["word"] * 20_000), None)
    assert drift.html_body_text(pages.limit(0)).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from(["a", " ", "\t", "\f", "\v", "\r", "\n", "\x1c", "\x1e", "\x1f", "\x85", " ", " ", "\xa0", "　", "b"]), max_size=20).map("".join))
def test_lines_are_what_python_calls_lines(spark, t):
    df = spark.createDataFrame([(t,)], "text string")
    assert drift.normalize_lines(df).first()[0] == markup.collapsed(t)


def test_cards(spark):
    html = "<body><button class='big card' data-slug=a data-date='May 1, 2026' data-title='A &lt; B' data-pdf=x/a.pdf><i class=card data-slug=b data-pdf='previews/b.pdf'></i><I CLASS=card DATA-SLUG=c data-pdf='c.pdf'>"
    pages = spark.createDataFrame([(1, html, "updates"), (2, html, "old"), (3, None, "updates"), (4, html, None)], "page_id long, html string, listed_on string")
    got = sorted(tuple(r) for r in corpus.extract_cards(pages, card_class="card", excluded=("old",)).where("page_id = 1").collect())
    assert got == [(1, "updates", 0, "a", "A < B", "May 1, 2026", "x/a.pdf"), (1, "updates", 2, "c", None, None, "c.pdf")]
    assert {r.page_id for r in corpus.extract_cards(pages, card_class="card", excluded=("old",)).collect()} == {1, 4}


def test_texts_are_made_once_for_comparison(spark):
    raw = spark.createDataFrame([("a", "x\r\n y ", "x\nz\nz"), ("b", None, "x"), ("c", "q", "q"), ("d", "", "v"), ("a", "k", "k\nk")], "slug string, old string, new string")
    old, new = (drift.normalize_lines(raw.select("slug", F.col(c).alias("text"))) for c in ("old", "new"))
    plan = drift.changed_pairs(old, new)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 4  # two for each side
    got = {(r.slug, r.line): (r.removed, r.added) for r in drift.line_delta(old, new).collect()}
    # Two rows of a page on either side are four pairs: x y - x z z, x y - k k, k - x z z, k - k k.
    assert got == {("a", "y"): (2, 0), ("a", "z"): (0, 4), ("a", "k"): (0, 2), ("d", ""): (1, 0), ("d", "v"): (0, 1)}


def test_pages_without_a_text_are_compared_as_there(spark):
    base = drift.build_baseline(spark.createDataFrame([("a", None), ("b", None), ("c", "x"), ("d", "x"), ("e", "x"), (None, "x")], PAGE), "seed")
    new = spark.createDataFrame([("a", None), ("c", None), ("d", "x"), ("f", None)], PAGE)
    got = {r.slug: r.status for r in drift.compare_baseline(base, new).collect()}
    assert got == {"a": "changed", "b": "missing", "c": "changed", "d": "unchanged", "e": "missing", "f": "new", None: "new"}


def test_parity_tells_each_pair_of_pages_of_a_slug(spark):
    live = spark.createDataFrame([("p", "a\nb"), ("p", "c"), ("q", None), ("r", "x"), ("s", "x\n")], PAGE)
    repo = spark.createDataFrame([("p", "a\nb"), ("q", "x"), ("r", None), ("s", "x")], PAGE)
    got = sorted((r.slug, r.matches is None, r.matches, r.diff) for r in drift.source_parity(live, repo, repo.select("slug")).collect())
    diff = "--- repo:p\n+++ live:p\n@@ -1,2 +1 @@\n-a\n-b\n+c"
    assert got == [("p", False, False, diff), ("p", False, True, None), ("q", True, None, None), ("r", True, None, None), ("s", False, True, None)]


def test_only_accepted_texts_come_into_the_baseline(spark, tmp_path):
    from groundwork.plans.drift import QUERIES

    # Page 1000010 has the slug of the copy that the later pages have of page 10; the copy's text is not new to it.
    body = "<body><article><p>line</p></article></body>"
    spark.createDataFrame([(i, "u", body) for i in (110, 1000110)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((r.slug, r.seeded_from) for r in QUERIES["b17_advance_baseline"](spark, str(tmp_path)).collect())
    assert got == [("p-1000110", "pr:fp-1000110"), ("p-110", "pr:fp-110")]
    base = drift.build_baseline(spark.createDataFrame([("p", "a")], PAGE), "seed")
    accepted = spark.createDataFrame([("p", "f"), ("p", "f")], "slug string, fingerprint string")
    assert [(r.text, r.seeded_from) for r in drift.advance_baseline(base, spark.createDataFrame([("p", "b")], PAGE), accepted).collect()] == [("b", "pr:f")]
