"""Hand-made cases of single operators."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from groundwork.functions import exprs as X
from groundwork.operators import corpus, drift, facts, kpi, messages, sections, surface
from groundwork.sources import files


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_chunk_words(spark):
    text = lambda n: " ".join(f"w{i}" for i in range(n))
    d = spark.createDataFrame([(0, ""), (1, "   "), (2, text(7)), (3, text(50)), (4, None), (5, text(1000))], "doc_id bigint, text string")
    got = {}
    for i, k, c in values(corpus.chunk_words(d, window=20, overlap=5), "doc_id", "chunk_index", "content"):
        got.setdefault(i, []).append((k, c.split()))
    assert set(got) == {2, 3, 5}
    assert [len(c) for _, c in sorted(got[3])] == [20, 20, 20]
    assert sorted({w for _, c in got[5] for w in c}) == sorted(text(1000).split())
    with pytest.raises(ValueError):
        corpus.chunk_words(d, window=5, overlap=5)


def test_merge_twice_is_merge_once(spark):
    cur = spark.createDataFrame([("a", "1", True), ("b", "2", True), ("c", "3", False)], "slug string, sha256 string, approved boolean")
    inc = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "slug string, sha256 string")
    allow = spark.createDataFrame([("4",)], "sha256 string")
    once = corpus.merge_corpus(cur, inc, allow)
    assert sorted(values(once, "slug", "sha256", "approved", "action")) == [("a", "1", True, "skip"), ("b", "9", False, "supersede"), ("c", "3", False, "keep"), ("d", "4", True, "insert")]
    twice = corpus.merge_corpus(once.select("slug", "sha256", "approved"), inc, allow)
    assert sorted(values(once, "slug", "sha256", "approved")) == sorted(values(twice, "slug", "sha256", "approved"))


def test_dates(spark):
    d = spark.createDataFrame([("January 5, 2026",), ("2026-01-05",), ("soon",), (None,), ("2026-13-05",)], "d string")
    assert [r[0] for r in values(d, X.display_date("d"))] == [dt.date(2026, 1, 5), dt.date(2026, 1, 5), None, None, None]


def test_tokens(spark):
    text = "Mail A.b@Example.org, see 0x" + "Ab" * 20 + " or https://e.org/x1. on 2026-01-05: 1,234.50 and 7% of abc9"
    d = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    got = {}
    for c, t in values(drift.extract_tokens(d), "category", "token"):
        got.setdefault(c, set()).add(t)
    assert got["address"] == {"0x" + "ab" * 20} and got["url"] == {"https://e.org/x1"} and got["date"] == {"2026-01-05"}
    assert got["email"] == {"a.b@example.org"} and got["number"] == {"1234.50", "7%"}


def brute_tokens(text):
    """Tokens by Python's own patterns, a category at a time with the spans before it blanked."""
    found = set()
    for category, pattern in drift.TOKENS:
        for t in re.findall(f"(?:{pattern})", text):
            found.add((category, t.lower() if category in ("address", "email") else t.rstrip(".,;:)") if category == "url" else t.replace(",", "") if category == "number" else t))
        text = re.sub(pattern, " ", text)
    return found


def test_tokens_equal_brute_force(spark, sf_dir):
    texts = ["", "5é and é5 but 5 é", "12,5 3.14.15 .7 8% 9%% 1,2,3, x_4 4_x 7-8 $9", "müller@grün.de, Ä.b+c@x-y.org.", "on 5 März 2026 or 5 March 2026, 2026-01-05é", "٣ and 1\u00a0000", "see https://e.org/ü?a=1). 0x" + "aB" * 21, "9" * 3000]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect() if r.text is not None]
    d = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "doc_id bigint, text string")
    got = {}
    for i, c, t in values(drift.extract_tokens(d), "doc_id", "category", "token"):
        assert (c, t) not in got.setdefault(i, set())
        got[i].add((c, t))
    assert {i: got.get(i, set()) for i in range(len(texts))} == {i: brute_tokens(t) for i, t in enumerate(texts)} and -1 not in got


def test_leading_amount(spark):
    cases = {"100,000 XYZ or $5": 100000, " 70 ": 70, "12xyz": None, "5 XYZs": None, "$5 for 7 XYZ": None, "about 7 XYZ": None, "7.5 XYZ": None, "": None, ",": None, "3 XYZ": 3, None: None}
    d = spark.createDataFrame([(t,) for t in cases], "t string")
    assert dict(values(d, "t", X.leading_amount("t", "XYZ"))) == cases


def test_inventory_and_faq(spark, tmp_path):
    p = tmp_path / "inventory.json"
    p.write_text('[{"kind": "post", "slug": "a", "words": 7, "gated": true, "more": 1},\n {"slug": "b", "sha256": null}]')
    got = files.read_inventory(spark, str(p))
    assert sorted(values(got, "slug", "kind", "words", "gated", "title")) == [("a", "post", 7, True, None), ("b", None, None, None, None)]
    assert got.columns == [f.split()[0] for f in files.INVENTORY.split(", ")]
    q = tmp_path / "faq.json"
    q.write_text('{"fees": [{"question": "How much?", "answer": "1"}, {"question": "When?", "answer": "now"}], "none": []}')
    faq = files.read_faq(spark, str(q)).first().faq
    assert {k: [(x.question, x.answer) for x in v] for k, v in faq.items()} == {"fees": [("How much?", "1"), ("When?", "now")], "none": []}


def test_versions_stay_beside_each_other(spark, tmp_path):
    one, two = (files.write_version(spark.range(n), str(tmp_path / "t"), v) for n, v in ((3, "a"), (5, "b")))
    assert one != two and (spark.read.parquet(one).count(), spark.read.parquet(two).count()) == (3, 5)
    with pytest.raises(Exception):
        files.write_version(spark.range(1), str(tmp_path / "t"), "a")


def test_nested_fact_values(spark):
    f = spark.createDataFrame([("a.x", '{"p": "12", "q": ["https://e.org/a", "0x' + "1" * 40 + '"]}'), ("a.y", "unknown"), ("a.z", "5,000")], "key string, value string")
    got = sorted(values(drift.fact_value_index(f), "category", "token", "key"))
    assert got == [("address", "0x" + "1" * 40, "a.x"), ("number", "12", "a.x"), ("number", "5000", "a.z"), ("url", "https://e.org/a", "a.x")]


def test_sitemap(spark, tmp_path):
    p = tmp_path / "s.xml"
    p.write_text('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://e.org/</loc></url><url><loc> https://e.org/a/b/ </loc></url></urlset>')
    assert sorted(values(files.sitemap_slugs(spark, str(p)), "slug")) == [("a/b",), ("index",)]
    bad = tmp_path / "bad.xml"
    bad.write_text("<urlset><url><loc>https://e.org/</url>")
    with pytest.raises(Exception):
        files.sitemap_slugs(spark, str(bad)).collect()


def test_upstream_time(spark):
    d = spark.createDataFrame([("2026-01-05T01:02:03.5Z",), ("1-5-2026 3:04 PM",), ("01-05-26 12:00 am",), ("never",), (None,)], "t string")
    assert [r[0] for r in values(d, kpi.parse_upstream_time("t"))] == ["2026-01-05T01:02:03.5Z", "2026-01-05T15:04:00", "2026-01-05T00:00:00", None, None]


def test_guard_strict(spark):
    r = spark.createDataFrame([("a",), ("b",)], "source string")
    assert values(kpi.guard_sources(r, ["b"]), "source") == [("b",)]
    with pytest.raises(Exception, match="blocked source"):
        kpi.guard_sources(r, ["b"], strict=True).collect()


def test_numbers(spark):
    assert one(spark, X.numbers_in(F.lit("$1,000.00 and 0.50, 007 or 12.340% of 4785380592391130"))) == ["1000", "0.5", "7", "12.34", "4785380592391130"]


def test_snake_case(spark):
    assert one(spark, X.snake_case(F.lit("totalXYZPresold"))) == "total_xyz_presold"


def test_terms_leave_link_targets(spark):
    r = messages.Rules(brand="Acme", brand_patterns=(r"(?i)\back-?me\b", r"(?i)\bacme\b"))
    d = spark.createDataFrame([("ACME [acme](https://x/acme) me@acme.io ack-me",)], "t string")
    once = messages.normalize_terms(d, ["t"], r)
    assert once.first().t == "Acme [Acme](https://x/acme) me@acme.io Acme"
    assert messages.normalize_terms(once, ["t"], r).first().t == once.first().t


def test_buttons_go_with_the_last_part_and_unknown_blocks_fail(spark):
    kind = "id int, blocks array<struct<type:string,text:string,label:string,value:string,source:string,as_of:string,items:array<struct<label:string,url:string>>>>"
    block = lambda t, text=None, items=None: (t, text, None, None, None, None, items)
    a, b = ("A", "https://a.example"), ("B", "https://b.example")
    good = [(1, [block("buttons", items=[a]), block("paragraph", "x" * 9), block("paragraph", "y" * 9), block("buttons", items=[b])]), (2, [block("buttons", items=[a])]), (3, [])]
    got = {r.id: [(m.text, [tuple(x) for x in m.buttons]) for m in r.messages] for r in messages.pack_messages(messages.render_blocks(spark.createDataFrame(good, kind)), limit=12).collect()}
    assert got == {1: [("x" * 9, []), ("y" * 9, [a, b])], 2: [("", [a])], 3: [("", [])]}
    with pytest.raises(Exception, match="unknown block type"):
        messages.render_blocks(spark.createDataFrame([(1, [block("carousel")])], kind)).collect()


def test_packing_joins_to_the_input(spark):
    d = spark.createDataFrame([(["a" * 5, "b" * 5, "c" * 30, "d"],), ([],)], "rendered array<string>")
    got = [r[0] for r in values(messages.pack_messages(d, limit=12), "parts")]
    assert got == [["aaaaa\n\nbbbbb", "c" * 30, "d"], [""]]


def test_commands(spark):
    d = spark.createDataFrame([("/Price@bot now\nplease",), ("/nope",), ("plain",)], "text string")
    assert values(messages.detect_command(d, ["price"]), "command", "args") == [("price", "now\nplease"), ("help", ""), (None, None)]


def test_routes(spark):
    rows = [("r", "app/main.py", 3, '@router.GET("/a")'), ("r", "web/app/api/u/[id]/route.ts", 1, "export const POST = x"), ("r", "api/f/index.js", 1, "x"), ("r", "api/f/index.js", 2, "y")]
    d = spark.createDataFrame(rows, "repo string, file string, line_no int, line string")
    assert sorted(values(surface.extract_routes(d), "subtype", "value", "line_no")) == [("ANY", "/api/f", 1), ("GET", "/a", 3), ("POST", "/api/u/[id]", 1)]


def test_sections(spark):
    d = spark.createDataFrame([(1, "x\n## B\nbb\n### s\nmore\n## A\naa\n## C\ncc")], "doc_id bigint, text string")
    assert sorted(values(sections.split_sections(d, ["A", "B", "Z"]), "section", "found", "content")) == [("A", True, "aa cc"), ("B", True, "bb more"), ("Z", False, None)]


def test_empty_question_finds_nothing(spark):
    q = spark.createDataFrame([(1, ""), (2, "blue bolt")], "query_id bigint, text string")
    f = spark.createDataFrame([(0, "a.x", "blue", ""), (1, "a.y", "unknown", "bolt"), (2, "a.z", "bolt", "blue")], "ordinal int, key string, value string, notes string")
    assert values(facts.keyword_topk(q, f).orderBy("rank"), "query_id", "key", "score") == [(2, "a.z", 2), (2, "a.x", 1)]


def test_vector_topk_takes_any_number_of_queries(spark):
    queries = spark.range(1100).select(F.col("id").alias("query_id"), F.array((F.col("id") % 7 - 3).cast("double"), F.lit(1.0)).alias("q"))
    items = spark.range(12).select(F.col("id").alias("item_id"), F.array((F.col("id") - 6).cast("double"), F.lit(1.0)).alias("v"))
    got = {(r.query_id, r["rank"]): r.item_id for r in corpus.vector_topk(queries, items, 2).collect()}

    def best(i):
        a = (i % 7 - 3, 1)
        cosine = lambda j: (a[0] * (j - 6) + 1) / ((a[0] ** 2 + 1) ** 0.5 * ((j - 6) ** 2 + 1) ** 0.5)
        return sorted(range(12), key=lambda j: (-round(cosine(j), 12), j))[:2]

    assert got == {(i, r + 1): j for i in range(1100) for r, j in enumerate(best(i))}


def test_fuzzy_faq_compares_without_a_common_token(spark):
    q = spark.createDataFrame([(1, "deposits"), (2, "hwo do withdrawls wrok"), (3, "zzz"), (4, "!!"), (5, None)], "query_id bigint, text string")
    faq = spark.createDataFrame([("deposit",), ("How does withdrawal work",), ("Howe di withdrawals works",), ("??",)], "question string")
    got = values(facts.fuzzy_faq(q, faq, {}), "query_id", "question", "score")
    assert (1, "deposit", 93) in got and {r[0] for r in got} <= {1, 2}


def test_iso_of_late_years(spark):
    got = spark.range(1).select(*[X.epoch_iso(F.lit(n)).alias(str(n)) for n in (61, 253402300799, 253402300800, 777599990400)]).first()
    assert list(got) == ["1970-01-01T00:01:01Z", "9999-12-31T23:59:59Z", "10000-01-01T00:00:00Z", "26611-03-01T21:20:00Z"]
