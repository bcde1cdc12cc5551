"""Operators of the training-data subpackage against brute force, round trips and held-out accuracy."""

import hashlib
import io
import itertools
import math
import random
import re
import wave
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groundwork.llm import decontam, langid, lm, media, neardup, packing, quality, sharding, toxicity, urlfilter
from groundwork.llm import queries as Q
from tests.compare import same

LONG = "lorem ipsum dolor " * 20_000
A = "abcdefghijklmnopqrstuvwxyz"
SF01 = "/root/testdata/sf0.01"


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and clashing names."""
    data = [(1, None, None), (2, "", "en"), (3, LONG, "en"), (4, "Same text here now ok yes", "en"), (5, "Same text here now ok yes", None), (5, "Same text here now ok yes", None), (None, "No id at all in this one", "de"), (None, None, None), (8, "123 456 !!", "de"), (9, "ünïcode Straße 日本語 é", "de")]
    d = spark.createDataFrame([(i, t, x, "s") for i, t, x in data], "doc_id bigint, text string, lang string, source string")
    clash = {c: F.lit("clash") for c in ("score", "predicted", "lang_pred", "n_words", "spans", "items", "shard", "slot", "curve", "host", "rule", "feature", "bands", "node", "digest", "row", "h", "head", "piece", "label")}
    return d.withColumns(clash)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def labels(spark, odd):
    return spark.createDataFrame([(3, 1, 0), (4, 0, 1), (9, 1, 0), (2, 0, 1), (None, 1, 1), (77, None, None)], "doc_id bigint, quality int, toxic int")


# --- language ---------------------------------------------------------------


def lang_table(entries, size):
    names = list(entries)
    h = langid.word_hashes(names) if size == 0 else np.concatenate([_bare_gram(g) for g in names] or [np.empty(0, np.uint64)])
    order = np.argsort(h)
    return langid.Table(h[order], np.array([entries[names[i]] for i in order], np.float32).reshape(len(names), 2))


def _bare_gram(gram):
    """Hash of one gram, taken from a word that holds it."""
    word = gram.strip()
    h, _ = langid.gram_hashes([word], len(gram))
    edged = f" {word} "
    return h[edged.index(gram) : edged.index(gram) + 1]


def test_langid_backs_off_from_words_to_shorter_grams():
    grams = {3: {" un": (-1, -5)}, 2: {" u": (-4, -2), "zz": (-1, -3)}, 1: {"q": (-2, -1)}, 4: {}}
    m = langid.Model(["de", "en"], lang_table({"the": (-9, -1)}, 0), {n: lang_table(g, n) for n, g in grams.items()})
    assert m.word_scores(["the", "un", "uzz", "q", "x"]).tolist() == [[-9, -1], [-1, -5], [-2.5, -2.5], [-2, -1], [0, 0]]
    assert m.predict(["the the"])[0][0] == "en" and m.predict(["123 ½ __"])[0][0] == "und"


def brute_langid(train, texts, sizes=(4, 3, 2, 1)):
    """The model by its definition, with words and grams as strings and no hashes, arrays or caches."""
    langs = sorted({x for _, x in train})
    counts = {n: {x: Counter() for x in langs} for n in (0, *sizes)}
    pieces = lambda w, n: [w] if n == 0 else [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)]
    for t, x in train:
        for w in langid.words_of(t):
            for n in (0, *sizes):
                counts[n][x].update(pieces(w, n))
    logs = {}
    for n, by in counts.items():
        known = {g for c in by.values() for g in c if n or sum(d[g] for d in by.values()) >= 2}
        logs[n] = {g: [math.log((by[x][g] + 0.5) / (sum(by[x].values()) + 0.5 * (len(known) + 1))) for x in langs] for g in known}

    def word(w):
        for n in (0, *sizes):
            known = [logs[n][g] for g in pieces(w, n) if g in logs[n]]
            if known:
                return [sum(v) / len(known) for v in zip(*known)]
        return [0.0] * len(langs)

    out = []
    for t in texts:
        words = langid.words_of(t)
        if not words:
            out.append(("und", 0.0))
            continue
        z = [sum(v) / math.sqrt(len(words)) for v in zip(*map(word, words))]
        share = [math.exp(v - max(z)) for v in z]
        k = max(range(len(langs)), key=lambda i: (share[i], -i))
        out.append((langs[k], share[k] / sum(share)))
    return out


def test_langid_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(langid, "CACHE_WORDS", 50)
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    train, asked = docs[:60], [*docs[60:110], (-1, "", None), (-2, "straße ½ 日本語 ñ", None), (-3, "--", None), (-4, LONG, None)]
    schema = "doc_id bigint, text string, lang string"
    m = langid.fit(spark.createDataFrame(train, schema))
    got = {x["doc_id"]: x for x in rows(langid.identify(spark.createDataFrame(asked, schema), m))}
    for (i, t, _), (lang, score) in zip(asked, brute_langid([(t, x) for _, t, x in train if t is not None and x is not None], [t or "" for _, t, _ in asked])):
        assert got[i]["lang_pred"] == lang and got[i]["score"] == pytest.approx(score, abs=1e-4)


def test_langid_learns_rare_languages_whole(spark):
    d = spark.createDataFrame([(i, f"alpha beta {i}", "a") for i in range(400)] + [(1000 + i, "gamma delta", "z") for i in range(3)], "doc_id bigint, text string, lang string")
    assert langid.learning_sample(d, "text", "lang", "doc_id", 20, 1 << 20).where("l = 'z'").count() == 3
    assert 5 < langid.learning_sample(d, "text", "lang", "doc_id", 20, 1 << 20).where("l = 'a'").count() < 50
    assert langid.fit(d, most_each=20).predict(["gamma"])[0][0] == "z"


def test_langid_held_out(spark, sf_dir):
    r = Q.op1_langid(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    got = rows(r)
    assert sum(x["lang"] == x["lang_pred"] for x in got) >= 0.95 * len(got)
    assert all(0 <= x["score"] <= 1 and x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1) for x in got)


def test_langid_odd(odd, empty):
    m = langid.fit(odd)
    got = rows(langid.identify(odd, m))
    assert len(got) == 10 and all(x["lang_pred"] == "und" for x in got if not x["text"] or x["doc_id"] == 8)
    assert langid.identify(empty, m).count() == 0
    none = langid.fit(empty)
    assert {x["lang_pred"] for x in rows(langid.identify(odd, none))} == {"und"}
    kept = langid.keep_identified(odd, m)
    assert kept.columns == odd.columns and {x["score"] for x in rows(kept)} == {"clash"}


# --- decontamination --------------------------------------------------------


def brute_hits(words, items, width):
    hit, found = set(), set()
    for item, text in items:
        w = decontam.words_of(text.encode())
        size = min(width, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            for j in range(len(words) - size + 1):
                if words[j : j + size] == w[i : i + size]:
                    hit.update(range(j, j + size))
                    found.add(item)
    return hit, found


def test_wu_manber_equals_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        word = lambda: rng.choice("abc")
        items = [(str(k), " ".join(word() for _ in range(rng.randint(0, 7)))) for k in range(5)]
        words = [word().encode() for _ in range(rng.randint(0, 40))]
        spans, found = decontam.Patterns([(k, t.encode()) for k, t in items], 4).scan(words)
        hit, expected = brute_hits(words, items, 4)
        assert {p for a, b in spans for p in range(a, b)} == hit and found == expected


def test_decontam_blocks_equal_one_block(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    cols = ["doc_id", "n_words", "n_hit", "items", "contaminated"]
    one, many = (sorted(map(str, decontam.mark_contamination(docs, bench, block_bytes=b).select(*cols).collect())) for b in (1 << 20, 2000))
    assert one == many and any("contaminated=True" in x for x in one)


def test_decontam_odd(spark, odd, empty):
    bench = spark.createDataFrame([(1, "text HERE now"), (2, None), (3, "--"), (None, "same"), (1, "text here now")], "item_id bigint, text string")
    got = rows(decontam.mark_contamination(odd, bench))
    assert sorted(x["n_hit"] for x in got) == [0] * 7 + [4] * 3
    assert {tuple(x["items"]) for x in got} == {(), ("", "1")}
    assert decontam.mark_contamination(empty, bench).count() == 0
    assert not any(x["contaminated"] for x in rows(decontam.mark_contamination(odd, bench.limit(0))))
    left = decontam.drop_contaminated(odd, bench)
    assert left.count() == 7 and left.columns == odd.columns and left.schema == odd.schema and {x["items"] for x in rows(left)} == {"clash"}
    upper = odd.withColumnRenamed("items", "ITEMS")
    for block in (1 << 20, 5):  # one block, and one for every item or so
        assert decontam.drop_contaminated(upper, bench, block_bytes=block).columns == upper.columns
        marked = decontam.mark_contamination(odd, bench, block_bytes=block)
        assert sorted(str((x["doc_id"], x["text"], x["n_words"], x["n_hit"], x["spans"], x["items"])) for x in rows(marked)) == sorted(str((x["doc_id"], x["text"], x["n_words"], x["n_hit"], x["spans"], x["items"])) for x in got)


def test_spans_of_blocks_are_joined(spark):
    rng = random.Random(6)
    cases = [[(a, a + rng.randint(1, 5)) for a in rng.choices(range(30), k=rng.randint(0, 8))] for _ in range(40)]
    d = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, s array<struct<start:bigint,end:bigint>>")
    got = {r.i: [tuple(x) for x in r.j] for r in d.select("i", decontam.joined_spans(F.col("s")).alias("j")).collect()}
    assert got == {i: decontam.join_spans(c) for i, c in enumerate(cases)}


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_sql_twin(spark, sf_dir, duck, name):
    same(Q.QUERIES[name](spark, sf_dir), duck, Q.ORACLE[name])


# --- sharding ---------------------------------------------------------------


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_is_a_path_through_all_cells(spark, dims, bits):
    cells = list(itertools.product(range(1 << bits), repeat=dims))
    names = [f"c{i}" for i in range(dims)]
    d = spark.createDataFrame(cells, ", ".join(f"{n} int" for n in names))
    got = sorted((r["h"], tuple(r[n] for n in names)) for r in rows(d.withColumn("h", sharding.hilbert_index([F.col(n) for n in names], bits))))
    assert [h for h, _ in got] == list(range(len(cells)))
    assert all(sum(abs(x - y) for x, y in zip(a, b)) == 1 for (_, a), (_, b) in itertools.pairwise(got))


def check_shards(got, shards, n):
    by = Counter(x["shard"] for x in got)
    sizes = [by.get(k, 0) for k in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    for k in range(shards):
        assert sorted(x["slot"] for x in got if x["shard"] == k) == list(range(sizes[k]))


def test_shards(spark, sf_dir, odd, empty):
    got = rows(Q.op3_shard_hilbert(spark, sf_dir))
    check_shards(got, 24, spark.read.parquet(f"{sf_dir}/documents.parquet").count())
    order = [x["curve"] for x in sorted(got, key=lambda x: (x["shard"], x["slot"]))]
    assert order == sorted(order)
    check_shards(rows(sharding.hilbert_shards(odd, ["source", "lang", "doc_id"], 4, ["doc_id", "text"])), 4, 10)
    assert sharding.hilbert_shards(empty, ["source", "lang", "doc_id"], 4, ["doc_id"]).count() == 0


def test_shard_files(spark, sf_dir, tmp_path):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars")
    cut = sharding.hilbert_shards(d, ["source", "lang", "n_chars"], 8, ["doc_id"])
    sharding.write_shards(cut, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == d.count()
    assert sharding.shard_ranges(cut, ["n_chars"]).count() == 8


# --- urls -------------------------------------------------------------------


def brute_url(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c in A.upper() else c for c in host)
    fits = [(len(h) + len(p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


URLS = [None, "", "x", "http://", "HTTP://A.COM/en/", "https://www.Example.COM/en/77?q#f", "ftp://b.example.com/en", "http://example.net/de/8/x", "http://xexample.net/de/81", "http://org/es/", "http://a.org:80/es/1", "http://É.org/es/#x", "a://b://c.com/en/", "http://com/en/" + "x" * 50_000]


def test_urls(spark):
    p = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS * 2)], "page_id int, url string, rule string")
    rules = urlfilter.example_rules()
    want = sorted((i, *brute_url(u, rules)) for i, u in enumerate(URLS * 2))
    order = lambda df: sorted(tuple(r) for r in df.select("page_id", "host", "path", "rule", "verdict").collect())
    assert order(urlfilter.judge_urls(p, rules)) == want
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    assert order(urlfilter.judge_urls_by_join(p, table)) == want
    assert urlfilter.judge_urls(p.limit(0), rules).count() == 0
    assert {r.verdict for r in urlfilter.judge_urls(p, []).collect()} == {"allow"}


def test_a_host_of_many_labels(spark):
    url = "http://" + "a." * 20_000 + "example.com/en/7"
    p = spark.createDataFrame([(1, url)], "page_id int, url string")
    rules = urlfilter.example_rules()
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    for judged in (urlfilter.judge_urls(p, rules), urlfilter.judge_urls_by_join(p, table)):
        assert [(r.rule, r.verdict) for r in judged.collect()] == [("example.com/en/7", "allow")]


def test_colliding_digests_are_told_apart_by_the_string():
    a = urlfilter.DigestArray(["x", "y"], ["block", "allow"])
    a.digests = np.array([5, 5], np.uint64).tobytes()
    import pyarrow as pa

    assert [a.keys[i] if i >= 0 else None for i in a.find(np.array([5, 5, 5, 9], np.uint64), pa.array(["y", "x", "z", "y"]), a.mapped())] == ["y", "x", None, None]


# --- quality and toxicity ---------------------------------------------------


def test_quality_held_out(spark, sf_dir):
    got = rows(Q.op5_quality(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out"))
    assert sum(x["quality"] == x["predicted"] for x in got) >= 0.9 * len(got)
    assert all(x["predicted"] == int(x["score"] >= 0.7) for x in got)


def test_quality_ranks_pairs():
    rng = np.random.default_rng(1)
    y = (rng.random(400) < 0.7).astype(int)
    x = rng.normal(size=(400, 5)) + y[:, None] * np.array([3, 0, 0, 0, 0])
    m = quality.rank_model(x, y, np.ones(400), 0.7, 4000)
    s = m.score(x)
    assert ((s >= 0.7) == y).mean() > 0.9
    good, bad = s[y == 1], s[y == 0]
    assert (good[:, None] > bad[None, :]).mean() > 0.97


def test_quality_learns_from_all_labelled_texts(spark):
    rng = np.random.default_rng(3)
    n, n_bad = 10_000, 900
    texts = [("word " * int(k) + ("!! " * int(j) if i < n_bad else "") + f"t{i}") for i, (k, j) in enumerate(zip(rng.integers(1, 20, n), rng.integers(0, 4, n), strict=True))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i >= n_bad)) for i in range(n)], "doc_id long, quality int")
    x, y = np.array([quality.features(t.encode()) for t in texts]), np.array([int(i >= n_bad) for i in range(n)])
    m = quality.fit(docs, labels)
    assert np.allclose(m.mean, x.mean(0)) and np.allclose(m.scale, x.std(0) + 1e-9)
    s = np.clip((x - m.mean) / m.scale, -8, 8) @ m.weights
    gains = [((s >= t)[y == 1].mean() + (s < t)[y == 0].mean()) for t in np.sort(s)[[int(np.ceil(q * n - 1e-9)) - 1 for q in quality.QUANTILES]]]
    assert np.isclose((s >= m.cut)[y == 1].mean() + (s < m.cut)[y == 0].mean(), max(gains))
    # Every pair counts for the gradient: at the weights found, a model of all n_bad x good pairs is nearly at rest too.
    z = np.clip((x - m.mean) / m.scale, -8, 8)
    every = [quality.pair_sums(z[y == 1] - b, m.weights) for b in z[:n_bad]]
    pairs = sum(k for *_, k in every)
    assert np.abs(sum(g for g, *_ in every) / pairs - 1e-3 * m.weights).max() < 0.01


def test_quality_parts_with_few_of_a_label(spark, monkeypatch):
    monkeypatch.setattr(quality, "PART_ROWS", 40)
    monkeypatch.setattr(quality, "LEAST_RARER", 8)
    docs = spark.createDataFrame([(i, f"a {i} " + ("b! " * (i % 7) if i < 5 else "bc ") * 3) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 5)) for i in range(300)], "doc_id long, quality int")
    seen = quality.labelled_features(docs, labels, "text", "doc_id", "quality")
    dealt = quality._dealt(seen, 0, 5, 295)
    assert dealt.where("not rarer").count() == 295 and dealt.where("rarer").groupBy("part").count().where("count = 5").count() == 8
    got = quality.score_quality(docs, quality.fit(docs, labels)).select("doc_id", "predicted").collect()
    assert sum(r.predicted == int(r.doc_id >= 5) for r in got) >= 298


def test_quality_and_toxicity_odd(odd, empty, labels):
    for fit, score in ((quality.fit, quality.score_quality), (toxicity.fit, toxicity.score_toxicity)):
        for docs, lab in ((odd, labels), (odd, labels.limit(0)), (empty, labels)):
            got = rows(score(odd, fit(docs, lab)))
            assert len(got) == 10 and all(0 <= x["score"] <= 1 for x in got)
            by_text = {}
            for x in got:
                assert by_text.setdefault(x["text"] or "", x["score"]) == x["score"]
        assert score(empty, fit(odd, labels)).count() == 0
    assert toxicity.drop_toxic(odd, toxicity.fit(empty, labels)).columns == odd.columns


def test_toxicity_finds_planted_words(spark):
    rng = random.Random(5)
    plain = lambda: " ".join(rng.choice(["the", "river", "ran", "over", "stone", "and", "under", "bridge", "while", "evening"]) for _ in range(60))
    bad = lambda: plain() + " " + " ".join(rng.choice(["zorgface", "blunkhead", "wuzzle" + rng.choice(A)]) for _ in range(4)) + " " + plain()
    data = [(i, bad() if i % 4 == 0 else plain(), int(i % 4 == 0)) for i in range(600)]
    d = spark.createDataFrame(data, "doc_id bigint, text string, toxic int")
    got = rows(toxicity.score_toxicity(d, toxicity.fit(d.where("doc_id < 400"), d.where("doc_id < 400"))).where("doc_id >= 400"))
    assert sum(x["predicted"] == x["toxic"] for x in got) >= 0.97 * len(got)


@pytest.mark.parametrize("toxic", [0, 1, 5, 11])
def test_few_toxic_texts_leave_clean_ones_alone(spark, toxic):
    rng = random.Random(toxic)
    words = [a + b + c for a in "bdfgklm" for b in "aeiou" for c in "nrst"]
    d = spark.createDataFrame([(i, " ".join(rng.choices(words, k=80)), int(i < toxic)) for i in range(90)], "doc_id bigint, text string, toxic int")
    got = rows(toxicity.score_toxicity(d, toxicity.fit(d, d)))
    assert len({x["score"] for x in got}) == 1 and not any(x["predicted"] for x in got)
    assert toxicity.drop_toxic(d, toxicity.fit(d, d)).count() == 90


def test_toxicity_cut_needs_something_to_cut():
    y = np.array([1.0] * 4 + [0.0] * 20)
    assert toxicity.calibrated(None, np.zeros((24, toxicity.FEATURES)), y, np.ones(24)) is None
    x = np.zeros((24, toxicity.FEATURES))
    x[:6] = 5  # ties across the classes: six rows above the cut, or none
    m = toxicity.calibrated(None, x, y, np.ones(24))
    s = ((x - m.mean) / m.scale) @ m.weights + m.bias
    assert (s[:6] > 0).all() and (s[6:] < 0).all()


def test_toxicity_held_out_on_the_given_tables(spark):
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    got = rows(Q.op8_toxicity(spark, SF01).join(labels, "doc_id").where("held_out and toxic is not null"))
    assert sum(x["predicted"] for x in got if x["toxic"]) >= 4
    clean = [x for x in got if not x["toxic"]]
    assert sum(x["predicted"] for x in clean) <= 0.03 * len(clean)


def test_toxicity_scores_are_logistic_in_window_lengths(spark):
    """The whole way from a text to its score again, by zstandard alone."""
    import zstandard

    rng = random.Random(8)
    plain = lambda: " ".join(rng.choice(["river", "stone", "bridge", "evening", "under", "slowly"]) for _ in range(40))
    data = [(i, plain() + (" you zorgface blunkhead " if i % 4 == 0 else " and so on ") + plain(), int(i % 4 == 0)) for i in range(300)]
    d = spark.createDataFrame(data, "doc_id bigint, text string, toxic int")
    m = toxicity.fit(d, d)
    assert len(m.dictionaries.toxic) == len(m.dictionaries.ordinary)
    assert m.dictionaries.toxic.count(b"zorgface") > m.dictionaries.ordinary.count(b"zorgface") == 0

    def lengths(content, parts):
        kind = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters.from_level(12, source_size=128, dict_size=len(content), write_content_size=0, write_checksum=0, write_dict_id=0, min_match=5)
        kind.precompute_compress(compression_params=params)
        return [len(zstandard.ZstdCompressor(compression_params=params, dict_data=kind).compress(p)) for p in parts]

    got = {x["doc_id"]: x["score"] for x in rows(toxicity.score_toxicity(d.limit(12), m))}
    for i, score in got.items():
        words, parts, at = f" {data[i][1]} ".encode(), [], 0
        while True:
            end = min(len(words), at + 64)
            if end < len(words):
                end = words.rindex(b" ", 0, end) + 1
            parts.append(words[at:end])
            if end == len(words):
                break
            at = end - 1
        diff = np.array(lengths(m.dictionaries.ordinary, parts)) - np.array(lengths(m.dictionaries.toxic, parts))
        top = sorted(diff)[-3:]
        x = [min(max(diff), 12), min(sum(top), 30), np.mean(diff), *(math.log1p(sum(v >= k for v in diff)) for k in (2, 3)), *(sum(v >= k for v in diff) / len(diff) for k in (2, 3))]
        z = sum((v - a) / b * w for v, a, b, w in zip(x, m.mean, m.scale, m.weights)) + m.bias
        assert score == pytest.approx(1 / (1 + math.exp(-z)))


def test_labelled_texts(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, "c"), (3, "c"), (4, None), (5, "long" * 9), (None, "x"), (6, "both"), (7, "no label")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 1), (4, 1), (5, 1), (None, 1), (6, 0), (6, 1), (7, None), (7, 2), (8, 0)], "doc_id bigint, bad int")
    from groundwork.llm.common import labelled_texts

    found, counts = labelled_texts(docs, labels, "text", "doc_id", "bad", {1: 100, 0: 100}, 20)
    first = min("ab", key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert sorted((bytes(r.raw).decode(), r.label) for r in found.collect()) == sorted([(first, 1), ("c", 1)])
    assert counts == {0: 2, 1: 4}


def test_windows_cover_the_text():
    for raw in (b"", b"a", b"word " * 50, b"x" * 500, LONG[:5000].encode()):
        w = toxicity.windows(toxicity.plain(raw))
        joined = w[0] + b"".join(p[1:] if p[:1] == b" " and w[i][-1:] == b" " else p for i, p in enumerate(w[1:]))
        assert joined == toxicity.plain(raw) and all(len(p) <= toxicity.WINDOW for p in w)


# --- packing ----------------------------------------------------------------


def tokenizer():
    from tokenizers import Tokenizer

    P = pytest.importorskip("public_tokenizers")
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return P.path("word_bpe_49k.json"), lambda x: t.encode(x, add_special_tokens=False).ids


def test_packing_round_trip(spark, sf_dir, odd, empty):
    path, ids = tokenizer()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for d, cap in ((docs, 2048), (odd, 100)):
        got = rows(packing.pack_documents(d, path, capacity=cap, keep_ids=True, group_pieces=300))
        want = Counter()
        for r in d.select("doc_id", "text").collect():
            full = [*ids(r.text or ""), 0]
            for k in range(0, len(full), cap):
                want[(r.doc_id, k // cap, k, tuple(full[k : k + cap]))] += 1
        assert Counter((x["doc_id"], x["piece"], x["start"], tuple(x["ids"])) for x in got) == want
        assert all(x["ids_crc32"] == zlib.crc32(np.array(x["ids"], "<u4").tobytes()) and x["length"] == len(x["ids"]) for x in got)
        bins = {}
        for x in got:
            bins.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
        for parts in bins.values():
            parts.sort()
            assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= cap
    assert packing.pack_documents(empty, path).count() == 0


def test_open_bins():
    rng = random.Random(2)
    b = packing.OpenBins(100, 4)
    level, closed = {}, 0
    for _ in range(2000):
        n = rng.randint(1, 100)
        k, at = b.place(n)
        assert level.get(k, 0) == at
        level[k] = at + n
        assert level[k] <= 100 and b.open <= 4 and b.open == sum(map(len, b.by_free.values()))
    assert sum(level.values()) / (100 * len(level)) > 0.85


def test_best_fit_and_closing():
    b = packing.OpenBins(10, 2)
    assert [b.place(n) for n in (6, 7, 3, 2, 9)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0)]
    # Two bins are open (8 and 9 full); none fits 5, so the fullest, bin 2, closes.
    assert b.place(5) == (3, 0) and b.place(1) == (0, 8) and b.place(2) == (3, 5)


# --- language model ---------------------------------------------------------


def test_lm_base_is_exact_and_model_beats_it(spark, sf_dir):
    got = {x["doc_id"]: x for x in rows(Q.op7_lm_score(spark, sf_dir))}
    docs = [(r.doc_id, (r.text or "").encode().lower().split()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    c = Counter()
    for i, w in docs:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update([*w, None])
    n, v = sum(c.values()), len(c)
    mine = base = 0.0
    for i, w in docs:
        x = got[i]
        b = sum(math.log10((c[t] + 1) / (n + v + 1)) for t in [*w, None])
        assert x["base_score"] == pytest.approx(b, rel=1e-9) and x["n_known"] == sum(c[t] > 0 for t in [*w, None])
        assert (x["n_tokens"], x["train_tokens"]) == (len(w) + 1, n) and x["score"] < 0
        if x["held_out"]:
            mine, base = mine + x["score"], base + b
    assert mine > base


def test_lm_probabilities_sum_to_one(spark):
    rng = random.Random(4)
    words = ["w" + rng.choice(A) + rng.choice(A[: 1 + k % 9]) for k in range(300)]
    d = spark.createDataFrame([(i, " ".join(rng.choices(words, k=30))) for i in range(80)], "doc_id bigint, text string")
    counts = lm.count_words(d, "text")
    hashes, forms, found = lm.frequent_words(counts)
    v = lm.Vocabulary(hashes, np.arange(len(hashes)), found, np.zeros(len(hashes)), 1000)
    table = lm.sample_contexts(lm.count_class_pairs(d, "text", v), v.width)
    assert np.allclose((10.0 ** table.astype(float)).sum(axis=1), 1, atol=1e-3)
    e = lm.sample_endings(counts)
    h, f, c = (np.array([r[i] for r in counts.collect()]) for i in range(3))
    p = 10 ** e.log_words(h, f, c)
    total = np.bincount(f, weights=p, minlength=lm.FORMS) + 10 ** e.log_unseen()
    assert np.allclose(total, 1)


def test_lm_tokens_as_split_one_by_one(monkeypatch):
    texts = [" The  cat\x0bA\x1c B\t\n", "", None, "É x\u00a0Y y\u2003Z", " \t", LONG, "\x85b\x0c c\rthe", "the"]
    want = [t.encode().lower().split() if t else [] for t in texts]
    for kind in (pa.string(), pa.binary(), pa.large_string()):
        t = lm.tokens_of(pa.array([x and x.encode() for x in texts], pa.binary()).cast(kind))
        assert len(set(t.words)) == len(t.words) and t.lengths.tolist() == [len(x) + 1 for x in want]
        names = [*t.words, None]
        for x, start, n, before in zip(want, t.starts, t.lengths, np.split(t.before(), t.starts[1:]), strict=True):
            assert [names[i] for i in t.at[start : start + n]] == [*x, None] and [names[i] for i in before] == [None, *x]
    monkeypatch.setattr(lm, "PIECE_BYTES", 40)
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    cut = list(lm.pieces([batch], "text"))
    assert [x for b in cut for x in b.column(0).to_pylist()] == texts and len(cut) == 3
    whole = [lm.tokens_of(b.column(0)).lengths.tolist() for b in cut]
    assert [n for x in whole for n in x] == [len(x) + 1 for x in want]


def test_what_contexts_gather_grows_with_the_text():
    sizes = [lm.own_classes(n) for n in (0, 1, 10**3, 10**6, 10**9, 10**13)]
    assert sizes == sorted(sizes) and sizes[2] < sizes[3] < sizes[4] < sizes[5] < 3000


def test_each_word_has_a_context_of_its_own(spark, monkeypatch):
    # 40 words before and 40 after, all with one ending and far from the commonest: only their pairs tell them apart.
    pairs = [(f"x{i:02d}end", f"y{i:02d}end") for i in range(40)]
    learned = spark.createDataFrame([(i, f"the {x} {y} the the") for i, (x, y) in enumerate(pairs * 3)], "doc_id bigint, text string")
    asked = spark.createDataFrame([(2 * i + k, f"the {x} {pairs[(i + k) % 40][1]} the the") for i, (x, _) in enumerate(pairs) for k in (0, 1)], "doc_id bigint, text string")
    monkeypatch.setattr(lm, "OWN_PER_DOUBLING", 1)
    for frequent in (1 << 17, 20):  # with all words known to each task, and with nearly none
        monkeypatch.setattr(lm, "FREQUENT", frequent)
        got = {x["doc_id"]: x for x in rows(lm.score_texts(asked, learned))}
        assert all(x["n_known"] == x["n_tokens"] == 6 for x in got.values())
        # Seen three times after its word, once only by chance (a context shared by ending cannot tell).
        assert all(got[2 * i]["score"] > got[2 * i + 1]["score"] + 1 for i in range(40))
    both = learned.unionAll(asked.withColumn("doc_id", F.col("doc_id") + 1000))
    one = {x["doc_id"]: x for x in rows(lm.score_texts(both, F.col("doc_id") < 1000))}
    assert len(one) == 200 and all(one[k + 1000]["score"] == pytest.approx(x["score"], abs=1e-4) for k, x in got.items())


def test_pair_restaurants_sum_to_one_and_count_all_pairs():
    rng = np.random.default_rng(6)
    width, own, words, new = 3 + lm.FORMS, 3, 60, 5
    classes = np.array([0, 1, 2, *(own + rng.integers(0, 4, words - own))])
    log_word, unseen = np.zeros(words), np.full(lm.FORMS, np.log10(0.2))
    for e in range(4):
        at = np.flatnonzero(classes == own + e)
        log_word[at] = np.log10(0.8 / len(at))
    table = rng.random((width, width)) * (np.arange(width) < own + 4)
    table = np.log10(table / table.sum(axis=1, keepdims=True) + 1e-300)
    h = np.arange(words + new) * 7919 + 11
    every = np.append(classes, own + np.arange(new) % 4)
    number = np.append(np.arange(words), np.full(new, -1))
    u, w = rng.integers(0, words, 4000), np.minimum(rng.geometric(0.1, 4000), words) - 1
    v = lm.Vocabulary(h[:words], classes, np.ones(words), log_word, own)
    model = lm.Pairs(v, 1)

    def bucket(u, w, code):
        at = (every[u] >= own) | (every[w] >= own)
        u, w, code = u[at], w[at], code[at]
        for x in model.packed(0, model.runs(h[u], every[u], every[w]), every[u], every[w], number[w], h[w], code):
            yield pa.table({k: a for k, a in x.items()})

    learned = list(bucket(u, w, np.full(4000, lm.LEARNED | lm.UNSCORED)))
    count = Counter(zip(u.tolist(), w.tolist(), strict=True))
    for context in (0, 2, 5, 20, 59):
        after = np.arange(words + 4)  # the last four stand for the unseen words of the four endings
        asked = list(bucket(np.full(len(after), context), after, after.astype(np.int64)))
        got = lm.bucket_scores(pa.concat_tables(learned + asked), v, table, unseen, np.full(lm.FORMS, 100.0))
        places, sums, _ = got["scored"]
        p = dict(zip(places.tolist(), (10.0**sums).tolist(), strict=True)) | dict(zip(got["rare"][1].tolist(), (got["rare"][3] + got["rare"][4]).tolist(), strict=True))
        if context < own:
            p |= {k: 10.0 ** table[context, k] for k in range(own)}
        assert len(p) == len(after) and sum(p.values()) == pytest.approx(1, abs=1e-6)
        if context >= own:  # a word seen n of N times has at least (n - its tables) / (N + 1) and more than one seen less often has of its own
            n = sum(c for (a, _), c in count.items() if a == context)
            top = max((c, b) for (a, b), c in count.items() if a == context)
            assert 0.5 * top[0] / (n + 1) < p[top[1]] < (top[0] + 1) / (n + 1) + 0.2


def test_seating():
    n = np.array([1, 2, 5, 1000, 20_000])
    t = lm.seat(n, np.full(5, 0.2), 0.5, 1.0, 10.0, np.arange(5), 1)
    assert t[0] == 1 and (t >= 1).all() and (t <= n).all() and t[3] < 400
    assert (t == lm.seat(n, np.full(5, 0.2), 0.5, 1.0, 10.0, np.arange(5), 1)).all()


def test_context_tables_are_carried_from_sweep_to_sweep(spark):
    n = np.random.default_rng(4).multinomial(200_000, 1 / np.arange(1, 1001) / (1 / np.arange(1, 1001)).sum())
    k = np.flatnonzero(n)
    contexts = spark.createDataFrame([(7, k.tolist(), n[k].tolist()), (9, [3], [2])], "context int, k array<int>, n array<bigint>")
    own = lm.seat_contexts(contexts, 1500)
    (first, before, _, held), (_, _, _, later) = own.sweeps
    assert later[7] == own.tables(7, k, n[k], before, held, first).sum() and later[9] in (1, 2)
    assert held[7] > 1.2 * len(k) and not held[[c for c in range(1500) if c not in (7, 9)]].any()


def test_lm_odd(spark, odd, empty):
    got = rows(lm.score_texts(odd, odd))
    assert len(got) == 10 and {x["n_tokens"] for x in got if x["doc_id"] in (1, 2)} == {1}
    none = rows(lm.score_texts(odd, empty))
    assert all(x["n_known"] == 0 and x["train_tokens"] == 0 and x["base_score"] == 0 for x in none)
    assert lm.score_texts(empty, odd).count() == 0


# --- media ------------------------------------------------------------------


def test_media_round_trip(odd, empty):
    got = rows(media.media_columns(odd))
    for x in got:
        raw = (x["text"] or "").encode()
        want = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        with wave.open(io.BytesIO(bytes(x["media"]))) as w:
            assert w.getsampwidth() == 1 and w.readframes(w.getnframes()) == want
        assert x["payload_sha256"] == hashlib.sha256(want).hexdigest() and x["tail_crc32"] == zlib.crc32(want[-32:])
        assert (x["n_bytes"], x["payload_bytes"], x["media_bytes"]) == (len(raw), len(want), len(x["media"]))
        assert x["media_sha256"] == hashlib.sha256(bytes(x["media"])).hexdigest() and x["n_pairs"] == len(x["fingerprint"])
    assert media.media_columns(empty).count() == 0


def test_peaks_find_a_tone():
    t = np.arange(576 * 8)
    tone = (127 + 100 * np.sin(2 * np.pi * 30 * t / 576)).astype(np.uint8).tobytes()
    bins, _ = media.peaks(tone)
    assert (bins[:, 2] == 30).all()
    codes = media.fingerprint(tone)
    assert ((3 << 32) | (30 << 20) | (30 << 8) | 1) in codes.tolist()


# --- near-duplicates --------------------------------------------------------


def brute_classes(docs, threshold=0.8):
    sets, parent = {}, {}
    for t in {t for _, t in docs if t is not None}:
        w = decontam.words_of(t.encode())
        sets[t] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        parent[t] = t

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
            parent[find(a)] = find(b)
    groups = {}
    for i, t in docs:
        if t is not None:
            groups.setdefault(find(t), []).append(i)
    return {t: min((i for i in groups[find(t)] if i is not None), default=None) for t in sets}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(9)
    words = [a + b for a in A for b in A]
    docs = []
    for _ in range(25):
        base = rng.choices(words, k=rng.choice([3, 12, 60, 200]))
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = rng.choice(words)
            docs.append((len(docs), " ".join(w)))
    # A chain: each is near to the next only.
    chain = rng.choices(words, k=100)
    for k in range(6):
        docs.append((len(docs), " ".join(chain[4 * k :] + rng.choices(words, k=4 * k))))
    docs += [(len(docs) + k, t) for k, t in enumerate(["", "", "!!", "A b", "a  B!", None, None])]
    want = brute_classes(docs)
    got = rows(neardup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")))
    text = dict(docs)
    assert len(got) == len(docs)
    for x in got:
        t = text[x["doc_id"]]
        assert x["class_id"] == (x["doc_id"] if t is None else want[t])
    left = neardup.drop_near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert left.count() == len(set(want.values())) + 2


def test_near_duplicates_with_repeated_passages_equal_brute_force(spark):
    rng = random.Random(21)
    words = [a + b + c for a in A for b in A for c in A]
    docs = []
    for times in (5, 30, 1000):
        for share in (5, 2):  # a fifth of the text is repeated, or half of it
            for _ in range(4):
                w = rng.choices(words, k=120)
                docs.append((len(docs), " ".join(w)))
                docs.append((len(docs), " ".join(w + w[-(120 // share) :] * times)))
    want = brute_classes(docs)
    assert len(set(want.values())) == len(docs) // 2
    got = rows(neardup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")))
    assert {x["doc_id"]: x["class_id"] for x in got} == {i: want[t] for i, t in docs}


@pytest.mark.parametrize("small, block", [(64, 512), (8, 16)])
def test_near_duplicates_in_large_buckets_equal_brute_force(spark, monkeypatch, small, block):
    """160 texts with a long common beginning, none linked by it, and a near copy of every fourth."""
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "BLOCK", block)
    sizes, made = [], neardup.crossing_pairs
    monkeypatch.setattr(neardup, "crossing_pairs", lambda o: (sizes.append(o.groupBy("key").count().agg(F.max("count")).first()[0]), made(o))[1])
    rng = random.Random(17)
    words = [a + b + c for a in A for b in A for c in A]
    base, docs = rng.sample(words, 172), []
    for i in range(160):
        w = base + rng.sample(words, 28)
        docs.append((len(docs), " ".join(w)))
        if i % 4 == 0:
            docs.append((len(docs), " ".join(w[:-2] + rng.sample(words, 2))))
    want = brute_classes(docs)
    assert len(set(want.values())) == 160
    got = rows(neardup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")))
    assert {x["doc_id"]: x["class_id"] for x in got} == {i: want[t] for i, t in docs}
    assert sizes[0] > 64


def test_probminhash_estimates_probability_jaccard():
    rng = np.random.default_rng(3)
    e = rng.integers(0, 2**63, 300).astype(np.uint64)
    wa, wb = rng.uniform(1, 4, 300), rng.uniform(1, 4, 300)
    wa[:60], wb[240:] = 0, 0
    both = [k for k in range(300) if wa[k] and wb[k]]
    exact = sum(1 / np.maximum(wa / wa[k], wb / wb[k]).sum() for k in both)
    a, b = (neardup.signature(e[w > 0], w[w > 0], 4096) for w in (wa, wb))
    assert abs((a == b).mean() - exact) < 0.04


def test_near_duplicates_odd(odd, empty):
    got = rows(neardup.near_duplicates(odd))
    assert len(got) == 10 and sum(x["class_id"] == 4 for x in got) == 3
    left = neardup.drop_near_duplicates(odd)
    assert left.columns == odd.columns and left.count() == 8
    assert neardup.near_duplicates(empty).count() == 0 and neardup.drop_near_duplicates(empty).count() == 0


# --- pipeline ---------------------------------------------------------------


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    everything = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    out = rows(P.run(spark, sf_dir))
    kept = {x["doc_id"] for x in out}
    step = docs
    for name, stage in P.STAGES[:-1]:
        step = stage(spark, step, sf_dir)
        assert step.columns == names, name
    assert {r.doc_id for r in step.select("doc_id").collect()} == kept
    bench = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    tables = decontam.Patterns([(k, t.encode()) for k, t in bench], 10)
    assert not any(tables.scan(decontam.words_of(everything[i].encode()))[0] for i in kept)
    classes = brute_classes([(i, everything[i]) for i in kept])
    assert len(set(classes.values())) == len(kept) > 100


def test_pipeline_odd(spark, sf_dir, odd, empty):
    import corpus_pipeline as P
    from groundwork.llm.common import written

    for docs in (odd, empty):
        step, left = docs, []
        for name, stage in P.STAGES[:-1]:
            step = written(stage(spark, step, sf_dir), name)
            assert step.columns == docs.columns, name
            left.append(step.count())
        texts = [r.text for r in step.collect()]
        assert len(set(texts)) == len(texts) and not {None, "", "123 456 !!"} & set(texts)
        assert left == sorted(left, reverse=True) and (left[-1] >= 3) == (docs is odd)
        pieces = P.STAGES[-1][1](spark, step, sf_dir).collect()
        assert {r.doc_id for r in pieces} == {r.doc_id for r in step.select("doc_id").collect()} and len(pieces) >= len(texts)
