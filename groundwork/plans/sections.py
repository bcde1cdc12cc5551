"""Queries of the sections lane, and of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwork.functions import exprs as X
from groundwork.operators import sections as G
from groundwork.plans.registry import Registry
from groundwork.sources.files import table

lane = Registry()
QUERIES, ORACLE, query = lane.QUERIES, lane.ORACLE, lane.query
NAMES = ["Overview", "Terms", "Risks"]


def _headed(spark, sf_dir):
    """Whole documents with headings planted around them: some lack one, and the order varies."""
    line = F.col("text")
    d = F.col("doc_id")
    a = F.concat(F.lit("intro\n## Overview\n"), line, F.lit("\n### Detail\nmore  text\n"))
    b = F.when(d % 3 != 0, F.concat(F.lit("## Terms\nshort\n"))).otherwise("")
    c = F.when(d % 5 != 0, F.concat(F.lit("## Risks\nrisk of "), d, F.lit(" "), F.col("source"), F.lit(" and others\n## Other\nend"))).otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(d % 2 == 0, F.concat(a, b, c)).otherwise(F.concat(b, a, c)).alias("text"))


CLEAN = r"trim(regexp_replace(regexp_replace({}, '(?m)^#{{2,}}[^\n]*$', ' ', 'g'), '\s+', ' ', 'g'))"
BODY_SQL = f"""h AS (SELECT doc_id, chr(10) || CASE WHEN doc_id % 2 = 0 THEN a || b || c ELSE b || a || c END || chr(10) AS t FROM (SELECT doc_id, 'intro' || chr(10) || '## Overview' || chr(10) || text || chr(10) || '### Detail' || chr(10) || 'more  text' || chr(10) AS a,
 CASE WHEN doc_id % 3 <> 0 THEN '## Terms' || chr(10) || 'short' || chr(10) ELSE '' END AS b, CASE WHEN doc_id % 5 <> 0 THEN '## Risks' || chr(10) || 'risk of ' || doc_id || ' ' || source || ' and others' || chr(10) || '## Other' || chr(10) || 'end' ELSE '' END AS c FROM documents)),
n AS (SELECT unnest(['Overview', 'Terms', 'Risks']) AS section), p AS (SELECT doc_id, t, section, strpos(t, chr(10) || '## ' || section || chr(10)) AS s FROM h, n),
x AS (SELECT a.doc_id, a.section, a.s, a.t, min(b.s) AS e FROM p a LEFT JOIN p b ON a.doc_id = b.doc_id AND b.s > a.s AND a.s > 0 GROUP BY ALL),
sec AS (SELECT doc_id, section, s > 0 AS found, CASE WHEN s > 0 THEN {CLEAN.format("substr(t, s + length(section) + 4, coalesce(e, length(t) + 1) - s - length(section) - 4)")} END AS content FROM x)"""


@query("g1_split_sections", f"WITH {BODY_SQL} SELECT * FROM sec")
def g1(spark, sf_dir):
    return G.split_sections(_headed(spark, sf_dir), NAMES)


def _numbered(spark, sf_dir):
    d = F.col("doc_id")
    t = F.concat(F.lit("cover\n1.1 Scope .... 3\nscope of "), d, F.lit("\n 12 \n\n1.2 Use\n"), "text", F.lit("\n"), F.when(d % 4 != 0, F.lit("2.1 End\nlast line")).otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("text"))


@query("g2_split_numbered", rf"""WITH h AS (SELECT doc_id, 'cover' || chr(10) || '1.1 Scope .... 3' || chr(10) || 'scope of ' || doc_id || chr(10) || ' 12 ' || chr(10) || chr(10) || '1.2 Use' || chr(10) || text || chr(10) || CASE WHEN doc_id % 4 <> 0 THEN '2.1 End' || chr(10) || 'last line' ELSE '' END AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos FROM h),
p AS (SELECT *, max(CASE WHEN regexp_matches(line, '^\s*\d+\.\d+\s+\S') THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS start FROM l),
hd AS (SELECT doc_id, regexp_extract(line, '^\s*(\d+\.\d+)\s+\S', 1) AS number, min(pos) AS start FROM p WHERE pos = start GROUP BY ALL),
c AS (SELECT doc_id, number, string_agg(CASE WHEN pos = start THEN trim(regexp_replace(line, '^\s*\d+\.\d+\s+', '')) ELSE trim(line) END, chr(10) ORDER BY pos) AS content FROM p JOIN hd USING (doc_id, start) WHERE NOT (regexp_matches(line, '^\s*\d*\s*$') OR regexp_matches(line, '\.{{4,}}')) GROUP BY ALL),
w AS (SELECT doc_id, unnest(['1.1', '1.2', '2.1', '3.9']) AS number FROM documents) SELECT w.doc_id, w.number, content IS NOT NULL AS found, content FROM w LEFT JOIN c USING (doc_id, number)""")
def g2(spark, sf_dir):
    return G.split_numbered(_numbered(spark, sf_dir), ["1.1", "1.2", "2.1", "3.9"])


@query("g3_validate_sections", f"WITH {BODY_SQL} SELECT doc_id, section, 'missing' AS problem FROM sec WHERE NOT found AND section IN ('Overview', 'Risks') UNION ALL SELECT doc_id, section, 'short' FROM sec WHERE found AND length(content) < 20")
def g3(spark, sf_dir):
    return G.validate_sections(G.split_sections(_headed(spark, sf_dir), NAMES), ["Overview", "Risks"])


@query("g4_clean_text", r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '[^\p{L}\p{N}_\s.,!?]', '', 'g')) AS text FROM documents")
def g4(spark, sf_dir):
    return G.clean_text(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("g5_format_sections", f"WITH {BODY_SQL} SELECT doc_id, string_agg('### ' || upper(section) || chr(10) || content || chr(10), chr(10) ORDER BY list_position(['Overview', 'Terms', 'Risks'], section)) AS training_text FROM sec WHERE found GROUP BY doc_id")
def g5(spark, sf_dir):
    return G.format_sections(G.split_sections(_headed(spark, sf_dir), NAMES), NAMES)


@query("g6_validate_values", r"""WITH p AS (SELECT page_id, url, '0x' || substr(sha256(url), 1, CASE WHEN page_id % 4 = 0 THEN 39 ELSE 40 END) AS a, CASE page_id % 3 WHEN 0 THEN '{"a": "x", "b": ["y"], "c": {"d": 1}}' WHEN 1 THEN '{"a": 5}' ELSE 'not json' END AS j FROM pages)
SELECT page_id, regexp_full_match(a, '0x[a-fA-F0-9]{40}') AS ok_address, regexp_full_match(url, 'https?://[A-Za-z0-9.-]+(:\d+)?(/\S*)?([?#]\S*)?') AS ok_url,
CASE WHEN json_valid(j) THEN json_type(j) = 'OBJECT' AND len(list_filter(json_keys(j), lambda k: json_type(j, '$.' || k) NOT IN ('VARCHAR', 'ARRAY', 'OBJECT', 'NULL'))) = 0 ELSE false END AS ok_shape FROM p""")
def g6(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    address = F.concat(F.lit("0x"), F.substring(F.sha2("url", 256), 1, F.when(F.col("page_id") % 4 == 0, 39).otherwise(40)))
    shape = F.when(F.col("page_id") % 3 == 0, F.lit('{"a": "x", "b": ["y"], "c": {"d": 1}}')).when(F.col("page_id") % 3 == 1, F.lit('{"a": 5}')).otherwise(F.lit("not json"))
    return G.validate_values(p.select("page_id", "url", address.alias("address"), shape.alias("shape")), "address", "url", "shape").select("page_id", "ok_address", "ok_url", "ok_shape")


@query("s1_s3_tokens_ngrams", "WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents) SELECT doc_id, len(t)::INT AS tokens, array_to_string(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]), '|') AS trigrams FROM t")
def s1(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", X.word_tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("tokens"), F.array_join(X.ngrams("t", 3), "|").alias("trigrams"))


@query("s2_snake_case", r"SELECT event_id, lower(regexp_replace(regexp_replace('total' || upper(event_type) || 'Count', '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')) AS name FROM events")
def s2(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.snake_case(F.concat(F.lit("total"), F.upper("event_type"), F.lit("Count"))).alias("name"))


@query("s4_s5_hash_checks", "WITH h AS (SELECT doc_id, sha256(text) AS sha256, substr(sha256(text), 1, CASE WHEN doc_id % 2 = 0 THEN 64 ELSE 63 END) AS cut FROM documents) SELECT doc_id, sha256, regexp_full_match(sha256, '[0-9a-fA-F]{64}') AS looks, regexp_full_match(cut, '[0-9a-fA-F]{64}') AS cut_looks FROM h")
def s4(spark, sf_dir):
    h = X.sha256_hex("text")
    return table(spark, sf_dir, "documents").select("doc_id", h.alias("sha256"), X.looks_like_sha256(h).alias("looks"), X.looks_like_sha256(F.when(F.col("doc_id") % 2 == 0, h).otherwise(F.substring(h, 1, 63))).alias("cut_looks"))


@query("s6_s7_paths", "WITH s AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages) SELECT page_id, CASE WHEN trim(path, '/') = '' THEN 'index' ELSE trim(path, '/') END AS slug, path <> '' AND NOT list_contains(string_split(path, '/'), 'en') AS public FROM s")
def s6(spark, sf_dir):
    path = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", X.url_slug("url").alias("slug"), X.is_public_path(path, "en").alias("public"))


@query("s8_vectors", "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) AS mirrored FROM embeddings")
def s8(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(X.l2_norm("embedding"), 6).alias("norm"), F.round(X.cosine(F.col("embedding"), F.reverse("embedding")), 6).alias("mirrored"))


@query("s9_s10_times", "SELECT o_orderkey, strftime(make_timestamp(o_orderkey * 86400000000 + 61000000), '%Y-%m-%dT%H:%M:%SZ') AS iso, CASE WHEN o_orderkey % 3 < 2 THEN o_orderdate::DATE END AS day FROM orders")
def s9(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "MMMM d, yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format(day, "yyyy-MM-dd")).otherwise("soon")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.epoch_iso(F.col("o_orderkey") * 86400 + 61).alias("iso"), X.display_date(text).alias("day"))


@query("s11_s13_numbers", r"""WITH t AS (SELECT *, format('{:,}', l_quantity::BIGINT * 1000) AS shown FROM lineitem), s AS (SELECT *, CASE l_linenumber % 4 WHEN 0 THEN shown WHEN 1 THEN ' ' || shown || ' units or $1,000 each' WHEN 2 THEN '$' || shown || ' for 7 units' ELSE shown || ' unitsets' END AS said FROM t),
a AS (SELECT *, try_cast(replace(regexp_extract(said, '^\s*([\d,]+)(?:\s*units\b|\s*$)', 1), ',', '') AS BIGINT) AS amount FROM s) SELECT l_orderkey, l_linenumber, (l_quantity::BIGINT * 1000)::VARCHAR AS plain, amount, amount IS NULL AS failed, shown FROM a""")
def s11(spark, sf_dir):
    """Amounts before their unit, alone, after another mark and before another word; `failed` marks the rows without one."""
    n = (F.col("l_quantity") * 1000).cast("bigint")
    shown, kind = F.format_number(n, 0), F.col("l_linenumber") % 4
    text = F.when(kind == 0, shown).when(kind == 1, F.concat(F.lit(" "), shown, F.lit(" units or $1,000 each"))).when(kind == 2, F.concat(F.lit("$"), shown, F.lit(" for 7 units"))).otherwise(F.concat(shown, F.lit(" unitsets")))
    amount = X.leading_amount(text, "units")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.normal_number(F.concat(F.lit("$"), F.format_number(n, 0), F.lit(".0"))).alias("plain"), amount.alias("amount"), amount.isNull().alias("failed"), X.thousands(n).alias("shown"))


@query("s14_markdown", r"""SELECT doc_id, regexp_replace(text, '([_*\[\]()~`>#+\-=|{}.!\\])', '\\\1', 'g') AS escaped, regexp_replace(text, '([`\\])', '\\\1', 'g') AS code, regexp_replace(text, '([)\\])', '\\\1', 'g') AS link FROM documents""")
def s14(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.escape_text("text").alias("escaped"), X.escape_code("text").alias("code"), X.escape_link("text").alias("link"))
