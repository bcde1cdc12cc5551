"""Queries of the facts lane."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwork.operators import facts as E
from groundwork.plans.fixtures import FACTS_SQL, facts
from groundwork.plans.registry import Registry
from groundwork.sources.files import FAQ, table

lane = Registry()
QUERIES, ORACLE, query = lane.QUERIES, lane.ORACLE, lane.query

FAULTY_SQL = """faulty AS (SELECT CASE m WHEN 0 THEN 'Products ' || k WHEN 1 THEN 'mystery.' || k WHEN 4 THEN 'products.' || (k - 1) WHEN 8 THEN 'links.' || k ELSE 'products.' || k END AS key,
 CASE WHEN k % 50 = 0 THEN 'unknown' ELSE 'v' || k END AS value, CASE m WHEN 2 THEN 'soon' ELSE '2026-01-02' END AS verified_on, CASE m WHEN 3 THEN '  ' ELSE 'https://x.example.com/' || k END AS source_url,
 CASE m WHEN 5 THEN 'colour' ELSE '' END AS extra, CASE m WHEN 6 THEN 2 ELSE 1 END AS version FROM (SELECT p_partkey AS k, p_partkey % 97 AS m FROM part))"""


def _faulty(spark, sf_dir):
    k = F.col("p_partkey")
    m = k % 97
    key = F.when(m == 0, F.concat(F.lit("Products "), k)).when(m == 1, F.concat(F.lit("mystery."), k)).when(m == 4, F.concat(F.lit("products."), k - 1)).when(m == 8, F.concat(F.lit("links."), k)).otherwise(F.concat(F.lit("products."), k))
    fields = F.array(*map(F.lit, E.FIELDS))
    return table(spark, sf_dir, "part").select(
        key.alias("key"), F.when(k % 50 == 0, "unknown").otherwise(F.concat(F.lit("v"), k)).alias("value"), F.when(m == 2, "soon").otherwise("2026-01-02").alias("verified_on"),
        F.when(m == 3, "  ").otherwise(F.concat(F.lit("https://x.example.com/"), k)).alias("source_url"), F.lit("").alias("notes"), F.when(m == 6, 2).otherwise(1).alias("version"),
        F.when(m == 5, F.array_append(fields, F.lit("colour"))).otherwise(fields).alias("fields"),
    )


@query("e1_validate_facts", f"""WITH {FAULTY_SQL} SELECT key, 'key_shape' AS rule, key AS detail FROM faulty WHERE NOT regexp_matches(key, '^[a-z][a-z0-9-]*\\.[A-Za-z0-9_.-]+$')
UNION ALL SELECT key, 'category', string_split(key, '.')[1] FROM faulty WHERE string_split(key, '.')[1] NOT IN ('products', 'links') UNION ALL SELECT key, 'verified_on', verified_on FROM faulty WHERE try_strptime(verified_on, '%Y-%m-%d') IS NULL
UNION ALL SELECT key, 'source_url', '' FROM faulty WHERE trim(source_url) = '' UNION ALL SELECT key, 'unknown_field', extra FROM faulty WHERE extra <> '' UNION ALL SELECT key, 'version', version::VARCHAR FROM faulty WHERE version <> 1
UNION ALL SELECT key, 'duplicate_key', count(*)::VARCHAR FROM faulty GROUP BY key HAVING count(*) > 1""")
def e1(spark, sf_dir):
    return E.validate_facts(_faulty(spark, sf_dir), ["products", "links"])


@query("e2_facts_summary", f"WITH {FAULTY_SQL} SELECT count(*) AS facts, (SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT DISTINCT string_split(key, '.')[1] AS c FROM faulty)) AS categories, count(*) FILTER (value = 'unknown') AS unknown FROM faulty")
def e2(spark, sf_dir):
    return E.facts_summary(_faulty(spark, sf_dir)).withColumn("categories", F.array_join("categories", ","))


@query("e3_lookup_facts", f"WITH {FACTS_SQL}, r AS (SELECT DISTINCT 'products.' || (o_custkey * 2) AS key FROM orders) SELECT r.key, coalesce(value <> 'unknown', false) AS known, CASE WHEN value <> 'unknown' THEN value END AS value, CASE WHEN value <> 'unknown' THEN '' ELSE 'not known; see the official source' END AS message, CASE WHEN value <> 'unknown' THEN source_url ELSE 'https://example.com' END AS link FROM r LEFT JOIN facts USING (key)")
def e3(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").select(F.concat(F.lit("products."), F.col("o_custkey") * 2).alias("key")).distinct()
    return E.lookup_facts(wanted, facts(table(spark, sf_dir, "part")), "https://example.com")


@query("e4_by_category", f"WITH {FAULTY_SQL} SELECT key, value FROM faulty WHERE starts_with(key, 'mystery.')")
def e4(spark, sf_dir):
    return E.by_category(_faulty(spark, sf_dir), "mystery").select("key", "value")


@query("e5_category_counts", f"WITH {FAULTY_SQL} SELECT string_split(key, '.')[1] AS category, count(*) AS facts FROM faulty GROUP BY 1")
def e5(spark, sf_dir):
    return E.category_counts(_faulty(spark, sf_dir))


def _questions(spark, sf_dir):
    """User turns, each about a part by words of its name, as the turns themselves are invented prose."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name", "p_brand")
    n = part.agg(F.count(F.lit(1)).alias("n"))
    asked = c.crossJoin(F.broadcast(n)).withColumn("k", 1 + (F.col("conv_id") * 7 + F.col("turn")) % F.col("n")).join(part, "k")  # n is one row
    return asked.select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.concat_ws(" ", "text", F.lit("price of"), "p_name", "p_brand").alias("text"))


QUESTIONS_SQL = "questions AS (SELECT conv_id * 100 + turn AS query_id, text || ' price of ' || p_name || ' ' || p_brand AS text FROM conversations JOIN part ON p_partkey = 1 + (conv_id * 7 + turn) % (SELECT count(*) FROM part) WHERE role = 'user')"


@query("e6_keyword_topk", f"""WITH {FACTS_SQL}, {QUESTIONS_SQL}, q AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM questions),
f AS (SELECT DISTINCT ordinal, key, unnest(regexp_extract_all(lower(key || ' ' || value || ' ' || notes), '[a-z0-9]+')) AS token FROM facts WHERE value <> 'unknown' AND key NOT IN ('products.1', 'products.7')),
s AS (SELECT query_id, ordinal, key, count(*) AS score FROM q JOIN f USING (token) GROUP BY ALL)
SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ordinal)::INT AS rank FROM s QUALIFY rank <= 3""")
def e6(spark, sf_dir):
    return E.keyword_topk(_questions(spark, sf_dir), facts(table(spark, sf_dir, "part")), ["products.1", "products.7"])


@query("e7_drop_blocked", f"WITH {FACTS_SQL} SELECT key, value FROM facts WHERE key NOT IN ('products.1', 'products.7')")
def e7(spark, sf_dir):
    return E.drop_blocked(facts(table(spark, sf_dir, "part")), ["products.1", "products.7"]).select("key", "value")


@query("e8_link_inventory", r"""SELECT DISTINCT url FROM (SELECT regexp_replace(unnest(regexp_extract_all(html, 'https://[^\s<>]+')), '[.,;:)}\]"'']+$', '') AS url FROM pages UNION ALL SELECT regexp_replace(unnest(regexp_extract_all(url, 'https://[^\s<>]+')), '[.,;:)}\]"'']+$', '') FROM pages UNION ALL SELECT 'https://example.com/')""")
def e8(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return E.link_inventory(pages.select(F.col("html").alias("t")).union(pages.select("url")), "t", ["https://example.com/", "http://old.example.com/"])


@query("e9_humanize_key", "SELECT 'parts.' || replace(p_name, ' ', '_') || '_usd_' || p_partkey AS key, CASE WHEN 'parts.' || replace(p_name, ' ', '_') || '_usd_' || p_partkey = 'parts.hot_gear_usd_3' THEN 'Hot gear price' ELSE array_to_string(list_transform(string_split(p_name || ' usd ' || p_partkey, ' '), lambda w: CASE WHEN w = 'usd' THEN 'USD' ELSE upper(w[1]) || lower(substr(w, 2)) END), ' ') END AS label FROM part")
def e9(spark, sf_dir):
    keys = table(spark, sf_dir, "part").select(F.concat(F.lit("parts."), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_usd_"), F.col("p_partkey")).alias("key"), "p_partkey", "p_name")
    special = {"parts.hot_gear_usd_3": "Hot gear price"}
    return E.humanize_key(keys, special, ["usd"])


def _sorted_sql(text: str) -> str:
    return f"array_to_string(list_sort(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+')), ' ')"


# What each kind of question is to find, said outright: a text with one more word, the same words in another order, a
# keyword whose question is listed, one whose question is not, and prose that nothing resembles.
@query("e10_fuzzy_faq", f"""WITH n AS (SELECT max(item_id) + 1 AS n FROM benchmark), items AS (SELECT item_id, min(text) OVER (PARTITION BY {_sorted_sql('text')}) AS question, length({_sorted_sql('text')}) AS l FROM benchmark),
asked AS (SELECT conv_id * 100 + turn AS query_id, turn % 5 AS kind, question, l FROM conversations, n JOIN items ON item_id = conv_id % n WHERE role = 'user')
SELECT query_id, question, round_even(100.0 * 2 * l / (2 * l + 3), 0)::INT AS score FROM asked WHERE kind = 0 AND 100.0 * 2 * l / (2 * l + 3) >= 79.5 UNION ALL SELECT query_id, question, 100 FROM asked WHERE kind = 1
UNION ALL SELECT query_id, 'How do refunds work?', 100 FROM asked WHERE kind = 2""")
def e10(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    n = items.agg(F.max("item_id")).first()[0] + 1
    c = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("item_id", F.col("conv_id") % n).join(items, "item_id")
    turned = F.array_join(F.reverse(F.split("question", r"\s+")), " ")
    kinds = F.array(F.concat("question", F.lit(" zz")), turned, F.lit("What is the Refund rule"), F.lit("and the warranty rule"), F.col("text"))
    asked = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), kinds[(F.col("turn") % 5).cast("int")].alias("text"))
    faq = items.select("question").unionAll(spark.range(1).select(F.lit("How do refunds work?")))
    return E.fuzzy_faq(asked, faq, {"warranty": "How long is the warranty?", "refund": "How do refunds work?"})


@query("e11_flatten_faq", "SELECT item_id, 'general' AS category, 0 AS position, 'Q' || item_id AS question, text AS answer FROM benchmark UNION ALL SELECT item_id, 'general', 1, 'R', 'none' FROM benchmark UNION ALL SELECT item_id, 'odd', 0, 'S', NULL FROM benchmark")
def e11(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    entry = lambda q, a: F.struct(q.alias("question"), a.alias("answer"))
    body = F.to_json(F.create_map(F.lit("general"), F.array(entry(F.concat(F.lit("Q"), F.col("item_id")), F.col("text")), entry(F.lit("R"), F.lit("none"))), F.lit("odd"), F.array(entry(F.lit("S"), F.lit(None).cast("string")))))
    return E.flatten_faq(b.select("item_id", F.from_json(body, FAQ).alias("faq")), keep=["item_id"])
