"""Inputs that the queries derive from the given tables, by id, so that SQL builds the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.sources.files import table


def next_snapshot(docs: DataFrame) -> DataFrame:
    """(doc_id, text) one step later: of ten ids one kind each is changed, grown, cut, gone or copied."""
    m = F.col("doc_id") % 10
    lines = F.split("text", "\n")
    changed = F.array_join(F.concat(F.array(F.concat(F.lit("changed "), lines[0])), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")
    grown = F.concat(F.lit("inserted line "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text"))
    cut = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "\n")
    edited = docs.where(m != 3).select("doc_id", F.when(m == 0, changed).when(m == 1, grown).when(m == 2, cut).otherwise(F.col("text")).alias("text"))
    return edited.union(docs.where(m == 4).select(F.col("doc_id") + 1000000, "text"))


NEXT_SQL = """nxt AS (
SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN array_to_string(list_concat(['changed ' || string_split(text, chr(10))[1]], string_split(text, chr(10))[2:]), chr(10))
 WHEN 1 THEN 'inserted line ' || doc_id || chr(10) || text WHEN 2 THEN array_to_string(string_split(text, chr(10))[2:], chr(10)) ELSE text END AS text FROM documents WHERE doc_id % 10 <> 3
UNION ALL SELECT doc_id + 1000000, text FROM documents WHERE doc_id % 10 = 4)"""


def versions(docs: DataFrame) -> DataFrame:
    """(slug, sha256, approved) of documents."""
    return docs.select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("slug"), F.sha2(F.encode("text", "utf-8"), 256).alias("sha256"), (F.col("doc_id") % 2 == 0).alias("approved"))


def dated(orders: DataFrame) -> DataFrame:
    """Orders as documents with a free-text date: long, ISO, a placeholder or none."""
    m = F.col("o_orderkey") % 4
    day = F.col("o_orderdate").cast("date")
    text = F.when(m == 0, F.date_format(day, "MMMM d, yyyy")).when(m == 1, F.date_format(day, "yyyy-MM-dd")).when(m == 2, "TBD")
    return orders.select(
        F.concat(F.lit("order-"), F.col("o_orderkey")).alias("slug"), text.alias("date"), F.col("o_orderdate").alias("ingested_at"),
        (F.col("o_orderkey") % 3 != 0).alias("approved"), F.when(F.col("o_orderkey") % 5 < 3, "updates").otherwise("archive").alias("listed_on"),
    )


DATED_SQL = """dated AS (SELECT 'order-' || o_orderkey AS slug, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%B %-d, %Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN 'TBD' END AS date,
 o_orderdate AS ingested_at, o_orderkey % 3 <> 0 AS approved, CASE WHEN o_orderkey % 5 < 3 THEN 'updates' ELSE 'archive' END AS listed_on FROM orders),
parsed AS (SELECT *, coalesce(try_strptime(date, '%B %-d, %Y'), try_strptime(date, '%Y-%m-%d'))::DATE AS day FROM dated)"""


def facts(part: DataFrame) -> DataFrame:
    """Parts as facts: (ordinal, key, value, notes, verified_on, source_url); one in fifty unknown."""
    k = F.col("p_partkey")
    return part.select(
        k.alias("ordinal"), F.concat(F.lit("products."), k).alias("key"), F.when(k % 50 == 0, "unknown").otherwise(F.format_string("%.2f", "p_retailprice")).alias("value"),
        F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("notes"), F.lit("2026-01-02").alias("verified_on"), F.concat(F.lit("https://facts.example.com/parts/"), k).alias("source_url"),
    )


FACTS_SQL = """facts AS (SELECT p_partkey AS ordinal, 'products.' || p_partkey AS key, CASE WHEN p_partkey % 50 = 0 THEN 'unknown' ELSE printf('%.2f', p_retailprice) END AS value,
 p_name || ' ' || p_brand || ' ' || p_type AS notes, '2026-01-02' AS verified_on, 'https://facts.example.com/parts/' || p_partkey AS source_url FROM part)"""


def polls(events: DataFrame) -> DataFrame:
    """Events as poll outcomes of seven sources: (source, at, id, metric, value, props, outcome)."""
    outcome = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "degraded").otherwise("ok")
    return events.select((F.col("user_id") % 7).alias("source"), F.col("ts").alias("at"), F.col("event_id").alias("id"), F.col("event_type").alias("metric"), "value", "props", outcome.alias("outcome"))


POLLS_SQL = """polls AS (SELECT user_id % 7 AS source, ts AS polled, event_id AS id, event_type AS metric, value, props, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'degraded' ELSE 'ok' END AS outcome FROM events)"""


def snapshot_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs, next_snapshot(docs)
