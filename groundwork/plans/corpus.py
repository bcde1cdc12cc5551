"""Queries of the corpus lane."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.functions import exprs as X
from groundwork.operators import corpus as C
from groundwork.plans.fixtures import DATED_SQL, NEXT_SQL, dated, snapshot_pair, versions
from groundwork.plans.registry import Registry
from groundwork.sources.files import table

lane = Registry()
QUERIES, ORACLE, query = lane.QUERIES, lane.ORACLE, lane.query
R6 = 6


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 3 == 0, "html").otherwise("pdf")
    return table(spark, sf_dir, "documents").select("doc_id", "source", kind.alias("kind"), F.when(F.col("doc_id") % 7 == 0, "failed").otherwise("ok").alias("extraction"))


@query("a1_inventory_scan", "SELECT doc_id, source FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 7 <> 0")
def a1(spark, sf_dir):
    return C.scan_inventory(_inventory(spark, sf_dir)).select("doc_id", "source")


@query("a1_inventory_counts", "SELECT count(*) FILTER (doc_id % 3 <> 0 AND doc_id % 7 <> 0) AS kept, count(*) FILTER (NOT (doc_id % 3 <> 0 AND doc_id % 7 <> 0)) AS skipped FROM documents")
def a1_counts(spark, sf_dir):
    return C.inventory_counts(_inventory(spark, sf_dir))


@query("a2_content_hash", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def a2(spark, sf_dir):
    return C.with_sha256(table(spark, sf_dir, "documents")).select("doc_id", "sha256")


MERGE_SQL = f"""WITH {NEXT_SQL}, cur AS (SELECT 'doc-' || doc_id AS slug, sha256(text) AS sha, doc_id % 2 = 0 AS approved FROM documents),
inc AS (SELECT 'doc-' || doc_id AS slug, sha256(text) AS sha FROM nxt), allow AS (SELECT DISTINCT sha256(text) AS sha FROM nxt WHERE doc_id % 20 = 0),
merged AS (SELECT coalesce(c.slug, i.slug) AS slug, coalesce(i.sha, c.sha) AS sha256, CASE WHEN i.sha IS NULL THEN 'keep' WHEN c.sha IS NULL THEN 'insert' WHEN c.sha = i.sha THEN 'skip' ELSE 'supersede' END AS action,
 c.approved AS was, a.sha IS NOT NULL AS allowed, c.sha AS old FROM cur c FULL JOIN inc i ON c.slug = i.slug LEFT JOIN allow a ON i.sha = a.sha)"""


def _merge(spark, sf_dir):
    docs, later = snapshot_pair(spark, sf_dir)
    allow = later.where(F.col("doc_id") % 20 == 0).select(X.sha256_hex("text").alias("sha256"))
    return C.merge_corpus(versions(docs), versions(later).drop("approved"), allow), later


@query("a3_idempotent_merge", MERGE_SQL + " SELECT slug, sha256, CASE WHEN action IN ('keep','skip') THEN was ELSE allowed END AS approved, action, CASE WHEN action = 'supersede' THEN old END AS replaced_sha FROM merged")
def a3(spark, sf_dir):
    return _merge(spark, sf_dir)[0]


WORDS = r"list_filter(string_split_regex(text, '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+'), lambda w: w <> '')"
CHUNK_COUNT = "CASE WHEN n = 0 THEN 0 ELSE 1 + greatest(0, ceil((n - 220) / 180.0))::BIGINT END"


@query("a4_ingest_summary", MERGE_SQL + f""", sizes AS (SELECT 'doc-' || doc_id AS slug, {CHUNK_COUNT} AS k FROM (SELECT doc_id, len({WORDS}) AS n FROM nxt))
SELECT count(*) FILTER (action IN ('insert','supersede')) AS ingested, count(*) FILTER (action = 'skip') AS skipped, count(*) FILTER (action = 'supersede') AS superseded, sum(CASE WHEN action IN ('insert','supersede') THEN coalesce(k, 0) ELSE 0 END)::BIGINT AS chunk_count FROM merged LEFT JOIN sizes USING (slug)""")
def a4(spark, sf_dir):
    merged, later = _merge(spark, sf_dir)
    chunks = C.chunk_words(later.withColumn("slug", F.concat(F.lit("doc-"), F.col("doc_id"))), keep=("slug",))
    return C.ingest_summary(merged, chunks.groupBy("slug").agg(F.count(F.lit(1)).alias("n_chunks")))


CHUNKS_SQL = f"""chunks AS (SELECT doc_id, i::INT AS chunk_index, array_to_string(w[i * 180 + 1 : i * 180 + 220], ' ') AS content FROM
 (SELECT doc_id, w, unnest(range(0, ({CHUNK_COUNT})::BIGINT)) AS i FROM (SELECT doc_id, {WORDS} AS w, len({WORDS}) AS n FROM documents)))"""


@query("a5_chunk_words", f"WITH {CHUNKS_SQL} SELECT doc_id, chunk_index, content FROM chunks")
def a5(spark, sf_dir):
    return C.chunk_words(table(spark, sf_dir, "documents"))


@query("a6_chunk_chars", "SELECT doc_id, i::INT AS chunk_index, substr(text, i * 1000 + 1, 1000) AS content FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 999) // 1000)) AS i FROM documents)")
def a6(spark, sf_dir):
    return C.chunk_chars(table(spark, sf_dir, "documents"))


EMBED_SQL = """tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents),
grams AS (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS g FROM tok) GROUP BY ALL),
hashed AS (SELECT doc_id, (('0x' || substr(h, 1, 16))::UBIGINT % 256)::INT AS bucket, CASE WHEN ('0x' || substr(h, 17, 2))::INT % 2 = 0 THEN n ELSE -n END AS v FROM (SELECT *, sha256(g) AS h FROM grams)),
summed AS (SELECT doc_id, bucket, sum(v)::BIGINT AS v FROM hashed GROUP BY ALL HAVING sum(v) <> 0),
emb AS (SELECT doc_id, bucket, v / sqrt(sum((v * v)::DOUBLE) OVER (PARTITION BY doc_id)) AS weight FROM summed)"""


@query("a7_hash_embed", f"WITH {EMBED_SQL} SELECT doc_id, bucket, round(weight, 6) AS weight FROM emb")
def a7(spark, sf_dir):
    return C.hash_embed(table(spark, sf_dir, "documents")).select("doc_id", "bucket", F.round("weight", R6).alias("weight"))


TOPK_SQL = """hits AS (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INT AS rank FROM
 (SELECT q.vec_id AS query_id, i.vec_id AS item_id, list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings i WHERE q.vec_id % 50 = 0) QUALIFY rank <= 5)"""


def _hits(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return C.vector_topk(asked, e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v")), 5)


@query("a8_vector_topk", f"WITH {TOPK_SQL} SELECT query_id, item_id, round(score, 6) AS score, rank FROM hits")
def a8(spark, sf_dir):
    return _hits(spark, sf_dir).withColumn("score", F.round("score", R6))


@query("a9_serving_gate", "SELECT doc_id, sha256(text) AS sha256 FROM documents JOIN labels USING (doc_id) WHERE quality = 1 OR sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 11 = 0)")
def a9(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    with_state = docs.join(labels, "doc_id").select("doc_id", X.sha256_hex("text").alias("sha256"), (F.col("quality") == 1).alias("approved"))
    allow = docs.where(F.col("doc_id") % 11 == 0).select(X.sha256_hex("text").alias("sha256"))
    return C.serving_gate(with_state, allow=allow).select("doc_id", "sha256")


CONTROL_SQL = """cur AS (SELECT 'doc-' || doc_id AS slug, sha256(text) AS sha256, doc_id % 2 = 0 AS approved FROM documents),
control AS (SELECT CASE WHEN doc_id % 2 = 0 THEN sha256(text) ELSE 'doc-' || (doc_id + 5) END AS identifier, quality = 1 AS approved, doc_id AS moment FROM documents JOIN labels USING (doc_id)),
one AS (SELECT identifier AS sha256, max({'moment': moment, 'approved': approved}) AS c1 FROM control WHERE regexp_full_match(identifier, '[0-9a-fA-F]{64}') GROUP BY 1),
two AS (SELECT identifier AS slug, max({'moment': moment, 'approved': approved}) AS c2 FROM control WHERE NOT regexp_full_match(identifier, '[0-9a-fA-F]{64}') GROUP BY 1)"""


def _approvals(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    named = F.when(F.col("doc_id") % 2 == 0, X.sha256_hex("text")).otherwise(F.concat(F.lit("doc-"), F.col("doc_id") + 5))
    control = docs.join(labels, "doc_id").select(named.alias("identifier"), (F.col("quality") == 1).alias("approved"), F.col("doc_id").alias("at"))
    return C.apply_approvals(versions(docs), control)


@query("a10_apply_approvals", f"WITH {CONTROL_SQL} SELECT slug, sha256, coalesce(c.approved, x.approved) AS approved, coalesce(c.approved, x.approved) <> x.approved AS changed FROM (SELECT cur.*, CASE WHEN c2 IS NULL OR c1.moment > c2.moment THEN c1 ELSE c2 END AS c FROM cur LEFT JOIN one USING (sha256) LEFT JOIN two USING (slug)) x")
def a10(spark, sf_dir):
    return _approvals(spark, sf_dir)[0]


@query("a10_unmatched", f"WITH {CONTROL_SQL} SELECT DISTINCT identifier FROM control WHERE identifier NOT IN (SELECT slug FROM cur) AND identifier NOT IN (SELECT sha256 FROM cur)")
def a10_missing(spark, sf_dir):
    return _approvals(spark, sf_dir)[1]


@query("a11_pending", f"WITH {DATED_SQL} SELECT slug, ingested_at FROM dated WHERE NOT approved ORDER BY ingested_at, slug")
def a11(spark, sf_dir):
    return C.list_pending(dated(table(spark, sf_dir, "orders"))).select("slug", "ingested_at")


@query("a12_drop_orphans", f"WITH {CHUNKS_SQL} SELECT doc_id, chunk_index, content FROM chunks WHERE doc_id IN (SELECT doc_id FROM labels)")
def a12(spark, sf_dir):
    return C.drop_orphan_chunks(C.chunk_words(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


@query("a13_chunk_stats", f"WITH {CHUNKS_SQL} SELECT doc_id, sum(n)::BIGINT AS n_chunks, count(*) FILTER (n > 1) AS n_repeated FROM (SELECT doc_id, chunk_index, count(*) AS n FROM chunks GROUP BY ALL) GROUP BY doc_id")
def a13(spark, sf_dir):
    return C.chunk_stats(C.chunk_words(table(spark, sf_dir, "documents")))


@query("a14_fresh_only", f"WITH {DATED_SQL} SELECT slug, date FROM parsed WHERE day >= DATE '1996-06-01'")
def a14(spark, sf_dir):
    return C.fresh_only(dated(table(spark, sf_dir, "orders")), "1996-06-01").select("slug", "date")


@query("a14_recent_updates", f"WITH {DATED_SQL} SELECT slug, date, ingested_at FROM (SELECT * FROM parsed WHERE listed_on = 'updates' AND approved ORDER BY ingested_at DESC, slug LIMIT 50) WHERE day >= DATE '1995-01-01' ORDER BY ingested_at DESC, slug LIMIT 5")
def a14_recent(spark, sf_dir):
    return C.recent_updates(dated(table(spark, sf_dir, "orders")), "updates", "1995-01-01").select("slug", "date", "ingested_at")


@query("a15_unparseable_dates", f"WITH {DATED_SQL} SELECT slug, min(date) AS date FROM parsed WHERE day IS NULL GROUP BY slug")
def a15(spark, sf_dir):
    return C.unparseable_dates(dated(table(spark, sf_dir, "orders")))


CARD_DAYS = ("January 5, 2026", "2026-02-07", "TBD")


def _card_pages(spark, sf_dir):
    """Pages with cards in their body: one that differs from page to page, one without a date, one hidden, one of another class."""
    id_ = F.col("page_id").cast("string")
    day = F.element_at(F.array(*map(F.lit, CARD_DAYS)), (F.col("page_id") % 3 + 1).cast("int"))
    first = F.concat(F.lit('<button data-pdf="papers/'), id_, F.lit(".pdf\" data-title='Q&amp;A \"on\" "), id_, F.lit("' class=\"wide pdf-preview-card\" data-date=\""), day, F.lit('" data-slug=paper-'), id_, F.lit(">Read</button>"))
    second = F.concat(F.lit('<div class="pdf-preview-card big" data-slug="undated-'), id_, F.lit('" data-pdf="a/b.pdf" data-title="Caf&eacute;"></div>'))
    hidden = F.lit('<a class="pdf-preview-card" data-slug="h" data-title="H" data-date="x" data-pdf="papers/previews/h.pdf"></a><a class="pdf-preview-card" data-slug="e" data-title="E" data-pdf=""></a>')
    other = F.lit('<a class="pdf-preview-cards" data-slug="o" data-pdf="o.pdf"></a><a class="pdf-preview-card" data-pdf="n.pdf"></a><!-- <a class="pdf-preview-card" data-slug="c" data-pdf="c.pdf"> -->')
    cards = F.concat(first, hidden, other, F.when(F.col("page_id") % 2 == 0, second).otherwise(""))
    listed = F.when(F.col("page_id") % 9 == 0, "archive").when(F.col("page_id") % 9 == 1, F.lit(None).cast("string")).otherwise("updates")
    return table(spark, sf_dir, "pages").select("page_id", listed.alias("listed_on"), F.replace("html", F.lit("<article>"), F.concat(F.lit("<article>"), cards)).alias("html"))


@query("a16_extract_cards", f"""WITH p AS (SELECT page_id, CASE WHEN page_id % 9 = 1 THEN NULL ELSE 'updates' END AS listed_on FROM pages WHERE page_id % 9 <> 0)
SELECT page_id, listed_on, 0 AS position, 'paper-' || page_id AS slug, 'Q&A "on" ' || page_id AS title, (['{"', '".join(CARD_DAYS)}'])[page_id % 3 + 1] AS date, 'papers/' || page_id || '.pdf' AS path FROM p
UNION ALL SELECT page_id, listed_on, 3, 'undated-' || page_id, 'Café', NULL, 'a/b.pdf' FROM p WHERE page_id % 2 = 0""")
def a16(spark, sf_dir):
    return C.extract_cards(_card_pages(spark, sf_dir), excluded=("archive",))


@query("a17_relevant_pushes", "SELECT event_id FROM events WHERE event_type <> 'view' AND (user_id % 10 = 0 OR user_id % 10 = 3)")
def a17(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    path = F.when(F.col("user_id") % 10 == 0, F.concat(F.lit("papers/"), F.col("event_id"), F.lit(".pdf"))).when(F.col("user_id") % 10 == 3, "index.html").otherwise("notes/x.md")
    commit = F.struct(F.array(path).alias("added"), F.array(F.lit("readme")).alias("modified"))
    body = F.to_json(F.struct(F.when(F.col("event_type") == "view", "refs/heads/dev").otherwise("refs/heads/main").alias("ref"), F.array(commit).alias("commits")))
    return C.relevant_pushes(e.withColumn("payload", body), "payload", ["index.html"], "papers/", "refs/heads/main").select("event_id")


CITE_SQL = TOPK_SQL + """, links AS (SELECT query_id, 'https://docs.example.com/' || CASE WHEN item_id % 7 = 0 THEN 'previews/' ELSE 'p/' END || (item_id % 40) AS url, score, rank FROM hits),
rows_ AS (SELECT query_id, url, 0 AS kind, rank FROM links WHERE score >= 0.2 AND NOT contains(url, '/previews/') UNION ALL SELECT vec_id, 'https://facts.example.com/' || label, 1, 1 FROM embeddings WHERE vec_id % 50 = 0)"""


def _links(spark, sf_dir):
    url = F.concat(F.lit("https://docs.example.com/"), F.when(F.col("item_id") % 7 == 0, "previews/").otherwise("p/"), F.col("item_id") % 40)
    facts = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("https://facts.example.com/"), F.col("label")).alias("url"), F.lit(1).alias("rank"))
    return _hits(spark, sf_dir).withColumn("url", url), facts


@query("a18_citations", f"WITH {CITE_SQL} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY kind, rank, url)::INT AS position, url FROM (SELECT query_id, url, min(kind) AS kind, arg_min(rank, kind * 1000 + rank) AS rank FROM rows_ GROUP BY 1, 2) QUALIFY position <= 3")
def a18(spark, sf_dir):
    hits, facts = _links(spark, sf_dir)
    return C.citations(hits, 0.2, ["/previews/"], 3, facts)


@query("a19_assemble_context", f"""WITH {TOPK_SQL}, r AS (SELECT vec_id AS query_id, 0 AS kind, 1 AS rank, 'fact ' || label AS text FROM embeddings WHERE vec_id % 50 = 0 AND vec_id % 2 = 0 UNION ALL SELECT query_id, 1, rank, 'chunk ' || item_id FROM hits WHERE query_id % 3 <> 0)
SELECT q.vec_id AS query_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY kind, rank), '') AS context, CASE max(kind) WHEN 1 THEN 'rag' WHEN 0 THEN 'faq' ELSE 'refusal' END AS answer_kind FROM embeddings q LEFT JOIN r ON r.query_id = q.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1""")
def a19(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    facts = e.where("query_id % 2 = 0").select("query_id", F.lit(1).alias("rank"), F.concat(F.lit("fact "), F.col("label")).alias("text"))
    chunks = _hits(spark, sf_dir).where("query_id % 3 <> 0").select("query_id", "rank", F.concat(F.lit("chunk "), F.col("item_id")).alias("text"))
    return C.assemble_context(e, facts, chunks)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash, chunk, embed and rank: which chunks answer benchmark questions best, over all documents. Every 50th item asks."""
    docs = C.with_sha256(table(spark, sf_dir, "documents"))
    chunks = C.chunk_words(docs, keep=("doc_id", "sha256")).withColumn("item_id", F.col("doc_id") * 10000 + F.col("chunk_index"))
    asked = table(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "text")
    queries = C.hash_vectors(asked, "query_id", "text").withColumnRenamed("v", "q")
    return C.vector_topk(queries, C.hash_vectors(chunks, "item_id", "content"), 5, digits=R6)


query("flagship_best_chunks", f"""WITH {CHUNKS_SQL}, texts AS (SELECT doc_id * 10000 + chunk_index AS id, content AS t, false AS asked FROM chunks UNION ALL SELECT item_id, text, true FROM benchmark WHERE item_id % 50 = 0),
tok AS (SELECT id, asked, regexp_extract_all(lower(t), '[a-z0-9]+') AS t FROM texts),
grams AS (SELECT id, asked, g, count(*) AS n FROM (SELECT id, asked, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS g FROM tok) GROUP BY ALL),
hashed AS (SELECT id, asked, (('0x' || substr(h, 1, 16))::UBIGINT % 256)::INT AS bucket, CASE WHEN ('0x' || substr(h, 17, 2))::INT % 2 = 0 THEN n ELSE -n END AS v FROM (SELECT *, sha256(g) AS h FROM grams)),
summed AS (SELECT id, asked, bucket, sum(v)::BIGINT AS v FROM hashed GROUP BY ALL HAVING sum(v) <> 0),
emb AS (SELECT id, asked, bucket, v / sqrt(sum((v * v)::DOUBLE) OVER (PARTITION BY id, asked)) AS w FROM summed),
scored AS (SELECT q.id AS query_id, i.id AS item_id, round(sum(q.w * i.w), 6) AS score FROM emb q JOIN emb i USING (bucket) WHERE q.asked AND NOT i.asked GROUP BY 1, 2)
SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INT AS rank FROM scored QUALIFY rank <= 5""")(flagship)
