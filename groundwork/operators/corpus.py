"""Corpus ingest, governance and retrieval."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwork.functions import exprs as X
from groundwork.functions.workers import ship, slices
from groundwork.operators import markup, nearest

# White space of any script, as text is split at.
BLANKS = r"(?U)[\s\x1C-\x1F]+"


def scan_inventory(df: DataFrame, kind: str = "pdf", ok_status: str = "ok") -> DataFrame:
    """Entries of the kind whose text was extracted."""
    return df.where((F.col("kind") == kind) & (F.col("extraction") == ok_status))


def inventory_counts(df: DataFrame, kind: str = "pdf", ok_status: str = "ok") -> DataFrame:
    """How many entries the scan keeps and skips."""
    good = F.coalesce((F.col("kind") == kind) & (F.col("extraction") == ok_status), F.lit(False))
    return df.agg(F.count_if(good).alias("kept"), F.count_if(~good).alias("skipped"))


def with_sha256(df: DataFrame, text: str = "text") -> DataFrame:
    """The content hash that identifies a document."""
    return df.withColumn("sha256", X.sha256_hex(text))


def merge_corpus(current: DataFrame, incoming: DataFrame, allow_sha: DataFrame) -> DataFrame:
    """Merge incoming (slug, sha256) into current (slug, sha256, approved), one row for each slug of either.

    Same hash: skip, and approval stays. New slug: insert. Other hash: supersede; the new version is
    approved only if its own hash is allowed, whatever the old one was. Absent slugs: keep.
    """
    old = current.select("slug", F.col("sha256").alias("old_sha"), F.col("approved").alias("old_approved"))
    new = incoming.select("slug", F.col("sha256").alias("new_sha"))
    allowed = allow_sha.select(F.col("sha256").alias("new_sha")).distinct().withColumn("allowed", F.lit(True))
    both = old.join(new, "slug", "full").join(allowed, "new_sha", "left")
    action = F.when(F.col("new_sha").isNull(), "keep").when(F.col("old_sha").isNull(), "insert").when(F.col("old_sha") == F.col("new_sha"), "skip").otherwise("supersede")
    kept = action.isin("keep", "skip")
    return both.select("slug", F.coalesce("new_sha", "old_sha").alias("sha256"), F.when(kept, F.col("old_approved")).otherwise(F.coalesce("allowed", F.lit(False))).alias("approved"), action.alias("action"), F.when(action == "supersede", F.col("old_sha")).alias("replaced_sha"))


def ingest_summary(actions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Counts by outcome, and the chunks that changed documents yield. chunks: (slug, n_chunks)."""
    changed = actions.join(chunks, "slug", "left").withColumn("n", F.when(F.col("action").isin("insert", "supersede"), F.coalesce("n_chunks", F.lit(0))).otherwise(0))
    return changed.agg(F.count_if(F.col("action").isin("insert", "supersede")).alias("ingested"), F.count_if(F.col("action") == "skip").alias("skipped"), F.count_if(F.col("action") == "supersede").alias("superseded"), F.sum("n").alias("chunk_count"))


def chunk_words(df: DataFrame, text: str = "text", window: int = 220, overlap: int = 40, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Windows of words, parted by blanks of any script; the last chunk is the first that reaches the end; no words, no chunk.

    Windows are cut before they become rows, so a long text's words are not carried along with each.
    """
    if overlap >= window:
        raise ValueError("overlap must be smaller than window")
    step = window - overlap
    words = F.filter(F.split(F.col(text), BLANKS), lambda w: w != "")
    split = df.select(*keep, words.alias("__w")).where(F.size("__w") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("__w") - window) / step)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice("__w", i * step + 1, F.lit(window)), " "))
    return split.select(*keep, F.posexplode(cut).alias("chunk_index", "content"))


def chunk_chars(df: DataFrame, text: str = "text", size: int = 1000, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Pieces of a fixed number of characters."""
    n = F.length(text)
    rows = df.where(n > 0).select(*keep, text, F.explode(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).alias("chunk_index"))
    return rows.select(*keep, "chunk_index", F.substring(text, F.col("chunk_index") * size + 1, F.lit(size)).alias("content"))


# Bytes outside words; those of other scripts are among them.
WORD_BYTES = bytes(b if chr(b).isascii() and chr(b).isalnum() else 0x20 for b in range(256))
KNOWN_GRAMS = 500_000  # that a task keeps before it forgets them


class Grams:
    """Buckets and signs of the grams that a task has met; each different gram is hashed once."""

    def __init__(self, dim: int, sizes: tuple[int, ...]):
        self.dim, self.sizes = dim, sizes
        self.forget()

    def forget(self) -> None:
        """A gram of n words is known by the number of its first n - 1 words and that of its last one."""
        self.numbers: list[dict] = [{} for _ in range(max(self.sizes))]
        self.buckets = [np.empty(0, np.int64) for _ in self.numbers]
        self.signs = [np.empty(0, np.int64) for _ in self.numbers]

    def add(self, level: int, keys: list, texts: list[bytes]) -> None:
        """Number new grams of a level, and hash them if grams of this length count."""
        known = self.numbers[level]
        known.update(zip(keys, range(len(known), len(known) + len(keys)), strict=True))
        if level + 1 in self.sizes:
            d = np.frombuffer(b"".join([hashlib.sha256(t).digest() for t in texts]), np.uint8).reshape(-1, 32)
            bucket = (np.ascontiguousarray(d[:, :8]).view(">u8")[:, 0] % np.uint64(self.dim)).astype(np.int64)
            self.buckets[level] = np.concatenate((self.buckets[level], bucket))
            self.signs[level] = np.concatenate((self.signs[level], 1 - 2 * (d[:, 8] & 1).astype(np.int64)))

    def sums(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row * dim + bucket, signed count) of the grams of some lower-case texts, sums of zero left out. Words are runs of a-z and 0-9."""
        if sum(map(len, self.numbers)) > KNOWN_GRAMS:
            self.forget()
        parted = [t.translate(WORD_BYTES).split() if t else [] for t in texts.cast(pa.binary()).to_pylist()]
        row = np.repeat(np.arange(len(parted)), [len(w) for w in parted])
        words = [w for text in parted for w in text]
        number = self.numbers[0].get
        found = list(map(number, words))
        if None in found:
            new = list(dict.fromkeys(w for w, n in zip(words, found, strict=True) if n is None))
            self.add(0, new, new)
            found = list(map(number, words))
        gram = word = np.array(found, np.int64)
        start = np.arange(len(words))
        slots, signs = [], []
        for level in range(len(self.numbers)):
            if level:
                # Grams that end beyond their row are none.
                inside = start + level < len(words)
                inside[inside] = row[start[inside]] == row[start[inside] + level]
                start, gram = start[inside], gram[inside]
                keys, first, back = np.unique(gram << 32 | word[start + level], return_index=True, return_inverse=True)
                known = self.numbers[level]
                new = [i for i, k in enumerate(keys.tolist()) if k not in known]
                if new:
                    self.add(level, keys[new].tolist(), [b" ".join(words[i : i + level + 1]) for i in start[first[new]].tolist()])
                gram = np.array(list(map(known.get, keys.tolist())), np.int64)[back]
            if level + 1 in self.sizes:
                slots.append(row[start] * self.dim + self.buckets[level][gram])
                signs.append(self.signs[level][gram])
        slot, sign = np.concatenate(slots), np.concatenate(signs)
        if len(parted) * self.dim <= 1 << 20:
            v = np.bincount(slot, weights=sign)
            slot = np.flatnonzero(v)
            return slot, v[slot]
        slot, back = np.unique(slot, return_inverse=True)
        v = np.bincount(back, weights=sign, minlength=len(slot))
        return slot[v != 0], v[v != 0]


def hash_embed(df: DataFrame, key: str = "doc_id", text: str = "text", dim: int = 256, sizes: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Sparse signed hashing embedding of unit length: (key, bucket, weight), for each row of its own.

    Bucket: the first eight bytes of the gram's sha256, unsigned, modulo dim; sign: parity of the ninth.
    Grams of a row are counted and hashed where the row is, so nothing is shuffled. Zero weights are left out.
    """
    ship(df.sparkSession)
    lower = df.select(key, F.lower(text).alias("t"))
    schema = T.StructType([lower.schema[key]]).add("bucket", "integer").add("weight", "double")

    def work(batches):
        grams = Grams(dim, sizes)
        for part in slices(batches, 256):
            slot, v = grams.sums(part.column("t"))
            row = slot // dim
            norm = np.sqrt(np.bincount(row, weights=v * v, minlength=part.num_rows))
            yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(row)), pa.array((slot % dim).astype(np.int32)), pa.array(v / norm[row])], schema.names)

    return lower.mapInArrow(work, schema)


def hash_vectors(df: DataFrame, key: str = "doc_id", text: str = "text", dim: int = 256, sizes: tuple[int, ...] = (1, 2)) -> DataFrame:
    """(key, v): the same embedding as one dense vector on its row; a text without a gram has zeros."""
    ship(df.sparkSession)
    lower = df.select(key, F.lower(text).alias("t"))
    schema = T.StructType([lower.schema[key]]).add("v", T.ArrayType(T.DoubleType()))

    def work(batches):
        grams = Grams(dim, sizes)
        for part in slices(batches, 256):
            slot, v = grams.sums(part.column("t"))
            rows = np.zeros(part.num_rows * dim)
            rows[slot] = v
            rows = rows.reshape(-1, dim)
            rows /= np.maximum(np.sqrt((rows * rows).sum(1)), 1)[:, None]
            ends = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * dim)
            yield pa.RecordBatch.from_arrays([part.column(key), pa.ListArray.from_arrays(ends, pa.array(rows.ravel()))], schema.names)

    return lower.mapInArrow(work, schema)


def dense(sparse: DataFrame, key: str = "doc_id", dim: int = 256) -> DataFrame:
    """(key, embedding) arrays of a sparse embedding."""
    entries = F.map_from_entries(F.collect_list(F.struct("bucket", "weight")))
    return sparse.groupBy(key).agg(entries.alias("m")).select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("embedding"))


def vector_topk(queries: DataFrame, items: DataFrame, k: int, block_bytes: int = 32 << 20, block_rows: int = 4096, chunk_bytes: int = 64 << 20, digits: int | None = None) -> DataFrame:
    """The k nearest items by cosine for each query: (query_id, item_id, score, rank).

    queries (query_id, q) and items (item_id, v) may be any number. Queries go to the tasks in blocks of about
    `block_bytes` or `block_rows`, one pass over the items for each block. A task multiplies a block with chunks of items
    as matrices and passes on the k best of a chunk for each query that may still count; a window ranks them. Item
    groups that an angle bound rules out are never multiplied. Null and zero vectors, those with a null or
    infinite part, and pairs of different length have no score and are left out. Equal scores go by item_id;
    with `digits` scores are rounded first. Repeated ids and vectors count each for itself.
    """
    spark = items.sparkSession
    ship(spark)
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("q").cast("array<double>").alias("q"), F.size("q").alias("dim")).where("q is not null and dim > 0")
    counts = sorted(tuple(r) for r in asked.groupBy("dim").count().collect())
    vectors = items.select("item_id", F.col("v").cast("array<double>").alias("v"))
    schema = T.StructType([T.StructField("query_id", T.LongType()), vectors.schema["item_id"]]).add("score", "double")

    def search(dim, given):
        def work(batches):
            ids, q, norms = given.value
            low = np.full(len(ids), -np.inf)
            for part in slices(batches, max(256, chunk_bytes // (8 * dim))):
                lengths = pc.fill_null(pc.list_value_length(part.column("v")), 0).to_numpy(zero_copy_only=False)
                part = part.take(pa.array(np.flatnonzero(lengths == dim)))
                v = pc.list_flatten(part.column("v")).to_numpy(zero_copy_only=False).reshape(-1, dim)
                names = part.column("item_id")
                ranks = np.empty(len(names), np.int64)
                ranks[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
                at, i, score, _ = nearest.top(q, norms, v, ranks, k, low, digits)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), names.take(pa.array(i)), pa.array(score)], schema.names)

        return work

    found = None
    for dim, n in counts:
        blocks = max(-(-n * dim * 8 // block_bytes), -(-n // block_rows))
        dealt = asked.where(F.col("dim") == dim).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
        for b in range(blocks):
            mine = dealt.where(F.col("block") == b).select("query_id", "q").toArrow()
            q = pc.list_flatten(mine.column("q")).to_numpy().reshape(-1, dim)
            norms = nearest.unit(q)[1]
            real = (norms > 0) & np.isfinite(norms)
            given = spark.sparkContext.broadcast((mine.column("query_id").to_numpy()[real], q[real], norms[real]))
            some = vectors.mapInArrow(search(dim, given), schema)
            found = some if found is None else found.unionAll(some)
    if found is None:
        found = vectors.limit(0).select(F.lit(0).cast("bigint").alias("query_id"), "item_id", F.lit(0.0).alias("score"))
    score = F.col("score") if digits is None else F.round("score", digits)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return found.select("query_id", "item_id", score.alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def serving_gate(docs: DataFrame, quarantine_on: bool = True, include_unapproved: bool = False, allow: DataFrame | None = None) -> DataFrame:
    """Approved documents only, unless the switch is off or the caller includes the others; `allow` adds hashes."""
    if not quarantine_on or include_unapproved:
        return docs
    if allow is None:
        return docs.where("approved")
    listed = allow.select("sha256").distinct().withColumn("__ok", F.lit(True))
    return docs.join(listed, "sha256", "left").where(F.col("approved") | F.coalesce("__ok", F.lit(False))).drop("__ok")


def apply_approvals(docs: DataFrame, control: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Docs (slug, sha256, approved) after control rows (identifier, approved, at), and the identifiers that match none.

    64 hex characters name a hash, anything else a slug. The latest control row of a document wins.
    """
    routed = control.withColumn("by_sha", X.looks_like_sha256("identifier"))
    by_sha = routed.where("by_sha").select(F.lower("identifier").alias("sha256"), F.struct("at", "approved").alias("c"))
    by_slug = routed.where("not by_sha").select(F.col("identifier").alias("slug"), F.struct("at", "approved").alias("c"))
    one = by_sha.groupBy("sha256").agg(F.max("c").alias("c1"))
    two = by_slug.groupBy("slug").agg(F.max("c").alias("c2"))
    joined = docs.join(one, "sha256", "left").join(two, "slug", "left")
    newest = F.when(F.col("c2").isNull() | (F.col("c1.at") > F.col("c2.at")), F.col("c1")).otherwise(F.col("c2"))
    changed = joined.withColumn("c", newest).withColumn("was", F.col("approved")).withColumn("approved", F.coalesce("c.approved", "approved"))
    missing = by_sha.join(docs.select("sha256").distinct(), "sha256", "left_anti").select(F.col("sha256").alias("identifier")).union(by_slug.join(docs.select("slug").distinct(), "slug", "left_anti").select(F.col("slug")))
    return changed.select("slug", "sha256", "approved", (F.col("approved") != F.col("was")).alias("changed")), missing.distinct()


def list_pending(docs: DataFrame) -> DataFrame:
    """Unapproved documents, the oldest first."""
    return docs.where(~F.col("approved")).orderBy("ingested_at", "slug")


def drop_orphan_chunks(chunks: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks whose document is still there."""
    return chunks.join(docs.select(key).distinct(), key, "left_semi")


def chunk_stats(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks of each document, and how many (document, index) pairs occur more than once."""
    pairs = chunks.groupBy(key, "chunk_index").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy(key).agg(F.sum("n").alias("n_chunks"), F.count_if(F.col("n") > 1).alias("n_repeated"))


def fresh_only(docs: DataFrame, cutoff: str, date: str = "date") -> DataFrame:
    """Documents dated on or after the cutoff; undated ones go; an empty cutoff keeps all."""
    return docs if not cutoff else docs.where(X.display_date(date) >= F.lit(cutoff).cast("date"))


def recent_updates(docs: DataFrame, listed_on: str, cutoff: str, fetch: int = 50, show: int = 5) -> DataFrame:
    """The newest approved documents of a list: the first `fetch` by arrival, then the cutoff, then `show`."""
    newest = docs.where((F.col("listed_on") == listed_on) & F.col("approved")).orderBy(F.desc("ingested_at"), "slug").limit(fetch)
    return fresh_only(newest, cutoff).orderBy(F.desc("ingested_at"), "slug").limit(show)


def unparseable_dates(docs: DataFrame, date: str = "date") -> DataFrame:
    """One row for each slug with a missing or unreadable date."""
    return docs.where(X.display_date(date).isNull()).groupBy("slug").agg(F.min(date).alias("date"))


CARD = {"slug": "data-slug", "title": "data-title", "date": "data-date", "path": "data-pdf"}


def extract_cards(pages: DataFrame, html: str = "html", listed_on: str = "listed_on", card_class: str = "pdf-preview-card", attributes: dict[str, str] = CARD, excluded: tuple[str, ...] = (), hidden: str = "previews", key: str = "page_id") -> DataFrame:
    """(key, listed_on, position, slug, title, date, path, ...) of the publication cards of index pages.

    A card is an element of the class, whatever other classes it has, that has the attribute named for
    `slug`; `attributes` says which of its attributes hold what, in any order and quoting, entities decoded.
    Absent ones are null. Pages on an excluded list give none, nor do cards without a path or with a hidden
    segment in it. Positions count all cards of a page, from 0. Only the html column goes to Python.
    """
    ship(pages.sparkSession)
    names = list(attributes)
    kind = pa.list_(pa.struct([(n, pa.string()) for n in names]))

    @F.arrow_udf(f"array<struct<{','.join(f'{n}:string' for n in names)}>>")
    def cards_of(html: pa.Array) -> pa.Array:
        found = (markup.marked_elements(x or "", card_class, attributes["slug"]) for x in html.to_pylist())
        return pa.array([[{n: e.get(a) for n, a in attributes.items()} for e in page] for page in found], kind)

    open_ = pages.where(~F.coalesce(F.col(listed_on).isin(list(excluded)), F.lit(False)))
    rows = open_.select(key, F.col(listed_on).alias("listed_on"), F.posexplode(cards_of(html)).alias("position", "c"))
    return rows.select(key, "listed_on", "position", *[F.col(f"c.{n}").alias(n) for n in names]).where(X.is_public_path("path", hidden))


PUSH = "ref string, commits array<struct<added:array<string>, modified:array<string>, removed:array<string>>>"


def relevant_pushes(events: DataFrame, payload: str, watched: list[str], prefix: str, ref: str) -> DataFrame:
    """Push events on the ref that touch a watched path or one below the prefix."""
    parsed = events.withColumn("__p", F.from_json(payload, PUSH)).where(F.col("__p.ref") == ref)
    paths = F.flatten(F.transform("__p.commits", lambda c: F.concat(*[F.coalesce(c[k], F.array().cast("array<string>")) for k in ("added", "modified", "removed")])))
    hit = F.exists(paths, lambda p: p.startswith(prefix) | p.isin(watched))
    return parsed.where(hit).drop("__p")


def citations(hits: DataFrame, min_score: float, excluded_markers: list[str], cap: int = 3, fact_links: DataFrame | None = None) -> DataFrame:
    """Links of each query: hits from `min_score` on, the best of each url, no excluded path, then fact links, `cap` at most.

    hits (query_id, url, score, rank); fact_links (query_id, url, rank).
    """
    good = hits.where(F.col("score") >= min_score)
    for marker in excluded_markers:
        good = good.where(~F.col("url").contains(marker))
    rows = good.select("query_id", "url", F.lit(0).alias("kind"), "rank")
    if fact_links is not None:
        rows = rows.unionByName(fact_links.select("query_id", "url", F.lit(1).alias("kind"), "rank"))
    one = rows.groupBy("query_id", "url").agg(F.min(F.struct("kind", "rank")).alias("o"))
    order = Window.partitionBy("query_id").orderBy("o.kind", "o.rank", "url")
    return one.withColumn("position", F.row_number().over(order)).where(F.col("position") <= cap).select("query_id", "position", "url")


def assemble_context(questions: DataFrame, fact_hits: DataFrame, rag_hits: DataFrame) -> DataFrame:
    """(query_id, context, answer_kind): facts then chunks by rank, parted by blank lines.

    Hits are (query_id, rank, text) of a top-k, so a question's list is short.
    """
    rows = fact_hits.select("query_id", F.lit(0).alias("kind"), "rank", "text").unionByName(rag_hits.select("query_id", F.lit(1).alias("kind"), "rank", "text"))
    lists = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("kind", "rank", "text"))).alias("l"), F.max("kind").alias("top"))
    joined = questions.select("query_id").distinct().join(lists, "query_id", "left")
    kind = F.when(F.col("top") == 1, "rag").when(F.col("top") == 0, "faq").otherwise("refusal")
    return joined.select("query_id", F.coalesce(F.array_join(F.transform("l", lambda x: x["text"]), "\n\n"), F.lit("")).alias("context"), kind.alias("answer_kind"))
