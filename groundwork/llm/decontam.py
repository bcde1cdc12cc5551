"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of consecutive benchmark words. A table of two-word blocks gives how far the
search may jump when a block ends nowhere useful; where the jump is zero, the bucket of that suffix
block lists the windows to compare directly. Windows of one length form one search, so a few short
items do not shorten the jumps of all.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwork.llm.common import checkpointed, set_aside, ship, slices

# Bytes of words: digits, a to z and everything from 0x80 up, A to Z folded; all else parts words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(raw: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text; no byte of a longer character is a separator, so bytes do."""
    return raw.translate(FOLD).split() if raw else []


class Search:
    """Wu-Manber tables for windows of one length."""

    def __init__(self, length: int, windows: dict[tuple[bytes, ...], list[str]]):
        self.length = length
        self.block = min(2, length)
        self.default = length - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = defaultdict(list)
        for window, items in windows.items():
            for end in range(self.block, length + 1):
                key = window[end - self.block : end] if self.block == 2 else window[0]
                self.shift[key] = min(self.shift.get(key, self.default), length - end)
            last = window[-2:] if self.block == 2 else window[0]
            self.bucket[last].append((window, items))
        self.bucket = dict(self.bucket)

    def find(self, words: list[bytes]):
        """Yield (start, items) of each occurrence."""
        n, length, shift, default = len(words), self.length, self.shift, self.default
        at = length - 1
        if self.block == 1:
            for i, w in enumerate(words):
                for _, items in self.bucket.get(w, ()):
                    yield i, items
            return
        while at < n:
            jump = shift.get((words[at - 1], words[at]), default)
            if jump:
                at += jump
                continue
            start = at - length + 1
            here = tuple(words[start : at + 1])
            for window, items in self.bucket[here[-2:]]:
                if window == here:
                    yield start, items
            at += 1


class Patterns:
    """All searches for a list of (item id, text)."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        by_length: dict[int, dict] = defaultdict(lambda: defaultdict(list))
        for item, raw in items:
            words = words_of(raw)
            if not words:
                continue
            size = min(width, len(words))
            for i in range(len(words) - size + 1):
                owners = by_length[size][tuple(words[i : i + size])]
                if item not in owners:
                    owners.append(item)
        self.searches = [Search(n, w) for n, w in sorted(by_length.items())]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Joined spans [start, end) of hit words, and the items that occur."""
        spans, found = [], set()
        for search in self.searches:
            for start, items in search.find(words):
                spans.append((start, start + search.length))
                found.update(items)
        return join_spans(spans), found


def join_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


ADDED = ("n_words", "n_hit", "spans", "items", "contaminated")
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # of texts that are not folded yet


def pattern_blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> tuple[DataFrame, int]:
    """(item, raw, block) of the items that have a text, each pair once, dealt by hash into blocks of about `block_bytes`; how many blocks."""
    chosen = benchmark.where(F.col(text).isNotNull()).select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.encode(F.col(text), "utf-8").alias("raw"))
    once = chosen.groupBy("item", F.md5("raw").alias("digest")).agg(F.min("raw").alias("raw"))
    total = chosen.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    if blocks > 1:
        once = checkpointed(once)
    return once.select("item", "raw", F.pmod(F.xxhash64("item", "digest"), F.lit(blocks)).alias("block")), blocks


def block_patterns(dealt: DataFrame, block: int, width: int) -> Patterns:
    """The searches of one block; no more than its bounded bytes come to the driver."""
    return Patterns(sorted((r[0], bytes(r[1])) for r in dealt.where(F.col("block") == block).select("item", "raw").collect()), width)


def block_hits(rows: DataFrame, text: str, patterns: Patterns) -> DataFrame:
    """(row, spans, items) of the rows with a hit, written before the block's tables are released."""
    tables = rows.sparkSession.sparkContext.broadcast(patterns)

    def scan(batches):
        for batch in slices(batches, 512):
            found = [tables.value.scan(words_of(raw)) for raw in batch.column(text).cast(pa.binary()).to_pylist()]
            at = [i for i, (spans, _) in enumerate(found) if spans]
            spans = pa.array([[{"start": a, "end": b} for a, b in found[i][0]] for i in at], ARROW_SPANS)
            yield pa.RecordBatch.from_arrays([batch.column("__row").take(pa.array(at, pa.int64())), spans, pa.array([sorted(found[i][1]) for i in at], pa.list_(pa.string()))], ["row", "spans", "items"])

    hits = checkpointed(rows.select("__row", text).mapInArrow(scan, T.StructType().add("row", "long").add("spans", SPANS).add("items", T.ArrayType(T.StringType()))))
    tables.destroy()
    return hits


def joined_spans(spans: Column) -> Column:
    """Spans of several blocks as sorted ones that don't overlap."""
    start = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(done, s):
        last = F.try_element_at(done, F.lit(-1))
        touch = F.coalesce(s["start"] <= last["end"], F.lit(False))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(touch, F.array_append(F.slice(done, F.lit(1), F.size(done) - 1), longer)).otherwise(F.array_append(done, s))

    return F.aggregate(F.array_sort(spans), start, add)


def mark_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """Add n_words, n_hit, spans (joined hit word ranges), items (sorted ids) and contaminated to every row.

    A window is `width` consecutive words of an item; an item of fewer words, but not none, is one
    window. Null and wordless texts have no words and no hits; null and wordless items occur nowhere;
    a null item id counts as ''. Repeated items and rows count each for itself. Columns of those five
    names, in any case, are replaced, others pass through; an empty benchmark marks nothing, an empty
    table gives an empty result. A very long text takes memory in proportion to itself.

    Items are dealt into blocks of about `block_bytes` of text, and only one block's tables exist at a time.
    One block needs one pass and no shuffle. Of several blocks each is one pass that keeps the hits alone,
    by the number of a row in a copy of `docs` that is written once; in the end they are joined to it.
    """
    ship(docs.sparkSession)
    base = docs.drop(*ADDED)
    plain = base.schema
    dealt, blocks = pattern_blocks(benchmark, item, item_text, block_bytes)
    if blocks == 1:
        schema = T.StructType(list(plain.fields)).add("n_words", "long").add("spans", SPANS).add("items", T.ArrayType(T.StringType()))
        tables = docs.sparkSession.sparkContext.broadcast(block_patterns(dealt, 0, width))

        def scan(batches):
            patterns = tables.value
            for batch in slices(batches, 512):
                counts, spans, items = [], [], []
                for raw in batch.column(text).cast(pa.binary()).to_pylist():
                    words = words_of(raw)
                    hits, found = patterns.scan(words)
                    counts.append(len(words))
                    spans.append([{"start": a, "end": b} for a, b in hits])
                    items.append(sorted(found))
                kept = batch.select(plain.names)
                yield kept.append_column("n_words", pa.array(counts, pa.int64())).append_column("spans", pa.array(spans, ARROW_SPANS)).append_column("items", pa.array(items, pa.list_(pa.string())))

        marked = base.mapInArrow(scan, schema)
    else:
        rows = checkpointed(base.withColumn("__row", F.monotonically_increasing_id()))
        hits = None
        for k in range(blocks):
            part = block_hits(rows, text, block_patterns(dealt, k, width))
            hits = part if hits is None else hits.union(part)
        by_row = hits.groupBy(F.col("row").alias("__row")).agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        none = F.array().cast("array<struct<start:bigint,end:bigint>>"), F.array().cast("array<string>")
        words = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
        marked = rows.join(by_row, "__row", "left").select(*plain.names, words.alias("n_words"), F.coalesce(joined_spans(F.col("spans")), none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return marked.withColumn("n_hit", hit).withColumn("contaminated", F.size("spans") > 0)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows of `docs` without a hit, with their own columns and values only, whatever their names."""
    names = set_aside(docs, ADDED)
    marked = mark_contamination(docs.withColumnsRenamed(names), benchmark, **options)
    return marked.where(~F.col("contaminated")).select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])
