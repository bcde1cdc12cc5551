"""Audit of how far the sources of a language diverge in their term frequencies, on run-length columns.

Every source is a column of counts over the language's terms. The vocabulary is ordered so that terms
with equal counts stand together; each column is then run-length encoded, the run boundaries of two
columns are intersected, and a difference is taken once for each common run and multiplied by its length.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.llm.common import ship, slices, written

# Bytes of terms: a to z and everything from 0x80 up, A to Z folded; all else parts terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SCALE = 1_000_000_000
PRIOR = 5
HELD = 1_000_000  # entries that a task holds before it passes them on
BLOCK = 65_536  # terms whose columns are encoded together
SAFE = 2**63 // SCALE - PRIOR - 1  # counts up to here stay within 64 bits when scaled


def terms_of(raw: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text; no byte of a longer character is a separator, so bytes do."""
    return raw.translate(FOLD).split() if raw else []


def count_terms(batches):
    """(lang, source, term, n, documents): sums over a part of the rows; a row without a term for each group that occurs."""

    def rows(held):
        for (lang, source), (counts, documents) in held.items():
            names = list(counts)
            for i in range(0, len(names), 50_000):
                some = names[i : i + 50_000]
                columns = [pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string()), pa.array([counts[t] for t in some], pa.int64()), pa.array([documents[t] for t in some], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "documents"])
        groups = list(held)
        none = [pa.nulls(len(groups), pa.string()), pa.array([0] * len(groups), pa.int64()), pa.array([0] * len(groups), pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in groups], pa.string()), pa.array([g[1] for g in groups], pa.string()), *none], ["lang", "source", "term", "n", "documents"])

    held: dict = {}
    for batch in slices(batches, 1024):
        for lang, source, raw in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            counts, documents = held.setdefault((lang, source), (Counter(), Counter()))
            terms = terms_of(raw)
            counts.update(terms)
            documents.update(set(terms))
        if len(held) + sum(len(c) for c, _ in held.values()) > HELD:
            yield from rows(held)
            held = {}
    yield from rows(held)


def scaled(count: Column | str, total: Column, vocabulary: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * vocabulary)), exactly."""
    n = F.col(count) if isinstance(count, str) else count
    above = (n + PRIOR).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", above, total + PRIOR * vocabulary) + 1


def scaled_runs(values: np.ndarray, total: int, vocabulary: int) -> np.ndarray:
    """The same for the values of runs; counts beyond 64-bit products are computed with whole numbers of any size."""
    below = total + PRIOR * vocabulary
    if values.size and int(values.max()) > SAFE:
        return np.array([1 + SCALE * (int(v) + PRIOR) // below for v in values], np.int64)
    return 1 + SCALE * (values.astype(np.int64) + PRIOR) // below


def run_lengths(rows: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(end of each run, its value) of a column with `counts` at `rows` and zeros elsewhere."""
    column = np.zeros(size, np.int64)
    column[rows] = counts
    ends = np.append(np.flatnonzero(np.diff(column)) + 1, size)
    return ends, column[ends - 1]


def run_difference(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Sum of |a - b| over a block: once for each run that both columns have in common, times its length."""
    ends = np.union1d(a[0], b[0])
    apart = np.abs(a[1][np.searchsorted(a[0], ends)] - b[1][np.searchsorted(b[0], ends)])
    return int((apart * np.diff(ends, prepend=0)).sum())


def block_differences(vectors: list, totals: np.ndarray, vocabulary: int):
    """(a, b, value) for all pairs of a language's columns over the terms of one block, a < b."""
    lengths = np.concatenate([np.diff(v.offsets.to_numpy()) for v in vectors])
    flat = [v.flatten() for v in vectors]
    place = np.concatenate([f.field("place").to_numpy() for f in flat])
    n = np.concatenate([f.field("n").to_numpy() for f in flat])
    row = np.repeat(np.arange(len(lengths)), lengths)
    order = np.argsort(place, kind="stable")
    cuts = np.searchsorted(place[order], np.arange(1, len(totals) + 2))
    columns = []
    for k, total in enumerate(totals):
        at = order[cuts[k] : cuts[k + 1]]
        ends, values = run_lengths(row[at], n[at], len(lengths))
        columns.append((ends, scaled_runs(values, int(total), vocabulary)))
    for a in range(len(columns)):
        for b in range(a + 1, len(columns)):
            yield a + 1, b + 1, run_difference(columns[a], columns[b])


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_documents: int = 30, most_terms: int = 50, most_groups: int = 4_000_000) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source stands from others of its language.

    Terms are runs of letters and of all characters outside ASCII, A-Z lower-cased. A language keeps the
    terms that `least_documents` of its documents have. p is 1 + floor(1e9 * (count + 5) / (N + 5 * V)),
    with N the group's count over kept terms and V their number. Part `pair` has, for every other source
    of the language, the sum of |p - q| over all kept terms, also those that neither has. Part `term` has
    the `most_terms` kept terms that occur in the group and whose p is farthest above the language's.
    Ranks start from 1, ties go by item in UTF-8 order. Sums are exact.

    Null text, language and source count as ''. Groups without a term take part with zeros; a language
    without kept terms has pairs of value 0 and no terms; a single source has no pair. Repeated rows count
    each for itself. An empty table gives an empty result. Columns other than the three don't matter,
    whatever their names. A very long text takes memory in proportion to itself.

    Counting is combined in tasks before the one shuffle by term, so no source or term is gathered. Ordered
    terms lie in range partitions, and each task sends one sum for each pair and block of terms. Workers get
    one number for each group, eight bytes, and no more than `most_groups` of them: a table with more is refused.
    """
    spark = docs.sparkSession
    ship(spark)
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    counted = plain.mapInArrow(count_terms, "lang string, source string, term string, n long, documents long").repartition("lang", "term")
    each = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    terms = each.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.collect_list(F.struct("source", "n")).alias("entries"))
    kept = written(terms.where(F.col("term").isNull() | (F.col("documents") >= least_documents)).drop("documents"), "divergence-terms")

    real = kept.where("term is not null")
    entries = real.select("lang", "term", F.aggregate("entries", F.lit(0).cast("long"), lambda s, e: s + e["n"]).alias("lang_n"), F.explode("entries").alias("e")).select("lang", "term", "lang_n", "e.source", "e.n")
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = real.groupBy("lang").agg(F.count(F.lit(1)).alias("vocabulary"), F.sum(F.aggregate("entries", F.lit(0).cast("long"), lambda s, e: s + e["n"])).alias("lang_total"))
    occurring = kept.where("term is null").select("lang", F.explode("entries.source").alias("source"))
    groups = occurring.join(totals, ["lang", "source"], "left").join(whole, "lang", "left").fillna(0, ["total", "vocabulary", "lang_total"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("total"), "source"))
    groups = written(groups.withColumn("place", place), "divergence-groups")

    placed = entries.join(groups, ["lang", "source"])
    above = scaled("n", F.col("total"), F.col("vocabulary")) - scaled("lang_n", F.col("lang_total"), F.col("vocabulary"))
    best = placed.select("lang", "source", F.col("term").alias("item"), above.alias("value")).where("value > 0")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    term_part = best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= most_terms)

    if (n_groups := groups.count()) > most_groups:
        raise ValueError(f"{n_groups} groups of language and source, more than most_groups={most_groups}")
    by_lang: dict = {}
    for r in groups.where("vocabulary > 0").select("lang", "place", "total", "vocabulary").toArrow().to_pylist():
        by_lang.setdefault(r["lang"], (r["vocabulary"], {}))[1][r["place"]] = r["total"]
    model = spark.sparkContext.broadcast({k: (v, np.array([t[p] for p in range(1, len(t) + 1)], np.int64)) for k, (v, t) in by_lang.items()})

    def differences(batches):
        def rows(name, vectors):
            vocabulary, group_totals = model.value[name]
            found = block_differences(vectors, group_totals, vocabulary)
            while some := [x for x, _ in zip(found, range(50_000), strict=False)]:
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), *[pa.array([x[i] for x in some], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64()))]], ["lang", "a", "b", "value"])

        name, vectors, held = None, [], 0
        for batch in slices(batches, 8192):
            names = batch.column("lang").to_pylist()
            starts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            for i, j in zip(starts[:-1], starts[1:], strict=True):
                if held and (names[i] != name or held >= BLOCK):
                    yield from rows(name, vectors)
                    vectors, held = [], 0
                name = names[i]
                vectors.append(batch.column("vector").slice(i, j - i))
                held += j - i
        if held:
            yield from rows(name, vectors)

    vectors = placed.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("place", "n"))).alias("vector")).select("lang", "vector")
    # The range is cut on the first entries alone, as a sample of its keys goes to the driver.
    ordered = vectors.repartitionByRange("lang", F.slice("vector", 1, 3)).sortWithinPartitions("lang", "vector")
    sums = ordered.mapInArrow(differences, "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    one = groups.select("lang", "source", F.col("place").alias("p"))
    pairs = one.join(one.select("lang", F.col("source").alias("item"), F.col("p").alias("o")), "lang").where("p <> o")
    pairs = pairs.select("lang", "source", "item", F.least("p", "o").alias("a"), F.greatest("p", "o").alias("b")).join(sums, ["lang", "a", "b"], "left")
    pair_part = pairs.select("lang", "source", "item", F.coalesce("value", F.lit(0)).cast("long").alias("value")).withColumn("rank", F.row_number().over(ranked))
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pair_part.withColumn("part", F.lit("pair")).select(*columns).unionAll(term_part.withColumn("part", F.lit("term")).select(*columns))
