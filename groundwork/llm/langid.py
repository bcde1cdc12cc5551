"""Language identification, words first, with backoff to shorter and shorter character n-grams.

A known word adds its log frequency in each language. An unseen word is scored by the longest of its
character n-grams (word edges included) of which any is known: the mean of their log frequencies.

Words and n-grams are told apart by 64-bit hashes, kept as sorted arrays beside their log frequencies, so
a model takes some dozens of bytes for each and needs no cap on how many it knows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwork.llm.common import checkpointed, set_aside, ship, slices

WORD = re.compile(r"[^\W\d_]+")
SIZES = (4, 3, 2, 1)
CACHE_WORDS, CACHE_CHARS = 100_000, 2_000_000
ADDED = ("lang_pred", "score", "n_letter_words")
U = np.uint64


def words_of(text: str) -> list[str]:
    """Runs of letters of the lower-case text; none if there is no letter at all."""
    words = WORD.findall(text.lower())
    return words if any(any(map(str.isalpha, w)) for w in words) else []


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), U, len(words))


def gram_hashes(words: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all words, edges included, and the number of the word that each is from."""
    joined = " " + "  ".join(words) + " " if words else ""
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    n = len(code) - size + 1
    if n <= 0:
        return np.empty(0, U), np.empty(0, np.int64)
    total = np.full(n, size, U)
    for j in range(size):
        total = (total ^ code[j : j + n]) * U(0x9E3779B97F4A7C15)
        total ^= total >> U(29)
    inside = owner[:n] == owner[size - 1 :]
    return total[inside], owner[:n][inside]


@dataclass
class Table:
    """Sorted hashes and the log frequencies by language of each."""

    hashes: np.ndarray
    logs: np.ndarray

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash, or -1."""
        at = np.searchsorted(self.hashes, hashes)
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        return np.where(self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashes, at, -1)


@dataclass
class Model:
    """Languages in order, the words and the n-grams by length."""

    langs: list[str]
    words: Table
    grams: dict[int, Table]
    kept: dict[str, int] = field(default_factory=dict)
    rows: np.ndarray | None = None
    chars: int = 0

    def __getstate__(self):
        return {**self.__dict__, "kept": {}, "rows": None, "chars": 0}

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Scores by language of each word."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        at = self.words.find(word_hashes(words))
        out[at >= 0] = self.words.logs[at[at >= 0]]
        unseen = np.flatnonzero(at < 0)
        for size in sorted(self.grams, reverse=True):
            if not len(unseen):
                break
            table = self.grams[size]
            hashes, owner = gram_hashes([words[i] for i in unseen], size)
            at = table.find(hashes)
            at, owner = at[at >= 0], owner[at >= 0]
            if len(at):
                first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                counts = np.diff(np.append(first, len(owner)))
                out[unseen[owner[first]]] = np.add.reduceat(table.logs[at].astype(np.float64), first, axis=0) / counts[:, None]
                unseen = np.delete(unseen, owner[first])
        return out

    def learn(self, words: set[str]) -> None:
        """Keep the scores of these words at hand; what is kept is bounded in words and characters."""
        new = [w for w in words if w not in self.kept]
        size = sum(map(len, new))
        if self.rows is None or len(self.kept) + len(new) > len(self.rows) or self.chars + size > CACHE_CHARS:
            # The words at hand must all fit, also those of one very long text.
            new = list(words)
            self.kept, self.chars, size = {}, 0, sum(map(len, new))
            if self.rows is None or len(self.rows) > CACHE_WORDS >= len(new) or len(new) > len(self.rows):
                self.rows = np.zeros((max(CACHE_WORDS, len(new)), len(self.langs)), np.float32)
        for i in range(0, len(new), 8192):
            part = new[i : i + 8192]
            at = len(self.kept)
            self.rows[at : at + len(part)] = self.word_scores(part)
            self.kept.update(zip(part, range(at, at + len(part))))
        self.chars += size

    def predict(self, texts: list[str]) -> list[tuple[str, float, int]]:
        """(language or und, score, words) of each text.

        The score is the language's share after dividing the logs by the root of the word count.
        """
        found = [words_of(t) for t in texts]
        if not self.langs:
            return [("und", 0.0, len(words)) for words in found]
        self.learn(set().union(*found))
        out = []
        for words in found:
            if not words:
                out.append(("und", 0.0, 0))
                continue
            total = np.zeros(len(self.langs))
            for i in range(0, len(words), 4096):
                at = np.fromiter(map(self.kept.__getitem__, words[i : i + 4096]), np.int64)
                total += self.rows[at].sum(axis=0, dtype=np.float64)
            total /= np.sqrt(len(words))
            share = np.exp(total - total.max())
            best = int(share.argmax())
            out.append((self.langs[best], float(share[best] / share.sum()), len(words)))
        return out


def learning_sample(docs: DataFrame, text: str, lang: str, key: str, most_each: int, longest: int) -> DataFrame:
    """(t, l): about `most_each` texts of each language, chosen by the hash of key and text; all where there are no more."""
    usable = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.octet_length(text) <= longest)).select(F.col(text).alias("t"), F.col(lang).alias("l"), F.col(key).alias("k"))
    counts = usable.groupBy("l").count().collect()  # one row for each language, which the model lists as well
    shares = F.create_map(*[F.lit(v) for r in counts for v in (r[0], most_each / r[1])]) if counts else F.create_map().cast("map<string,double>")
    bucket = F.xxhash64("k", F.md5("t"), F.lit(17)).bitwiseAND(F.lit(2**32 - 1)) / float(2**32)
    return usable.where(bucket < F.try_element_at(shares, F.col("l"))).select("t", "l")


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", most_each: int = 3000, longest: int = 1 << 20, least_count: int = 2) -> Model:
    """Learn from rows with a text and a language.

    About `most_each` texts of each language, of at most `longest` bytes, chosen by the hash of their key and
    text, are the bound on what is counted; rare languages keep all of theirs. A word is known if it occurs
    `least_count` times in them, an n-gram if it occurs; no other limit is put on either. Counts are summed by
    task first. No usable row gives a model that knows no language and answers `und`.
    """
    ship(docs.sparkSession)
    sample = checkpointed(learning_sample(docs, text, lang, key, most_each, longest))
    langs = sorted(r[0] for r in sample.select("l").distinct().collect())
    place = {x: i for i, x in enumerate(langs)}
    if not langs:
        none = Table(np.empty(0, U), np.empty((0, 0), np.float32))
        return Model([], none, {})

    def count(batches):
        seen = [Counter() for _ in langs]
        for batch in slices(batches, 256):
            for t, x in zip(batch.column("t").to_pylist(), batch.column("l").to_pylist(), strict=True):
                seen[place[x]].update(words_of(t))
        for i, by in enumerate(seen):
            words = list(by)
            times = np.fromiter(by.values(), np.int64, len(by))
            for size in (0, *SIZES):
                for start in range(0, len(words), 50_000):
                    part = words[start : start + 50_000]
                    h, owner = (word_hashes(part), np.arange(len(part))) if size == 0 else gram_hashes(part, size)
                    hashes, at = np.unique(h, return_inverse=True)
                    c = np.bincount(at, weights=times[start : start + 50_000][owner]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), size, np.int32)), pa.array(hashes.view(np.int64)), pa.array(np.full(len(c), i, np.int32)), pa.array(c)], ["n", "h", "i", "c"])

    counted = sample.mapInArrow(count, "n int, h long, i int, c long")
    sums = [F.sum(F.when(F.col("i") == i, F.col("c")).otherwise(0)).alias(f"c{i}") for i in range(len(langs))]
    every = checkpointed(counted.groupBy("n", "h").agg(*sums))
    totals = {r[0]: np.array(r[1:], float) for r in every.groupBy("n").agg(*[F.sum(f"c{i}") for i in range(len(langs))]).collect()}

    def table(n: int, least: int) -> Table:
        rows = every.where((F.col("n") == n) & (sum(F.col(f"c{i}") for i in range(len(langs))) >= least)).toArrow()
        hashes = rows.column("h").to_numpy().view(U)
        counts = np.stack([rows.column(f"c{i}").to_numpy() for i in range(len(langs))], axis=1)
        order = np.argsort(hashes)
        size = len(hashes) + 1
        logs = np.log((counts + 0.5) / (totals.get(n, np.zeros(len(langs))) + 0.5 * size)).astype(np.float32)
        return Table(hashes[order], logs[order])

    return Model(langs, table(0, least_count), {n: table(n, 1) for n in SIZES})


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred (a learned language, or `und` for null and for texts without a letter), score and n_letter_words.

    Whole texts count; a very long one takes memory in proportion to itself. Ties go to the language that
    sorts first; `und` has score 0. Equal texts get equal results, repeated rows stay, an empty table gives
    an empty result. Columns of those names, in any case, are replaced, others pass through.
    """
    ship(docs.sparkSession)
    base = docs.drop(*ADDED)
    schema = T.StructType(list(base.schema.fields)).add("lang_pred", "string").add("score", "double").add("n_letter_words", "long")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        own = shared.value
        for batch in slices(batches, 256):
            found = own.predict([t or "" for t in batch.column(text).to_pylist()])
            for name, i, kind in (("lang_pred", 0, pa.string()), ("score", 1, pa.float64()), ("n_letter_words", 2, pa.int64())):
                batch = batch.append_column(name, pa.array([x[i] for x in found], kind))
            yield batch

    return base.mapInArrow(work, schema)


def keep_identified(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """Rows of `docs` whose language is told with a score of at least `least`, with their own columns and values only, whatever their names."""
    names = set_aside(docs, ADDED)
    found = identify(docs.withColumnsRenamed(names), model, text)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return kept.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])
