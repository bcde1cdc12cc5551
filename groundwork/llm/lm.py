"""Language-model scoring with a hierarchical Pitman-Yor model.

The model is a bigram over word classes with words below them. The commonest words are classes of
their own, and the more of them the longer the training text; every other word belongs to a class by its ending. For each class as context there is a
restaurant whose customers are the classes seen after it; all context restaurants share one parent,
whose customers are their tables. Below, each class of rare words is a restaurant of its words, with
one dish kept for any unseen word. On top, each word has restaurants of the words after it, whose base
is this class model; they hold every pair that the class table does not tell apart by itself.

Seating is sampled by Gibbs sweeps in blocks: given the parent's current predictive, the tables of
every restaurant are drawn anew by the Chinese-restaurant process; their sum seats the parent anew.
Predictive probabilities of the sweeps after burn-in are averaged. Counts of all training tokens are
gathered; the class table grows with the square of the logarithm of the text, and counts of words and of pairs stay distributed.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwork.llm.common import checkpointed, ship, written
from groundwork.llm.neardup import mix

FORMS = 512
OWN_PER_DOUBLING = 60
FREQUENT = 1 << 17
END = 1  # the hash that stands for the end of a text
SWEEPS, BURN_IN = 4, 2
FLUSH = 300_000
SEEN_WORDS = 1_000_000
PIECE_TEXTS, PIECE_BYTES = 4096, 1 << 23  # texts are split so many at once


@dataclass
class Tokens:
    """Words of some texts, A-Z folded, split at spaces and at 0x09 to 0x0D; each text ends with one end, numbered len(words)."""

    words: list[bytes]  # each once
    at: np.ndarray  # which word, or the end
    lengths: np.ndarray  # tokens of each text

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.lengths) - self.lengths

    def before(self) -> np.ndarray:
        """The token before each one; before the first of a text comes an end."""
        return np.concatenate(([len(self.words)], self.at[:-1])) if len(self.at) else self.at

    def counts(self) -> np.ndarray:
        return np.bincount(self.at, minlength=len(self.words) + 1)


def tokens_of(texts: pa.Array) -> Tokens:
    """Null counts as empty."""
    raw = pc.fill_null(texts.cast(pa.binary()), b"").view(pa.string())
    split = pc.ascii_split_whitespace(pc.ascii_lower(raw))
    flat = split.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
    ends = kept[np.cumsum(pc.list_value_length(split).to_numpy())]
    lengths = np.diff(ends, prepend=0) + 1
    coded = flat.filter(full).dictionary_encode()
    words = coded.dictionary.view(pa.binary()).to_pylist()
    at = np.full(int(lengths.sum()), len(words), np.int64)
    inner = np.ones(len(at), bool)
    inner[np.cumsum(lengths) - 1] = False
    at[inner] = coded.indices.to_numpy()
    return Tokens(words, at, lengths)


def pieces(batches, text: str):
    """Cut Arrow batches into pieces of at most PIECE_TEXTS rows and about PIECE_BYTES of text."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            seen = size[start - 1] if start else 0
            end = min(start + PIECE_TEXTS, max(start + 1, int(np.searchsorted(size, seen + PIECE_BYTES))))
            yield batch.slice(start, end - start)
            start = end


def word_hash(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >= 1 << 63 else h


def form_of(word: bytes) -> int:
    """Class of a rare word by its last letters, marks at its end left aside."""
    return xxhash.xxh32_intdigest((word.rstrip(b".,;:!?\"')|*#$%&") or word)[-3:]) % FORMS


def own_classes(tokens: int) -> int:
    """How many of the commonest words are classes of their own: more by OWN_PER_DOUBLING whenever the training text doubles.

    The table of classes grows with the square of that, from 11 MB at a million tokens to 40 MB at 2**44.
    """
    return OWN_PER_DOUBLING * max(1, int(tokens).bit_length() - 1)


def uniform(keys: np.ndarray, serial: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the key and the serial only, so a task run again draws alike."""
    salt = mix(np.array([serial + 1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return ((mix(keys.astype(np.int64).view(np.uint64) ^ salt) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def seat(counts: np.ndarray, base: np.ndarray, discount: float, strength: float, tables_before: np.ndarray | float, keys: np.ndarray, serial: int) -> np.ndarray:
    """Tables of each dish after its customers have sat down one after another.

    counts: customers by dish; base: the parent's probability of the dish; tables_before: tables of the
    whole restaurant (of each dish's restaurant) from the sweep before. A customer opens a table with
    odds (strength + discount * tables) * base to customers - discount * own tables. The first
    customers are seated one by one, later ones in blocks of a tenth of those seated.
    """
    tables = np.minimum(counts, 1).astype(np.float64)
    seated = tables.copy()
    fresh = (strength + discount * tables_before) * base
    active = np.flatnonzero(counts > seated)
    step = 0
    while len(active):
        step += 1
        s, t = seated[active], tables[active]
        f = fresh[active] if isinstance(fresh, np.ndarray) else np.full(len(active), fresh)
        p = f / (f + s - discount * t)
        block = np.minimum(counts[active] - s, np.maximum(1, np.floor(s / 10)))
        u = uniform(keys[active], serial * 1_000_003 + step)
        mean, spread = block * p, np.sqrt(block * p * (1 - p))
        # One customer: a coin; a block: its mean with a normal spread, whole tables by a coin.
        normal = (u - 0.5) * 3.4641016 * spread + mean
        drawn = np.where(block == 1, u < p, np.clip(np.floor(normal + uniform(keys[active], serial * 1_000_003 + step + 500_000)), 0, block))
        tables[active] = t + drawn
        seated[active] = s + block
        active = active[counts[active] > seated[active]]
    return tables


def discount_of(ones: float, twos: float) -> float:
    """The usual estimate from the numbers of dishes with one and with two customers."""
    return float(np.clip(ones / (ones + 2 * twos), 0.1, 0.95)) if ones + twos else 0.5


@dataclass
class Vocabulary:
    """Frequent words by hash, the end first: class, count and what scoring adds for each."""

    hashes: np.ndarray
    classes: np.ndarray
    counts: np.ndarray
    log_word: np.ndarray  # log10 P(word | class)
    own: int  # the first so many are classes of their own; then come the classes by ending

    @property
    def width(self) -> int:
        return self.own + FORMS

    def lookup(self) -> dict[int, int]:
        return {int(h): i for i, h in enumerate(self.hashes.tolist())}


class Reader:
    """Looks up words: number among the frequent ones (unknown words are -1), hash and class. One for each task."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.by_hash = vocabulary.lookup()
        self.seen: dict[bytes, tuple[int, int, int]] = {}

    def look(self, word: bytes) -> tuple[int, int, int]:
        h = word_hash(word)
        n = self.by_hash.get(h, -1)
        out = self.seen[word] = n, h, int(self.vocabulary.classes[n]) if n >= 0 else self.vocabulary.own + form_of(word)
        return out

    def numbers(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, hashes and classes of the words and, last, of the end."""
        if len(self.seen) > SEEN_WORDS:
            self.seen = {}
        found = [x or self.look(w) for w, x in zip(words, map(self.seen.get, words), strict=True)]
        found.append((0, END, int(self.vocabulary.classes[0])))
        table = np.array(found, dtype=np.int64)
        return table[:, 0], table[:, 1], table[:, 2]


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """(h, form, c) of all tokens, ends included, summed by task first."""

    def work(batches):
        seen: Counter = Counter()
        ends = 0

        def out(counter: Counter, ends: int):
            words = list(counter)
            h = [END, *map(word_hash, words)]
            return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array([0, *map(form_of, words)], pa.int32()), pa.array([ends, *counter.values()], pa.int64())], ["h", "form", "c"])

        for piece in pieces(batches, text):
            tokens = tokens_of(piece.column(text))
            for w, c in zip(tokens.words, tokens.counts().tolist(), strict=False):
                seen[w] += c
            ends += len(tokens.lengths)
            if len(seen) > FLUSH:
                yield out(seen, ends)
                seen, ends = Counter(), 0
        yield out(seen, ends)

    counted = docs.select(text).mapInArrow(work, "h long, form int, c long").where("c > 0")
    return written(counted.groupBy("h").agg(F.min("form").alias("form"), F.sum("c").alias("c")), "word-counts")


def count_class_pairs(docs: DataFrame, text: str, vocabulary: Vocabulary) -> DataFrame:
    """(context, classes, counts): one row for each context class, of at most as many entries as there are classes."""
    width = vocabulary.width
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches):
        reader = Reader(shared.value)
        cells = np.zeros(width * width, np.int64)
        for piece in pieces(batches, text):
            tokens = tokens_of(piece.column(text))
            _, _, classes = reader.numbers(tokens.words)
            at, n = np.unique(classes[tokens.before()] * width + classes[tokens.at], return_counts=True)
            cells[at] += n
        full = np.flatnonzero(cells)
        for i in range(0, len(full), 100_000):
            part = full[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(cells[part])], ["cell", "n"])

    cells = docs.select(text).mapInArrow(work, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    by_context = cells.groupBy(F.expr(f"cell div {width}").cast("int").alias("context")).agg(F.array_sort(F.collect_list(F.struct((F.col("cell") % width).alias("k"), "n"))).alias("e"))
    return checkpointed(by_context.select("context", F.col("e.k").alias("k"), F.col("e.n").alias("n")))


@dataclass
class Contexts:
    """Settings of the context restaurants and of their parent.

    sweeps, of each kept one: its serial, the parent's predictive before and after it, and the tables by
    context before it.
    """

    width: int
    discount: float
    strength: float
    sweeps: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]

    def tables(self, context: int, k: np.ndarray, n: np.ndarray, parent: np.ndarray, before: np.ndarray, serial: int) -> np.ndarray:
        keys = context * self.width + k
        return seat(n, parent[k], self.discount, self.strength, float(before[context]), keys, serial)


def seat_contexts(rows: DataFrame, width: int) -> Contexts:
    """Gibbs sweeps over the contexts; 2 x width numbers come back from each: tables by dish and by context."""
    spark = rows.sparkSession
    one = F.size(F.filter("n", lambda x: x == 1))
    two = F.size(F.filter("n", lambda x: x == 2))
    ends = rows.agg(F.sum(one), F.sum(two)).first()
    own = Contexts(width, discount_of(ends[0] or 0, ends[1] or 0), 1.0, [])
    parent = np.full(width, 1 / width)
    # Before the first sweep each dish has one table.
    held, top = np.zeros(width), None
    for c, n in rows.select("context", F.size("n")).collect():  # width rows at most
        held[c] = n
    for sweep in range(SWEEPS):
        shared = spark.sparkContext.broadcast((own, parent, held))

        def seats(batches, shared=shared, sweep=sweep):
            model, p, before = shared.value
            total = np.zeros(2 * width)
            for batch in batches:
                for c, k, n in zip(batch.column("context").to_pylist(), batch.column("k").to_pylist(), batch.column("n").to_pylist(), strict=True):
                    at = np.array(k)
                    drawn = model.tables(c, at, np.array(n), p, before, sweep)
                    total[at] += drawn
                    total[width + c] += drawn.sum()
            full = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], ["k", "t"])

        both = np.zeros(2 * width)
        for k, t in rows.mapInArrow(seats, "k long, t double").groupBy("k").agg(F.sum("t")).collect():  # 2 x width rows at most
            both[k] = t
        tables, after_by_context = both[:width], both[width:]
        d = discount_of((tables == 1).sum(), (tables == 2).sum())
        above = seat(tables, np.full(width, 1 / width), d, 1.0, float((tables > 0).sum() if top is None else top), np.arange(width), 100 + sweep)
        top = above.sum()
        after = (tables - d * above + (1.0 + d * above.sum()) / width) / (1.0 + tables.sum())
        if sweep >= BURN_IN:
            own.sweeps.append((sweep, parent, after, held))
        parent, held = after, after_by_context
    return own


def sample_contexts(rows: DataFrame, width: int) -> np.ndarray:
    """log10 of the averaged predictive, width x width as float32."""
    own = seat_contexts(rows, width)
    shared = rows.sparkSession.sparkContext.broadcast(own)

    def predictive(batches):
        model = shared.value
        for batch in batches:
            out = []
            for c, k, n in zip(batch.column("context").to_pylist(), batch.column("k").to_pylist(), batch.column("n").to_pylist(), strict=True):
                at, n = np.array(k), np.array(n, float)
                mean = np.zeros(model.width)
                for sweep, before, after, held in model.sweeps:
                    t = model.tables(c, at, n, before, held, sweep)
                    p = (model.strength + model.discount * t.sum()) * after
                    p[at] += n - model.discount * t
                    mean += p / (model.strength + n.sum()) / len(model.sweeps)
                out.append(np.log10(mean).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column("context"), pa.array(out, pa.list_(pa.float32()))], ["context", "p"])

    table = np.tile(np.log10(np.mean([a for _, _, a, _ in own.sweeps], axis=0)).astype(np.float32), (width, 1))
    for c, p in rows.mapInArrow(predictive, "context int, p array<float>").toLocalIterator():
        table[c] = p
    return table


@dataclass
class Endings:
    """The restaurants of rare words: customers, distinct words and mean tables by class."""

    discount: float
    strength: float
    customers: np.ndarray
    words: np.ndarray
    sweeps: list[tuple[int, np.ndarray]]  # serial and tables by class before the sweep
    tables: np.ndarray  # the mean of the kept sweeps

    def sampled(self, h: np.ndarray, form: np.ndarray, c: np.ndarray, before: np.ndarray, serial: int) -> np.ndarray:
        return seat(c, 1 / (self.words[form] + 1), self.discount, self.strength, before[form], h, serial)

    def log_unseen(self) -> np.ndarray:
        return np.log10((self.strength + self.discount * self.tables) / (self.words + 1) / (self.strength + self.customers))

    def log_words(self, h: np.ndarray, form: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 of the averaged predictive of each word in its class."""
        t = np.mean([self.sampled(h, form, c, before, serial) for serial, before in self.sweeps], axis=0)
        base = (self.strength + self.discount * self.tables[form]) / (self.words[form] + 1)
        return np.log10((c - self.discount * t + base) / (self.strength + self.customers[form]))


def sample_endings(rare: DataFrame) -> Endings:
    """Gibbs sweeps over the distributed (h, form, c) of rare words; FORMS numbers come back from each."""
    spark = rare.sparkSession
    customers, words = np.zeros(FORMS), np.zeros(FORMS)
    ones = twos = 0
    for form, n, c, one, two in rare.groupBy("form").agg(F.count(F.lit(1)), F.sum("c"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).collect():
        words[form], customers[form] = n, c
        ones, twos = ones + one, twos + two
    own = Endings(discount_of(ones, twos), 1.0, customers, words, [], words.copy())
    tables, kept = words.copy(), []
    for sweep in range(SWEEPS):
        if sweep >= BURN_IN:
            own.sweeps.append((200 + sweep, tables))
        shared = spark.sparkContext.broadcast((own, tables))

        def seats(batches, shared=shared, sweep=sweep):
            model, before = shared.value
            total = np.zeros(FORMS)
            for batch in batches:
                h, form, c = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("h", "form", "c"))
                total += np.bincount(form, weights=model.sampled(h, form, c, before, 200 + sweep), minlength=FORMS)
            full = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], ["form", "t"])

        after = np.zeros(FORMS)
        for form, t in rare.select("h", "form", "c").mapInArrow(seats, "form long, t double").groupBy("form").agg(F.sum("t")).collect():
            after[form] = t
        tables = after
        if sweep >= BURN_IN:
            kept.append(after)
    own.tables = np.mean(kept, axis=0)
    return own


def frequent_words(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, form and count of the end and of the words from the least count on that leaves FREQUENT at most, the commonest first."""
    words = counts.where(F.col("h") != END)
    room, least = FREQUENT - 1, None
    for c, n in words.groupBy("c").count().orderBy(F.desc("c")).limit(FREQUENT).collect():  # one row for each count that occurs
        room -= n
        if room < 0:
            break
        least = c
    ends = counts.where(F.col("h") == END).first()
    own = np.array([END]), np.array([0]), np.array([ends["c"] if ends else 0])
    if least is None:
        return own
    top = words.where(F.col("c") >= least).select("h", "form", "c").toArrow()
    h, form, c = (top.column(x).to_numpy().astype(np.int64) for x in ("h", "form", "c"))
    order = np.lexsort((h, -c))
    return tuple(np.concatenate((a, b[order])) for a, b in zip(own, (h, form, c), strict=True))


def rows_of(values: np.ndarray, cuts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """One list for each stretch between two cuts."""
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))


@dataclass
class Pairs:
    """Which restaurants words have after each other word, and in which bucket they are seated.

    After a word with a class of its own there is a restaurant for each ending, of the words with that
    ending; after any other word there is one, of all words. All customers of a restaurant are in one
    bucket. The endings after one word are dealt to slices, more of them the more buckets there are, so that runs
    of customers after the same word stay long and no bucket gets too much of a common word.
    """

    vocabulary: Vocabulary
    buckets: int

    def runs(self, before: np.ndarray, context: np.ndarray, after: np.ndarray) -> np.ndarray:
        """before: hash of the word before; context, after: classes of it and of the word itself."""
        slices = min(FORMS, 1 << (self.buckets >> 4).bit_length())
        ending = np.where(context < self.vocabulary.own, after % slices + 1, 0).astype(np.uint64)
        return mix(before.view(np.uint64) ^ mix(ending))

    def bucket(self, runs: np.ndarray) -> np.ndarray:
        return ((runs >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)

    def packed(self, piece: int, runs: np.ndarray, context: np.ndarray, after: np.ndarray, number: np.ndarray, h: np.ndarray, code: np.ndarray):
        """Columns of one row for each bucket: its runs (their words' hashes, 0 for words with a class of their own, and
        their classes) and, one run after another, their customers, of which the first has FIRST in its code.

        Frequent words go by number, the others by hash and class.
        """
        for rare in (False, True):
            chosen = np.flatnonzero((number < 0) == rare)
            if not len(chosen):
                continue
            at = chosen[np.argsort(runs[chosen])]
            own = runs[at]
            start = np.concatenate(([True], own[1:] != own[:-1]))
            new = np.flatnonzero(start)
            buckets = self.bucket(own[new])
            first = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1])))
            by_run, by_word = np.append(first, len(new)), np.append(new[first], len(at))
            word_class = context[at[new]]
            none = pa.nulls(len(first), pa.list_(pa.int64()))
            yield {
                "bucket": pa.array(buckets[first], pa.int32()), "piece": pa.array(np.full(len(first), piece), pa.int64()),
                "g": rows_of(np.where(word_class < self.vocabulary.own, 0, own[new].view(np.int64)), by_run, pa.int64()),
                "context": rows_of(word_class, by_run, pa.int16()), "code": rows_of(code[at] + FIRST * start, by_word, pa.int16()),
                "number": none.cast(pa.list_(pa.int32())) if rare else rows_of(number[at], by_word, pa.int32()),
                "h": rows_of(h[at], by_word, pa.int64()) if rare else none, "after": rows_of(after[at], by_word, pa.int16()) if rare else none.cast(pa.list_(pa.int16())),
            }


# Of a customer's code: its text is learned from, is not scored, it is the first of a run, its text is at this place of its piece.
LEARNED, UNSCORED, FIRST, PLACE = 1 << 12, 1 << 13, 1 << 14, (1 << 12) - 1
PAIR_BYTES = 1 << 22  # text for each bucket of pairs
PAIR_SERIAL = 300


def seat_words(g: np.ndarray, q: np.ndarray, c: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each dish has by itself, and the share of the base measure, in the averaged predictive of its restaurant.

    g: restaurant of each dish; q: base probability; c: customers, 0 for a word that was never learned there.
    The restaurants are independent given their base, so the sweeps need nothing from elsewhere.
    """
    d, strength = discount_of((c == 1).sum(), (c == 2).sum()), 1.0
    _, at = np.unique(g, return_inverse=True)
    customers = np.bincount(at, weights=c)[at]
    tables, kept = np.bincount(at, weights=np.minimum(c, 1))[at], []
    for sweep in range(SWEEPS):
        drawn = seat(c, q, d, strength, tables, keys, PAIR_SERIAL + sweep)
        tables = np.bincount(at, weights=drawn)[at]
        if sweep >= BURN_IN:
            kept.append((drawn, tables))
    own, held = (np.mean([x[i] for x in kept], axis=0) for i in (0, 1))
    return (c - d * own) / (strength + customers), (strength + d * held) / (strength + customers)


def bucket_scores(bucket: pa.Table, vocabulary: Vocabulary, table: np.ndarray, unseen: np.ndarray, customers: np.ndarray) -> dict[str, list]:
    """Counts and seats the pairs of one bucket. Of each piece: what frequent words add to each of its texts; of each
    rare word of a scored text: its probability as a + b * (that of the word in its class, in times of an unseen one's).
    """
    parts = []
    for rare in (False, True):
        rows = bucket.filter(pc.is_valid(bucket.column("h" if rare else "number"))).combine_chunks()
        if not rows.num_rows:
            continue
        flat = {x: pc.list_flatten(rows.column(x)).to_numpy() for x in ("g", "context", "code", "h" if rare else "number")}
        word = flat["h" if rare else "number"].astype(np.int64)
        after = pc.list_flatten(rows.column("after")).to_numpy() if rare else vocabulary.classes[word]
        piece = np.repeat(rows.column("piece").to_numpy(), pc.list_value_length(rows.column("code")).to_numpy())
        run = np.cumsum((flat["code"] & FIRST) > 0) - 1
        context, after = flat["context"][run].astype(np.int64), after.astype(np.int64)
        # A restaurant after a word with a class of its own is known by both classes; the others by the hash of the word.
        by_classes = mix((context * vocabulary.width + after + 1).view(np.uint64))
        parts.append([np.where(context < vocabulary.own, by_classes, flat["g"][run].view(np.uint64)), context, after, word, np.full(len(word), rare), flat["code"], piece])
    if not parts:
        return {"piece": [], "scored": [], "rare": []}
    g, context, after, word, rare, code, piece = (np.concatenate(x) for x in zip(*parts, strict=True))
    keys, first, which = np.unique(mix(mix(g) * np.uint64(0x9E3779B97F4A7C15) + mix(word.view(np.uint64) + rare)), return_index=True, return_inverse=True)
    c = np.bincount(which, weights=(code & LEARNED) > 0)
    # Of each dish: the class part of its base, and what the word has in its class; the place of the class part depends on the context.
    g, context, after, word, rare_dish = g[first], context[first], after[first], word[first], rare[first]
    by_class, own = 10.0 ** table[context, after].astype(np.float64), context < vocabulary.own
    ending = np.maximum(after - vocabulary.own, 0)
    new = 10.0 ** unseen[ending]
    by_word = np.where(rare_dish, np.maximum(new, c / (1 + customers[ending])), 10.0 ** vocabulary.log_word[np.where(rare_dish, 0, word)])
    inner, outer = np.where(own, 1.0, by_class), np.where(own, by_class, 1.0)
    a, b = seat_words(g, inner * by_word, c, keys.view(np.int64))
    a, b = outer * a, outer * b * inner
    gained = np.log10(a + b * by_word)
    place, scored = (code & PLACE).astype(np.int64), (code & UNSCORED) == 0
    f = np.flatnonzero(scored & ~rare)
    # Pieces are numbered by their first row, and have fewer rows than places.
    pieces_here, number = np.unique(piece[f], return_inverse=True)
    slot = number * (PLACE + 1) + place[f]
    if len(pieces_here) * (PLACE + 1) <= 4 * len(f):
        slots = np.flatnonzero(np.bincount(slot))
        sums = np.bincount(slot, weights=gained[which[f]])[slots]
    else:
        slots, at = np.unique(slot, return_inverse=True)
        sums = np.bincount(at, weights=gained[which[f]])
    r = np.flatnonzero(scored & rare)
    d = which[r]
    cuts = np.searchsorted(slots, np.arange(len(pieces_here) + 1) * (PLACE + 1))
    return {"piece": [pieces_here], "scored": [slots % (PLACE + 1), sums, cuts], "rare": [piece[r], place[r], word[d], a[d], (b * new)[d]]}


def score_texts(docs: DataFrame, training: DataFrame | Column, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each row of `docs`: the `keep` columns, n_tokens, n_known, train_tokens, base_score, score and perplexity.

    `training` is any DataFrame with the text column, or a condition on `docs` for the rows to learn from,
    which spares a pass. Tokens are words and one end for each text;
    null counts as empty, so it has one token. base_score is the add-one unigram log10 probability,
    score the model's log10 probability of the whole text. An empty `training` makes every token
    unknown. Repeated rows are scored each for itself, and equal texts get equal scores up to the
    last digits of a sum of 32-bit numbers.

    Passes over texts: word counts, class pairs, scores. Pairs of words with a class of their own are
    scored where the text is read. All others go to the restaurant of the word before in one shuffle, where
    they are counted, seated and looked up at once; sums by text come back in another. Frequent words (a fixed number) are known
    to each task; the others go by hash to the distributed counts on their way. A word that is common in
    `docs` but not in `training` is not among the frequent ones, and its rows meet in one partition, and those after it in one bucket.
    """
    spark = docs.sparkSession
    ship(spark)
    if isinstance(training, Column):
        learned = F.coalesce(training, F.lit(False))
        learning, every = docs.where(learned), docs.select(*keep, F.col(text).alias("__text"), learned.alias("__learned"), F.lit(True).alias("__scored"))
    else:
        learning = training
        nothing = [F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in keep]
        every = docs.select(*keep, F.col(text).alias("__text"), F.lit(False).alias("__learned"), F.lit(True).alias("__scored")).unionAll(
            training.select(*nothing, F.col(text).alias("__text"), F.lit(True).alias("__learned"), F.lit(False).alias("__scored"))
        )
    counts = count_words(learning, text)
    n, v = (x or 0 for x in counts.agg(F.sum("c"), F.count(F.lit(1))).first())
    size = every.agg(F.sum(F.octet_length("__text").cast("long"))).first()[0] or 0
    hashes, forms, found = frequent_words(counts)
    own = own_classes(n)
    classes = np.where(np.arange(len(hashes)) < own, np.arange(len(hashes)), own + forms)
    vocabulary = Vocabulary(hashes, classes, found, np.zeros(len(hashes)), own)
    table = sample_contexts(count_class_pairs(learning, text, vocabulary), vocabulary.width)
    owned = [int(h) for h in hashes[:own]]
    endings = sample_endings(counts.where(~F.col("h").isin(owned)))
    if len(hashes) > own:
        vocabulary.log_word[own:] = endings.log_words(hashes[own:], forms[own:], found[own:])
    unseen = endings.log_unseen()
    base_one = float(-np.log10(n + v + 1))
    pairs = Pairs(vocabulary, 1 + size // PAIR_BYTES)
    shared = spark.sparkContext.broadcast((pairs, table, np.log10(vocabulary.counts + 1.0)))
    seating = spark.sparkContext.broadcast((Vocabulary(np.zeros(0), vocabulary.classes, np.zeros(0), vocabulary.log_word, own), table, unseen, endings.customers))

    chosen = every.withColumn("__row", F.monotonically_increasing_id())
    head = T.StructType([T.StructField(c, chosen.schema[c].dataType) for c in keep])
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("base", "double"), ("score", "double")):
        head = head.add(f"__{name}", kind)
    heads_type = T.ArrayType(head)
    long, integer, short = T.LongType(), T.IntegerType(), T.ShortType()
    numbers_in = {"g": long, "context": short, "code": short, "number": integer, "h": long, "after": short}
    schema = T.StructType().add("bucket", "integer").add("piece", "long")
    for name, kind in numbers_in.items():
        schema = schema.add(name, T.ArrayType(kind))
    schema = schema.add("heads", heads_type)
    arrow_kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    lists = {long: pa.list_(pa.int64()), integer: pa.list_(pa.int32()), short: pa.list_(pa.int16())}

    def work(batches):
        pairs, table, log_count = shared.value
        vocabulary = pairs.vocabulary
        reader = Reader(vocabulary)
        known_end = int(vocabulary.counts[0] > 0)
        for batch in pieces(batches, "__text"):
            ids = batch.column("__row").to_numpy()
            piece = int(ids[0])
            flags = [batch.column(x).to_numpy(zero_copy_only=False).astype(bool) for x in ("__learned", "__scored")]
            t = tokens_of(batch.column("__text"))
            numbers, hashes, classes = reader.numbers(t.words)
            full = numbers >= 0
            tokens, starts = t.lengths, t.starts
            known = np.add.reduceat(full[t.at].astype(np.int64), starts) - (1 - known_end)
            # Of base_score, a rare word's count comes by its hash.
            more_base = np.where(full, log_count[numbers], 0.0)
            base = tokens * base_one + np.add.reduceat(more_base[t.at], starts)
            before = t.before()
            context, after = classes[before], classes[t.at]
            plain = (context < vocabulary.own) & (after < vocabulary.own)
            score = np.add.reduceat(np.where(plain, table[context, after], 0.0), starts)
            heads = pa.StructArray.from_arrays([*(batch.column(c) for c in keep), *(pa.array(x, k) for x, k in zip((tokens, known, base, score), arrow_kinds, strict=True))], head.names)
            if flags[1].all():
                row = {"bucket": pa.array(mix(np.array([piece], np.uint64)) % np.uint64(pairs.buckets), pa.int32()), "piece": pa.array([piece], pa.int64()), "heads": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), heads)}
                yield pa.RecordBatch.from_arrays([row[f] if f in row else pa.nulls(1, lists[numbers_in[f]]) for f in schema.names], schema.names)
            code = np.arange(len(ids)) + LEARNED * flags[0] + UNSCORED * ~flags[1]
            at = np.flatnonzero(~plain)
            context, after, word = context[at], after[at], t.at[at]
            code = np.repeat(code, tokens)[at]
            for row in pairs.packed(piece, pairs.runs(hashes[before[at]], context, after), context, after, numbers[word], hashes[word], code):
                yield pa.RecordBatch.from_arrays([row[f] if f in row else pa.nulls(len(row["bucket"]), pa.list_(heads.type)) for f in schema.names], schema.names)

    scored_schema = T.StructType().add("piece", "long").add("h", "long").add("place", "short").add("a", "float").add("b", "float").add("places", T.ArrayType(short)).add("sums", T.ArrayType(T.FloatType())).add("heads", heads_type)

    def seated(bucket: pa.Table) -> pa.Table:
        vocabulary, table, unseen, customers = seating.value
        heads = bucket.select(["piece", "heads"]).filter(pc.is_valid(bucket.column("heads")))
        kind = bucket.schema.field("heads").type
        names = scored_schema.names
        kinds = [pa.int64(), pa.int64(), pa.int16(), pa.float32(), pa.float32(), pa.list_(pa.int16()), pa.list_(pa.float32()), kind]
        out = []

        def add(n: int, **columns):
            if n:
                out.append(pa.table({f: columns[f] if f in columns else pa.nulls(n, k) for f, k in zip(names, kinds, strict=True)}))

        def scattered(piece: np.ndarray) -> pa.Array:
            """Rows that look for no word go to partitions of their own choosing."""
            return pa.array(mix(piece.view(np.uint64)).view(np.int64))

        own = heads.column("piece").to_numpy()
        add(len(own), piece=pa.array(own, pa.int64()), h=scattered(own.astype(np.int64)), heads=heads.column("heads").combine_chunks())
        found = bucket_scores(bucket, vocabulary, table, unseen, customers)
        if found["scored"]:
            (own,), (places, sums, cuts), (piece, place, h, a, b) = found["piece"], found["scored"], found["rare"]
            add(len(own), piece=pa.array(own, pa.int64()), h=scattered(own + bucket.column("bucket")[0].as_py()), places=rows_of(places, cuts, pa.int16()), sums=rows_of(sums, cuts, pa.float32()))
            add(len(piece), piece=pa.array(piece, pa.int64()), h=pa.array(h, pa.int64()), place=pa.array(place, pa.int16()), a=pa.array(a, pa.float32()), b=pa.array(b, pa.float32()))
        return pa.concat_tables(out) if out else pa.table({f: pa.nulls(0, k) for f, k in zip(names, kinds, strict=True)})

    def gains(batches):
        for batch in batches:
            h, form, c = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("h", "form", "c"))
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("c"), pa.array(10.0 ** (endings.log_words(h, form, c) - unseen[form]))], ["h", "c", "times"])

    out_schema = T.StructType([T.StructField(c, chosen.schema[c].dataType) for c in keep]).add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("score", "double")

    def summed(piece: pa.Table) -> pa.Table:
        heads = pa.concat_arrays([pc.list_flatten(x) for x in piece.column("heads").chunks])
        k, b, s = (np.zeros(len(heads)) for _ in range(3))
        if len(heads):
            rare = piece.filter(pc.is_valid(piece.column("place")))
            place = rare.column("place").to_numpy()
            c = pc.fill_null(rare.column("c"), 0).to_numpy()
            k, b, s = (np.bincount(place, weights=x, minlength=len(heads)).astype(np.float64) for x in (c > 0, np.log10(c + 1.0), rare.column("gained").to_numpy()))
            for places, sums in zip(piece.column("places").chunks, piece.column("sums").chunks, strict=True):
                s += np.bincount(pc.list_flatten(places).to_numpy(), weights=pc.list_flatten(sums).to_numpy(), minlength=len(heads))
        own = dict(zip(head.names, heads.flatten(), strict=True))
        tokens, known, base, score = (own[f"__{x}"].to_numpy(zero_copy_only=False) for x in ("n_tokens", "n_known", "base", "score"))
        return pa.Table.from_arrays([*(own[c] for c in keep), pa.array(tokens, pa.int64()), pa.array(known + k.astype(np.int64), pa.int64()), pa.array(base + b), pa.array(score + s)], names=out_schema.names)

    parts = chosen.mapInArrow(work, schema).groupBy("bucket").applyInArrow(seated, scored_schema)
    words = counts.where(F.col("h") != END).mapInArrow(gains, "h long, c long, times double")
    joined = parts.join(words, "h", "left")
    gained = F.log10(F.col("a").cast("double") + F.col("b").cast("double") * F.coalesce("times", F.lit(1.0)))
    texts = joined.select("piece", "place", "c", gained.cast("float").alias("gained"), "places", "sums", "heads")
    scored = texts.groupBy("piece").applyInArrow(summed, out_schema)
    return scored.select(*keep, "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
