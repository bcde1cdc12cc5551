"""Phrase collocation mining: HAT-trie counts of word sequences, exact, for each language.

A task counts phrases in burstable hash containers under a shallow trie of word ids. When it holds too
many, whole subtrees leave as sorted runs; Spark deals the runs by phrase prefix and merges their counts.
A phrase can be frequent only if the phrases inside it are, so every longer pass looks only at places
where the shorter ones passed: a bit table of frequent phrases, which may let others through but loses none.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.llm.common import ship, slices, written

BREAK = b"\xff"  # no byte of UTF-8
# Bytes: A-Z folded, what ends a piece made BREAK, all else as it is.
FOLD = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
COUNTED = "lang string, prefix int, phrase string, n long"
BURST = 4_096  # entries of a container
HELD = 1_000_000  # entries that a task holds before subtrees leave
TOKENS = 1_000_000  # words that are looked up together
WORDS = 1_000_000  # words that a task numbers before it starts anew
RANKED = 256  # parts of a language in which candidates are ranked before they meet
MIX = np.uint64(0x9E3779B97F4A7C15)
ALL = 2**64 - 1


def tokens_of(texts: list[bytes]) -> list[bytes]:
    """Words of all texts in a row; BREAK stands between pieces and between texts."""
    return BREAK.join(texts).translate(FOLD).replace(BREAK, b" \xff ").split()


class Container(dict):
    """Counts of what follows a path of words; the words that follow are packed into one number."""


class Node(dict):
    """Containers and further nodes by word id."""


class Trie:
    """Phrase counts: the first word's id leads to a hash container; one that grows beyond BURST entries becomes a node with containers of its own.

    Of a phrase's further ids, each below 2^bits, the next one stands highest, and 0 stands where there is none.
    """

    def __init__(self, longest: int):
        self.longest, self.bits = longest, 63 // max(1, longest - 1)
        self.root = Node()
        self.size = 0

    def pack(self, ids: np.ndarray) -> np.ndarray:
        """Rows of further ids as one number each."""
        packed = np.zeros(len(ids), np.int64)
        for i in range(ids.shape[1]):
            packed |= ids[:, i] << self.bits * (self.longest - 2 - i)
        return packed

    def unpack(self, first: np.ndarray, packed: np.ndarray) -> list[np.ndarray]:
        """The ids of each place in the phrases, 0 after their ends."""
        return [first, *(packed >> self.bits * (self.longest - 2 - i) & (1 << self.bits) - 1 for i in range(self.longest - 1))]

    def add(self, first: np.ndarray, packed: np.ndarray, counts: np.ndarray) -> None:
        """Different phrases, sorted by their first ids and then by their packed ones."""
        cuts = [0, *(np.flatnonzero(np.diff(first)) + 1).tolist(), len(first)] if len(first) else [0]
        heads, keys, n = first[cuts[:-1]].tolist(), packed.tolist(), counts.tolist()
        for head, i, j in zip(heads, cuts, cuts[1:], strict=False):
            self.put(self.root, head, keys[i:j], n[i:j], 1)

    def put(self, node: Node, head: int, keys: list[int], counts: list[int], depth: int) -> None:
        at = node.get(head)
        if isinstance(at, Node):
            self.spread(at, keys, counts, depth)
            return
        if at is None:
            at = node[head] = Container(zip(keys, counts, strict=True))
            self.size += len(at)
        else:
            before = len(at)
            for k, n in zip(keys, counts, strict=True):
                at[k] = at.get(k, 0) + n
            self.size += len(at) - before
        if len(at) > BURST and depth < self.longest - 1:
            self.size -= len(at)
            node[head] = Node()
            self.spread(node[head], *map(list, zip(*sorted(at.items()), strict=True)), depth)

    def spread(self, node: Node, keys: list[int], counts: list[int], depth: int) -> None:
        """Sorted entries over the children of a node, by their next word; 0 keeps what ends here."""
        shift, mask = self.bits * (self.longest - 2), (1 << self.bits * (self.longest - 1)) - 1
        i = 0
        while i < len(keys):
            head, j = keys[i] >> shift, i
            while j < len(keys) and keys[j] >> shift == head:
                j += 1
            self.put(node, head, [k << self.bits & mask for k in keys[i:j]], counts[i:j], depth + 1)
            i = j

    def count(self, node) -> int:
        return len(node) if isinstance(node, Container) else sum(map(self.count, node.values()))

    def entries(self, node):
        """(packed ids, count) of a subtree, as they stand below its root."""
        if isinstance(node, Container):
            yield from node.items()
            return
        shift = self.bits * (self.longest - 2)
        for head, below in node.items():
            for packed, n in self.entries(below):
                yield head << shift | packed >> self.bits, n

    def spill(self, down_to: int, run: int = 50_000):
        """Take out whole subtrees, the largest first, until `down_to` entries are left; yields (first ids, packed ids, counts) of some at a time."""
        sizes = {k: self.count(x) for k, x in self.root.items()}
        heads, lengths, entries, held = [], [], [], 0
        for k in sorted(sizes, key=sizes.get, reverse=True):
            if self.size <= down_to:
                break
            self.size -= sizes[k]
            heads.append(k)
            lengths.append(sizes[k])
            entries.append(self.entries(self.root.pop(k)))
            held += sizes[k]
            if held >= run:
                yield self.taken(heads, lengths, entries)
                heads, lengths, entries, held = [], [], [], 0
        if heads:
            yield self.taken(heads, lengths, entries)

    @staticmethod
    def taken(heads: list[int], lengths: list[int], entries: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        both = np.fromiter(chain.from_iterable(chain.from_iterable(entries)), np.int64, 2 * sum(lengths)).reshape(-1, 2)
        return np.repeat(np.array(heads, np.int64), lengths), both[:, 0], both[:, 1]


class Numbers:
    """Ids of the words that may be part of a counted phrase; 0 for all others."""

    def __init__(self, lang: str, bits: np.ndarray):
        self.lang, self.bits = lang.encode() + b"\0", bits
        self.ids: dict[bytes, int] = {BREAK: 0}
        self.words = [b""]
        self.hashes = np.zeros(1, np.uint64)

    def of(self, tokens: list[bytes]) -> np.ndarray:
        new = list(set(tokens).difference(self.ids))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, [self.lang + w for w in new]), np.uint64, len(new))
        known = has(self.bits, mixed(hashes))
        self.ids.update(zip(new, np.where(known, len(self.words) - 1 + np.cumsum(known), 0).tolist(), strict=True))
        self.words += [new[i] for i in np.flatnonzero(known).tolist()]
        self.hashes = np.append(self.hashes, hashes[known])
        return np.fromiter(map(self.ids.__getitem__, tokens), np.int64, len(tokens))


def mixed(h: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Hash of a phrase from that of all but its last word and of the last word."""
    x = h if before is None else h + before * MIX
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def mixed_one(h: int, before: int | None = None) -> int:
    """`mixed` of one phrase."""
    x = h if before is None else (h + before * int(MIX)) & ALL
    x = (x ^ x >> 32) * int(MIX) & ALL
    return x ^ x >> 29


def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(len(bits) * 64 - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def phrase_hash(lang: str, words: list[str]) -> int:
    x = None
    for w in words:
        x = mixed_one(xxhash.xxh64_intdigest(lang.encode() + b"\0" + w.encode()), x)
    return x


def occurrences(ids: np.ndarray, hashes: np.ndarray, size: int, shorter: int, bits: np.ndarray, trie: Trie) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first id, packed further ids, count) of the different phrases of `size` words; every phrase of `shorter` words in them must be in the bit table."""
    n = len(ids) - size + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    there = ids > 0
    window = reduce(np.logical_and, [there[i : len(ids) - shorter + 1 + i] for i in range(shorter)])
    if shorter > 1:  # single words were looked up when they were numbered
        word = hashes[ids]
        window &= has(bits, reduce(lambda x, i: mixed(word[i : len(ids) - shorter + 1 + i], x), range(shorter), None))
    at = np.flatnonzero(reduce(np.logical_and, [window[i : i + n] for i in range(size - shorter + 1)]))
    first, packed = ids[at], trie.pack(np.stack([ids[at + i] for i in range(1, size)], 1))
    order = np.lexsort((packed, first))
    first, packed = first[order], packed[order]
    new = np.flatnonzero(np.append(True, (np.diff(first) != 0) | (np.diff(packed) != 0))[: len(at)])
    return first[new], packed[new], np.diff(np.append(new, len(at)))


def runs_of(lang: str, numbers: Numbers, trie: Trie, down_to: int):
    """Subtrees that leave a trie, as runs of rows sorted by phrase; the prefix of a phrase, its first three words, is hashed."""
    names = pa.array(numbers.words, pa.binary()).cast(pa.string())
    for first, packed, counts in trie.spill(down_to):
        ids = trie.unpack(first, packed)
        prefix = reduce(lambda x, i: np.where(i > 0, mixed(numbers.hashes[i], x), x), ids[1:3], mixed(numbers.hashes[first]))
        phrase = pc.binary_join_element_wise(*[pc.if_else(pa.array(i > 0), names.take(pa.array(i)), None) for i in ids], pa.scalar(" "), null_handling="skip")
        batch = pa.RecordBatch.from_arrays([pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(first), np.int32)), pa.array([lang])).cast(pa.string()), pa.array((prefix >> np.uint64(48)).astype(np.int32)), phrase, pa.array(counts)], ["lang", "prefix", "phrase", "n"])
        yield batch.take(pc.sort_indices(phrase))


def texts_by_lang(batch) -> dict[str, list[bytes]]:
    by_lang: dict = {}
    for lang, raw in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
        by_lang.setdefault(lang, []).append(raw or b"")
    return by_lang


def count_words(batches):
    """Rows of single words, and one without a phrase for all words of a language."""
    held: dict[str, Counter] = {}

    def rows():
        for lang, counts in held.items():
            counts.pop(BREAK, None)
            words, n = pa.array(counts.keys(), pa.binary()).cast(pa.string()), np.fromiter(counts.values(), np.int64, len(counts))
            for i in range(0, len(words), 50_000):
                some = words[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.nulls(len(some), pa.int32()), some, pa.array(n[i : i + 50_000])], ["lang", "prefix", "phrase", "n"])
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.string()), pa.array([n.sum()])], ["lang", "prefix", "phrase", "n"])

    for batch in slices(batches, 4096):
        for lang, texts in texts_by_lang(batch).items():
            held.setdefault(lang, Counter()).update(tokens_of(texts))
        if sum(map(len, held.values())) > WORDS:
            yield from rows()
            held.clear()
    yield from rows()


def count_longer(sizes: tuple[int, ...], bit_tables):
    """A task's work for phrases of two words or more: `bit_tables` has the frequent words, and the frequent phrases one shorter than the first of `sizes`."""
    shorter = sizes[0] - 1

    def count(batches):
        words_table, table = bit_tables.value[1], bit_tables.value[shorter]
        held: dict[str, tuple[Numbers, Trie]] = {}

        for batch in slices(batches, 4096):
            for lang, texts in texts_by_lang(batch).items():
                tokens = tokens_of(texts)
                for start in range(0, len(tokens), TOKENS):
                    numbers, trie = held.setdefault(lang, (Numbers(lang, words_table), Trie(sizes[-1])))
                    # A stretch ends with the first words of the next, which no whole phrase of this one begins with.
                    ids = numbers.of(tokens[start : start + TOKENS + sizes[-1] - 1])
                    for size in sizes:
                        trie.add(*occurrences(ids[: TOKENS + size - 1], numbers.hashes, size, shorter, table, trie))
                    if len(numbers.ids) > min(WORDS, 1 << trie.bits - 1):
                        yield from runs_of(lang, numbers, trie, 0)
                        del held[lang]
                    elif trie.size > HELD:
                        yield from runs_of(lang, numbers, trie, HELD // 4)
            if sum(len(x.ids) + t.size for x, t in held.values()) > WORDS + 2 * HELD:
                for lang, (numbers, trie) in held.items():
                    yield from runs_of(lang, numbers, trie, 0)
                held.clear()
        for lang, (numbers, trie) in held.items():
            yield from runs_of(lang, numbers, trie, 0)

    return count


def merged(runs: DataFrame, least: int, *prefix: str) -> DataFrame:
    """(lang, phrase, n) of runs merged in partitions of a prefix, from `least` occurrences on; totals without a phrase stay."""
    dealt = runs.repartition("lang", *prefix) if prefix else runs
    return dealt.groupBy("lang", *prefix, "phrase").agg(F.sum("n").alias("n")).where(F.col("phrase").isNull() | (F.col("n") >= least)).select("lang", "phrase", "n")


def bit_table(phrases: DataFrame, most_bits: int) -> np.ndarray:
    """A bit for each frequent phrase, about sixteen times as many bits as phrases, a power of two, at most `most_bits`."""
    bits = 1 << max(10, min(most_bits.bit_length() - 1, (16 * phrases.count()).bit_length()))

    def positions(batches):
        for batch in slices(batches, 4096):
            found = [phrase_hash(lang, p.split(" ")) & (bits - 1) for lang, p in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x >> 6 for x in found], pa.int64()), pa.array(np.array([1 << (x & 63) for x in found], np.uint64).view(np.int64))], ["slot", "bit"])

    slots = phrases.mapInArrow(positions, "slot long, bit long").groupBy("slot").agg(F.bit_or("bit").alias("bit")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[slots.column("slot").to_numpy()] = slots.column("bit").to_numpy().view(np.uint64)
    return table


def frequent_phrases(plain: DataFrame, least: int, longest: int, most_bits: int) -> DataFrame:
    """(lang, phrase, n, size) of all phrases of up to `longest` words with `least` occurrences; size 0 is a language's number of words."""
    sc = plain.sparkSession.sparkContext
    found = [written(merged(plain.mapInArrow(count_words, COUNTED).repartition("lang", "phrase"), least).withColumn("size", F.when(F.col("phrase").isNull(), 0).otherwise(1)), "phrases-1")]
    tables: dict[int, np.ndarray] = {}
    passes = [(2,), tuple(range(3, longest + 1))]
    for sizes in [p for p in passes if p and p[-1] <= longest]:
        tables = {k: t for k, t in tables.items() if k == 1} | {sizes[0] - 1: bit_table(found[-1].where("phrase is not null"), most_bits)}
        given = sc.broadcast(tables)
        counted = merged(plain.mapInArrow(count_longer(sizes, given), COUNTED), least, "prefix")
        found.append(written(counted.withColumn("size", F.size(F.split("phrase", " "))), f"phrases-{sizes[0]}"))
        given.destroy()
    return reduce(DataFrame.unionByName, found)


def joined_words(phrase: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, length), " ")


def mine_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, most: int = 2000, longest: int = 4, share: int = 80, most_bits: int = 1 << 31) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `most` best phrases of 2 to `longest` words.

    A-Z are lower-cased; `[.,;:!?\\x0A-\\x0D]` ends a piece, and words are what blanks and tabs part. Everything is for
    one language; a null language is `und`. n is the number of its words, a the phrase's occurrences within
    pieces, overlaps included, and phrases with `least` of them are candidates. Cut after k words, l and r
    count the two parts, and the score is floor(2000000 * a / (l + r)); the lowest counts, ties to the
    smallest k. A candidate inside a longer one goes if 100 times the longer's count is `share` times a or
    more, even if the longer goes too. Ranks are by score, then a, then phrase in UTF-8 order. All
    arithmetic is exact.

    Null and empty texts have no words; a language without candidates has no row. Repeated rows count each
    for itself. An empty table gives an empty result. Other columns don't matter, whatever their names. A
    very long text takes memory in proportion to itself, everything else in a task is bounded by BURST, HELD
    and WORDS. Bit tables have at most `most_bits` bits; fuller ones let more phrases through to be
    counted and dropped, and change no result.
    """
    ship(docs.sparkSession)
    plain = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    known = frequent_phrases(plain, least, longest, most_bits)
    phrases, totals = known.where("size > 0"), known.where("size = 0").select("lang", F.col("n").alias("n"))
    wanted = phrases.where("size > 1").select("lang", "phrase", F.col("n").alias("a"), "size")

    part = lambda k, side, at, length: F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), joined_words(F.col("phrase"), at, length).alias("part"))
    cuts = F.array(*[F.when(F.col("size") > k, x) for k in range(1, longest) for x in (part(k, "l", 1, k), part(k, "r", k + 1, longest))])
    asked = wanted.select("lang", "phrase", "a", F.explode(F.array_compact(cuts)).alias("c")).select("lang", "phrase", "a", "c.k", "c.side", "c.part")
    parts = asked.join(phrases.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")), ["lang", "part"])
    side = lambda k, s: F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("f")))
    both = parts.groupBy("lang", "phrase", "a").agg(*[side(k, s).alias(f"{s}{k}") for k in range(1, longest) for s in "lr"])
    score = lambda k: F.call_function("div", F.col("a").cast("decimal(20,0)") * F.lit(2_000_000).cast("decimal(7,0)"), F.col(f"l{k}") + F.col(f"r{k}"))
    scores = F.array_compact(F.array(*[F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, longest)]))
    scored = both.select("lang", "phrase", "a", F.array_min(scores).alias("s")).select("lang", "phrase", "a", "s.l", "s.r", "s.score")

    places = [(at, length) for length in range(2, longest) for at in range(1, longest - length + 2)]
    inner = F.array(*[F.when(F.col("size") >= at + length - 1, joined_words(F.col("phrase"), at, length)) for at, length in places])
    longer = wanted.where("size > 2").select("lang", "phrase", F.col("a").alias("longer"), F.explode(F.array_distinct(F.array_compact(inner))).alias("inner")).where("inner <> phrase")
    longer = longer.groupBy("lang", F.col("inner").alias("phrase")).agg(F.max("longer").alias("longer"))
    left = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))

    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    some = left.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(RANKED))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).where(F.col("rank") <= most)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
