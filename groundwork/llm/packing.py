"""Best-fit packing of token pieces into sequences of bounded length.

Tokens come from a public tokenizer file. Packing is online best-fit with bounded space: a fixed
number of bins is open, a bitset keyed by free space finds the fullest bin that a piece fits in, and
when no bin fits and all are open, the fullest one closes to make room.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwork.llm.common import checkpointed, ship, slices

CACHE_WORDS = 500_000
MARK = "|"  # one token of its own between blanks
AT_ONCE = 50


class WordCache:
    """Token ids of texts as little-endian bytes, words encoded once.

    The tokenizer drops white space between words and never joins across it, so a text's ids are the
    ids of its blank-separated parts in order. New parts are encoded many at a time, joined by a mark
    whose id tells them apart; parts that hold the mark themselves are encoded alone. Beyond
    CACHE_WORDS parts a new generation begins, and what is met again moves over from the last one.
    """

    def __init__(self, path: str):
        # Spark runs one worker on each core already; threads of the tokenizer's own would only contend.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.ids: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        alone = [w for w in words if self.mark is None or MARK in w]
        rest = [w for w in words if self.mark is not None and MARK not in w]
        groups = [rest[i : i + AT_ONCE] for i in range(0, len(rest), AT_ONCE)]
        joined = [f" {MARK} ".join(g) for g in groups]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, dtype="<u4")
            cuts = np.flatnonzero(ids == self.mark).tolist()
            if len(cuts) != len(group) - 1:
                alone += group
                continue
            raw = ids.tobytes()
            for word, a, b in zip(group, [-1, *cuts], [*cuts, len(ids)], strict=True):
                self.ids[word] = raw[4 * a + 4 : 4 * b]
        for word, found in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            self.ids[word] = np.array(found.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.ids) > CACHE_WORDS:
            self.old, self.ids = self.ids, {}
        parts = [t.replace("\n", " ").split(" ") for t in texts]
        new = []
        for w in {w for p in parts for w in p}.difference(self.ids):
            kept = self.old.get(w)
            if kept is None:
                new.append(w)
            else:
                self.ids[w] = kept
        self.learn(new)
        get = self.ids.__getitem__
        return [b"".join(map(get, p)) for p in parts]


_CACHES: dict[str, WordCache] = {}


def word_cache(path: str) -> WordCache:
    """One cache for each Python worker, kept between its tasks."""
    if path not in _CACHES:
        _CACHES[path] = WordCache(path)
    return _CACHES[path]


class OpenBins:
    """A fixed number of open bins in a bitset keyed by free space."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits = 0  # bit f is set where a bin with f free tokens is open
        self.by_free: dict[int, list[int]] = {}
        self.open = 0
        self.next_id = 0

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        bin_id = stack.pop()
        if not stack:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.open -= 1
        return bin_id

    def _put(self, free: int, bin_id: int) -> None:
        if free:  # a full bin closes by itself
            self.by_free.setdefault(free, []).append(bin_id)
            self.bits |= 1 << free
            self.open += 1

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset in it): best fit, else a new bin."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, bin_id = self.capacity, self.next_id
            self.next_id += 1
        self._put(free - length, bin_id)
        return bin_id, self.capacity - free


def tokenize_pieces(docs: DataFrame, tokenizer: str, capacity: int, text: str, key: str, end_id: int = 0, keep_ids: bool = False, keep_cache: bool = True) -> DataFrame:
    """Pieces of every document: key, piece, start, length, ids_crc32, and on wish the ids.

    Ids of the whole text, then `end_id`; only a longer document is cut, into pieces of `capacity`
    tokens, the last one shorter. A null text counts as empty and so is one piece of one token.
    """
    ship(docs.sparkSession)
    chosen = docs.select(F.col(key), F.col(text).alias("__text"))
    schema = T.StructType([chosen.schema[key]]).add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    if keep_ids:
        schema = schema.add("ids", T.ArrayType(T.LongType()))
    end = np.array([end_id], dtype="<u4").tobytes()

    def work(batches):
        cache = word_cache(tokenizer) if keep_cache else WordCache(tokenizer)
        for batch in slices(batches, 1024):
            rows, piece, start, length, crc, kept = [], [], [], [], [], []
            for row, body in enumerate(cache.encode([t or "" for t in batch.column("__text").to_pylist()])):
                ids = body + end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    rows.append(row)
                    piece.append(i)
                    start.append(at // 4)
                    length.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
                    if keep_ids:
                        kept.append(np.frombuffer(cut, "<u4").astype(np.int64))
            columns = [batch.column(key).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return chosen.mapInArrow(work, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, open_bins: int = 128, group_pieces: int = 65536, text: str = "text", key: str = "doc_id", keep_ids: bool = False, keep_cache: bool = True) -> DataFrame:
    """Pieces with sequence_id and offset, in as few sequences as the method finds.

    Pieces are written to the checkpoint folder first, so texts are tokenized once. They are dealt
    by a hash of the piece and its place (so repeated keys and rows spread)
    into groups of about `group_pieces`; each group is packed on its own in the order of that hash,
    which mixes lengths as bounded-space packing wants. A task that runs again gets the same group in
    the same order. A group leaves at most `open_bins` bins partly filled. Bins are numbered by group,
    so sequence ids never clash. Offsets of a sequence are gapless from 0. Null and repeated keys are
    kept; an empty table gives an empty result; other columns are not carried. The key may not have the
    name of a result column (piece, start, length, ids_crc32, ids, sequence_id, offset). A very long
    text takes memory in proportion to itself. `keep_cache` keeps the token ids of words in a Python
    worker between tasks; without it they go when a task ends.
    """
    if key.lower() in ("piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"):
        raise ValueError(f"the key can't be named like a result column: {key}")
    pieces = checkpointed(tokenize_pieces(docs, tokenizer, capacity, text, key, keep_ids=keep_ids, keep_cache=keep_cache))
    groups = max(1, -(-pieces.count() // group_pieces))
    # The number is that of a row of the checkpoint, so it is the same whenever a task runs.
    mixed = pieces.withColumn("__mix", F.xxhash64(key, "piece", "length", "ids_crc32", F.monotonically_increasing_id()))
    dealt = mixed.repartition(groups, "__mix").sortWithinPartitions("__mix")
    schema = T.StructType(list(pieces.schema.fields)).add("sequence_id", "long").add("offset", "long")

    def work(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 36
        bins = OpenBins(capacity, open_bins)
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            ids = pa.array([first + b for b, _ in placed], pa.int64())
            yield batch.drop_columns(["__mix"]).append_column("sequence_id", ids).append_column("offset", pa.array([o for _, o in placed], pa.int64()))

    return dealt.mapInArrow(work, schema)
