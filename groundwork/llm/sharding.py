"""Sharding by Hilbert-curve order, with DataFrame functions only.

Several metadata dimensions are quantised, each row gets the index of its cell on a Hilbert curve,
rows are sorted by that index, and the sorted sequence is cut into runs. Neighbours on the curve are
near each other in every dimension, so the files of a run have tight value ranges in all of them.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.llm.common import checkpointed


@lru_cache
def curve_tables(dims: int) -> tuple[list[int], list[int], int]:
    """State tables of the curve: next state and output digit for (state, cell digit), and the state count.

    A state is the entry corner and the direction of a sub-cube. The tables follow from the
    reflected Gray code alone.
    """
    size = 1 << dims
    mask = size - 1

    def gray(i: int) -> int:
        return i ^ (i >> 1)

    def ungray(g: int) -> int:
        i = 0
        while g:
            i ^= g
            g >>= 1
        return i

    def right(x: int, k: int) -> int:
        k %= dims
        return ((x >> k) | (x << (dims - k))) & mask

    def left(x: int, k: int) -> int:
        return right(x, dims - k % dims)

    def trailing(i: int) -> int:
        return ((~i & (i + 1)).bit_length() - 1) % dims

    def entry(w: int) -> int:
        return 0 if w == 0 else gray(2 * ((w - 1) // 2))

    def direction(w: int) -> int:
        if w == 0:
            return 0
        return trailing(w) if w % 2 else trailing(w - 1)

    states = {(0, 0): 0}
    todo, step, out = [(0, 0)], [], []
    while todo:
        e, d = todo.pop(0)
        for cell in range(size):
            w = ungray(right(cell ^ e, d + 1))
            nxt = (e ^ left(entry(w), d + 1), (d + direction(w) + 1) % dims)
            if nxt not in states:
                states[nxt] = len(states)
                todo.append(nxt)
            step.append(states[nxt])
            out.append(w)
    return step, out, len(states)


def hilbert_index(coords: list[Column], bits: int) -> Column:
    """Index on the curve of integer coordinates in [0, 2^bits), as a native expression."""
    dims = len(coords)
    if dims * bits > 62:
        raise ValueError("dims * bits must be at most 62")
    step, out, _ = curve_tables(dims)
    size = 1 << dims
    digits = F.array(*[sum(((F.shiftright(c.cast("int"), b).bitwiseAND(F.lit(1))) * (1 << i) for i, c in enumerate(coords)), F.lit(0)) for b in range(bits - 1, -1, -1)])
    to, digit = F.array(*map(F.lit, step)), F.array(*map(F.lit, out))

    def fold(acc: Column, cell: Column) -> Column:
        at = acc["s"] * size + cell + 1
        return F.struct(F.element_at(to, at).alias("s"), (acc["h"] * size + F.element_at(digit, at)).alias("h"))

    start = F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("h"))
    return F.aggregate(digits, start, fold, lambda acc: acc["h"])


def text_ordinal(col: Column, prefix: Column) -> Column:
    """A number that keeps the order of strings by the six bytes behind a prefix that all share."""
    rest = F.substring(F.encode(F.substring(col, F.length(prefix) + 1, F.lit(6)), "utf-8"), 1, 6)
    return F.conv(F.rpad(F.hex(rest), 12, "0"), 16, 10).cast("double")


def common_prefix(a: str, b: str) -> str:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return a[:n]


def quantised(df: DataFrame, dims: list[str], bits: int, accuracy: int = 4096) -> tuple[DataFrame, list[str]]:
    """Add a cell number in [0, 2^bits) for each dimension; null is cell 0.

    Cuts are approximate quantiles over all rows, gathered by one aggregation of bounded sketches.
    Strings count by their bytes behind the prefix that the smallest and largest value share.
    """
    kinds = dict(df.dtypes)
    texts = [c for c in dims if kinds[c] == "string"]
    prefix = {}
    if texts:
        ends = df.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(texts) for n, f in (("lo", F.min), ("hi", F.max))]).first()
        prefix = {c: common_prefix(ends[f"lo_{i}"] or "", ends[f"hi_{i}"] or "") for i, c in enumerate(texts)}
    value = {c: text_ordinal(F.col(c), F.lit(prefix[c])) if c in prefix else F.col(c).cast("double") for c in dims}
    at = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = df.agg(*[F.percentile_approx(value[c], at, accuracy).alias(f"q_{i}") for i, c in enumerate(dims)]).first()
    cells = []
    for i, c in enumerate(dims):
        edges = sorted(set(cuts[f"q_{i}"] or []))
        name = f"__cell_{i}"
        found = sum((F.when(value[c] > e, 1).otherwise(0) for e in edges), F.lit(0))
        df = df.withColumn(name, F.when(F.col(c).isNull() | F.isnan(value[c]), 0).otherwise(found))
        cells.append(name)
    return df, cells


def hilbert_shards(df: DataFrame, dims: list[str], shards: int, ties: list[str], bits: int = 5) -> DataFrame:
    """Cut `df` into `shards` runs of the curve; adds curve long, shard int and slot long.

    Row counts of any two shards differ by one at most. Rows of one cell are ordered by the hash of
    `ties` and then by `ties`, so a cell that holds a third of all rows is spread over tasks as any
    other. Rows equal in all of that are interchangeable. An empty table gives an empty result; null
    dimensions fall in cell 0. Columns named curve, shard or slot are replaced.

    Global positions come from a range partitioning: sorted partitions are checkpointed, each
    partition's offset is a running sum over partition counts (one row for each partition), and the
    position inside a partition is Spark's own row number in it. No row passes the driver.
    """
    df = df.drop("curve", "shard", "slot", "__cut", "__at", "__first")
    celled, cells = quantised(df, dims, bits)
    keyed = celled.withColumn("curve", hilbert_index([F.col(c) for c in cells], bits)).drop(*cells)
    order = ["curve", F.xxhash64(*ties), *ties]
    placed = checkpointed(keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumn("__cut", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = placed.groupBy("__cut").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)
    total = Window.orderBy("__cut").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One row for each partition of the sort, whatever the input's size.
    offsets = counts.select("__cut", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"), F.sum("__n").over(total).alias("__rows"))
    at = F.col("__first") + F.col("__at")
    shard = F.expr(f"cast((__rank * {shards}) div __rows as int)")
    first = F.expr(f"(cast(shard as bigint) * __rows + {shards - 1}) div {shards}")
    ranked = placed.join(F.broadcast(offsets), "__cut").withColumn("__rank", at).withColumn("shard", shard)
    return ranked.withColumn("slot", F.col("__rank") - first).drop("__cut", "__at", "__first", "__rows", "__rank")


def write_shards(df: DataFrame, path: str) -> None:
    """Write each shard to a folder of its own, in curve order, for pruning by file statistics."""
    df.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_ranges(df: DataFrame, dims: list[str]) -> DataFrame:
    """Value ranges of each shard: what a reader can prune by."""
    ends = [f(c).alias(f"{n}_{c}") for c in dims for n, f in (("min", F.min), ("max", F.max))]
    return df.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *ends)
