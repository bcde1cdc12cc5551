"""Near-duplicate classes by ProbMinHash signatures, banding and exact verification.

A text is a set of five-word shingles. Each shingle sends points by a Poisson process to random
signature positions; the first point of a position wins, and a shingle stops once it is later than all
positions. Two signatures agree in a position with the probability Jaccard similarity of the sets. The
rate of the process is a shingle's weight, and all weigh alike however often they occur, so that what
signatures estimate is the Jaccard similarity that links are tested for. Texts that agree in a whole
band are candidates, and a link is a pair whose shingle sets have a Jaccard similarity of at least the
threshold, counted on 32-bit hashes of the shingles (two texts of 1,000 shingles each have one more in
common by chance in 1 of 4,000 cases). Classes are connected components of links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwork.llm.common import checkpointed, ship, slices
from groundwork.llm.decontam import FOLD

BANDS, ROWS = 25, 5
POSITIONS = 512
SKETCH = POSITIONS // 16  # longs of sixteen 4-bit values
# Agreeing 4-bit values that a pair at 0.8 falls short of with a chance of about 3 in 100,000 (four standard
# deviations), as often as it shares no band.
AGREE = 381
STAR_ROUNDS = 2
SMALL, BLOCK = 64, 512
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


FACTORS = mix(np.arange(1, 65, dtype=np.uint64)) | U(1)


def hashed_words(folded: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of folded bytes (decontam.FOLD), and where each begins."""
    code = np.frombuffer(folded, np.uint8)
    inside = code != 32
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at, first = np.flatnonzero(inside), np.flatnonzero(begins)
    if not len(first):
        return np.empty(0, np.uint64), first
    place = at - np.repeat(first, np.diff(np.append(np.flatnonzero(begins[at]), len(at))))
    letters = mix((place.astype(np.uint64) << U(8)) + code[at] + U(1))
    return mix(np.add.reduceat(letters, np.flatnonzero(begins[at]))), first


def word_hashes(texts: list[bytes], piece: int = 1 << 18) -> list[np.ndarray]:
    """Word hashes of each text. Short texts are hashed many at a time, long ones in pieces of about `piece` bytes."""
    out: list[np.ndarray] = []
    held: list[bytes] = []

    def flush():
        if held:
            h, first = hashed_words(b" ".join(held))
            ends = np.cumsum([len(t) + 1 for t in held])
            out.extend(np.split(h, np.searchsorted(first, ends[:-1])))
            held.clear()

    size = 0
    for raw in texts:
        folded = raw.translate(FOLD)
        if len(folded) <= piece:
            if size + len(folded) > piece:
                flush()
                size = 0
            held.append(folded)
            size += len(folded)
            continue
        flush()
        size, at, parts = 0, 0, []
        while at < len(folded):
            end = folded.find(b" ", at + piece)  # never inside a word
            end = len(folded) if end < 0 else end
            parts.append(hashed_words(folded[at:end])[0])
            at = end
        out.append(np.concatenate(parts))
    flush()
    return out


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Distinct shingle hashes of a text's word hashes; a text of fewer words, but not none, is one shingle."""
    if not len(h):
        return h
    size = min(width, len(h))
    n = len(h) - size + 1
    total = np.full(n, size, np.uint64)
    for j in range(size):
        total += h[j : j + n] * FACTORS[j]
    return np.unique(mix(total))


def signature(elements: np.ndarray, weights: np.ndarray, positions: int = POSITIONS) -> np.ndarray:
    """ProbMinHash: the element whose point comes first, for each position.

    Points are made in rounds of several arrivals for each element that can still matter.
    """
    first = np.full(positions, np.inf)
    won = np.zeros(positions, np.uint64)
    active, rate, at = elements, weights, np.zeros(len(elements))
    made = 0
    while len(active):
        n = max(1, -(-int(7 * positions) // len(active))) if made == 0 else 4
        serial = mix(np.arange(made + 1, made + n + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
        random = mix(active[:, None] ^ serial[None, :])
        gap = -np.log(((random >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[:, None]
        time = at[:, None] + np.cumsum(gap, axis=1)
        place = (mix(random) % U(positions)).astype(np.int64).ravel()
        flat = time.ravel()
        early = np.flatnonzero(flat < first[place])
        early = early[np.argsort(-flat[early], kind="stable")]  # of points of one position the earliest is written last
        first[place[early]] = flat[early]
        won[place[early]] = active[early // n]
        at, made = time[:, -1], made + n
        stay = at < first.max()  # early termination
        active, rate, at = active[stay], rate[stay], at[stay]
    return won


def band_keys(won: np.ndarray) -> np.ndarray:
    part = mix(won[: BANDS * ROWS].reshape(BANDS, ROWS) + FACTORS[None, :ROWS])
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key = mix(key * U(0x9E3779B97F4A7C15) + part[:, j])
    return key.view(np.int64)


def sketch_of(won: np.ndarray) -> np.ndarray:
    nibbles = (mix(won + U(1)) & U(15)).reshape(SKETCH, 16)
    return np.bitwise_or.reduce(nibbles << (np.arange(16, dtype=np.uint64) * U(4))[None, :], axis=1).view(np.int64)


def agreeing(a: str, b: str) -> Column:
    """How many 4-bit values of two sketches agree, as a native expression."""
    total = F.lit(0)
    for i in range(SKETCH):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        total = total + 16 - F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def text_digest(text: str) -> Column:
    return F.unhex(F.md5(F.encode(F.col(text), "utf-8")))


def distinct_texts(docs: DataFrame, text: str, key: str, width: int) -> DataFrame:
    """(node, digest, doc, bands, sketch): one row for each different text; doc is its smallest key.

    Only digests, keys and signatures are shuffled. Texts without a word have no bands.
    """
    ship(docs.sparkSession)
    chosen = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc"), text_digest(text).alias("digest"), F.col(text).alias("t"))
    schema = T.StructType([chosen.schema["doc"], chosen.schema["digest"]]).add("bands", T.ArrayType(T.LongType())).add("sketch", T.ArrayType(T.LongType()))
    longs = pa.list_(pa.int64())

    def work(batches):
        for batch in slices(batches, 1024):
            raws = batch.column("t").cast(pa.binary()).to_pylist()
            seen: dict[bytes, tuple] = dict.fromkeys(raws, ((), ()))
            for raw, h in zip(seen, word_hashes(list(seen)), strict=True):
                e = shingles(h, width)
                if len(e):
                    won = signature(e, np.ones(len(e)))
                    seen[raw] = band_keys(won), sketch_of(won)
            rows = [seen[raw] for raw in raws]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("digest"), pa.array([r[0] for r in rows], longs), pa.array([r[1] for r in rows], longs)], ["doc", "digest", "bands", "sketch"])

    signed = chosen.mapInArrow(work, schema)
    one = signed.groupBy("digest").agg(F.min("doc").alias("doc"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
    return checkpointed(one.withColumn("node", F.monotonically_increasing_id()))


def shingle_sets(docs: DataFrame, wanted: DataFrame, text: str, key: str, width: int) -> DataFrame:
    """(node, s): sorted 32-bit shingle hashes of the wanted (node, digest, doc), each text read once.

    Joined on digest and key together, so that many copies of one text don't meet in one task.
    """
    chosen = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc"), text_digest(text).alias("digest"), F.col(text).alias("t"))
    found = chosen.alias("a").join(wanted.alias("b"), (F.col("a.digest") == F.col("b.digest")) & F.col("a.doc").eqNullSafe(F.col("b.doc"))).select("node", "t")

    def work(batches):
        for batch in slices(batches, 256):
            sets = [np.unique((shingles(h, width) >> U(32)).astype(np.uint32)).tobytes() for h in word_hashes(batch.column("t").cast(pa.binary()).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "s"])

    return found.mapInArrow(work, "node long, s binary").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of (a, b) those whose sets have at least this Jaccard similarity, with it."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").select("a", "b", "sa", "sb")

    def work(batches):
        for batch in slices(batches, 256):
            keep, sims = [], []
            raw_a = set_a = None
            for i, (x, y) in enumerate(zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)):
                if x != raw_a:
                    raw_a, set_a = x, np.frombuffer(x, np.uint32)
                b = np.frombuffer(y, np.uint32)
                small, large = sorted((len(set_a), len(b)))
                if small < threshold * large:
                    continue
                merged = np.concatenate((set_a, b))
                merged.sort(kind="mergesort")
                common = int((merged[1:] == merged[:-1]).sum())
                sim = common / (small + large - common)
                if sim >= threshold:
                    keep.append(i)
                    sims.append(sim)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at), pa.array(sims, pa.float64())], ["a", "b", "similarity"])

    return both.mapInArrow(work, "a long, b long, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of (a, b) edges is connected with.

    Each round takes the smallest label among neighbours and then the label's own label, until none
    changes; rounds are cut by checkpoints, and only a count comes to the driver.
    """
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = lower.alias("x").join(labels.select(F.col("node").alias("label"), F.col("label").alias("up")), "label", "left")
        nxt = checkpointed(jump.select("node", "was", F.least("label", F.coalesce("up", "label")).alias("label")))
        if not nxt.where("label < was").limit(1).count():
            return nxt.select("node", "label")
        labels = nxt.select("node", "label")


def bucket_members(nodes: DataFrame) -> DataFrame:
    """(key, node, weight) of buckets with more than one text; weight: how many texts all buckets of the node hold."""
    members = nodes.select("node", F.explode("bands").alias("key"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = checkpointed(members.join(sizes, "key"))
    weights = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    return checkpointed(shared.select("key", "node").join(weights, "node"))


def mixed_buckets(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(key, node, weight, label) of buckets that hold more than one component."""
    if labels is None:
        return buckets.withColumn("label", F.col("node"))
    marked = buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = marked.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    return checkpointed(marked.join(mixed, "key", "left_semi"))


def star_pairs(open_: DataFrame, used: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Pairs of each bucket's heaviest node that wasn't its hub before with the nodes of other components; (key, hub)."""
    rest = open_ if used is None else open_.join(used.select("key", F.col("hub").alias("node")), ["key", "node"], "left_anti")
    hubs = rest.groupBy("key").agg(F.max(F.struct("weight", "node", "label")).alias("h")).select("key", F.col("h.node").alias("hub"), F.col("h.label").alias("hub_label"))
    met = open_.join(hubs, "key").where(F.col("label") != F.col("hub_label"))
    pairs = met.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
    return pairs, hubs.select("key", "hub")


def sketched(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose sketches agree often enough to be worth counting."""
    k = nodes.select("node", "sketch")
    both = pairs.join(k.select(F.col("node").alias("b"), F.col("sketch").alias("kb")), "b").join(k.select(F.col("node").alias("a"), F.col("sketch").alias("ka")), "a")
    return both.where(agreeing("ka", "kb") >= AGREE).select("a", "b")


def crossing_pairs(open_: DataFrame) -> DataFrame:
    """(a, b): pairs of a bucket (key, node, label, sketch, bands) across components whose sketches agree often enough.

    Small buckets join with themselves. Large ones are cut in blocks of about BLOCK texts, and each pair
    of blocks is compared by one task's arrays, so that only what agrees becomes a row, and that in the
    first band alone that the two texts share.
    """
    sized = open_.join(open_.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")
    small = sized.where(F.col("n") <= SMALL)
    left = small.select("key", F.col("node").alias("a"), F.col("label").alias("la"), F.col("sketch").alias("ka"))
    right = small.select("key", F.col("node").alias("b"), F.col("label").alias("lb"), F.col("sketch").alias("kb"))
    near = left.join(right, "key").where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & (agreeing("ka", "kb") >= AGREE)).select("a", "b")
    blocks = F.ceil(F.col("n") / BLOCK)
    large = sized.where(F.col("n") > SMALL).withColumn("own", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    dealt = large.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label", "sketch", "bands")

    def compare(part: pa.Table) -> pa.Table:
        node, label, own = (part.column(c).to_numpy() for c in ("node", "label", "own"))
        raw = part.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint8).reshape(len(node), -1)
        values = np.hstack((raw & 15, raw >> 4))
        bands = part.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        band = int(np.flatnonzero(bands[0] == part.column("key")[0].as_py())[0])
        i, j = part.column("i")[0].as_py(), part.column("j")[0].as_py()
        rows, others = np.flatnonzero(own == i), np.flatnonzero(own == j)
        a, b = [], []
        for r in rows:
            with_ = others[(node[others] > node[r]) & (label[others] != label[r])] if i == j else others[label[others] != label[r]]
            if len(with_):
                hit = with_[np.count_nonzero(values[with_] == values[r], axis=1) >= AGREE]
                hit = hit[(bands[hit] == bands[r]).argmax(axis=1) == band]
                a.append(np.minimum(node[r], node[hit]))
                b.append(np.maximum(node[r], node[hit]))
        none = [np.empty(0, np.int64)]
        return pa.table({"a": np.concatenate(none + a), "b": np.concatenate(none + b)})

    return near.unionByName(dealt.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long"))


def duplicate_classes(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """(digest, class_id, first_digest): the class of each different text.

    class_id is the smallest key of a class (null keys last), first_digest tells texts of that key
    apart. In each bucket the text that shares most buckets with others, the likely original of a group,
    is verified against all, which joins groups of thousands by as many pairs; STAR_ROUNDS such
    rounds go over the buckets that still hold several components. In the end all pairs of such
    buckets across components are verified, so no link is lost, and pairs inside a component are
    never made.
    """
    nodes = distinct_texts(docs, text, key, width)
    buckets = bucket_members(nodes)
    in_buckets = buckets.select("node").distinct()
    sets = checkpointed(shingle_sets(docs, nodes.join(in_buckets, "node", "left_semi").select("node", "digest", "doc"), text, key, width))
    links = tested = labels = used = None
    for _ in range(STAR_ROUNDS):
        open_ = mixed_buckets(buckets, labels)
        pairs, hubs = star_pairs(open_, used)
        pairs = checkpointed(sketched(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), nodes))
        found = checkpointed(verified(pairs, sets, threshold).select("a", "b"))
        used = checkpointed(hubs) if used is None else checkpointed(used.union(hubs))
        tested = pairs if tested is None else tested.union(pairs)
        links = found if links is None else links.union(found)
        labels = components(links)

    open_ = checkpointed(mixed_buckets(buckets, labels).join(nodes.select("node", "sketch", "bands"), "node").select("key", "node", "label", "sketch", "bands"))
    crossing = crossing_pairs(open_)
    rest = crossing.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti")
    more = checkpointed(verified(rest, sets, threshold).select("a", "b"))
    if more.limit(1).count():
        labels = components(links.union(more))

    placed = nodes.select("node", "digest", "doc").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # Null keys come last; of equal keys the smaller digest stands for the class.
    lead = placed.groupBy("label").agg(F.min(F.struct(F.col("doc").isNull().alias("no"), "doc", F.hex("digest").alias("digest"))).alias("lead"))
    return placed.join(lead, "label").select("digest", F.col("lead.doc").alias("class_id"), F.unhex("lead.digest").alias("first_digest"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row for each row of `docs`: its key, class_id and kept (it stands for its class).

    Words are runs of a-z, 0-9 and all beyond ASCII, A-Z folded. Equal texts are always in one class,
    also texts without a word; a text of one to four words is one shingle. A null text is a class of
    its own, named by its key, and kept. Repeated rows of the leading text are all marked kept;
    `drop_near_duplicates` leaves one of them. Any table size works, the empty one too.
    """
    classes = duplicate_classes(docs, text, key, width, threshold)
    rows = docs.where(F.col(text).isNotNull()).select(key, text_digest(text).alias("digest"))
    told = rows.join(classes, "digest").select(key, "class_id", (F.col(key).eqNullSafe(F.col("class_id")) & (F.col("digest") == F.col("first_digest"))).alias("kept"))
    alone = docs.where(F.col(text).isNull()).select(key, F.col(key).alias("class_id"), F.lit(True).alias("kept"))
    return told.unionByName(alone)


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row of each class, with the columns of `docs`; rows with a null text stay."""
    classes = duplicate_classes(docs, text, key, width, threshold)
    lead = checkpointed(classes.where(F.col("digest") == F.col("first_digest")).select(F.col("class_id").alias("__k"), F.col("digest").alias("__d")))
    rows = docs.withColumn("__d", text_digest(text)).alias("r")
    kept = rows.where(F.col(text).isNotNull()).join(lead.alias("l"), (F.col("r.__d") == F.col("l.__d")) & F.col(f"r.{key}").eqNullSafe(F.col("l.__k")))
    kept = kept.select(*[F.col(f"r.{c}") for c in docs.columns], F.col("r.__d").alias("__d"))
    repeated = docs.where(F.col(text).isNotNull()).groupBy(key, text_digest(text)).count().where("count > 1").limit(1).count()
    if repeated:
        kept = kept.dropDuplicates([key, "__d"])
    return kept.drop("__d").unionByName(docs.where(F.col(text).isNull()))
