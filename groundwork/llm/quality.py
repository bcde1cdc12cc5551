"""Quality by Bradley-Terry ranking: the chance that one text is preferred to another is the logistic
function of the difference of their scores, and scores are linear in text features. The cut between
good and bad is a quantile of the scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwork.llm.common import checkpointed, ship, slices

CLASSES = 8
CLASS = np.full(256, 7, np.int64)  # 7: any other ASCII mark or control
CLASS[list(b"abcdefghijklmnopqrstuvwxyz")] = 0
CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
CLASS[list(b"0123456789")] = 2
CLASS[list(b" \t\r\n")] = 3
CLASS[list(b".,;:'\"()-?")] = 4
CLASS[list(b"!")] = 5
CLASS[128:] = 6
SIMPLE = 16
FEATURES = 2 * SIMPLE
ROUNDS = 10  # how often each text of the commoner label is paired
PART_ROWS, LEAST_RARER = 1 << 16, 2048  # texts of the commoner label in a part, and of the rarer one if there are so many
QUANTILES = np.arange(0.005, 1.0, 0.005)


def simple_features(raw: bytes) -> np.ndarray:
    """Shares of byte classes, word and line statistics, and sizes; an empty text is all zero but the bias of none."""
    if not raw:
        return np.zeros(SIMPLE)
    counts = np.bincount(CLASS[np.frombuffer(raw, np.uint8)], minlength=CLASSES)
    share = counts / len(raw)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, m = max(1, len(words)), max(1, len(lines))
    return np.array([
        *share, np.log1p(len(words)), len(raw) / n / 10, len(set(words)) / n, len(set(lines)) / m, np.log1p(m), np.log1p(n / m),
        sum(w.isupper() for w in words) / n, sum(raw.count(x) for x in (b"http", b"www.", b"@", b"</", b"|")) / n,
    ])


def features(raw: bytes) -> np.ndarray:
    x = simple_features(raw)
    return np.concatenate([x, x * x])


@dataclass
class Model:
    """score = logistic(slope * (s - cut) + logit(threshold)), s linear in the standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float
    offset: float

    def score(self, x: np.ndarray) -> np.ndarray:
        s = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * (s - self.cut) + self.offset, -30, 30)))


def preference_pairs(y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most `most` pairs (preferred, other): each round pairs the larger class once around with the other, shuffled."""
    rng = np.random.default_rng(7)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    a, b = [], []
    size = max(len(good), len(bad))
    for _ in range(min(20, max(1, most // max(1, size)))):
        a.append(np.resize(rng.permutation(good), size))
        b.append(np.resize(rng.permutation(bad), size))
    return np.concatenate(a)[:most], np.concatenate(b)[:most]


def newton(sums, width: int) -> np.ndarray:
    """Weights of the most likely ridge model; `sums` gives gradient, curvature and number of pairs at given weights."""
    w = np.zeros(width)
    for _ in range(40):
        gradient, curvature, n = sums(w)
        ridge = 1e-3 * n * np.eye(width)
        step = np.linalg.solve(curvature + ridge, gradient - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def pair_sums(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Gradient, curvature and number of pairs; d is preferred less other."""
    p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
    return d.T @ (1 - p), (d * (p * (1 - p))[:, None]).T @ d, len(d)


def rank_model(x: np.ndarray, y: np.ndarray, weight: np.ndarray, threshold: float, most_pairs: int) -> Model:
    """`fit` for texts in memory: scores by preference pairs, and the cut at the score quantile of the best balanced accuracy."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.clip((x - mean) / scale, -8, 8)
    good, bad = preference_pairs(y, most_pairs)
    d = z[good] - z[bad]
    w = newton(lambda w: pair_sums(d, w), x.shape[1])
    s = z @ w
    order = np.argsort(s)
    below = np.cumsum(weight[order]) / weight.sum()
    best, cut = -1.0, 0.0
    for q in QUANTILES:
        t = s[order][min(len(s) - 1, int(np.searchsorted(below, q)))]
        gain = ((s >= t) & (y == 1)).sum() / max(1, (y == 1).sum()) + ((s < t) & (y == 0)).sum() / max(1, (y == 0).sum())
        if gain > best + 1e-12:
            best, cut = gain, t
    under = s[s < cut]
    cut = (cut + under.max()) / 2 if len(under) else cut
    return Model(mean, scale, w, float(cut), 1.0, float(np.log(threshold / (1 - threshold))))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)


def _partial(df: DataFrame, work, fields: str) -> list:
    """One row of sums from each task that has rows."""
    return df.mapInArrow(work, fields).collect()


def labelled_features(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str) -> DataFrame:
    """(digest, y, x): features of every text with a label of 0 or 1.

    Null ids, ids whose labels contradict each other, and null texts don't count. An id counts once, with the
    text of the smallest digest; equal texts count once, with the largest label. Features are made where
    the text is, so no text is moved.
    """
    ids = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias("y"), F.max(label).alias("__other")).where("y = __other").select(F.col(key).alias("k"), F.col("y").cast("int").alias("y"))
    raw = F.encode(F.col(text), "utf-8")
    texts = docs.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.md5(raw).alias("digest"), raw.alias("raw"))

    def work(batches):
        for batch in slices(batches, 256):
            rows = [features(r).tolist() for r in batch.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("digest"), pa.array(rows, pa.list_(pa.float64()))], ["k", "digest", "x"])

    made = texts.mapInArrow(work, T.StructType([texts.schema["k"], texts.schema["digest"]]).add("x", T.ArrayType(T.DoubleType())))
    once = made.join(ids, "k").groupBy("k").agg(F.min(F.struct("digest", "x")).alias("t"), F.max("y").alias("y"))
    return checkpointed(once.groupBy("t.digest").agg(F.max("y").alias("y"), F.min("t.x").alias("x")))


def _moments(seen: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of each feature over all texts."""

    def work(batches):
        n, total, square = 0, np.zeros(FEATURES), np.zeros(FEATURES)
        for batch in slices(batches, 4096):
            x = _matrix(batch)
            if len(x):
                mean = x.mean(0)
                square += ((x - mean) ** 2).sum(0) + (n * len(x) / (n + len(x)) * (mean - total / n) ** 2 if n else 0)
                total += x.sum(0)
                n += len(x)
        if n:
            yield pa.RecordBatch.from_pylist([{"n": n, "total": total.tolist(), "square": square.tolist()}])

    rows = _partial(seen.select("x"), work, "n long, total array<double>, square array<double>")
    n = sum(r["n"] for r in rows)
    mean = sum(np.array(r["total"]) for r in rows) / n
    square = sum(np.array(r["square"]) + r["n"] * (np.array(r["total"]) / r["n"] - mean) ** 2 for r in rows)
    return mean, np.sqrt(square / n) + 1e-9


def _dealt(seen: DataFrame, rarer: int, n_rarer: int, n_other: int) -> DataFrame:
    """(rarer, x): texts dealt to parts, the rarer label's first; where it has few texts, each of them comes to several parts or all."""
    parts = -(-n_other // PART_ROWS)
    copies = min(parts, -(-parts * LEAST_RARER // n_rarer))
    home = F.pmod(F.xxhash64("digest"), F.lit(parts)).cast("int")
    part = F.when(F.col("y") == rarer, F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda j: F.pmod(home + j, F.lit(parts)))).otherwise(F.array(home))
    placed = seen.select("digest", "x", (F.col("y") == rarer).alias("rarer"), F.explode(part).alias("part"))
    return checkpointed(placed.repartition(parts, "part").sortWithinPartitions("part", F.desc("rarer"), "digest").select("part", "rarer", "x"))


def _weights(dealt: DataFrame, mean: np.ndarray, scale: np.ndarray, sign: int) -> np.ndarray:
    """Weights by preference pairs of all texts: in each part and round, the larger label is paired once around with the other, shuffled."""

    def at(w):
        def work(batches):
            sums = [np.zeros(FEATURES), np.zeros((FEATURES, FEATURES)), 0]
            part, rare, turns, held, n = None, [], None, [], 0

            def add(other, those):
                for turn in turns:
                    for k, v in enumerate(pair_sums(sign * (other - rare[turn[those]]), w)):
                        sums[k] = sums[k] + v

            def close():
                if n and n < len(rare):  # fewer of the other label here: these go around
                    rest = np.arange(n, len(rare))
                    add(np.concatenate(held)[rest % n], rest)

            for batch in slices(batches, 4096):
                parts, flags = batch.column("part").to_numpy(), batch.column("rarer").to_numpy(zero_copy_only=False)
                z = np.clip((_matrix(batch) - mean) / scale, -8, 8)
                for p in np.unique(parts):
                    here = parts == p
                    if p != part:
                        close()
                        part, rare, turns, held, n = p, np.empty((0, FEATURES)), None, [], 0
                    rare = np.concatenate((rare, z[here & flags]))
                    other = z[here & ~flags]
                    if len(other) and len(rare):
                        if turns is None:
                            rng = np.random.default_rng(7 + int(p))
                            turns = [rng.permutation(len(rare)) for _ in range(ROUNDS)]
                        if n < len(rare):
                            held.append(other)
                        add(other, (n + np.arange(len(other))) % len(rare))
                        n += len(other)
            close()
            if sums[2]:
                yield pa.RecordBatch.from_pylist([{"g": sums[0].tolist(), "h": sums[1].ravel().tolist(), "n": int(sums[2])}])

        rows = _partial(dealt, work, "g array<double>, h array<double>, n long")
        return sum(np.array(r["g"]) for r in rows), sum(np.array(r["h"]) for r in rows).reshape(FEATURES, FEATURES), sum(r["n"] for r in rows)

    return newton(at, FEATURES)


def _cut(seen: DataFrame, model: Model, n: dict[int, int]) -> float:
    """The score quantile, of all texts, of the best balanced accuracy, halfway to the next lower score."""

    def score(batches):
        for batch in slices(batches, 4096):
            s = np.clip((_matrix(batch) - model.mean) / model.scale, -8, 8) @ model.weights
            yield pa.RecordBatch.from_arrays([pa.array(s), batch.column("y")], ["s", "y"])

    scored = seen.select("x", "y").mapInArrow(score, "s double, y int")
    ranged = checkpointed(scored.repartitionByRange("s").sortWithinPartitions("s").withColumn("p", F.spark_partition_id()))
    sizes = sorted(ranged.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("good"), F.max("s").alias("high")).collect())
    total = n[0] + n[1]
    ranks = sorted({min(total - 1, int(np.ceil(q * total - 1e-9)) - 1) for q in QUANTILES} - {-1}) or [0]
    before, rows_before, good_before, high = {}, 0, 0, None
    for r in sizes:
        before[r["p"]] = (rows_before, good_before, high)
        rows_before, good_before, high = rows_before + r["n"], good_before + r["good"], r["high"]

    def work(batches):
        parts = [(b.column("s").to_numpy(), b.column("y").to_numpy(), b.column("p")[0].as_py()) for b in batches if b.num_rows]
        if not parts:
            return
        s, y = (np.concatenate(x) for x in list(zip(*parts, strict=True))[:2])
        rows, good, lower = before[parts[0][2]]
        goods = np.concatenate(([0], np.cumsum(y)))
        for rank in ranks:
            if rows <= rank < rows + len(s):
                t = s[rank - rows]
                i = int(np.searchsorted(s, t))  # the first with this score
                under = good + int(goods[i])
                gain = (n[1] - under) / n[1] + (rows + i - under) / n[0]
                yield pa.RecordBatch.from_pylist([{"t": float(t), "gain": float(gain), "lower": float(s[i - 1]) if i else lower}], pa.schema([("t", pa.float64()), ("gain", pa.float64()), ("lower", pa.float64())]))

    best, cut = -1.0, 0.0
    for r in sorted(ranged.mapInArrow(work, "t double, gain double, lower double").collect(), key=lambda r: r["t"]):
        if r["gain"] > best + 1e-12:
            best, cut = r["gain"], r["t"] if r["lower"] is None else (r["t"] + r["lower"]) / 2
    return cut


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", threshold: float = 0.7) -> Model:
    """Learn from every labelled text; which labels and texts count is told in `labelled_features`.

    Mean, spread, weights and cut come from all of them, as sums of tasks; only sums come to the driver. With one
    class only, every score is the threshold's side of that class.
    """
    ship(docs.sparkSession)
    seen = labelled_features(docs, labels, text, key, label)
    n = {r["y"]: r["n"] for r in seen.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    offset = float(np.log(threshold / (1 - threshold)))
    if len(n) < 2:
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 5.0 if 0 in n else 0.0, 1.0, offset)
    mean, scale = _moments(seen)
    rarer = 0 if n[0] <= n[1] else 1
    w = _weights(_dealt(seen, rarer, n[rarer], n[1 - rarer]), mean, scale, 1 if rarer == 0 else -1)
    model = Model(mean, scale, w, 0.0, 1.0, offset)
    model.cut = float(_cut(seen, model, n))
    return model


def score_quality(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Add score (0 to 1, higher: better) and predicted (1 from `threshold` on) to every row.

    Whole texts count; null counts as empty. Equal texts get equal scores. Columns of those two names
    are replaced, others pass through.
    """
    ship(docs.sparkSession)
    base = docs.drop("score", "predicted")
    schema = T.StructType(list(base.schema.fields)).add("score", "double").add("predicted", "integer")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for batch in slices(batches, 256):
            # One row at a time: equal texts must get the same last digit whatever stands beside them.
            scores = np.array([float(shared.value.score(features(raw or b""))) for raw in batch.column(text).cast(pa.binary()).to_pylist()])
            yield batch.append_column("score", pa.array(scores, pa.float64())).append_column("predicted", pa.array(scores >= threshold).cast(pa.int32()))

    return base.mapInArrow(work, schema)
