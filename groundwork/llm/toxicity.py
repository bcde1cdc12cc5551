"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text, in equal size. Most of
what toxic texts say is ordinary, and a dictionary of a few kilobytes trained on them whole spends
itself on that. So each is trained on the stretches of its texts whose byte grams are commoner in
texts of its own kind, behind a base that both share and that is trained on whole ordinary text. A text
is cut into windows; the difference of a window's compressed lengths says which kind it is nearer to. A
logistic model over the differences of all windows, and its threshold, are calibrated on labelled texts
that neither dictionary has seen.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwork.llm.common import labelled_texts, set_aside, ship, slices

JUNK = re.compile(rb"[\s!-/:-@\[-`{-~]+")
GRAM = 5
# A gram marks toxic text where its share of toxic texts is 10 times that of ordinary ones, and ordinary text at 1.5 times.
TOXIC_RATIO, ORDINARY_RATIO = 10.0, 1.5
LEVEL, WINDOW, SAMPLE = 12, 64, 256
BASE, OWN, SEGMENT = 32768, 4096, 24
FLUSH = 1_000_000
FEATURES = 7


def plain(raw: bytes) -> bytes:
    """Lower-case bytes with white space and ASCII marks folded to one space, in spaces."""
    return b" " + JUNK.sub(b" ", raw.decode("utf-8", "replace").lower().encode()).strip() + b" "


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    """Cut at the last space within `size` bytes, so that windows begin and end with one."""
    out, at, n = [], 0, len(text)
    while True:
        end = min(n, at + size)
        if end < n:
            space = text.rfind(b" ", at + size // 2, end)
            end = space + 1 if space > 0 else end
        out.append(text[at:end])
        if end >= n:
            return out
        at = end - 1 if text[end - 1 : end] == b" " else end


def compressor(content: bytes, level: int = LEVEL) -> zstandard.ZstdCompressor:
    kept = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters.from_level(level, source_size=2 * WINDOW, dict_size=len(content), write_content_size=0, write_checksum=0, write_dict_id=0, min_match=5)
    kept.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=kept)


@dataclass
class Dictionaries:
    """The two dictionaries' contents."""

    toxic: bytes
    ordinary: bytes

    def differences(self, raw: bytes, kept: dict) -> np.ndarray:
        """Bytes that the toxic dictionary saves, by window. kept: holds the compressors of a task."""
        if "c" not in kept:
            kept["c"] = compressor(self.ordinary).compress, compressor(self.toxic).compress
        ordinary, toxic = kept["c"]
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(plain(raw))], dtype=np.int32)


def features(d: np.ndarray) -> np.ndarray:
    """Largest saving, three largest, mean saving, and how many and which share of windows save at least 2 or 3 bytes."""
    top = np.sort(d)[-3:]
    two, three = (d >= 2).sum(), (d >= 3).sum()
    return np.array([min(top[-1], 12), min(top.sum(), 30), d.mean(), np.log1p(two), np.log1p(three), two / len(d), three / len(d)])


@dataclass
class Model:
    """Dictionaries and the calibrated weights over features; without dictionaries a constant."""

    dictionaries: Dictionaries | None
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, raw: bytes, kept: dict) -> float:
        z = self.bias
        if self.dictionaries is not None:
            z += float(((features(self.dictionaries.differences(raw, kept)) - self.mean) / self.scale) @ self.weights)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def stretches(text: bytes, grams: set[bytes] | frozenset[bytes]) -> list[bytes]:
    """Parts of a plain text that are covered by these grams, four to a sample."""
    out, start, end = [], 0, -1
    for i in range(len(text) - GRAM + 1):
        if text[i : i + GRAM] in grams:
            if i > end:
                if end > 0:
                    out.append(text[start:end])
                start = i
            end = i + GRAM
    if end > 0:
        out.append(text[start:end])
    return [b"".join(out[i : i + 4]) for i in range(0, len(out), 4)]


def gram_counts(train: DataFrame) -> DataFrame:
    """(key, a, b): in how many toxic and ordinary texts each byte gram is, counted by task first."""

    def work(batches):
        seen = Counter(), Counter()

        def out():
            keys = list(seen[0].keys() | seen[1].keys())
            for i in range(0, len(keys), 50_000):
                part = keys[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), *(pa.array([seen[k][g] for g in part], pa.int64()) for k in (1, 0))], ["key", "a", "b"])

        for batch in slices(batches, 256):
            for raw, label in zip(batch.column("raw").to_pylist(), batch.column("label").to_pylist(), strict=True):
                text = plain(raw)
                seen[label].update({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})
                if len(seen[0]) + len(seen[1]) > FLUSH:
                    yield from out()
                    seen = Counter(), Counter()
        yield from out()

    return train.mapInArrow(work, "key binary, a long, b long").groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def least_texts(n1: int, n0: int) -> int:
    """How many toxic texts a gram must be in, and no ordinary one, to be no chance find: odds of 1 in 10,000."""
    return max(3, int(np.ceil(np.log(1e-4) / np.log(n1 / (n1 + n0)))))


def marking_grams(train: DataFrame, n1: int, n0: int) -> tuple[frozenset[bytes], frozenset[bytes]]:
    """Grams that mark toxic and ordinary training texts; no more of them than the bounded sample holds."""
    p1, p0 = (F.col("a") + 0.5) / (n1 + 1), (F.col("b") + 0.5) / (n0 + 1)
    toxic = (F.col("a") >= least_texts(n1, n0)) & (p1 > TOXIC_RATIO * p0)
    ordinary = (F.col("b") >= 3) & (p0 > ORDINARY_RATIO * p1)
    rows = gram_counts(train).where(toxic | ordinary).select("key", toxic.alias("t")).collect()
    return frozenset(bytes(r[0]) for r in rows if r[1]), frozenset(bytes(r[0]) for r in rows if not r[1])


def gathered(samples: DataFrame, most_bytes: int) -> list[bytes]:
    """Samples (column s) in an order of their own hash; about `most_bytes` of them, if there are more."""
    total = samples.agg(F.sum(F.octet_length("s"))).first()[0] or 0
    if total > most_bytes:
        samples = samples.where(F.xxhash64("s", F.lit(31)).bitwiseAND(F.lit(2**32 - 1)) < int(most_bytes / total * 2**32))
    return sorted((bytes(r[0]) for r in samples.collect()), key=lambda s: (xxhash.xxh64_intdigest(s), s))


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained by zstandard; empty where the samples are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=6).as_bytes()
    except zstandard.ZstdError:
        return b""


def train_dictionaries(train: DataFrame, n1: int, n0: int, most_bytes: int) -> Dictionaries | None:
    """Dictionaries from (raw, label), of equal size; None where too little text marks toxic text.

    What the driver gathers to train on are three times at most about `most_bytes`.
    """
    grams = dict(zip((1, 0), marking_grams(train, n1, n0), strict=True))
    shared = train.sparkSession.sparkContext.broadcast(grams)

    def cut(batches, whole: bool):
        for batch in slices(batches, 64):
            for raw, label in zip(batch.column("raw").to_pylist(), batch.column("label").to_pylist(), strict=True):
                text = plain(raw)
                parts = windows(text, SAMPLE) if whole else stretches(text, shared.value[label])
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], ["s"])

    def samples(label: int, whole: bool) -> list[bytes]:
        return gathered(train.where(F.col("label") == label).mapInArrow(lambda batches: cut(batches, whole), "s binary"), most_bytes)

    toxic = trained(samples(1, False), OWN)
    if not toxic:
        return None
    plain_windows = samples(0, True)
    base = trained(plain_windows, BASE)
    ordinary = trained(samples(0, False), max(256, len(toxic))) or trained(plain_windows, max(256, len(toxic)))
    shared.unpersist()
    # A side that came out shorter gets blanks in front, where a dictionary is dearest to refer to.
    size = max(len(toxic), len(ordinary))
    return Dictionaries(base + toxic.rjust(size), base + ordinary.rjust(size))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", most_toxic: int = 1500, most_ordinary: int = 3000, longest: int = 1 << 20, most_bytes: int = 8 << 20) -> Model:
    """Train on about `most_toxic` and `most_ordinary` labelled texts of at most `longest` bytes, the bound on what fitting sees.

    Which labels and texts count is as in `common.labelled_texts`. Two thirds train the dictionaries, one
    third calibrates. The model is a constant, the smoothed share of toxic labels, where there is no toxic or
    no ordinary text, where too few toxic texts share anything that ordinary ones lack, or where no cut
    through the calibration texts is better than calling all of them toxic.
    """
    ship(docs.sparkSession)
    sample, counts = labelled_texts(docs, labels, text, key, label, {1: most_toxic, 0: most_ordinary}, longest)
    share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
    constant = Model(None, np.zeros(1), np.ones(1), np.zeros(1), float(np.log(share / (1 - share))))
    sample = sample.withColumn("hold", F.xxhash64("raw").bitwiseAND(F.lit(0xFFFF)) % 3 == 0)
    sizes = {(bool(r[0]), r[1]): r[2] for r in sample.groupBy("hold", "label").count().collect()}
    n1, n0 = sizes.get((False, 1), 0), sizes.get((False, 0), 0)
    dictionaries = train_dictionaries(sample.where(~F.col("hold")), n1, n0, most_bytes) if n1 and n0 else None
    if dictionaries is None:
        return constant

    def measured(batches):
        kept: dict = {}
        for batch in slices(batches, 256):
            rows = [features(dictionaries.differences(r, kept)).tolist() for r in batch.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column("label").cast(pa.int64())], ["x", "y"])

    seen = sample.where("hold").mapInArrow(measured, "x array<double>, y long").collect()
    if len({r[1] for r in seen}) < 2:  # too few to hold any out: the texts that trained the dictionaries
        seen = sample.mapInArrow(measured, "x array<double>, y long").collect()
    seen.sort()
    x, y = np.array([r[0] for r in seen]), np.array([r[1] for r in seen], dtype=float)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return calibrated(dictionaries, x, y, weight) or constant


def calibrated(dictionaries: Dictionaries, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Model | None:
    """Weighted logistic regression by Newton steps with a ridge; the bias then puts the best F1 at one half.

    Rows of equal score fall on one side of the cut. None where no cut beats calling every row toxic.
    """
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.diag([1.0] * x.shape[1] + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weight * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    s = z @ w
    order = np.argsort(-s)
    hits, alarms = np.cumsum((weight * y)[order]), np.cumsum((weight * (1 - y))[order])
    f1 = 2 * hits / (hits + alarms + (weight * y).sum())
    last = np.append(np.diff(s[order]) != 0, True)  # equal scores fall on one side
    k = int(np.argmax(np.where(last, f1, -1)))
    if k + 1 == len(s) or f1[k] <= f1[-1]:
        return None
    cut = (s[order][k] + s[order][k + 1]) / 2
    return Model(dictionaries, mean, scale, w[:-1], float(w[-1] - cut))


def score_toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add score (0 to 1, higher: nearer to toxic text) and predicted (1 from 0.5 on) to every row.

    Whole texts count, window by window; a very long one takes memory in proportion to itself. A null
    text counts as empty; an empty one is one blank window. Equal texts get equal scores, repeated rows
    stay, an empty table gives an empty result. Columns of those two names, in any case, are replaced,
    others pass through.
    """
    ship(docs.sparkSession)
    base = docs.drop("score", "predicted")
    schema = T.StructType(list(base.schema.fields)).add("score", "double").add("predicted", "integer")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        kept: dict = {}
        for batch in slices(batches, 256):
            scores = np.array([shared.value.score(raw or b"", kept) for raw in batch.column(text).cast(pa.binary()).to_pylist()])
            yield batch.append_column("score", pa.array(scores, pa.float64())).append_column("predicted", pa.array(scores >= 0.5).cast(pa.int32()))

    return base.mapInArrow(work, schema)


def drop_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Rows of `docs` that aren't predicted toxic, with their own columns and values only, whatever their names."""
    names = set_aside(docs, ("score", "predicted"))
    kept = score_toxicity(docs.withColumnsRenamed(names), model, text).where("predicted = 0")
    return kept.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])
