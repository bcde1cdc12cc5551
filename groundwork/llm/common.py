"""What the operators of this subpackage share: tables, splits, checkpoints and worker code."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parents[1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a data folder; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % modulus).cast("int")


def _shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a temporary one, and that on a local master only."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table as Parquet in the shared folder and read it again."""
    path = f"{_shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder of spark.checkpoint.dir."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Give executors this package where their Python path does not have it already; Spark serves the archive to them."""
    root = str(PACKAGE.parent)
    known = [os.path.realpath(p) for p in (*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()) if p]
    if os.path.realpath(root) in known or getattr(spark.sparkContext, "_groundwork_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="ship-")) / f"{PACKAGE.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in PACKAGE.rglob("*.py"):
            z.write(p, p.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(str(target))
    spark.sparkContext._groundwork_shipped = True


def slices(batches, rows: int = 512):
    """Cut Arrow batches into pieces of bounded row counts."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def bounded_sample(df: DataFrame, most: int, key: str = "doc_id", seed: int = 17) -> DataFrame:
    """About `most` rows at random, the same ones each time: rows whose key hashes below most / count.

    With no more than `most` rows every row stays. The expected size, not the exact one, is the bound.
    """
    n = df.count()
    if n <= most:
        return df
    share = int(most / n * 2**32)
    bucket = F.xxhash64(F.col(key), F.lit(seed)).bitwiseAND(F.lit(2**32 - 1))
    return df.where(bucket < share)


def set_aside(df: DataFrame, names: tuple[str, ...]) -> dict[str, str]:
    """New names for columns of `df` that an operator would replace; Spark tells no upper from lower case."""
    return {c: f"__own_{c}" for c in df.columns if c.lower() in names}


def labelled_texts(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, most: dict[int, int], longest: int) -> tuple[DataFrame, dict[int, int]]:
    """(raw, label): about most[k] texts with label k, and how many ids have each label.

    Labels other than the keys of `most` don't count, nor do null ids, ids whose labels contradict each
    other, ids without a document, null texts and texts of more than `longest` bytes. An id counts once,
    with the text of the smallest digest; equal texts count once, with the largest label. Ids are sampled
    by their hash, so their number, and with `longest` their bytes, are bounded and may be broadcast.
    """
    ids = labels.where(F.col(label).isin(*most) & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias("label"), F.max(label).alias("__other")).where("label = __other").select(key, F.col("label").cast("int").alias("label"))
    counts = {r[0]: r[1] for r in ids.groupBy("label").count().collect()}
    bucket = F.xxhash64(F.col(key), F.lit(29)).bitwiseAND(F.lit(2**32 - 1))
    keep = F.lit(False)
    for k, n in most.items():
        share = min(1.0, n / counts[k]) if counts.get(k) else 0.0
        keep = keep | ((F.col("label") == k) & (bucket < int(share * 2**32)))
    fair = docs.where(F.col(text).isNotNull() & (F.octet_length(text) <= longest)).select(F.col(key), F.encode(F.col(text), "utf-8").alias("raw"))
    found = fair.join(F.broadcast(ids.where(keep)), key)
    once = found.groupBy(key).agg(F.min(F.struct(F.md5("raw").alias("digest"), "raw")).alias("t"), F.max("label").alias("label"))
    texts = once.groupBy("t.digest").agg(F.max("label").alias("label"), F.min("t.raw").alias("raw"))
    return checkpointed(texts.select("raw", "label")), counts
