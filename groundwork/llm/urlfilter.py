"""URL filtering against a sorted array of 64-bit digests.

Each rule's key is hashed with xxhash64; the digests are sorted and memory-mapped; a url's candidate
keys (every suffix of its host with every rule-length prefix of its path) are probed by vectorised
binary search, and each hit is confirmed against the stored string, so a digest collision cannot
decide.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwork.llm.common import ship, slices

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEED = 42  # the seed of Spark's xxhash64, so that both sides hash alike


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; '' where there is none."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.lit(2**31 - 1))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.translate(host, UPPER, LOWER)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; '' where there is no `://`."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.lit(2**31 - 1))
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def candidate_keys(host: Column, path: Column, lengths: list[int], most_labels: int) -> Column:
    """Keys that a rule for this url can have, the longest first; among equals the longer host first.

    No rule's host has more than `most_labels` labels, so no longer suffix of the host can be one.
    """
    labels = F.split(F.substring_index(host, ".", -most_labels), r"\.", -1)
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cut = F.filter(F.array(*map(F.lit, lengths)), lambda n: F.length(path) >= n)
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(cut, lambda n: F.struct((-F.length(h) - n).alias("a"), (-F.length(h)).alias("b"), F.concat(h, F.substring(path, F.lit(1), n)).alias("k")))))
    return F.transform(F.array_sort(keys), lambda x: x["k"])


class DigestArray:
    """Sorted digests in a memory-mapped file, the rule of each, and the rules' full strings.

    The file is scratch of one task: it is unlinked as soon as it is made, and no other task looks for it.
    """

    def __init__(self, keys: list[str], verdicts: list[str]):
        raw = [k.encode() for k in keys]
        digest = np.array([xxhash.xxh64_intdigest(k, seed=SEED) for k in raw], dtype=np.uint64)
        order = np.argsort(digest, kind="stable")
        self.digests = digest[order].tobytes()
        self.keys, self.verdicts = [keys[i] for i in order], [verdicts[i] for i in order]

    def mapped(self) -> np.ndarray:
        if not self.digests:
            return np.empty(0, np.uint64)
        with tempfile.TemporaryFile() as f:  # unlinked at once; the mapping keeps it
            f.write(self.digests)
            f.flush()
            return np.memmap(f, dtype=np.uint64, mode="r")

    def find(self, digests: np.ndarray, keys: pa.Array, sorted_digests: np.ndarray) -> np.ndarray:
        """Index of the rule of each key, or -1; runs of equal digests are walked to the end."""
        found = np.full(len(digests), -1, dtype=np.int64)
        if not len(sorted_digests):
            return found
        left = np.searchsorted(sorted_digests, digests, "left")
        inside = left < len(sorted_digests)
        for i in np.flatnonzero(inside & (sorted_digests[np.where(inside, left, 0)] == digests)):
            at, key = left[i], keys[int(i)].as_py()
            while at < len(sorted_digests) and sorted_digests[at] == digests[i]:
                if self.keys[at] == key:
                    found[i] = at
                    break
                at += 1
        return found


def rule_key(host: str, path: str) -> str:
    """The text of a rule. A path is empty or starts with a slash."""
    if path and path[0] != "/":
        raise ValueError(f"the path of a rule starts with a slash: {path}")
    return host.translate(str.maketrans(UPPER, LOWER)) + path


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to every row.

    rules: (verdict, host, path). A rule fits its host and all subdomains if the path starts with the
    rule's path; the longest wins (host and path together, then the longer host). Of rules with the
    same text the last wins. Null urls and urls without `://` have an empty host and path and get
    `default`, as do urls that no rule fits. Columns of those four names are replaced; other columns
    and repeated rows pass through. `rules` is a list in the driver's memory and its digest array is
    broadcast; for rule tables of any size take `judge_urls_by_join`.
    """
    rules = list(rules)
    table = {rule_key(h, p): (v, len(p)) for v, h, p in rules}
    most_labels = max((h.count(".") + 1 for _, h, _ in rules), default=1)
    array = DigestArray(list(table), [v for v, _ in table.values()])
    lengths = sorted({n for _, n in table.values()}) or [0]
    spark = pages.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(array)
    base = pages.drop("host", "path", "rule", "verdict", "__k", "__d")
    ready = base.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))}).withColumn("__k", candidate_keys(F.col("host"), F.col("path"), lengths, most_labels))
    ready = ready.withColumn("__d", F.transform("__k", lambda k: F.xxhash64(k)))
    out = T.StructType(list(base.schema.fields)).add("host", "string").add("path", "string").add("rule", "string").add("verdict", "string")

    def probe(batches):
        digests = shared.value
        mapped = digests.mapped()
        for batch in slices(batches, 8192):
            d, k = batch.column("__d"), batch.column("__k")
            n = np.diff(d.offsets.to_numpy())
            flat = d.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            found = digests.find(flat, k.flatten(), mapped)
            row = np.repeat(np.arange(len(n)), n)
            hit = np.flatnonzero(found >= 0)
            rule: list = [None] * len(n)
            for i in hit[::-1]:  # candidates come the longest first, so the first hit of a row is left standing
                rule[row[i]] = found[i]
            names = pa.array([None if r is None else digests.keys[r] for r in rule], pa.string())
            verdicts = pa.array([default if r is None else digests.verdicts[r] for r in rule], pa.string())
            yield batch.drop_columns(["__k", "__d"]).append_column("rule", names).append_column("verdict", verdicts)

    return ready.mapInArrow(probe, out)


def judge_urls_by_join(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The same for a rule table (verdict, host, path) of any size, by a shuffle join on digests.

    Distinct (host, path) pairs are judged once, so that a hot host does not make a hot key; equal
    rules keep the greatest verdict. `pages` gets host, path, rule and verdict as in `judge_urls`.
    """
    host = F.translate(F.col("host"), UPPER, LOWER)
    keyed = rules.groupBy(F.concat(host, F.coalesce(F.col("path"), F.lit(""))).alias("rule")).agg(F.max("verdict").alias("verdict"), F.max(F.length(F.coalesce(F.col("path"), F.lit("")))).alias("n"))
    keyed = keyed.withColumn("__d", F.xxhash64("rule"))
    lengths = sorted(r[0] for r in keyed.select("n").distinct().collect()) or [0]  # as many as paths have lengths
    most_labels = rules.agg(F.max(F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1)).first()[0] or 1
    base = pages.drop("host", "path", "rule", "verdict").withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    asked = base.select("host", "path").distinct().select("host", "path", F.posexplode(candidate_keys(F.col("host"), F.col("path"), lengths, most_labels)).alias("pos", "k"))
    asked = asked.withColumn("__d", F.xxhash64("k"))
    hits = asked.join(keyed, (asked["__d"] == keyed["__d"]) & (asked["k"] == keyed["rule"])).groupBy("host", "path").agg(F.min_by(F.struct("rule", "verdict"), "pos").alias("__r"))
    return base.join(hits, ["host", "path"], "left").select(*base.columns, F.col("__r.rule").alias("rule"), F.coalesce("__r.verdict", F.lit(default)).alias("verdict"))


def example_rules(_: SparkSession | None = None) -> list[tuple[str, str, str]]:
    """The rules of the registered query."""
    return [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
