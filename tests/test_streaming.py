"""Streams give what the batch operators give."""

import datetime as dt
import os
import shutil

import pytest
from pyspark.sql import functions as F

from groundwork.operators import drift, kpi
from groundwork.plans.fixtures import polls
from groundwork.sources.files import stream_parquet, table
from groundwork.streaming import state as S
from tests.compare import ordered


@pytest.fixture(scope="module")
def landed(spark, sf_dir, tmp_path_factory):
    """Events in four files, in time order."""
    folder = str(tmp_path_factory.mktemp("events"))
    e = table(spark, sf_dir, "events").withColumn("part", F.ntile(4).over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("ts", "event_id")))
    for i in range(1, 5):
        e.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(folder)
    return folder


def stream(spark, landed):
    schema = spark.read.parquet(landed).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landed)


@pytest.fixture(scope="module", autouse=True)
def on_disk(spark):
    S.keep_state_on_disk(spark)
    yield
    for name in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"):
        spark.conf.unset(name)


def in_two_runs(spark, landed, tmp_path, start):
    """Half of the files, then a new query from the same checkpoint over all."""
    files = sorted(p for p in os.listdir(landed) if p.endswith(".parquet"))
    files.sort(key=lambda p: spark.read.parquet(f"{landed}/{p}").agg(F.min("ts")).first()[0])
    here = tmp_path / "in"
    here.mkdir()
    schema = spark.read.parquet(landed).schema
    for k, some in enumerate((files[:2], files[2:])):
        for i, name in enumerate(some):
            shutil.copy(f"{landed}/{name}", here / name)
            os.utime(here / name, (1_000_000 + 100 * (2 * k + i),) * 2)
        start(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(here))).awaitTermination()


def test_latest_kpi(spark, sf_dir, landed, tmp_path):
    ready = lambda e: polls(e).where("outcome <> 'failed'").select("source", "metric", "value", F.col("at").alias("fetched_at"), "id")
    out = str(tmp_path / "o")
    in_two_runs(spark, landed, tmp_path, lambda e: S.write_updates(S.latest_kpi(ready(e)), out, str(tmp_path / "c")))
    want = kpi.latest_kpi(ready(table(spark, sf_dir, "events")))
    told = spark.read.parquet(out)
    cols = ["source", "metric", "value", "fetched_at"]
    assert ordered(kpi.latest_kpi(told.drop("batch")).select(*cols).collect()) == ordered(want.select(*cols).collect())
    # Each batch holds what it changed, and no more.
    assert told.select("batch").distinct().count() == 4
    assert all(r.n <= want.count() for r in told.groupBy("batch").agg(F.count("*").alias("n")).collect())


def test_poll_health(spark, sf_dir, landed, tmp_path):
    out = str(tmp_path / "o")
    in_two_runs(spark, landed, tmp_path, lambda e: S.append(S.poll_health(polls(e)), out, str(tmp_path / "c")))
    got = spark.read.parquet(out)
    assert got.where("late").count() == 0
    newest = got.groupBy("source").agg(F.max_by(F.struct("ok", "consecutive_failures", "last_success"), F.struct("at", "id")).alias("r")).select("source", "r.*")
    want = kpi.latest_health(polls(table(spark, sf_dir, "events")))
    assert ordered(newest.collect()) == ordered(want.select(*newest.columns).collect())
    # Every row is the health that the batch operator has after that poll.
    history = kpi.poll_health(polls(table(spark, sf_dir, "events")))
    names = ["source", "at", "id", "ok", "consecutive_failures", "last_success"]
    assert got.count() > want.count() and got.select(*names).exceptAll(history.select(*names)).count() == 0


def test_late_polls_change_nothing(spark, tmp_path):
    s = "source long, at timestamp_ntz, id long, outcome string"
    at = lambda h: dt.datetime(2026, 1, 1, h)
    batches = [[(1, at(2), 1, "ok"), (1, at(3), 2, "failed"), (1, at(4), 3, "failed")], [(1, at(1), 9, "ok"), (1, at(4), 3, "failed"), (1, at(5), 4, "degraded")], [(1, at(6), 5, "failed"), (1, at(0), 7, "failed")]]
    told = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, s).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = S.append(S.poll_health(spark.readStream.schema(s).parquet(str(tmp_path / "in"))), str(tmp_path / "o"), str(tmp_path / "c"))
        q.awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "o")).collect()
        told.append(sorted(((r.at.hour, r.ok, r.consecutive_failures, r.last_success and r.last_success.hour, r.late) for r in rows), key=lambda t: (t[4], t[0])))
        assert len(rows) == [1, 4, 6][i]
    assert [r for r in told[-1] if not r[4]] == [(4, False, 2, 2, False), (5, False, 2, 2, False), (6, False, 3, 2, False)]
    assert sorted(r[0] for r in told[-1] if r[4]) == [0, 1, 4]


def test_new_findings(spark, sf_dir, landed, tmp_path):
    found = lambda e: e.select(F.concat(F.lit("u"), F.col("user_id") % 20).alias("slug"), F.col("event_type").alias("fingerprint"), F.col("ts").alias("detected_at"))
    known = spark.createDataFrame([("u3", "view")], "slug string, fingerprint string")
    out = str(tmp_path / "o")
    in_two_runs(spark, landed, tmp_path, lambda e: S.append(S.new_findings(found(e), known), out, str(tmp_path / "c")))
    want = drift.dedup_findings(found(table(spark, sf_dir, "events")), known)
    assert ordered(spark.read.parquet(out).select(*want.columns).collect()) == ordered(want.collect())


def test_surface_is_reported_once(spark, tmp_path):
    rows = [[(1, "f", False), (2, None, None)], [(1, "f", None), (2, "g", None)], [(1, None, None), (2, "g", None)], [(1, "f", None), (2, "h", None)], [(1, "f", True), (2, "h", None)], [(1, "f", None)]]
    s = "repo long, fingerprint string, accepted boolean, seen_at timestamp_ntz"
    told = []
    for i, batch in enumerate(rows):
        spark.createDataFrame([(*r, dt.datetime(2026, 1, i + 1)) for r in batch], s).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        S.write_updates(S.surface_status(spark.readStream.schema(s).parquet(str(tmp_path / "in"))), str(tmp_path / "o"), str(tmp_path / "c"), "append").awaitTermination()
        now = spark.read.parquet(str(tmp_path / f"o/batch={i}")).orderBy("repo").collect()
        assert all((r.last_seen and r.last_seen.day) == (i + 1 if r.status in ("reported", "suppressed") else None) for r in now)
        told.append([(r.repo, r.status, r.first_seen and r.first_seen.day) for r in now])
    assert told == [
        [(1, "reported", 1), (2, "silent", None)],
        [(1, "suppressed", 1), (2, "reported", 2)],
        [(1, "silent", None), (2, "suppressed", 2)],
        [(1, "reported", 4), (2, "reported", 2)],
        [(1, "accepted", None), (2, "suppressed", 2)],
        [(1, "reported", 6)],
    ]


def test_enabled_stream(spark, landed, tmp_path):
    switches = spark.createDataFrame([(0, True), (1, False)], "source bigint, enabled boolean")
    ready = polls(stream(spark, landed)).select("source", "id")
    out = str(tmp_path / "o")
    S.enabled_stream(ready, switches).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out).awaitTermination()
    assert {r[0] for r in spark.read.parquet(out).select("source").distinct().collect()} == {0}


def test_stream_reader(spark, sf_dir, tmp_path):
    schema = table(spark, sf_dir, "events").schema
    q = stream_parquet(spark, sf_dir, "events.parquet", schema).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "o"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == table(spark, sf_dir, "events").count()
