"""Stateful operators as streams, on Spark's own state: what a micro-batch writes grows with the batch, not with history.

State lies in the query's checkpoint, one row for each key, so a query that is started again goes on
where it ended and a batch that runs again leaves the same rows. `keep_state_on_disk` moves it from
executor memory to RocksDB, whose checkpoints are logs of changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from groundwork.operators import kpi


def keep_state_on_disk(spark: SparkSession) -> None:
    """Let queries started from now on keep their state in RocksDB and write changes only."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def append(stream: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream's rows as Parquet, each once; by default it takes what is there and ends."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(folder)


def write_updates(stream: DataFrame, folder: str, checkpoint: str, mode: str = "update", **trigger) -> StreamingQuery:
    """Write the rows that each micro-batch changed to `batch=<number>` of a folder; a batch that runs again overwrites its own."""

    def step(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_kpi(readings: DataFrame) -> DataFrame:
    """The newest reading of each (source, metric), again whenever it changes; a late one never replaces it. In mode update."""
    return kpi.latest_kpi(readings)


def micros(time: str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(time))


def from_micros(time: str) -> Column:
    return F.timestamp_add("MICROSECOND", F.col(time), F.lit("1970-01-01").cast("timestamp_ntz"))


def poll_health(polls: DataFrame) -> DataFrame:
    """(source, at, id, ok, consecutive_failures, last_success, late) of polls (source, at, id, outcome).

    After each micro-batch a source that was polled has one row with late = false: its health at its newest poll,
    as the batch operator `latest_health` has it. Polls not newer than what an earlier batch had come out
    as late rows with their own time and id, and change nothing. A failure adds one, a degraded poll
    changes neither number nor time, a success clears. Polls of a source within a batch may come in any order;
    the task holds the failures since the newest success, not all polls.
    """

    def update(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen_at, seen_id, outcome, fails, success = state.get if state.exists else (None, None, None, 0, None)
        carried = None if seen_at is None else (seen_at, seen_id)
        newest, won, open_ = carried, None, pd.DataFrame({"at": [], "id": []}, dtype="int64")
        for chunk in chunks:
            if carried is not None:
                old = (chunk["at"] < carried[0]) | ((chunk["at"] == carried[0]) & (chunk["id"] <= carried[1]))
                late = chunk[old]
                if len(late):
                    yield pd.DataFrame({"source": key[0], "at": late["at"], "id": late["id"], "ok": late["outcome"] == "ok", "consecutive_failures": pd.array([None] * len(late), "Int64"), "last_success": pd.array([None] * len(late), "Int64"), "late": True})
                chunk = chunk[~old]
            if not len(chunk):
                continue
            last = chunk.sort_values(["at", "id"]).iloc[-1]
            if newest is None or (last["at"], last["id"]) > newest:
                newest, outcome = (int(last["at"]), int(last["id"])), last["outcome"]
            wins = chunk[chunk["outcome"] == "ok"].sort_values(["at", "id"])
            if len(wins) and (won is None or (wins.iloc[-1]["at"], wins.iloc[-1]["id"]) > won):
                won = (int(wins.iloc[-1]["at"]), int(wins.iloc[-1]["id"]))
            open_ = pd.concat([open_, chunk.loc[chunk["outcome"] == "failed", ["at", "id"]]])
            if won is not None:
                open_ = open_[(open_["at"] > won[0]) | ((open_["at"] == won[0]) & (open_["id"] > won[1]))]
        if newest == carried:
            return
        fails = len(open_) + (0 if won else fails)
        success = won[0] if won else success
        state.update((*newest, outcome, fails, success))
        yield pd.DataFrame({"source": [key[0]], "at": [newest[0]], "id": [newest[1]], "ok": [outcome == "ok"], "consecutive_failures": [fails], "last_success": pd.array([success], "Int64"), "late": [False]})

    source = polls.schema["source"].dataType.simpleString()
    rows = polls.select("source", micros("at").alias("at"), F.col("id").cast("long").alias("id"), "outcome").groupBy("source")
    out = rows.applyInPandasWithState(update, f"source {source}, at long, id long, ok boolean, consecutive_failures long, last_success long, late boolean", "at long, id long, outcome string, fails long, success long", "append", GroupStateTimeout.NoTimeout)
    return out.withColumns({"at": from_micros("at"), "last_success": from_micros("last_success")})


def new_findings(findings: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(slug, fingerprint, first_seen) of findings (slug, fingerprint, detected_at) that were never seen, each once.

    first_seen is the earliest time within the micro-batch that brought the finding. `known` findings of
    a table stay silent.
    """

    def update(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first = min(int(c["at"].min()) for c in chunks)
        if not state.exists:
            yield pd.DataFrame({"slug": [key[0]], "fingerprint": [key[1]], "first_seen": [first]})
            state.update((True,))

    fresh = findings if known is None else findings.join(known.select("slug", "fingerprint"), ["slug", "fingerprint"], "left_anti")
    rows = fresh.select("slug", "fingerprint", micros("detected_at").alias("at")).groupBy("slug", "fingerprint")
    out = rows.applyInPandasWithState(update, "slug string, fingerprint string, first_seen long", "seen boolean", "append", GroupStateTimeout.NoTimeout)
    return out.withColumn("first_seen", from_micros("first_seen"))


def surface_status(prints: DataFrame) -> DataFrame:
    """(repo, status, fingerprint, first_seen, last_seen) of prints (repo, fingerprint or null, seen_at, accepted), one row for each repo of a micro-batch.

    The last print of a batch counts. accepted: the diff becomes the baseline; silent: nothing differs; both clear
    the repo's state. suppressed: the diff is the open one; reported: it is not, and is open from now on, since
    the time at which this repo's diff was first seen.
    """

    def update(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = max((c.sort_values("at").iloc[-1] for c in chunks), key=lambda r: r["at"])
        at, mark = int(last["at"]), None if pd.isna(last["fingerprint"]) else last["fingerprint"]
        old, since = state.get if state.exists else (None, None)
        status = "accepted" if bool(last["accepted"]) else "silent" if mark is None else "suppressed" if mark == old else "reported"
        if status in ("accepted", "silent"):
            if state.exists:
                state.remove()
            mark = first = at = None
        else:
            first = at if since is None else since
            state.update((mark, first))
        yield pd.DataFrame({"repo": [key[0]], "status": [status], "fingerprint": [mark], "first_seen": pd.array([first], "Int64"), "last_seen": pd.array([at], "Int64")})

    repo = prints.schema["repo"].dataType.simpleString()
    rows = prints.select("repo", "fingerprint", micros("seen_at").alias("at"), F.coalesce("accepted", F.lit(False)).alias("accepted")).groupBy("repo")
    out = rows.applyInPandasWithState(update, f"repo {repo}, status string, fingerprint string, first_seen long, last_seen long", "fingerprint string, since long", "append", GroupStateTimeout.NoTimeout)
    return out.withColumns({"first_seen": from_micros("first_seen"), "last_seen": from_micros("last_seen")})


def enabled_stream(stream: DataFrame, switches: DataFrame) -> DataFrame:
    """Readings of enabled sources; the switch table is read anew for each batch."""
    return kpi.enabled_only(stream, switches)
