"""KPI feed: envelopes, payloads, latest readings, freshness, shape and health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions import exprs as X


def to_envelope(df: DataFrame, ttl_s: int = 3600, stale_after_s: int = 1800) -> DataFrame:
    """Add ttl_s, stale_after_s and expiry_s; expiry is always later than staleness, so stale is never mistaken for absent."""
    return df.withColumns({"ttl_s": F.lit(ttl_s), "stale_after_s": F.lit(stale_after_s), "expiry_s": F.greatest(F.lit(ttl_s), F.lit(stale_after_s + 1))})


def unpivot_payload(df: DataFrame, payload: str, keep: Sequence[str], skip: Sequence[str] = ()) -> DataFrame:
    """(keep, metric, value): one row for each top-level key of a JSON object but the skipped ones."""
    rows = df.select(*keep, F.explode(F.from_json(payload, "map<string,string>")).alias("name", "value"))
    return rows.where(~F.col("name").isin(list(skip))).select(*keep, X.snake_case("name").alias("metric"), "value")


ENTRY = "array<struct<asset:string, market_type:string, price:double, time:bigint>>"


def unpivot_list_feed(df: DataFrame, payload: str, keep: Sequence[str]) -> DataFrame:
    """(keep, ok, metric, price, as_of): one row for each complete entry of a JSON list; a payload that is no list is one row with ok false."""
    # A lone object is no list, though the parser would read it as one.
    entries = F.when(F.ltrim(payload).startswith("["), F.from_json(payload, ENTRY))
    parsed = df.select(*keep, entries.alias("e"))
    good = parsed.where("e is not null").select(*keep, F.explode("e").alias("x")).where("coalesce(x.asset, '') <> '' and coalesce(x.market_type, '') <> ''")
    rows = good.select(*keep, F.lit(True).alias("ok"), F.lower(F.concat("x.asset", F.lit("_"), "x.market_type")).alias("metric"), F.col("x.price").alias("price"), X.epoch_iso("x.time").alias("as_of"))
    bad = parsed.where("e is null").select(*keep, F.lit(False).alias("ok"), F.lit(None).cast("string").alias("metric"), F.lit(None).cast("double").alias("price"), F.lit(None).cast("string").alias("as_of"))
    return rows.unionByName(bad)


def parse_upstream_time(raw: str | Column) -> Column:
    """ISO with a closing Z as it is; month-day-year with a 12-hour clock as ISO without a zone; else null."""
    t = F.trim(F.col(raw) if isinstance(raw, str) else raw)
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z$"), t)
    long = F.when(t.rlike(r"(?i)^\d{1,2}-\d{1,2}-\d{4} \d{1,2}:\d{2} [AP]M$"), F.try_to_timestamp(F.upper(t), F.lit("M-d-yyyy h:mm a")))
    short = F.when(t.rlike(r"(?i)^\d{1,2}-\d{1,2}-\d{2} \d{1,2}:\d{2} [AP]M$"), F.try_to_timestamp(F.upper(t), F.lit("M-d-yy h:mm a")))
    return F.coalesce(iso, F.date_format(F.coalesce(long, short), "yyyy-MM-dd'T'HH:mm:ss"))


def sheet_rows(df: DataFrame, values: str, keep: Sequence[str]) -> DataFrame:
    """(keep, row_no, cells): data rows as maps by the header row; short rows get nulls, long ones are cut."""
    head = F.get(values, F.lit(0))
    rows = df.where(F.size(values) > 1).select(*keep, head.alias("h"), F.posexplode(F.slice(values, 2, F.size(values) - 1)).alias("row_no", "r"))
    cells = F.map_from_arrays("h", F.transform(F.sequence(F.lit(0), F.size("h") - 1), lambda i: F.get("r", i)))
    return rows.where(F.size("h") > 0).select(*keep, (F.col("row_no") + 1).alias("row_no"), cells.alias("cells"))


def sheet_latest(df: DataFrame, values: str, keep: Sequence[str]) -> DataFrame:
    """(keep, cells): the last data row of each sheet, an empty map where there is none."""
    last = sheet_rows(df, values, keep).groupBy(*keep).agg(F.max_by("cells", "row_no").alias("cells"))
    return df.select(*keep).distinct().join(last, list(keep), "left").select(*keep, F.coalesce("cells", F.create_map().cast("map<string,string>")).alias("cells"))


def shape_problems(df: DataFrame, payload: str, expected: dict[str, Sequence[str]], source: str = "source") -> DataFrame:
    """Add missing: the expected top-level keys of the row's source that its payload lacks, in declared order."""
    keys = F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>"))
    wanted = F.lit(None).cast("array<string>")
    for name, fields in expected.items():
        wanted = F.when(F.col(source).cast("string") == name, F.array(*map(F.lit, fields))).otherwise(wanted)
    return df.withColumn("missing", F.array_except(F.coalesce(wanted, F.array().cast("array<string>")), keys))


def latest_kpi(readings: DataFrame, order: Sequence[str] = ("fetched_at", "id")) -> DataFrame:
    """The last reading of each (source, metric) by fetch time; a late row never replaces a newer one."""
    rest = [c for c in readings.columns if c not in ("source", "metric")]
    newest = readings.groupBy("source", "metric").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return newest.select("source", "metric", "r.*")


def read_kpi(latest: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Requests (source, metric) with value and state: fresh, stale, expired or never; unknown ages are not stale."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    age = F.floor((micros(now) - micros(F.col("fetched_at"))) / 1_000_000)
    state = F.when(~F.coalesce("__there", F.lit(False)), "never").when(age > F.col("expiry_s"), "expired").when(age > F.col("stale_after_s"), "stale").otherwise("fresh")
    known = latest.withColumn("__there", F.lit(True))
    joined = requests.join(known, ["source", "metric"], "left").withColumn("state", state)
    return joined.select("source", "metric", "state", F.when(F.col("state").isin("fresh", "stale"), F.col("value")).alias("value"), "fetched_at")


def guard_sources(requests: DataFrame, blocked: Sequence[str], strict: bool = False) -> DataFrame:
    """Requests that read a blocked source; in strict mode such a row is an error when it is read."""
    bad = requests.where(F.col("source").cast("string").isin(list(blocked)))
    return bad.withColumn("__e", F.raise_error(F.concat(F.lit("blocked source "), F.col("source").cast("string")))) if strict else bad


def poll_health(polls: DataFrame) -> DataFrame:
    """(source, at, id, ok, consecutive_failures, last_success) after each poll.

    A failure adds one; a degraded poll is not ok but changes neither number nor time; a success
    clears. Each day of a source is walked on its own and takes what earlier days left from a window
    over days, so no task has to hold a source's whole log.
    """
    p = polls.select("source", "at", "id", "outcome", F.to_date("at").alias("day"))
    order = Window.partitionBy("source", "day").orderBy("at", "id")
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    win = F.col("outcome") == "ok"
    lose = F.col("outcome") == "failed"
    inside = p.withColumn("wins", F.sum(win.cast("int")).over(run)).withColumn("seen", F.max(F.when(win, F.col("at"))).over(run))
    streak = Window.partitionBy("source", "day", "wins").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("fails", F.sum(lose.cast("int")).over(streak))
    last = p.groupBy("source", "day").agg(F.max(F.when(win, F.struct("at", "id"))).alias("s"), F.count_if(lose).alias("all_"))
    tails = p.where(lose).join(last.select("source", "day", "s"), ["source", "day"]).where(F.col("s").isNull() | (F.struct("at", "id") > F.col("s"))).groupBy("source", "day").agg(F.count(F.lit(1)).alias("tail"))
    days = last.join(tails, ["source", "day"], "left").withColumn("left_", F.coalesce("tail", F.lit(0)))
    by_day = Window.partitionBy("source").orderBy("day")
    up_to = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    days = days.withColumn("g", F.sum(F.col("s").isNotNull().cast("int")).over(up_to)).withColumn("ls", F.max("s.at").over(up_to))
    group = Window.partitionBy("source", "g").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    days = days.withColumn("end", F.sum("left_").over(group))
    before = days.select("source", "day", F.lag("end", 1, 0).over(by_day).alias("carry"), F.lag("ls").over(by_day).alias("carry_seen"))
    full = inside.join(before, ["source", "day"])
    fails = F.when(F.col("wins") > 0, F.col("fails")).otherwise(F.col("fails") + F.col("carry"))
    return full.select("source", "at", "id", win.alias("ok"), fails.alias("consecutive_failures"), F.coalesce("seen", "carry_seen").alias("last_success"))


def latest_health(polls: DataFrame) -> DataFrame:
    """(source, ok, consecutive_failures, last_success) now, by aggregation only."""
    win = F.col("outcome") == "ok"
    ends = polls.groupBy("source").agg(F.max(F.when(win, F.struct("at", "id"))).alias("s"), F.max_by("outcome", F.struct("at", "id")).alias("o"))
    fails = polls.where("outcome = 'failed'").join(ends.select("source", "s"), "source").where(F.col("s").isNull() | (F.struct("at", "id") > F.col("s"))).groupBy("source").agg(F.count(F.lit(1)).alias("f"))
    return ends.join(fails, "source", "left").select("source", (F.col("o") == "ok").alias("ok"), F.coalesce("f", F.lit(0)).alias("consecutive_failures"), F.col("s.at").alias("last_success"))


def health_rollup(active: DataFrame, health: DataFrame) -> DataFrame:
    """One row: all_ok and a map of source to ok; a source never polled is null and fails the whole. `active` is the list of configured sources."""
    joined = active.select("source").join(health.select("source", "ok"), "source", "left")
    entries = F.array_sort(F.collect_list(F.struct(F.col("source").cast("string").alias("source"), "ok")))
    return joined.agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("all_ok"), F.map_from_entries(entries).alias("sources"))


def enabled_only(readings: DataFrame, switches: DataFrame) -> DataFrame:
    """Readings of sources whose switch is on; works on a stream too."""
    return readings.join(switches.where("enabled").select("source"), "source", "left_semi")


def scale_units(df: DataFrame, raw: str, decimals: int) -> DataFrame:
    """Add raw_value (a whole number of up to 38 digits) and scaled (raw / 10^decimals)."""
    return df.withColumn("raw_value", F.col(raw).cast("decimal(38,0)")).withColumn("scaled", F.col("raw_value").cast("double") / F.lit(10.0**decimals))


def derive_metric(readings: DataFrame, total: str, burned: str, out: str) -> DataFrame:
    """(source, cycle, metric, value): total minus burned of the same cycle, where both are there, beside what was read."""
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("value")))
    wide = readings.groupBy("source", "cycle").agg(pick(total).alias("a"), pick(burned).alias("b")).where("a is not null and b is not null")
    made = wide.select("source", "cycle", F.lit(out).alias("metric"), (F.col("a") - F.col("b")).alias("value"))
    return readings.select("source", "cycle", "metric", "value").unionByName(made)


def rate_budget(calls: DataFrame, max_calls: int, period_s: int) -> DataFrame:
    """(host, at, id, in_window, over): calls of a host in the trailing period, its start not included.

    Calls are cut in blocks of one period, each with a copy of the block before, so a busy host spreads.
    """
    us = F.unix_micros(F.col("at").cast("timestamp"))
    size = period_s * 1_000_000
    base = calls.select("host", "at", "id", us.alias("us"), F.floor(us / size).alias("own"))
    copied = base.select("*", F.explode(F.array(F.col("own"), F.col("own") + 1)).alias("block"))
    trailing = Window.partitionBy("host", "block").orderBy("us").rangeBetween(-(size - 1), 0)
    counted = copied.withColumn("in_window", F.count(F.lit(1)).over(trailing)).where("own = block")
    return counted.select("host", "at", "id", "in_window", (F.col("in_window") > max_calls).alias("over"))


def kpi_or_fact(wanted: DataFrame, kpi: DataFrame, facts: DataFrame) -> DataFrame:
    """wanted (item, source, metric, fact_key): a fresh KPI wins, else a known fact, else nothing; provenance goes along."""
    fresh = kpi.where("state = 'fresh'").select("source", "metric", F.struct(F.col("value").cast("string").alias("value"), F.concat(F.lit("kpi:"), F.col("source").cast("string"), F.lit(":"), "metric").alias("origin")).alias("k"))
    known = facts.where("value <> 'unknown'").select(F.col("key").alias("fact_key"), F.struct("value", F.concat(F.lit("fact:"), "key").alias("origin")).alias("f"))
    chosen = F.coalesce("k", "f")
    return wanted.join(fresh, ["source", "metric"], "left").join(known, "fact_key", "left").select("item", chosen["value"].alias("value"), chosen["origin"].alias("origin"))
