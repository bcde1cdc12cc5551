"""Queries of the KPI lane."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwork.operators import kpi as K
from groundwork.plans.fixtures import FACTS_SQL, POLLS_SQL, facts, polls
from groundwork.plans.registry import Registry
from groundwork.sources.files import table

lane = Registry()
QUERIES, ORACLE, query = lane.QUERIES, lane.ORACLE, lane.query
NOW = "2024-01-30 23:59:00"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def _polls(spark, sf_dir):
    return polls(_events(spark, sf_dir))


def _readings(spark, sf_dir):
    return K.to_envelope(_polls(spark, sf_dir).where("outcome <> 'failed'").withColumnRenamed("at", "fetched_at"))


@query("d1_envelope", f"WITH {POLLS_SQL} SELECT id, source, metric, polled AS fetched_at, 3600 AS ttl_s, 1800 AS stale_after_s, 3600 AS expiry_s FROM polls WHERE outcome <> 'failed'")
def d1(spark, sf_dir):
    return _readings(spark, sf_dir).select("id", "source", "metric", "fetched_at", "ttl_s", "stale_after_s", "expiry_s")


@query("d2_unpivot_payload", """WITH p AS (SELECT event_id, json_extract_string(props, '$.k') AS k, round(value * 100)::BIGINT::VARCHAR AS v FROM events)
SELECT event_id, 'total_views' AS metric, k AS value FROM p UNION ALL SELECT event_id, 'avg_usd_value', v FROM p""")
def d2(spark, sf_dir):
    body = F.concat(F.lit('{"totalViews": '), F.get_json_object("props", "$.k"), F.lit(', "avgUSDValue": '), F.round(F.col("value") * 100).cast("bigint"), F.lit(', "id": '), F.col("event_id"), F.lit("}"))
    return K.unpivot_payload(_events(spark, sf_dir).withColumn("payload", body), "payload", ["event_id"], ["id"])


@query("d3_unpivot_list_feed", """WITH e AS (SELECT event_id, event_type, user_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events)
SELECT event_id, true AS ok, 'u' || user_id || '_spot' AS metric, k::DOUBLE AS price, strftime(make_timestamp((1700000000 + k) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS as_of FROM e WHERE event_type <> 'error'
UNION ALL SELECT event_id, false, NULL, NULL, NULL FROM e WHERE event_type = 'error'""")
def d3(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    good = F.concat(F.lit('[{"asset": "U'), F.col("user_id"), F.lit('", "market_type": "SPOT", "price": '), k, F.lit(', "time": '), F.lit(1700000000) + k.cast("bigint"), F.lit('}, {"asset": "X", "price": 1.5}]'))
    body = F.when(F.col("event_type") == "error", F.lit('{"error": "busy"}')).otherwise(good)
    return K.unpivot_list_feed(_events(spark, sf_dir).withColumn("payload", body), "payload", ["event_id"])


@query("d4_parse_upstream_time", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 3 THEN NULL ELSE strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M:%S') END AS parsed FROM events""")
def d4(spark, sf_dir):
    m = F.col("event_id") % 4
    fmt = lambda p: F.date_format(F.col("ts").cast("timestamp"), p)
    raw = F.when(m == 0, fmt("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(m == 1, fmt("M-d-yyyy h:mm a")).when(m == 2, fmt("MM-dd-yy hh:mm a")).otherwise("yesterday noon")
    return _events(spark, sf_dir).select("event_id", K.parse_upstream_time(raw).alias("parsed"))


def _sheets(spark, sf_dir):
    e = _events(spark, sf_dir)
    s = lambda c: F.col(c).cast("string")
    rows = F.array(F.array(F.lit("id"), F.lit("kind"), F.lit("user")), F.array(s("event_id"), F.lit("first")), F.array(s("event_id"), F.col("event_type"), s("user_id"), F.lit("extra")))
    return e.select("event_id", F.when(F.col("event_id") % 10 == 0, F.slice(rows, 1, 1)).otherwise(rows).alias("values"))


@query("d5_sheet_rows", "SELECT event_id, 1 AS row_no, event_id::VARCHAR AS id, 'first' AS kind, NULL::VARCHAR AS user FROM events WHERE event_id % 10 <> 0 UNION ALL SELECT event_id, 2, event_id::VARCHAR, event_type, user_id::VARCHAR FROM events WHERE event_id % 10 <> 0")
def d5(spark, sf_dir):
    rows = K.sheet_rows(_sheets(spark, sf_dir), "values", ["event_id"])
    return rows.select("event_id", "row_no", *[F.try_element_at("cells", F.lit(c)).alias(c) for c in ("id", "kind", "user")])


@query("d6_sheet_latest", """WITH v AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN [['id', 'kind', 'user']] ELSE [['id', 'kind', 'user'], [event_id::VARCHAR, 'first'], [event_id::VARCHAR, event_type, user_id::VARCHAR, 'extra']] END AS r FROM events)
SELECT event_id, CASE WHEN len(r) > 1 THEN r[len(r)][list_position(r[1], 'kind')] END AS kind, CASE WHEN len(r) > 1 THEN len(r[1]) ELSE 0 END AS n FROM v""")
def d6(spark, sf_dir):
    last = K.sheet_latest(_sheets(spark, sf_dir), "values", ["event_id"])
    return last.select("event_id", F.try_element_at("cells", F.lit("kind")).alias("kind"), F.size("cells").alias("n"))


@query("d7_shape_problems", """WITH p AS (SELECT event_id, CASE WHEN event_type = 'error' THEN '[1, 2]' ELSE props END AS j, CASE user_id % 7 WHEN 0 THEN ['k', 'total'] WHEN 1 THEN ['k'] ELSE [] END AS wanted FROM events)
SELECT event_id, array_to_string(list_filter(wanted, lambda k: NOT coalesce(list_contains(json_keys(j), k), false)), ',') AS missing FROM p""")
def d7(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("source", F.col("user_id") % 7).withColumn("payload", F.when(F.col("event_type") == "error", "[1, 2]").otherwise(F.col("props")))
    return K.shape_problems(e, "payload", {"0": ["k", "total"], "1": ["k"]}).select("event_id", F.array_join("missing", ",").alias("missing"))


LATEST_SQL = POLLS_SQL + ", latest AS (SELECT source, metric, arg_max(value, {'polled': polled, 'id': id}) AS value, max(polled) AS fetched_at FROM polls WHERE outcome <> 'failed' GROUP BY ALL)"


@query("d8_latest_kpi", f"WITH {LATEST_SQL} SELECT source, metric, value, fetched_at FROM latest")
def d8(spark, sf_dir):
    return K.latest_kpi(_readings(spark, sf_dir)).select("source", "metric", "value", "fetched_at")


READ_SQL = LATEST_SQL + f""", req AS (SELECT DISTINCT user_id % 9 AS source, event_type AS metric FROM events),
kpi AS (SELECT source, metric, CASE WHEN fetched_at IS NULL THEN 'never' WHEN age > 3600 THEN 'expired' WHEN age > 1800 THEN 'stale' ELSE 'fresh' END AS state, value AS v, fetched_at FROM (SELECT req.*, value, fetched_at, floor(epoch(TIMESTAMP '{NOW}' - fetched_at)) AS age FROM req LEFT JOIN latest USING (source, metric)))"""


def _read(spark, sf_dir):
    wanted = _events(spark, sf_dir).select((F.col("user_id") % 9).alias("source"), F.col("event_type").alias("metric")).distinct()
    return K.read_kpi(K.latest_kpi(_readings(spark, sf_dir)), wanted, F.lit(NOW).cast("timestamp_ntz"))


@query("d9_read_kpi", f"WITH {READ_SQL} SELECT source, metric, state, CASE WHEN state IN ('fresh', 'stale') THEN v END AS value, fetched_at FROM kpi")
def d9(spark, sf_dir):
    return _read(spark, sf_dir)


@query("d10_blocked_sources", f"WITH {POLLS_SQL} SELECT id, source FROM polls WHERE source IN (2, 5)")
def d10(spark, sf_dir):
    return K.guard_sources(_polls(spark, sf_dir), ["2", "5"]).select("id", "source")


HEALTH_SQL = POLLS_SQL + """, w AS (SELECT *, count(*) FILTER (outcome = 'ok') OVER (PARTITION BY source ORDER BY polled, id ROWS UNBOUNDED PRECEDING) AS s FROM polls),
hist AS (SELECT source, polled AS at_, id, outcome = 'ok' AS ok, count(*) FILTER (outcome = 'failed') OVER (PARTITION BY source, s ORDER BY polled, id ROWS UNBOUNDED PRECEDING) AS consecutive_failures, max(CASE WHEN outcome = 'ok' THEN polled END) OVER (PARTITION BY source ORDER BY polled, id ROWS UNBOUNDED PRECEDING) AS last_success FROM w)"""


@query("d11_poll_health", f"WITH {HEALTH_SQL} SELECT source, at_ AS polled_at, id, ok, consecutive_failures, last_success FROM hist")
def d11(spark, sf_dir):
    return K.poll_health(_polls(spark, sf_dir)).withColumnRenamed("at", "polled_at")


NOW_SQL = HEALTH_SQL + ", now_ AS (SELECT source, ok, consecutive_failures, last_success FROM hist QUALIFY row_number() OVER (PARTITION BY source ORDER BY at_ DESC, id DESC) = 1)"


@query("d11_latest_health", f"WITH {NOW_SQL} SELECT * FROM now_")
def d11_latest(spark, sf_dir):
    return K.latest_health(_polls(spark, sf_dir))


@query("d12_health_rollup", f"WITH {NOW_SQL}, act AS (SELECT DISTINCT user_id % 8 AS source FROM events) SELECT bool_and(coalesce(ok, false)) AS all_ok, string_agg(source || '=' || coalesce(ok::VARCHAR, 'null'), ',' ORDER BY source::VARCHAR) AS sources FROM act LEFT JOIN now_ USING (source)")
def d12(spark, sf_dir):
    active = _events(spark, sf_dir).select((F.col("user_id") % 8).alias("source")).distinct()
    rolled = K.health_rollup(active, K.latest_health(_polls(spark, sf_dir)))
    one = F.transform(F.map_entries("sources"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"].cast("string"), F.lit("null"))))
    return rolled.select("all_ok", F.array_join(one, ",").alias("sources"))


@query("d13_enabled_only", f"WITH {POLLS_SQL} SELECT id, source FROM polls WHERE source IN (SELECT n_nationkey FROM nation WHERE n_regionkey % 2 = 0)")
def d13(spark, sf_dir):
    switches = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("source"), (F.col("n_regionkey") % 2 == 0).alias("enabled"))
    return K.enabled_only(_polls(spark, sf_dir), switches).select("id", "source")


@query("d14_scale_units", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * 100)::BIGINT::VARCHAR AS raw_value, round(round(l_extendedprice * 100)::BIGINT / 1000000.0, 9) AS scaled FROM lineitem")
def d14(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem").withColumn("raw", F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    return K.scale_units(raw, "raw", 6).select("l_orderkey", "l_linenumber", F.col("raw_value").cast("string").alias("raw_value"), F.round("scaled", 9).alias("scaled"))


@query("d15_derive_metric", f"""WITH {POLLS_SQL}, r AS (SELECT source, date_trunc('day', polled) AS cycle, metric, max(value) AS value FROM polls GROUP BY ALL)
SELECT source, cycle, metric, round(value, 6) AS value FROM r UNION ALL SELECT a.source, a.cycle, 'effective', round(a.value - b.value, 6) FROM r a JOIN r b USING (source, cycle) WHERE a.metric = 'purchase' AND b.metric = 'click'""")
def d15(spark, sf_dir):
    daily = _polls(spark, sf_dir).groupBy("source", F.to_date("at").cast("timestamp_ntz").alias("cycle"), "metric").agg(F.max("value").alias("value"))
    return K.derive_metric(daily, "purchase", "click", "effective").withColumn("value", F.round("value", 6))


@query("d16_rate_budget", f"WITH {POLLS_SQL} SELECT source AS host, id, count(*) OVER w AS in_window, count(*) OVER w > 2 AS over_budget FROM polls WINDOW w AS (PARTITION BY source ORDER BY epoch_us(polled) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW)")
def d16(spark, sf_dir):
    return K.rate_budget(_polls(spark, sf_dir).withColumnRenamed("source", "host"), 2, 3600).select("host", "id", "in_window", F.col("over").alias("over_budget"))


@query("d17_kpi_or_fact", f"""WITH {READ_SQL}, {FACTS_SQL}, w AS (SELECT p_partkey AS item, p_partkey % 9 AS source, CASE WHEN p_partkey % 2 = 0 THEN 'view' ELSE 'click' END AS metric, 'products.' || (p_partkey * 3) AS fact_key FROM part)
SELECT item, CASE WHEN k.v IS NOT NULL THEN printf('%.2f', k.v) ELSE f.value END AS value, CASE WHEN k.v IS NOT NULL THEN 'kpi:' || w.source || ':' || w.metric ELSE 'fact:' || f.key END AS origin
FROM w LEFT JOIN kpi k ON k.source = w.source AND k.metric = w.metric AND k.state = 'fresh' LEFT JOIN facts f ON f.key = w.fact_key AND f.value <> 'unknown'""")
def d17(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    m = F.col("p_partkey")
    wanted = part.select(m.alias("item"), (m % 9).alias("source"), F.when(m % 2 == 0, "view").otherwise("click").alias("metric"), F.concat(F.lit("products."), m * 3).alias("fact_key"))
    return K.kpi_or_fact(wanted, _read(spark, sf_dir).withColumn("value", F.format_string("%.2f", "value")), facts(part))
