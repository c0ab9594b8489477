"""Audit queries: windows, bounds, counters, sliding counts and report filters over `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward.functions.names import fold_name
from lakeward.operators import audit as A
from lakeward.operators import serving
from lakeward.operators import signals as S
from lakeward.operators.correlation import own_activity
from lakeward.plans.base import access_events, read, sample_findings


def event_window_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = access_events(spark, sf_dir).select(
        "ts", F.lit(None).cast("timestamp").alias("ts_last"), "target", "action", F.lit(1).alias("aggregated_count"), "rows", F.lit(None).cast("long").alias("bytes"),
        F.filter(F.array(F.when(F.col("rows") > 30000, "volume.large_result"), F.when(F.col("k") > 95, "shape.full_table_read")), lambda s: s.isNotNull()).alias("signals"),
        (F.col("k") == 7).alias("overflowed"),
    )
    merged = A.aggregate_events(events, ["target", "action"], 3600)
    return merged.select("target", "action", "window_start", "ts", "ts_last", "aggregated_count", "rows", F.array_join("signals", ",").alias("signals"), "overflowed")


def first_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.first_event_windows(access_events(spark, sf_dir), ["target", "action"], 3600)


def object_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = access_events(spark, sf_dir).groupBy("principal").agg(F.collect_set("object").alias("objects"))
    return grouped.select("principal", F.array_join(A.bound_objects(F.col("objects")), ",").alias("objects"), (F.size("objects") > A.NAMED_OBJECTS).alias("overflowed"))


def failed_login_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    failures = access_events(spark, sf_dir).where("action = 'auth_failure'")
    return A.failed_login_windows(failures, "target", "principal", 43_200).select("event_id", "principals", "failures", "many_accounts", "one_account")


def one_account_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    failures = access_events(spark, sf_dir).where("action = 'auth_failure'")
    seen = A.failed_login_windows(failures, "target", "principal", 7 * 86_400)
    return seen.where("failures >= 3").groupBy("principal").agg(F.min("ts").alias("first_alert"), F.max("failures").alias("most"))


def failed_group_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = access_events(spark, sf_dir).where("action = 'auth_failure'").groupBy("target", "principal").agg(F.count("*").alias("n"))
    return A.cap_groups(groups, ["target"], "n", "principal", 10)


def counter_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    polls = access_events(spark, sf_dir).groupBy(F.to_date("ts").alias("day"), "object").agg(F.max("rows").alias("counter"))
    first = polls.agg(F.min("day")).first()[0]
    return A.counter_delta(polls, ["object"], "day", "counter", F.lit(first)).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "object", "counter", "delta")


def report_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = access_events(spark, sf_dir).select("event_id", "action", "rows", F.array(fold_name(F.col("object"))).alias("objects"), F.array().cast("array<string>").alias("signals"))
    sensitive = sample_findings(spark, sf_dir).groupBy("object").agg(F.sum("matched").alias("matched"), F.sum("sampled").alias("sampled")).where("2 * matched >= sampled").select("object")
    return A.reportable(events, sensitive, 20_000).select("event_id", "action", "rows")


def signals_by_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    statement = F.when(F.col("k") % 7 == 0, "select * from t into outfile '/tmp/x'").when(F.col("k") % 7 == 1, "BACKUP DATABASE d").when(F.col("k") % 7 == 2, "select * from openrowset('x')").otherwise("select 1")
    application = F.when(F.col("k") % 5 == 0, "pg_dump").when(F.col("k") % 5 == 1, "mysqldump/8").when(F.col("k") % 5 == 2, "bcpx").otherwise("psql")
    events = access_events(spark, sf_dir).select(
        "event_id", "rows", "action", (F.col("k") % 3 == 0).alias("whole_relation"), F.when(F.col("k") % 11 == 0, "file").alias("copy_to"), application.alias("application"), statement.alias("statement")
    )
    return events.withColumn("signal", F.explode(S.signals_column())).groupBy("signal", "action").agg(F.count("*").alias("n"))


def dump_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = access_events(spark, sf_dir).where("action = 'read'").select("event_id", "ts", F.concat_ws("/", "principal", F.to_date("ts").cast("string")).alias("session"), F.col("object").alias("relation"))
    return A.dump_sessions(reads).select("event_id", "relations", "dump")


def own_activity_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return own_activity(access_events(spark, sf_dir), "7", 100_000).select("event_id")


def ticket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("kind"), (F.col("o_orderstatus") == "F").alias("encrypted"))
    return kinds.groupBy("kind").agg(F.count_if("encrypted").alias("encrypted"), F.count_if(~F.col("encrypted")).alias("clear"))


def event_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access_events(spark, sf_dir).groupBy("target", "action").agg(F.count("*").alias("n"))


def retention_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = serving.retained(access_events(spark, sf_dir), F.to_timestamp(F.lit("2024-01-31 00:00:00")), 10)
    return kept.groupBy("target").agg(F.count("*").alias("n"), F.min("ts").alias("oldest"))


QUERIES = {
    f.__name__: f
    for f in (
        event_window_agg, first_event_windows, object_bound, failed_login_window, one_account_failures, failed_group_cap, counter_delta, report_filter,
        signals_by_volume, dump_sessions, own_activity_budget, ticket_counts, event_census, retention_filter,
    )
}

# ---- SQL ----------------------------------------------------------------------------------------
from lakeward.plans.base import EVENTS_SQL, FINDINGS_SQL  # noqa: E402


def _failures(hours: int) -> str:
    span = f"RANGE BETWEEN INTERVAL '{hours * 3_600_000_000 - 1} microseconds' PRECEDING AND CURRENT ROW"
    return f"""f AS (SELECT event_id, ts, target, principal, count(DISTINCT principal) OVER (PARTITION BY target ORDER BY ts {span}) AS principals,
      count(*) OVER (PARTITION BY principal ORDER BY ts {span}) AS failures FROM ev WHERE action = 'auth_failure')"""


ORACLE_SQL = {
    "event_window_agg": f"""WITH {EVENTS_SQL} SELECT target, action, time_bucket(INTERVAL '1 hour', ts) AS window_start, min(ts) AS ts, max(ts) AS ts_last,
      count(*) AS aggregated_count, CAST(sum(rows) AS BIGINT) AS rows,
      concat_ws(',', CASE WHEN bool_or(k > 95) THEN 'shape.full_table_read' END, CASE WHEN bool_or(rows > 30000) THEN 'volume.large_result' END) AS signals,
      bool_or(k = 7) AS overflowed FROM ev GROUP BY 1, 2, 3""",
    "first_event_windows": f"""WITH RECURSIVE {EVENTS_SQL}, e AS (SELECT target, action, epoch_us(ts) AS t FROM ev),
      r AS (SELECT target, action, min(t) AS opened_us FROM e GROUP BY 1, 2
        UNION ALL SELECT r.target, r.action, (SELECT min(t) FROM e WHERE e.target = r.target AND e.action = r.action AND e.t >= r.opened_us + 3600000000) FROM r WHERE r.opened_us IS NOT NULL)
      SELECT target, action, opened_us, opened_us + 3600000000 AS closed_us FROM r WHERE opened_us IS NOT NULL""",
    "object_bound": f"""WITH {EVENTS_SQL}, g AS (SELECT principal, list_sort(list_distinct(list(object))) AS o FROM ev GROUP BY 1)
      SELECT principal, array_to_string(CASE WHEN len(o) > 15 THEN list_append(list_slice(o, 1, 15), '*') ELSE o END, ',') AS objects, len(o) > 15 AS overflowed FROM g""",
    "failed_login_window": f"WITH {EVENTS_SQL}, {_failures(12)} SELECT event_id, principals, failures, principals >= 16 AS many_accounts, failures >= 20 AS one_account FROM f",
    "one_account_failures": f"WITH {EVENTS_SQL}, {_failures(168)} SELECT principal, min(ts) AS first_alert, max(failures) AS most FROM f WHERE failures >= 3 GROUP BY 1",
    "failed_group_cap": f"""WITH {EVENTS_SQL}, g AS (SELECT target, principal, count(*) AS n FROM ev WHERE action = 'auth_failure' GROUP BY 1, 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY n DESC, principal) AS r FROM g)
      SELECT target, CASE WHEN r <= 10 THEN principal ELSE '*' END AS principal, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1, 2""",
    "counter_delta": f"""WITH {EVENTS_SQL}, p AS (SELECT CAST(ts AS DATE) AS d, object, max(rows) AS counter FROM ev GROUP BY 1, 2),
      l AS (SELECT *, lag(counter) OVER (PARTITION BY object ORDER BY d) AS b, min(d) OVER () AS f FROM p)
      SELECT strftime(d, '%Y-%m-%d') AS day, object, counter, CASE WHEN b IS NULL AND d = f THEN NULL WHEN b IS NULL OR counter < b THEN counter ELSE counter - b END AS delta FROM l""",
    "report_filter": f"""WITH {EVENTS_SQL}, {FINDINGS_SQL} SELECT event_id, action, rows FROM ev WHERE action NOT IN ('read', 'write') OR rows >= 20000
      OR lower(object) IN (SELECT object FROM fi GROUP BY 1 HAVING 2 * sum(matched) >= sum(sampled))""",
    "signals_by_volume": f"""WITH {EVENTS_SQL}, s AS (SELECT action, unnest(list_filter([
      CASE WHEN rows > 10000 THEN 'volume.large_result' END, CASE WHEN action = 'read' AND k % 3 = 0 AND k % 11 <> 0 THEN 'shape.full_table_read' END,
      CASE WHEN k % 3 = 0 AND k % 11 = 0 THEN 'shape.full_table_copy' END, CASE WHEN k % 11 = 0 THEN 'signature.copy_to_file' END,
      CASE WHEN k % 7 = 0 THEN 'signature.into_outfile' END, CASE WHEN k % 7 = 1 THEN 'signature.backup_database' END, CASE WHEN k % 7 = 2 THEN 'signature.remote_data_access' END,
      CASE WHEN k % 5 = 0 AND k % 3 = 0 THEN 'signature.pg_dump' END, CASE WHEN k % 5 = 1 AND k % 3 = 0 THEN 'signature.mysqldump' END], lambda x: x IS NOT NULL)) AS signal FROM ev)
      SELECT signal, action, count(*) AS n FROM s GROUP BY 1, 2""",
    "dump_sessions": f"""WITH {EVENTS_SQL}, r AS (SELECT event_id, ts, principal || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS s, object FROM ev WHERE action = 'read')
      SELECT event_id, c AS relations, c >= 3 AS dump FROM (SELECT event_id, count(DISTINCT object) OVER (PARTITION BY s ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS c FROM r)""",
    "own_activity_budget": f"""WITH {EVENTS_SQL}, s AS (SELECT *, sum(rows) OVER (PARTITION BY principal, object ORDER BY ts RANGE BETWEEN INTERVAL '86399999999 microseconds' PRECEDING AND CURRENT ROW) AS spent FROM ev)
      SELECT event_id FROM s WHERE NOT (principal = '7' AND action = 'read' AND spent <= 100000)""",
    "ticket_counts": """SELECT o_orderpriority AS kind, count(*) FILTER (o_orderstatus = 'F') AS encrypted, count(*) FILTER (o_orderstatus <> 'F') AS clear FROM orders GROUP BY 1""",
    "event_census": f"WITH {EVENTS_SQL} SELECT target, action, count(*) AS n FROM ev GROUP BY 1, 2",
    "retention_filter": f"WITH {EVENTS_SQL} SELECT target, count(*) AS n, min(ts) AS oldest FROM ev WHERE ts >= TIMESTAMP '2024-01-21 00:00:00' GROUP BY 1",
}
