"""Correlation queries: sensitivity, scores, policies, baselines, incidents and their upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward.functions.names import fold_name
from lakeward.operators import correlation as C
from lakeward.operators import signals as S
from lakeward.plans.base import access_events, read, sample_findings

POLICIES = [
    {"id": "bulk-read", "conditions": {"actions": ["read"], "min_rows": 30_000}},
    {"id": "named-objects", "conditions": {"objects": ["obj_1*", "OBJ_?"], "actions": ["write"], "min_rows": 10_000}},
    {"id": "night", "conditions": {"hours": [22, 4], "targets": ["target_1", "target_3"], "min_rows": 5_000}},
]
EXCEPTIONS = [
    {"conditions": {"principals": ["7", "8", "9"]}},
    {"policy": "bulk-read", "conditions": {"objects": ["obj_2*"]}, "expires": "2024-01-15 00:00:00"},
]


def _sensitivities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.object_sensitivity(sample_findings(spark, sf_dir), ["target", "db", "object"])


def object_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sensitivities(spark, sf_dir)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_object = C.object_sensitivity(sample_findings(spark, sf_dir), ["target", "object"]).withColumnRenamed("object", "name")
    events = access_events(spark, sf_dir).withColumn("name", fold_name(F.col("object")))
    joined = events.join(by_object, ["target", "name"], "left")
    return joined.withColumn("sensitivity", F.coalesce("sensitivity", F.lit(0.0))).withColumn("score", C.event_score(F.col("sensitivity"), F.col("rows")))


def event_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("event_id", "sensitivity", "score")


def schema_wildcard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sample_findings(spark, sf_dir).select("object", F.when(F.col("finding_id") % 3 > 0, F.concat(F.lit("S"), (F.col("finding_id") % 3).cast("string"))).alias("schema"), "classifier").distinct()
    events = access_events(spark, sf_dir).select("event_id", fold_name(F.col("object")).alias("object"), F.when(F.col("k") % 2 == 0, F.lit("*")).otherwise(F.concat(F.lit("s"), (F.col("k") % 3).cast("string"))).alias("schema_key"))
    hits = events.join(C.with_schema_wildcard(found).select("object", "schema_key", "classifier").distinct(), ["object", "schema_key"])
    return hits.groupBy("schema_key", "classifier").agg(F.count("*").alias("n"))


def database_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.bounds(_sensitivities(spark, sf_dir), "target", "db")


def derive_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    derived = C.derive_objects(sample_findings(spark, sf_dir), ["target", "object"])
    return derived.select("target", "object", F.array_join("classifiers", ",").alias("classifiers"))


def merge_objects_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    manual = read(spark, sf_dir, "nation").where("n_nationkey < 3").select(F.lit("target_0").alias("target"), F.lower("n_name").alias("object"))
    derived = _sensitivities(spark, sf_dir).groupBy("target", "object").agg(F.max("sensitivity").alias("sensitivity"))
    merged = C.merge_objects(derived, manual, ["target", "object"], 20)
    return merged.select("target", "object", F.when(F.col("rank") < 1e9, F.col("rank")).alias("rank"))


def policy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.match_policies(_facts(spark, sf_dir), POLICIES).select("event_id", "policy")


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).withColumn("signals", F.filter(F.array(F.when(F.col("rows") > 40_000, "volume.large_result"), F.when(F.col("k") == 3, "signature.pg_dump")), lambda s: s.isNotNull())).withColumn("anomaly", F.col("rows") > 48_000)


def exception_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.match_policies(_facts(spark, sf_dir), POLICIES, EXCEPTIONS).select("event_id", "policy")


def baseline_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = C.baselines(access_events(spark, sf_dir), ["target", "principal"], ["ts", "event_id"])
    return folded.select("event_id", "n", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"), "warm", "anomaly")


def anomaly_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Principals' baselines after all events, with typical and threshold rows where these are warm."""
    return C.baselines(access_events(spark, sf_dir), ["target"], ["ts", "event_id"]).where("warm").select("event_id", F.round(F.expm1("mean"), 2).alias("typical_rows"), F.round(F.expm1("limit_log"), 0).alias("threshold_rows"), "anomaly")


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = C.match_policies(_facts(spark, sf_dir), POLICIES, EXCEPTIONS)
    return matched.withColumn("dedup", C.dedup_key(F.col("policy"), F.col("target"), F.lit("any"), F.lit(None).cast("string"), F.col("ts")))


def incident_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = C.incidents(_matches(spark, sf_dir))
    return merged.select("dedup", "policy", "match_count", "max_score", "total_rows", "first_ts", "last_ts", "anomaly", F.array_join("signals", ",").alias("signals"))


def incident_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = C.incidents(_matches(spark, sf_dir)).withColumn("day", F.date_format("first_ts", "yyyy-MM-dd"))
    return C.cap_incidents(merged, ["policy", "day"], ["first_ts", "dedup"], 3).select("policy", "day", "overflow", "dedup", "match_count", "max_score")


def incident_reopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each match against the one before it of its policy and target, taken as closed alternately as
    resolved and as false positive."""
    from pyspark.sql import Window

    order = Window.partitionBy("policy", "target").orderBy("ts", "event_id")
    seen = C.match_policies(_facts(spark, sf_dir), POLICIES)
    seen = seen.withColumn("old", F.lag(F.struct("score", "rows", "signals", "anomaly")).over(order)).where("old is not null")
    status = F.when(F.col("event_id") % 2 == 0, "resolved").otherwise("false_positive")
    return seen.select("event_id", "policy", C.reopens(status, F.col("old"), F.col("score"), F.col("anomaly"), F.col("signals"), F.col("rows")).alias("reopens"))


def signal_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = _facts(spark, sf_dir).groupBy("target", "action").agg(F.flatten(F.collect_set("signals")).alias("s"))
    return grouped.select("target", "action", F.array_join(S.union_signals(F.col("s")), ",").alias("signals"))


def finding_upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sample_findings(spark, sf_dir).select("target", "object", "classifier", "confidence", F.col("last_seen").alias("seen"), "finding_id")
    old = found.where("finding_id < 700").groupBy("target", "object", "classifier").agg(F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"), F.min("confidence").alias("confidence"))
    return C.upsert_findings(old, found.where("finding_id >= 500"), ["target", "object", "classifier"], ["finding_id"])


def batch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 5000).alias("batch_id"), F.concat_ws("/", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("string")).alias("received"), (F.col("l_partkey") % 2).cast("string").alias("content_hash")).distinct()
    return C.ingest_batches(lines).groupBy("outcome").agg(F.count("*").alias("n"))


def dedup_principals(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = access_events(spark, sf_dir)
    who = C.dedup_principal(F.when(F.col("k") % 3 > 0, F.col("principal")), F.when(F.col("k") % 2 == 0, F.lit("10.0.0.0/24")), F.col("k") % 7 == 0)
    return events.groupBy(who.alias("who")).agg(F.count("*").alias("n"))


def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = list(C.LIFECYCLE)
    at = lambda c: F.get(F.array(*map(F.lit, states)), (c % 4).cast("int"))
    moves = access_events(spark, sf_dir).select(at(F.col("k")).alias("old"), at(F.floor(F.col("k") / 4)).alias("new"))
    return moves.withColumn("allowed", C.lifecycle_allows(F.col("old"), F.col("new"))).groupBy("old", "new", "allowed").agg(F.count("*").alias("n"))


def baseline_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = access_events(spark, sf_dir).groupBy("target", "principal").agg(F.max("ts").alias("updated"))
    return C.evict_baselines(states, "target", "updated", "principal", 10)


def location_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sample_findings(spark, sf_dir)
    schema = F.when(F.col("finding_id") % 2 == 0, F.lit("Public "))
    return found.groupBy(C.location_key(F.col("target"), F.col("db"), schema, F.col("object")).alias("location")).agg(F.count("*").alias("n"))


def name_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.name_inventory(access_events(spark, sf_dir), ["target", "object"], 50)


QUERIES = {
    f.__name__: f
    for f in (
        object_sensitivity, event_score, schema_wildcard_join, database_bound, derive_objects, merge_objects_topk, policy_match, exception_anti, baseline_fold, anomaly_verdict,
        incident_dedup, incident_cap, incident_reopen, signal_union, finding_upsert_last_wins, batch_outcomes, dedup_principals, lifecycle,
        baseline_eviction, location_keys, name_inventory,
    )
}

# ---- SQL ----------------------------------------------------------------------------------------
from lakeward.plans.base import EVENTS_SQL, FINDINGS_SQL, WEIGHT_SQL  # noqa: E402

_SENS = f"""sn AS (SELECT target, db, object, round(least(sum(c * ({WEIGHT_SQL})), 30.0), 2) AS sensitivity FROM
  (SELECT target, db, object, classifier, max(confidence) AS c FROM fi GROUP BY ALL) GROUP BY ALL)"""
_SCORED = f"""so AS (SELECT target, object, round(least(sum(c * ({WEIGHT_SQL})), 30.0), 2) AS s FROM
  (SELECT target, object, classifier, max(confidence) AS c FROM fi GROUP BY ALL) GROUP BY ALL),
sc AS (SELECT ev.*, coalesce(so.s, 0.0) AS sensitivity, CASE WHEN rows > 0 AND so.s > 0 THEN round(so.s * log10(1 + rows), 2) ELSE 0.0 END AS score,
  list_filter([CASE WHEN k = 3 THEN 'signature.pg_dump' END, CASE WHEN rows > 40000 THEN 'volume.large_result' END], lambda x: x IS NOT NULL) AS signals, rows > 48000 AS anomaly
  FROM ev LEFT JOIN so ON so.target = ev.target AND so.object = lower(ev.object))"""
_POL = """pm AS (
  SELECT *, 'bulk-read' AS policy FROM sc WHERE action = 'read' AND rows >= 30000
  UNION ALL SELECT *, 'named-objects' FROM sc WHERE (regexp_matches(lower(object), '^obj_1.*$') OR regexp_matches(lower(object), '^obj_.$')) AND action = 'write' AND rows >= 10000
  UNION ALL SELECT *, 'night' FROM sc WHERE (hour(ts) >= 22 OR hour(ts) <= 4) AND target IN ('target_1', 'target_3') AND rows >= 5000)"""
_EXC = """pe AS (SELECT * FROM pm WHERE principal NOT IN ('7', '8', '9') AND NOT (policy = 'bulk-read' AND lower(object) LIKE 'obj\\_2%' ESCAPE '\\' AND ts < TIMESTAMP '2024-01-15 00:00:00')),
  mk AS (SELECT *, sha256(policy || '|' || target || '|any|-|' || strftime(ts, '%Y-%m-%d %H')) AS dedup FROM pe)"""
_INC = """ic AS (SELECT dedup, policy, count(*) AS match_count, max(score) AS max_score, CAST(sum(rows) AS BIGINT) AS total_rows, min(ts) AS first_ts, max(ts) AS last_ts, bool_or(anomaly) AS anomaly,
  concat_ws(',', CASE WHEN bool_or(k = 3) THEN 'signature.pg_dump' END, CASE WHEN bool_or(rows > 40000) THEN 'volume.large_result' END) AS signals FROM mk GROUP BY dedup, policy)"""
_WITH = f"WITH {EVENTS_SQL}, {FINDINGS_SQL}, {_SENS}, {_SCORED}, {_POL}, {_EXC}, {_INC}"
_FOLD = """WITH RECURSIVE {ev}, o AS (SELECT event_id, {g} AS g, rows, row_number() OVER (PARTITION BY {g} ORDER BY ts, event_id) AS i FROM ev WHERE action NOT IN ('connect', 'auth_failure')),
  b AS (SELECT event_id, g, i, CAST(0 AS BIGINT) AS n, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS variance, ln(10.0)::DOUBLE AS lim, false AS warm, false AS anomaly, ln(1.0 + rows)::DOUBLE AS x FROM o WHERE i = 1
    UNION ALL SELECT event_id, g, i, n, mean, variance, lim, warm, warm AND rows >= 1000 AND x0 > lim AS anomaly, CASE WHEN warm THEN least(x0, lim) ELSE x0 END AS x FROM (
      SELECT *, mean + greatest(ln(10.0), 3 * sqrt(variance)) AS lim FROM (
        SELECT o.event_id, o.g, o.i, o.rows, ln(1.0 + o.rows) AS x0, b.n + 1 AS n, b.n + 1 >= 20 AS warm,
          b.mean + greatest(0.05, 1.0 / (b.n + 1)) * (b.x - b.mean) AS mean,
          greatest(0.0, (1 - greatest(0.05, 1.0 / (b.n + 1))) * (b.variance + (b.x - b.mean) * greatest(0.05, 1.0 / (b.n + 1)) * (b.x - b.mean))) AS variance
        FROM b JOIN o ON o.g = b.g AND o.i = b.i + 1)))"""

ORACLE_SQL = {
    "object_sensitivity": f"{_WITH} SELECT target, db, object, sensitivity FROM sn",
    "event_score": f"{_WITH} SELECT event_id, sensitivity, score FROM sc",
    "schema_wildcard_join": f"""WITH {EVENTS_SQL}, {FINDINGS_SQL}, a AS (SELECT DISTINCT object, CASE WHEN finding_id % 3 > 0 THEN 's' || CAST(finding_id % 3 AS VARCHAR) ELSE '*' END AS schema_key, classifier FROM fi),
      w AS (SELECT * FROM a UNION SELECT object, '*', classifier FROM a),
      e AS (SELECT event_id, lower(object) AS object, CASE WHEN k % 2 = 0 THEN '*' ELSE 's' || CAST(k % 3 AS VARCHAR) END AS schema_key FROM ev)
      SELECT schema_key, classifier, count(*) AS n FROM e JOIN w USING (object, schema_key) GROUP BY 1, 2""",
    "database_bound": f"{_WITH} SELECT target, db, max(sensitivity) AS sensitivity FROM sn GROUP BY 1, 2 UNION ALL SELECT target, '*', max(sensitivity) FROM sn GROUP BY 1",
    "derive_objects": f"WITH {FINDINGS_SQL} SELECT target, object, array_to_string(list_slice(list_sort(list_distinct(list(classifier))), 1, 32), ',') AS classifiers FROM fi GROUP BY 1, 2",
    "merge_objects_topk": f"""{_WITH}, u AS (SELECT target, object, max(sensitivity) AS r FROM sn GROUP BY 1, 2 UNION ALL SELECT 'target_0', lower(n_name), 1e300 FROM nation WHERE n_nationkey < 3)
      SELECT target, object, CASE WHEN r < 1e9 THEN r END AS rank FROM (SELECT target, object, max(r) AS r FROM u GROUP BY 1, 2 ORDER BY r DESC, target, object LIMIT 20)""",
    "policy_match": f"{_WITH} SELECT event_id, policy FROM pm",
    "exception_anti": f"{_WITH} SELECT event_id, policy FROM pe",
    "baseline_fold": _FOLD.format(ev=EVENTS_SQL, g="target || chr(31) || principal") + " SELECT event_id, n, round(mean, 6) AS mean, round(variance, 6) AS variance, warm, anomaly FROM b",
    "anomaly_verdict": _FOLD.format(ev=EVENTS_SQL, g="target") + " SELECT event_id, round(exp(mean) - 1, 2) AS typical_rows, round(exp(lim) - 1, 0) AS threshold_rows, anomaly FROM b WHERE warm",
    "incident_dedup": f"{_WITH} SELECT dedup, policy, match_count, max_score, total_rows, first_ts, last_ts, anomaly, signals FROM ic",
    "incident_cap": f"""{_WITH}, r AS (SELECT *, strftime(first_ts, '%Y-%m-%d') AS day FROM ic), p AS (SELECT *, row_number() OVER (PARTITION BY policy, day ORDER BY first_ts, dedup) > 3 AND NOT (signals LIKE '%signature.%' OR anomaly) AS overflow FROM r)
      SELECT policy, day, overflow, CASE WHEN overflow THEN '*' ELSE dedup END AS dedup, CAST(sum(match_count) AS BIGINT) AS match_count, max(max_score) AS max_score FROM p GROUP BY 1, 2, 3, 4""",
    "incident_reopen": f"""{_WITH}, l AS (SELECT *, lag(score) OVER w AS ps, lag(rows) OVER w AS pr, lag(signals) OVER w AS pg, lag(anomaly) OVER w AS pa FROM pm WINDOW w AS (PARTITION BY policy, target ORDER BY ts, event_id)),
      n AS (SELECT *, list_filter(signals, lambda x: NOT list_contains(pg, x)) AS fresh FROM l WHERE ps IS NOT NULL)
      SELECT event_id, policy, CASE WHEN event_id % 2 = 0 THEN score > ps OR (anomaly AND NOT pa) OR len(fresh) > 0
        ELSE score > ps OR (rows > 0 AND rows > pr) OR len(list_filter(fresh, lambda x: starts_with(x, 'signature.'))) > 0 END AS reopens FROM n""",
    "signal_union": f"{_WITH} SELECT target, action, concat_ws(',', CASE WHEN bool_or(k = 3) THEN 'signature.pg_dump' END, CASE WHEN bool_or(rows > 40000) THEN 'volume.large_result' END) AS signals FROM sc GROUP BY 1, 2",
    "finding_upsert_last_wins": f"""WITH {FINDINGS_SQL}, o AS (SELECT target, object, classifier, min(last_seen) AS fs, max(last_seen) AS ls, min(confidence) AS c FROM fi WHERE finding_id < 700 GROUP BY 1, 2, 3),
      n AS (SELECT * FROM (SELECT target, object, classifier, confidence, last_seen AS seen, row_number() OVER (PARTITION BY target, object, classifier ORDER BY finding_id DESC) AS r FROM fi WHERE finding_id >= 500) WHERE r = 1)
      SELECT target, object, classifier, coalesce(fs, seen) AS first_seen, coalesce(seen, ls) AS last_seen, coalesce(n.confidence, c) AS confidence FROM n FULL JOIN o USING (target, object, classifier)""",
    "batch_outcomes": """WITH b AS (SELECT DISTINCT l_orderkey % 5000 AS b, CAST(l_orderkey * 8 + l_linenumber AS VARCHAR) AS r, CAST(l_partkey % 2 AS VARCHAR) AS h FROM lineitem),
      w AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY r, h) AS p, first_value(h) OVER (PARTITION BY b ORDER BY r, h) AS f FROM b)
      SELECT CASE WHEN p = 1 THEN 'accepted' WHEN h = f THEN 'duplicate' ELSE 'conflict' END AS outcome, count(*) AS n FROM w GROUP BY 1""",
    "dedup_principals": f"""WITH {EVENTS_SQL} SELECT CASE WHEN k % 7 = 0 THEN 'unrecorded:' || net ELSE coalesce(usr, 'unknown:' || net) END AS who, count(*) AS n FROM (
      SELECT k, CASE WHEN k % 3 > 0 THEN principal END AS usr, CASE WHEN k % 2 = 0 THEN '10.0.0.0/24' ELSE 'none' END AS net FROM ev) GROUP BY 1""",
    "baseline_eviction": f"""WITH {EVENTS_SQL}, s AS (SELECT target, principal, max(ts) AS updated FROM ev GROUP BY 1, 2)
      SELECT target, principal, updated FROM s QUALIFY row_number() OVER (PARTITION BY target ORDER BY updated DESC, principal) <= 10""",
    "location_keys": f"""WITH {FINDINGS_SQL} SELECT sha256('=' || target || chr(31) || '=' || db || chr(31) || CASE WHEN finding_id % 2 = 0 THEN '=public' ELSE '-' END || chr(31) || '=' || object) AS location,
      count(*) AS n FROM fi GROUP BY 1""",
    "name_inventory": f"WITH {EVENTS_SQL} SELECT target, object, count(*) AS n FROM ev GROUP BY 1, 2 ORDER BY n DESC, target, object LIMIT 51",
    "lifecycle": f"""WITH {EVENTS_SQL}, s AS (SELECT ['open', 'acknowledged', 'resolved', 'false_positive'] AS a), m AS (SELECT a[k % 4 + 1] AS old, a[(k // 4) % 4 + 1] AS new FROM ev, s)
      SELECT old, new, (old = 'open' AND new IN ('acknowledged', 'resolved', 'false_positive')) OR (old = 'acknowledged' AND new IN ('resolved', 'false_positive')) OR (old IN ('resolved', 'false_positive') AND new = 'open') AS allowed, count(*) AS n FROM m GROUP BY ALL""",
}
