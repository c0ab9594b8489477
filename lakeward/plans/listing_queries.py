"""Listings, joins, set comparisons and whole batches over the driver's tables, in Spark and in SQL.

`nation` stands for agents and their targets, `orders` for incidents, `lineitem` for links of events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward.functions.names import fold_name
from lakeward.operators import audit as A
from lakeward.operators import correlation as C
from lakeward.operators import listing as L
from lakeward.operators import serving as V
from lakeward.plans.base import EVENTS_SQL, FINDINGS_SQL, WEIGHT_SQL, access_events, pick, pick_sql, read, sample_findings
from lakeward.plans.correlation_queries import _FOLD, EXCEPTIONS
from lakeward.sources import sampling as P

_ENGINES, _SEVERITY, _MODES = ("postgresql", "mysql", "redis", "sqlserver"), ("critical", "high", "medium"), ("sensitive", "insensitive", "unknown")


def _text(c: str, n: int, word: str):
    return F.concat(F.lit(word), (F.col(c) % n).cast("string"))


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").groupBy(_text("n_nationkey", 7, "agent_").alias("agent")).agg(F.lower(F.min_by("n_name", "n_nationkey")).alias("agent_name"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return read(spark, sf_dir, "nation").select(_text("n_nationkey", 7, "agent_").alias("agent"), _text("n_nationkey", 5, "target_").alias("target"), pick(k, _ENGINES).alias("engine"), pick(k, _MODES).alias("name_case"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("finding_id")
    return sample_findings(spark, sf_dir).select("*", _text("finding_id", 9, "agent_").alias("agent"), F.when(k % 3 > 0, "postgresql").alias("engine"), F.when(k % 2 == 0, "public").alias("schema"), (k % 11 == 0).alias("false_positive"))


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        k.alias("incident_id"), pick(F.col("o_custkey"), _SEVERITY).alias("severity"), pick(k, L.STATUSES).alias("status"), F.col("o_orderdate").cast("timestamp").alias("ts"),
        _text("o_custkey", 9, "agent_").alias("agent"), _text("o_custkey", 5, "target_").alias("target"), F.when(k % 2 == 0, F.col("o_custkey")).alias("finding_id"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.array(F.when(F.col("k") == 3, "signature.pg_dump"), F.when(F.col("rows") > 15_000, "volume.large_result"))
    return access_events(spark, sf_dir).select("*", F.concat(F.lit("agent_"), (F.col("principal").cast("long") % 9).cast("string")).alias("agent"), F.filter(found, lambda s: s.isNotNull()).alias("signals"), (F.col("rows") > 18_000).alias("anomaly"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 10_000).alias("event_id"), F.col("l_suppkey").alias("incident_id"), F.col("l_shipdate").cast("timestamp").alias("linked_at"))


def finding_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = L.parse_filter("findings", {"target": "target_2", "engine": "not an engine!", "nothing": "x"})
    return L.finding_list(findings(spark, sf_dir), agents(spark, sf_dir), wanted).select("finding_id", "agent_name", "target", "classifier", "object", F.col("turn").cast("long").alias("turn"))


def incident_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = L.parse_filter("incidents", {"status": ["open", "acknowledged", "gone"], "severity": "high", "agent": ""})
    rows = L.incident_list(incidents(spark, sf_dir), agents(spark, sf_dir), findings(spark, sf_dir), targets(spark, sf_dir), wanted, V.severity_rank)
    return rows.select("incident_id", "status", "agent", "agent_name", "object", "engine", "ts")


def event_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = L.parse_filter("events", {"signal": "volume.*", "from": "2024-01-05T00:00:00Z", "to": "2024-01-25", "principal": "no/name"})
    return L.event_list(events(spark, sf_dir), agents(spark, sf_dir), wanted).select("event_id", "agent_name", "principal", "ts")


def anomalous_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = L.parse_filter("events", {"signal": "volume.large_result", "anomaly": "1", "target": "target_1"})
    return events(spark, sf_dir).where(L.predicate("events", wanted)).select("event_id")


def incident_event_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("incident_id"))
    return L.linked_events(events(spark, sf_dir), links(spark, sf_dir), chosen).select("event_id", "action", "ts")


def rows_since_false_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    cases = read(spark, sf_dir, "supplier").select(k.alias("incident_id"), pick(k, L.STATUSES).alias("status"), F.timestamp_micros(F.lit(694_224_000_000_000).cast("long") + k * 864_000_000_000).alias("marked_at"))
    return L.rows_since(cases, links(spark, sf_dir), events(spark, sf_dir))


def principal_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = events(spark, sf_dir).groupBy("agent", "target", "principal").agg(F.max("rows").alias("max_score"), F.count("*").alias("events"), F.count_if("anomaly").alias("anomalies"))
    return L.principal_list(states, agents(spark, sf_dir)).select("agent_name", "target", "principal", "max_score", "events", "anomalies")


def objects_by_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = spark.createDataFrame([("public", "obj_1"), (None, "obj_2"), ("other", "obj_3"), (None, "obj_5")], "schema string, object string")
    return L.named_objects(findings(spark, sf_dir), named).groupBy("schema", "object").agg(F.count("*").alias("n"))


def unsent_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = incidents(spark, sf_dir).where("severity = 'critical'").select("incident_id", "target")
    sent = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("incident_id"))
    return L.unsent(alerts, sent, ["incident_id"])


def object_list_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings(spark, sf_dir).select("finding_id", "target", F.concat_ws(".", "db", "object").alias("name"))
    changes = L.list_changes(found.where("finding_id % 3 <> 0"), found.where("finding_id % 3 <> 1"), ["target"], "name")
    return changes.withColumn("warning", F.coalesce(V.shrink_warning(F.col("old_size"), F.col("removed"), F.col("new_size")), F.lit("none")))


def altered_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("finding_id")
    parts = F.array(F.when(k % 40 == 0, "field"), F.when(k % 30 == 0, "database"), F.when(k % 17 == 0, "object"))
    lists = findings(spark, sf_dir).groupBy("target", "object").agg(F.flatten(F.collect_list(parts)).alias("parts"))
    return lists.select("target", "object", F.array_join(L.merged_parts(F.col("parts")), ",").alias("altered"))


def pattern_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = findings(spark, sf_dir).groupBy("target", "db").agg(F.collect_list("object").alias("patterns"))
    return L.shared_patterns(lists, ["target"], "patterns").select("target", F.array_join("patterns", ",").alias("patterns"))


def overflow_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose objects overflowed: what a condition retains and what exceptions cover."""
    star = access_events(spark, sf_dir).select("event_id", pick(F.col("k"), ("*", "Crm", "billing ", "Obj")).alias("database"), pick(F.col("event_id"), ("*", "x")).alias("object"), (F.col("k") % 3 == 0).alias("overflowed"))
    cover = {"whole": {"database": "crm", "object": "*"}, "part": {"object": "o*"}, "any": {}, "star": {"database": "*"}}
    kept = star.where(C.overflow_star(F.col("overflowed"), F.col("object"))).withColumn("retained", C.star_matches("c*", F.col("database")))
    return kept.groupBy("database", "retained", *[C.exception_covers_star(p, F.col("database")).alias(n) for n, p in cover.items()]).agg(F.count("*").alias("n"))


def dedup_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = F.array(*[((F.col("k") * m) % 7).cast("double") for m in (1, 2, 3)])
    chosen = access_events(spark, sf_dir).withColumn("at", C.dedup_object(F.when(F.col("k") % 5 == 0, F.array().cast("array<double>")).otherwise(scores)))
    return chosen.groupBy(F.col("at").cast("long").alias("at")).agg(F.count("*").alias("n"))


def incident_rematch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents of one policy for each target and day; those of the first events are stored, the others join."""
    matched = events(spark, sf_dir).where("rows > 8000").select("event_id", "ts", "rows", "signals", "anomaly", F.lit("big").alias("policy"), (F.col("rows") / 100).alias("score"), F.concat_ws("/", "target", F.date_format("ts", "yyyy-MM-dd")).alias("dedup"))
    merged = C.rematch(C.incidents(matched.where("event_id < 6000")), C.incidents(matched.where("event_id >= 6000")))
    return merged.select("dedup", "match_count", "max_score", "total_rows", "first_ts", "last_ts", "anomaly", F.array_join("signals", ",").alias("signals"))


FINDING_POLICIES = [
    {"id": "sure", "conditions": {"min_confidence": 0.9, "classifiers": ["card_number", "iban", "password_hash"]}},
    {"id": "many", "conditions": {"min_matched": 150, "objects": ["OBJ_1*"]}},
]
FINDING_EXCEPTIONS = [{"policy": "sure", "conditions": {"targets": ["target_4"]}}]


def finding_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = findings(spark, sf_dir).withColumn("classifiers", F.array("classifier")).withColumn("ts", F.col("last_seen"))
    k = F.col("o_orderkey")
    stored = read(spark, sf_dir, "orders").select(
        k.alias("incident_id"), pick(k, ("sure", "many")).alias("policy"), F.col("o_custkey").alias("finding_id"), pick(k, L.STATUSES[:3]).alias("status"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.when(k % 5 > 0, F.timestamp_micros(F.lit(1_704_067_200_000_000).cast("long") + (k % 3000) * 60_000_000)).alias("finding_seen"), (k % 200).alias("finding_matched"),
        F.when(k % 7 > 0, F.timestamp_micros(F.lit(1_704_067_200_000_000).cast("long") + (k % 2500) * 60_000_000)).alias("resolved_at"),
    )
    applied = C.apply_finding_policies(facts, stored, FINDING_POLICIES, FINDING_EXCEPTIONS)
    return applied.select("finding_id", "policy", "outcome")


def pending_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pending_order(events(spark, sf_dir), "agent", ["ts", "event_id"]).select("event_id", "agent", F.col("place").cast("long").alias("place"))


def name_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).join(targets(spark, sf_dir), ["agent", "target"])
    name = F.when(F.col("k") % 2 == 0, F.lower("object")).otherwise(F.col("object"))
    return rows.groupBy("engine", "name_case", L.name_matches(name, "Obj_1*", F.col("engine"), F.col("name_case")).alias("matches")).agg(F.count("*").alias("n"))


def case_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = events(spark, sf_dir).join(targets(spark, sf_dir), ["agent", "target"]).groupBy("engine", "name_case", "object").agg(F.count("*").alias("n"))
    return L.case_changes(names, ["obj_1*", "Obj_2*", "OBJ_?"]).select("engine", "name_case", "object", "exception", "n")


def batch_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct(F.col("target"), F.col("event_id"), F.struct(F.col("rows"), F.col("action")).alias("measure"))
    batches = access_events(spark, sf_dir).groupBy("principal").agg(F.struct(F.sort_array(F.collect_list(F.struct("event_id", item.alias("item"))))["item"].alias("events"), F.count("*").alias("count")).alias("batch"))
    return batches.select("principal", L.content_hash(batches, "batch").alias("content"))


def event_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = events(spark, sf_dir).withColumn("engine", pick(F.col("k"), _ENGINES))
    return L.checked_events(sent, targets(spark, sf_dir)).groupBy("agent", "target", "unexpected", "mismatch").agg(F.count("*").alias("n"))


def false_positive_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = findings(spark, sf_dir).where("finding_id % 4 < 2").select("finding_id", (F.col("finding_id") % 4 == 0).alias("marked"))
    closed = L.apply_false_positives(incidents(spark, sf_dir), marks).groupBy(F.concat(F.lit("incident "), "status").alias("what")).agg(F.count("*").alias("n"))
    again = L.pending_findings(findings(spark, sf_dir), marks).agg(F.lit("finding pending").alias("what"), F.count("*").alias("n"))
    return closed.unionByName(again)


def agent_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.agent_list(agents(spark, sf_dir), targets(spark, sf_dir).where("agent <> 'agent_3'"))


def integrity_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.budgeted(events(spark, sf_dir), "agent", ["ts", "event_id"], 1).select("event_id", "agent", "suppressed_before")


def token_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = access_events(spark, sf_dir).where("action in ('connect', 'read')")
    return A.correlated(rows, ["principal"], F.col("action") == "connect", 21_600).select("event_id", "request_id")


def guarded_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = findings(spark, sf_dir).withColumn("samples", F.lit("a***")).withColumn("fingerprints", F.lit("f"))
    kept = L.guarded(facts, ["obj_2?"], ["OBJ_1*"])
    return kept.groupBy("object", "classifier").agg(F.count("*").alias("n"), F.count("samples").alias("samples"), F.count("fingerprints").alias("fingerprints"))


def evaluate_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one batch: scores, bounds, verdicts and policies."""
    over = F.col("k") % 10 == 0
    batch = events(spark, sf_dir).drop("anomaly").withColumn("overflowed", over).withColumn("object", F.when(over, "*").otherwise(F.col("object")))
    by_object = C.object_sensitivity(sample_findings(spark, sf_dir), ["target", "object"])
    bounds = by_object.groupBy("target").agg(F.max("sensitivity").alias("bound"))
    policies = [{"id": "costly", "conditions": {"min_score": 80}}, {"id": "odd", "conditions": {"anomaly": True}}, {"id": "night", "conditions": {"hours": [22, 4], "actions": ["read"], "min_rows": 20_000}}]
    done = C.evaluate_events(batch, by_object.select("target", fold_name(F.col("object")).alias("name"), "sensitivity"), bounds, policies, EXCEPTIONS[:1])
    return done.withColumn("policies", F.array_join("policies", ","))


def scan_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rotate(read(spark, sf_dir, "supplier").select("s_name"), "s_name", 7).select("s_name", "place")


def sample_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select("s_suppkey", P.sample_share(F.col("s_suppkey") * 700, 1_000).alias("percent"))


QUERIES = {
    f.__name__: f
    for f in (
        finding_list, incident_list, event_list, anomalous_events, incident_event_list, rows_since_false_positive, principal_list, objects_by_schema, unsent_alerts, object_list_changes, altered_parts,
        pattern_sets, overflow_objects, dedup_objects, incident_rematch, finding_policies, pending_chunk, name_cases, case_inventory, batch_identity, event_targets, false_positive_marks, agent_list,
        integrity_budget, token_requests, guarded_findings, evaluate_chunk, scan_rotation, sample_shares,
    )
}

# ---- SQL ----------------------------------------------------------------------------------------
_A = "ag AS (SELECT 'agent_' || CAST(n_nationkey % 7 AS VARCHAR) AS agent, lower(arg_min(n_name, n_nationkey)) AS agent_name FROM nation GROUP BY 1)"
_T = f"""tg AS (SELECT 'agent_' || CAST(n_nationkey % 7 AS VARCHAR) AS agent, 'target_' || CAST(n_nationkey % 5 AS VARCHAR) AS target, {pick_sql('n_nationkey', _ENGINES)} AS engine,
  {pick_sql('n_nationkey', _MODES)} AS name_case FROM nation)"""
_F = f"""{FINDINGS_SQL}, f AS (SELECT *, 'agent_' || CAST(finding_id % 9 AS VARCHAR) AS agent, CASE WHEN finding_id % 3 > 0 THEN 'postgresql' END AS engine,
  CASE WHEN finding_id % 2 = 0 THEN 'public' END AS schema, finding_id % 11 = 0 AS fp FROM fi)"""
_I = f"""ic AS (SELECT o_orderkey AS incident_id, {pick_sql('o_custkey', _SEVERITY)} AS severity, {pick_sql('o_orderkey', L.STATUSES)} AS status, o_orderdate AS ts,
  'agent_' || CAST(o_custkey % 9 AS VARCHAR) AS agent, 'target_' || CAST(o_custkey % 5 AS VARCHAR) AS target, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS finding_id FROM orders)"""
_E = f"{EVENTS_SQL}, e AS (SELECT *, 'agent_' || CAST(CAST(principal AS BIGINT) % 9 AS VARCHAR) AS agent, rows > 18000 AS anomaly FROM ev)"
_L = "lk AS (SELECT l_orderkey % 10000 AS event_id, l_suppkey AS incident_id, l_shipdate AS linked_at FROM lineitem)"
_SO = f"so AS (SELECT target, object, round(least(sum(c * ({WEIGHT_SQL})), 30.0), 2) AS s FROM (SELECT target, object, classifier, max(confidence) AS c FROM fi GROUP BY ALL) GROUP BY ALL)"
_CASED = "(engine IN ('mysql', 'mariadb', 'sqlserver') AND name_case <> 'insensitive')"
_AT = "make_timestamp(1704067200000000 + ({0}) * 60000000)"

ORACLE_SQL = {
    "finding_list": f"""WITH {_F}, {_A}, r AS (SELECT f.*, agent_name, row_number() OVER (PARTITION BY agent, target ORDER BY last_seen DESC, finding_id) AS turn FROM f JOIN ag USING (agent) WHERE target = 'target_2' AND NOT fp)
      SELECT finding_id, agent_name, target, classifier, object, turn FROM r ORDER BY turn, agent_name, target, classifier, object, finding_id LIMIT 500""",
    "incident_list": f"""WITH {_F}, {_A}, {_T}, {_I}, c AS (SELECT * FROM ic WHERE status IN ('open', 'acknowledged') AND severity = 'high' ORDER BY ts DESC, incident_id LIMIT 500)
      SELECT incident_id, status, c.agent, agent_name, f.object, coalesce(f.engine, (SELECT max(tg.engine) FROM tg WHERE tg.agent = c.agent AND tg.target = c.target)) AS engine, ts
      FROM c LEFT JOIN ag ON ag.agent = c.agent LEFT JOIN f ON f.finding_id = c.finding_id""",
    "event_list": f"""WITH {_E}, {_A} SELECT event_id, agent_name, principal, ts FROM e JOIN ag USING (agent) WHERE rows > 15000 AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-25 00:00:00'
      ORDER BY ts DESC, event_id DESC LIMIT 500""",
    "anomalous_events": f"WITH {_E} SELECT event_id FROM e WHERE rows > 15000 AND anomaly AND target = 'target_1'",
    "incident_event_list": f"WITH {_E}, {_L} SELECT event_id, action, ts FROM e WHERE event_id IN (SELECT event_id FROM lk WHERE incident_id IN (SELECT s_suppkey FROM supplier)) ORDER BY ts DESC, event_id DESC LIMIT 50",
    "rows_since_false_positive": f"""WITH {_E}, {_L}, s AS (SELECT s_suppkey AS incident_id, {pick_sql('s_suppkey', L.STATUSES)} AS status, make_timestamp(694224000000000 + s_suppkey * 864000000000) AS marked_at FROM supplier)
      SELECT incident_id, status, CASE WHEN status = 'false_positive' THEN coalesce((SELECT CAST(sum(e.rows) AS BIGINT) FROM lk JOIN e ON e.event_id = lk.event_id WHERE lk.incident_id = s.incident_id AND lk.linked_at >= s.marked_at), 0) ELSE 0 END AS rows_since FROM s""",
    "principal_list": f"""WITH {_E}, {_A}, b AS (SELECT agent, target, principal, max(rows) AS max_score, count(*) AS events, count(*) FILTER (anomaly) AS anomalies FROM e GROUP BY 1, 2, 3)
      SELECT agent_name, target, principal, max_score, events, anomalies FROM b JOIN ag USING (agent) ORDER BY max_score DESC, target, principal LIMIT 200""",
    "objects_by_schema": f"""WITH {_F}, n(schema, object) AS (VALUES ('public', 'obj_1'), (NULL, 'obj_2'), ('other', 'obj_3'), (NULL, 'obj_5'))
      SELECT f.schema, f.object, count(*) AS n FROM f JOIN n ON f.schema IS NOT DISTINCT FROM n.schema AND f.object = n.object GROUP BY 1, 2""",
    "unsent_alerts": f"WITH {_I} SELECT incident_id, target FROM ic WHERE severity = 'critical' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey = incident_id)",
    "object_list_changes": f"""WITH {_F}, x AS (SELECT DISTINCT target, db || '.' || object AS name FROM f WHERE finding_id % 3 <> 0), y AS (SELECT DISTINCT target, db || '.' || object AS name FROM f WHERE finding_id % 3 <> 1),
      c AS (SELECT coalesce(x.target, y.target) AS target, count(x.name) AS old_size, count(y.name) AS new_size, count(*) FILTER (x.name IS NULL) AS added, count(*) FILTER (y.name IS NULL) AS removed
        FROM x FULL JOIN y ON x.target = y.target AND x.name = y.name GROUP BY 1)
      SELECT *, CASE WHEN old_size > 0 AND new_size = 0 THEN 'emptied' WHEN removed >= 20 OR (2 * removed >= old_size AND old_size > 0) THEN 'shrunk' ELSE 'none' END AS warning FROM c""",
    "altered_parts": f"""WITH {_F} SELECT target, object, nullif(concat_ws(',', CASE WHEN bool_or(finding_id % 30 = 0) THEN 'database' END, CASE WHEN bool_or(finding_id % 17 = 0) THEN 'object' END,
      CASE WHEN bool_or(finding_id % 40 = 0) THEN 'field' END), '') AS altered FROM f GROUP BY 1, 2""",
    "pattern_sets": f"""WITH {_F}, d AS (SELECT target, count(DISTINCT db) AS dbs FROM f GROUP BY 1), o AS (SELECT target, object, count(DISTINCT db) AS n FROM f GROUP BY 1, 2)
      SELECT d.target, coalesce(string_agg(object, ',' ORDER BY object) FILTER (n = dbs), '') AS patterns FROM d JOIN o ON o.target = d.target GROUP BY 1""",
    "overflow_objects": f"""WITH {EVENTS_SQL}, s AS (SELECT {pick_sql('k', ('*', 'Crm', 'billing ', 'Obj'))} AS database FROM ev WHERE k % 3 = 0 AND event_id % 2 = 0)
      SELECT database, database = '*' OR lower(database) LIKE 'c%' AS retained, CASE WHEN database = '*' THEN false ELSE lower(rtrim(database)) = 'crm' END AS whole, false AS part, true AS "any", true AS star, count(*) AS n FROM s GROUP BY ALL""",
    "dedup_objects": f"""WITH {EVENTS_SQL}, s AS (SELECT k, k % 7 AS a, (k * 2) % 7 AS b, (k * 3) % 7 AS c FROM ev)
      SELECT CAST(CASE WHEN k % 5 = 0 THEN NULL WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS BIGINT) AS at, count(*) AS n FROM s GROUP BY 1""",
    "incident_rematch": f"""WITH {_E} SELECT target || '/' || strftime(ts, '%Y-%m-%d') AS dedup, count(*) AS match_count, max(rows / 100) AS max_score, CAST(sum(rows) AS BIGINT) AS total_rows, min(ts) AS first_ts, max(ts) AS last_ts,
      bool_or(anomaly) AS anomaly, concat_ws(',', CASE WHEN bool_or(k = 3) THEN 'signature.pg_dump' END, CASE WHEN bool_or(rows > 15000) THEN 'volume.large_result' END) AS signals FROM e WHERE rows > 8000 GROUP BY 1""",
    "finding_policies": f"""WITH {_F}, st AS (SELECT o_orderkey AS incident_id, {pick_sql('o_orderkey', ('sure', 'many'))} AS policy, o_custkey AS finding_id, {pick_sql('o_orderkey', L.STATUSES[:3])} AS status, o_orderdate AS created_at,
        CASE WHEN o_orderkey % 5 > 0 THEN {_AT.format('o_orderkey % 3000')} END AS finding_seen, o_orderkey % 200 AS finding_matched, CASE WHEN o_orderkey % 7 > 0 THEN {_AT.format('o_orderkey % 2500')} END AS resolved_at FROM orders
        QUALIFY row_number() OVER (PARTITION BY policy, finding_id ORDER BY created_at DESC, incident_id DESC) = 1),
      m AS (SELECT f.*, 'sure' AS policy, target = 'target_4' AS excepted FROM f WHERE confidence >= 0.9 AND classifier IN ('card_number', 'iban', 'password_hash') AND NOT fp
        UNION ALL SELECT f.*, 'many', false FROM f WHERE matched >= 150 AND object LIKE 'obj_1%' AND NOT fp)
      SELECT m.finding_id, m.policy, CASE WHEN excepted THEN 'excepted' WHEN status IN ('open', 'acknowledged') THEN CASE WHEN finding_seen IS NULL OR finding_seen < last_seen THEN 'rematched' ELSE 'unchanged' END
        WHEN status = 'resolved' AND NOT (resolved_at IS NULL OR last_seen > resolved_at OR matched > coalesce(finding_matched, 0)) THEN 'suppressed' ELSE 'created' END AS outcome
      FROM m LEFT JOIN st ON st.policy = m.policy AND st.finding_id = m.finding_id""",
    "pending_chunk": f"""WITH {_E}, r AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY ts, event_id) AS t FROM e)
      SELECT event_id, agent, row_number() OVER (ORDER BY t, ts, event_id) AS place FROM r WHERE t <= 50 QUALIFY place <= 200""",
    "name_cases": f"""WITH {_E}, {_T} SELECT engine, name_case, CASE WHEN {_CASED} THEN (CASE WHEN k % 2 = 0 THEN lower(object) ELSE object END) LIKE 'Obj\\_1%' ESCAPE '\\' ELSE lower(object) LIKE 'obj\\_1%' ESCAPE '\\' END AS matches, count(*) AS n
      FROM e JOIN tg USING (agent, target) GROUP BY ALL""",
    "case_inventory": f"""WITH {_E}, {_T}, n AS (SELECT engine, name_case, object, count(*) AS n FROM e JOIN tg USING (agent, target) GROUP BY ALL), x(exception, loose, strict) AS (VALUES ('obj_1*', '^obj_1.*$', '^obj_1.*$'), ('Obj_2*', '^obj_2.*$', '^Obj_2.*$'), ('OBJ_?', '^obj_.$', '^OBJ_.$'))
      SELECT engine, name_case, object, exception, n FROM n, x WHERE regexp_matches(lower(object), loose) AND {_CASED} AND NOT regexp_matches(object, strict)""",
    "batch_identity": f"""WITH {EVENTS_SQL} SELECT principal, sha256('{{"count":' || CAST(count(*) AS VARCHAR) || ',"events":[' || string_agg('{{"event_id":' || CAST(event_id AS VARCHAR) || ',"measure":{{"action":"' || action || '","rows":' || CAST(rows AS VARCHAR) || '}},"target":"' || target || '"}}', ',' ORDER BY event_id) || ']}}') AS content FROM ev GROUP BY 1""",
    "event_targets": f"""WITH {_E}, {_T}, s AS (SELECT *, {pick_sql('k', _ENGINES)} AS en FROM e) SELECT s.agent, s.target, tg.engine IS NULL AS unexpected, coalesce(en <> tg.engine, true) AS mismatch, count(*) AS n FROM s LEFT JOIN tg ON tg.agent = s.agent AND tg.target = s.target GROUP BY ALL""",
    "false_positive_marks": f"""WITH {_F}, {_I} SELECT 'incident ' || CASE WHEN f.finding_id % 4 = 0 AND status IN ('open', 'acknowledged') THEN 'false_positive' ELSE status END AS what, count(*) AS n FROM ic LEFT JOIN f USING (finding_id) GROUP BY 1
      UNION ALL SELECT 'finding pending', count(*) FROM f WHERE finding_id % 4 = 1""",
    "agent_list": f"""WITH {_A}, {_T} SELECT ag.agent, agent_name, coalesce(string_agg(DISTINCT target, ',' ORDER BY target), '') AS targets, count(DISTINCT engine) AS engines
      FROM ag LEFT JOIN tg ON tg.agent = ag.agent AND tg.agent <> 'agent_3' GROUP BY 1, 2""",
    "integrity_budget": f"""WITH {_E}, r AS (SELECT *, row_number() OVER (PARTITION BY agent, date_trunc('hour', ts) ORDER BY ts, event_id) > 1 AS cut FROM e),
      s AS (SELECT *, CAST(sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY agent ORDER BY ts, event_id) AS BIGINT) AS c FROM r)
      SELECT event_id, agent, c - coalesce(lag(c) OVER (PARTITION BY agent ORDER BY ts, event_id), 0) AS suppressed_before FROM s WHERE NOT cut""",
    "token_requests": f"""WITH {EVENTS_SQL} SELECT event_id, (SELECT arg_max(q.event_id, struct_pack(t := q.ts, i := q.event_id)) FROM ev q WHERE q.action = 'connect' AND q.principal = ev.principal AND q.ts <= ev.ts AND q.ts >= ev.ts - INTERVAL 6 HOURS) AS request_id FROM ev WHERE action = 'read'""",
    "guarded_findings": f"""WITH {_F} SELECT object, classifier, count(*) AS n, count(CASE WHEN object NOT LIKE 'obj_1%' THEN 1 END) AS samples, count(CASE WHEN NOT (object LIKE 'obj_1%' AND classifier IN ('aws_key', 'password_hash')) THEN 1 END) AS fingerprints
      FROM f WHERE NOT regexp_matches(object, '^obj_2.$') GROUP BY 1, 2""",
    "evaluate_chunk": f"""{_FOLD.format(ev=EVENTS_SQL, g="target || chr(31) || principal")}, {FINDINGS_SQL}, {_SO}, tb AS (SELECT target, max(s) AS bound FROM so GROUP BY 1),
      x AS (SELECT ev.*, k % 10 = 0 AS ovf, coalesce(CASE WHEN k % 10 = 0 THEN 0.0 ELSE so.s END, 0.0) AS sensitivity, coalesce(tb.bound, 0.0) AS bound, coalesce(b.anomaly, false) AS an
        FROM ev LEFT JOIN so ON so.target = ev.target AND so.object = lower(ev.object) LEFT JOIN tb ON tb.target = ev.target LEFT JOIN b ON b.event_id = ev.event_id),
      y AS (SELECT *, CASE WHEN ovf THEN greatest(sensitivity, bound) ELSE sensitivity END AS bs FROM x),
      z AS (SELECT *, CASE WHEN rows > 0 AND sensitivity > 0 THEN round(sensitivity * log10(1 + rows), 2) ELSE 0.0 END AS score, CASE WHEN rows > 0 AND bs > 0 THEN round(bs * log10(1 + rows), 2) ELSE 0.0 END AS bscore FROM y)
      SELECT event_id, sensitivity, score, bs AS bound_sensitivity, bscore AS bound_score, an AS anomaly, CASE WHEN principal IN ('7', '8', '9') THEN '' ELSE
        concat_ws(',', CASE WHEN bscore >= 80 THEN 'costly' END, CASE WHEN (hour(ts) >= 22 OR hour(ts) <= 4) AND action = 'read' AND rows >= 20000 THEN 'night' END, CASE WHEN an THEN 'odd' END) END AS policies FROM z""",
    "scan_rotation": "SELECT s_name, md5('7/' || s_name) AS place FROM supplier",
    "sample_shares": "SELECT s_suppkey, CASE WHEN s_suppkey * 700 >= 10000 AND s_suppkey * 700 >= 10000 THEN greatest(0.0001, least(100.0, 100.0 * 3 * 1000 / (s_suppkey * 700))) END AS percent FROM supplier",
}
