"""Listings, digests, metrics, sources and statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward.functions.sqlshape import sql_shape, statement_kind
from lakeward.operators import serving as V
from lakeward.operators import validation as W
from lakeward.plans.base import access_events, read, sample_findings
from lakeward.sources import sampling as P


def fair_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.fair_listing(sample_findings(spark, sf_dir), ["target", "object"], [F.desc("last_seen"), F.asc("finding_id")], 500).select("finding_id", "target", "object", F.col("round").cast("long").alias("round"))


def summary_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.summary(sample_findings(spark, sf_dir), ["target", "object", "classifier"]).select("target", "object", "classifier", "findings", "confidence", F.col("rank").cast("long").alias("rank"))


def latest_per_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.latest_per(access_events(spark, sf_dir), ["target", "action"], [F.desc("ts"), F.desc("event_id")]).select("target", "action", "event_id", "ts")


def _incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda c, n: F.get(F.array(*map(F.lit, n)), (c % len(n)).cast("int"))
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("incident_id"), pick(F.col("o_custkey"), V.SEVERITIES[:3]).alias("severity"), pick(F.col("o_orderkey"), ("open", "acknowledged", "resolved", "false_positive")).alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("ts"), F.concat(F.lit("agent_"), (F.col("o_custkey") % 7).cast("string")).alias("agent"),
    )


def severity_sort_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _incidents(spark, sf_dir).where("status = 'open'")
    return V.newest(rows, [V.severity_rank(F.col("severity")), F.desc("ts"), F.asc("incident_id")], 500).select("incident_id", "severity", "ts")


def newest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.newest(access_events(spark, sf_dir).where("action = 'read'"), [F.desc("ts"), F.desc("event_id")], 500).select("event_id", "ts", "principal")


def active_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.counts_by_severity(_incidents(spark, sf_dir))


def hourly_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.hourly_digest(access_events(spark, sf_dir), "target")


def suppression_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed logins as what was held back, seen from the middle of the last full day of events."""
    failed = access_events(spark, sf_dir).where("action = 'auth_failure'")
    return V.suppression_digests(failed, "target", F.to_timestamp(F.lit("2024-01-29 12:30:00")))


def event_digest_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.event_digest(access_events(spark, sf_dir), "action", "principal")


def coverage_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c: (F.col("o_orderkey") % c).cast("double")
    progress = F.create_map(F.lit("objects_total"), n(50) + 10, F.lit("objects_sampled"), n(40), F.lit("skipped_error"), n(3), F.lit("skipped_limit"), n(5))
    jobs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), progress.alias("progress"))
    return V.coverage(jobs).select("job_id", "skipped", "unreached", "warn")


def settings_shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each month's ordered priorities and customers as a list of objects, against the list of the month before."""
    from pyspark.sql import Window

    named = F.concat_ws("/", "o_orderpriority", (F.col("o_custkey") % 40).cast("string"))
    months = read(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.collect_set(named).alias("now"))
    lists = months.withColumn("old", F.lag("now").over(Window.orderBy("month"))).where("old is not null")  # some hundred months
    removed = F.size(F.array_except("old", "now"))
    added = F.size(F.array_except("now", "old"))
    return lists.select("month", removed.cast("long").alias("removed"), added.cast("long").alias("added"), F.coalesce(V.shrink_warning(F.size("old"), removed, F.size("now")), F.lit("none")).alias("warning"))


def silent_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.silent(access_events(spark, sf_dir), "principal", F.to_timestamp(F.lit("2024-01-30 12:00:00")), 86_400)


def status_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _incidents(spark, sf_dir).groupBy("status", "severity").agg(F.count("*").alias("n"))
    return V.prometheus(rows, "incidents", ["severity", "status"], "n")


def findings_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and order-free hash sum of the findings: changes when any row does."""
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("finding_id").cast("string"), "target", "object", "classifier")), 1, 8), 16, 10).cast("long")
    return sample_findings(spark, sf_dir).agg(F.count("*").alias("n"), F.sum(digest).cast("long").alias("stamp"))


def incident_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the ids of at most ten of the incidents they are linked to."""
    links = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 10_000).alias("event_id"), F.col("l_suppkey").alias("incident_id")).distinct()
    ids = links.groupBy("event_id").agg(F.slice(F.sort_array(F.collect_set("incident_id")), 1, 10).alias("ids"))
    joined = access_events(spark, sf_dir).join(ids, "event_id")
    return joined.select("event_id", "action", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as deliveries: the number of a line is that of the attempt."""
    attempts = read(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("attempt")).agg(F.count("*").alias("deliveries"))
    return attempts.withColumn("seconds", V.backoff_seconds(F.col("attempt")).cast("long"))


def document_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = read(spark, sf_dir, "events").select("event_id", F.struct(F.from_json("props", "k int").alias("props"), F.array(F.struct(F.col("event_type").alias("t"))).alias("tags"), F.create_map(F.col("event_type"), F.col("user_id")).alias("by")).alias("doc"))
    return P.flatten(nested, "event_id", "doc").groupBy("path").agg(F.count("*").alias("n"), F.min("value").alias("least"))


def key_pattern_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = read(spark, sf_dir, "pages").select(F.regexp_replace("url", "^https?://|[?#].*$|\\.html$", "").alias("key"))
    return P.key_patterns(urls, "key", "/:.")


def family_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.balance_families(read(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 200)


def object_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return P.select_objects(suppliers, "s_name", ["supplier#*1?", "*7"], ["*17"])


STATEMENTS = (
    "SELECT * FROM crm.customers", "select id from a, \"B c\" where x = 'y'", "COPY t TO '/tmp/x'", "COPY t TO PROGRAM 'cat'", "WITH q AS (SELECT 1) SELECT * FROM q",
    "SELECT count(*) FROM t", "SELECT * FROM t LIMIT 5", "SELECT * FROM t LIMIT 20000", "DELETE FROM t WHERE id = 3 -- x", "GRANT SELECT ON t TO u", "CREATE TABLE z (a int)", "vacuum",
)


def sql_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of tables and lists of columns that the events name; the lexer has no SQL form."""
    text = F.get(F.array(*map(F.lit, STATEMENTS)), (F.col("event_id") % len(STATEMENTS)).cast("int"))
    texts = read(spark, sf_dir, "events").groupBy(text.alias("statement")).agg(F.count("*").alias("n"))
    return texts.withColumn("s", sql_shape(F.col("statement"))).select("statement", "n", "s.kind", F.array_join("s.relations", ",").alias("relations"), "s.whole_relation", "s.copy_to", "s.normalized")


def statement_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.get(F.array(*map(F.lit, STATEMENTS)), (F.col("event_id") % len(STATEMENTS)).cast("int"))
    return read(spark, sf_dir, "events").groupBy(statement_kind(text).alias("kind")).agg(F.count("*").alias("n"))


def hourly_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = W.hourly_budget(access_events(spark, sf_dir), ["target"], ["ts", "event_id"], 2)
    return marked.groupBy("target", "sent").agg(F.count("*").alias("n"))


def dropped_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = access_events(spark, sf_dir).where("action = 'connect'").groupBy("target", "ts").agg(F.max("k").cast("long").alias("dropped"))
    return W.dropped_batch_alerts(reports, "target", "dropped")


def invalid_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = sample_findings(spark, sf_dir).withColumn("matched", F.col("matched") + F.col("finding_id") % 7).withColumn("confidence", F.col("confidence") + 0.02)
    return odd.withColumn("error", F.explode(W.finding_errors())).groupBy("error").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        fair_listing, summary_rank, latest_per_target, severity_sort_topk, newest_events, active_counts, hourly_digest, suppression_digests, event_digest_map, coverage_gap, settings_shrink,
        silent_agents, status_metrics, findings_stamp, incident_events, retry_schedule, document_flatten, key_pattern_templates, family_balance, object_selection,
        sql_shapes, statement_kinds, hourly_budgets, dropped_batches, invalid_findings,
    )
}

# ---- SQL ----------------------------------------------------------------------------------------
from lakeward.plans.base import EVENTS_SQL, FINDINGS_SQL  # noqa: E402

_INC = """ic AS (SELECT o_orderkey AS incident_id, ['critical', 'high', 'medium'][o_custkey % 3 + 1] AS severity,
  ['open', 'acknowledged', 'resolved', 'false_positive'][o_orderkey % 4 + 1] AS status, o_orderdate AS ts FROM orders)"""

ORACLE_SQL = {
    "fair_listing": f"""WITH {FINDINGS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY target, object ORDER BY last_seen DESC, finding_id) AS round FROM fi)
      SELECT finding_id, target, object, round FROM r ORDER BY round, last_seen DESC, finding_id LIMIT 500""",
    "summary_rank": f"""WITH {FINDINGS_SQL}, g AS (SELECT target, object, classifier, count(*) AS findings, max(confidence) AS confidence, max(last_seen) AS ls FROM fi GROUP BY 1, 2, 3)
      SELECT target, object, classifier, findings, confidence, row_number() OVER (PARTITION BY target ORDER BY ls DESC, target, object, classifier) AS rank FROM g""",
    "latest_per_target": f"WITH {EVENTS_SQL} SELECT DISTINCT ON (target, action) target, action, event_id, ts FROM ev ORDER BY target, action, ts DESC, event_id DESC",
    "severity_sort_topk": f"WITH {_INC} SELECT incident_id, severity, ts FROM ic WHERE status = 'open' ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, ts DESC, incident_id LIMIT 500",
    "newest_events": f"WITH {EVENTS_SQL} SELECT event_id, ts, principal FROM ev WHERE action = 'read' ORDER BY ts DESC, event_id DESC LIMIT 500",
    "active_counts": f"WITH {_INC} SELECT s.severity, count(ic.incident_id) AS n FROM (SELECT unnest(['critical', 'high', 'medium', 'low']) AS severity) s LEFT JOIN ic ON ic.severity = s.severity AND ic.status IN ('open', 'acknowledged') GROUP BY 1",
    "hourly_digest": f"WITH {EVENTS_SQL} SELECT target, date_trunc('hour', ts) AS hour, count(*) AS n FROM ev GROUP BY 1, 2",
    "suppression_digests": f"""WITH {EVENTS_SQL} SELECT target, date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, count(*) AS n, 'digest:' || target || '|' || strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%SZ') AS key
      FROM ev WHERE action = 'auth_failure' AND ts >= TIMESTAMP '2024-01-27 12:30:00' AND ts < TIMESTAMP '2024-01-29 12:00:00' GROUP BY ALL""",
    "event_digest_map": f"""WITH {EVENTS_SQL}, k AS (SELECT action, count(*) AS n FROM ev GROUP BY 1)
      SELECT (SELECT count(*) FROM ev) AS events, (SELECT '{{' || string_agg('"' || action || '":' || CAST(n AS VARCHAR), ',' ORDER BY action) || '}}' FROM k) AS kinds, (SELECT count(DISTINCT principal) FROM ev) AS sources""",
    "coverage_gap": """SELECT o_orderkey AS job_id, CAST(o_orderkey % 3 + o_orderkey % 5 AS DOUBLE) AS skipped, CAST(greatest(o_orderkey % 50 + 10 - o_orderkey % 40 - o_orderkey % 3 - o_orderkey % 5, 0) AS DOUBLE) AS unreached,
      (o_orderkey % 50 + 10 - o_orderkey % 40 - o_orderkey % 3 - o_orderkey % 5 > 0 OR o_orderkey % 3 + o_orderkey % 5 > 0) AS warn FROM orders""",
    "settings_shrink": """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, list(DISTINCT o_orderpriority || '/' || CAST(o_custkey % 40 AS VARCHAR)) AS n FROM orders GROUP BY 1), l AS (SELECT month, coalesce(n, []) AS n, lag(coalesce(n, [])) OVER (ORDER BY month) AS o FROM m),
      c AS (SELECT month, len(o) AS os, len(n) AS ns, len(list_filter(o, lambda x: NOT list_contains(n, x))) AS removed, len(list_filter(n, lambda x: NOT list_contains(o, x))) AS added FROM l WHERE o IS NOT NULL)
      SELECT month, removed, added, CASE WHEN os > 0 AND ns = 0 THEN 'emptied' WHEN removed >= 20 OR (2 * removed >= os AND os > 0) THEN 'shrunk' ELSE 'none' END AS warning FROM c""",
    "silent_agents": f"WITH {EVENTS_SQL} SELECT principal, max(ts) AS last_ts, floor(epoch(TIMESTAMP '2024-01-30 12:00:00')) - floor(epoch(max(ts))) > 86400 AS silent FROM ev GROUP BY 1",
    "status_metrics": f"WITH {_INC} SELECT 'incidents{{severity=\"' || severity || '\",status=\"' || status || '\"}} ' || CAST(count(*) AS VARCHAR) AS line FROM ic GROUP BY severity, status",
    "findings_stamp": f"WITH {FINDINGS_SQL} SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', CAST(finding_id AS VARCHAR), target, object, classifier)), 1, 8) AS BIGINT)) AS BIGINT) AS stamp FROM fi",
    "incident_events": f"""WITH {EVENTS_SQL}, l AS (SELECT l_orderkey % 10000 AS event_id, list_slice(list_sort(list_distinct(list(l_suppkey))), 1, 10) AS ids FROM lineitem GROUP BY 1)
      SELECT event_id, action, array_to_string(ids, ',') AS ids FROM ev JOIN l USING (event_id)""",
    "retry_schedule": "SELECT CAST(l_linenumber AS BIGINT) AS attempt, count(*) AS deliveries, CAST(least(3600, 60 * pow(2, l_linenumber - 1)) AS BIGINT) AS seconds FROM lineitem GROUP BY l_linenumber",
    "document_flatten": """SELECT path, count(*) AS n, min(v) AS least FROM (SELECT 'props.k' AS path, regexp_extract(props, '([0-9]+)', 1) AS v FROM events
      UNION ALL SELECT 'tags[].t', event_type FROM events UNION ALL SELECT 'by.*', CAST(user_id AS VARCHAR) FROM events) GROUP BY 1""",
    "family_balance": "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) SELECT doc_id, source FROM r ORDER BY r, source LIMIT 200",
    "object_selection": "SELECT s_suppkey, s_name FROM supplier WHERE (regexp_matches(lower(s_name), '^supplier#.*1.$') OR s_name LIKE '%7') AND s_name NOT LIKE '%17'",
    "hourly_budgets": f"""WITH {EVENTS_SQL}, r AS (SELECT target, row_number() OVER (PARTITION BY target, date_trunc('hour', ts) ORDER BY ts, event_id) <= 2 AS sent FROM ev)
      SELECT target, sent, count(*) AS n FROM r GROUP BY 1, 2""",
    "dropped_batches": f"""WITH {EVENTS_SQL}, c AS (SELECT target, ts, max(k) AS v FROM ev WHERE action = 'connect' GROUP BY 1, 2), l AS (SELECT *, lag(v) OVER (PARTITION BY target ORDER BY ts) AS b FROM c),
      d AS (SELECT target, ts, CASE WHEN b IS NULL OR v < b THEN v ELSE v - b END AS d FROM l) SELECT target, date_trunc('hour', ts) AS hour, CAST(sum(d) AS BIGINT) AS dropped FROM d WHERE d > 0 GROUP BY 1, 2""",
    "invalid_findings": f"""WITH {FINDINGS_SQL} SELECT 'confidence' AS error, count(*) AS n FROM fi WHERE confidence + 0.02 > 1 HAVING count(*) > 0
      UNION ALL SELECT 'matched', count(*) FROM fi WHERE matched + finding_id % 7 > sampled HAVING count(*) > 0""",
    "statement_kinds": """SELECT ['read','read','read','read','read','read','read','read','write','dcl','ddl','other'][event_id % 12 + 1] AS kind, count(*) AS n FROM events GROUP BY 1""",
}
