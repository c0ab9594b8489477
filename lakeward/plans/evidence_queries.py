"""Queries of evidence, sketches, sessions and audit rows; what the given tables lack is written from their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward.functions import addresses
from lakeward.functions.evidence import ENTITIES, GIVEN, SURNAMES
from lakeward.operators import evidence as E
from lakeward.operators import heavy as H
from lakeward.operators import signals as S
from lakeward.operators import validation as W
from lakeward.operators.correlation import WEIGHTS
from lakeward.plans.base import EVENTS_SQL, FINDINGS_SQL, access_events, pick, pick_sql, read, sample_findings
from lakeward.plans.discovery_queries import _PLANT, _planted
from lakeward.sources import logs as L

_GIVEN, _FAMILY, _PLACES = (tuple(w.capitalize() for w in sorted(words)) for words in (GIVEN, SURNAMES, ENTITIES))
_FRENCH = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")
_ENGLISH = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def _values(frame: DataFrame, name: str, columns: dict[str, Column]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), c.cast("string").alias("value")) for n, c in columns.items()])
    return frame.select(F.lit(name).alias("object"), F.explode(pairs).alias("p")).select("object", "p.field", "p.value")


def birth_date_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Birth dates in three forms, beside dates of orders and numbers."""
    k = F.col("o_orderkey")
    year, month, day = (F.lit(1930) + k % 70).cast("string"), (k % 12 + 1), (k % 28 + 1).cast("string")
    columns = {
        "iso": F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0")), "french": F.concat_ws(" ", day, pick(month - 1, _FRENCH), year),
        "english": F.when(k % 3 == 0, F.lit("unknown")).otherwise(F.concat(pick(month - 1, _ENGLISH), F.lit(" "), day, F.lit(", "), year)), "ordered": F.date_format("o_orderdate", "yyyy-MM-dd HH:mm"), "key": k,
    }
    return E.birth_date_columns(_values(read(spark, sf_dir, "orders"), "orders", columns))


def name_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of persons and places made from customers, beside their own names."""
    k = F.col("c_custkey")
    columns = {"person": F.concat_ws(" ", F.when(k % 5 == 0, F.lit("Dr.")), pick(k, _GIVEN), F.when(k % 7 == 0, F.lit("de")), pick(k, _FAMILY)), "place": pick(k, _PLACES), "name": F.col("c_name"), "segment": F.initcap("c_mktsegment")}
    return E.name_columns(_values(read(spark, sf_dir, "customer"), "customer", columns), E.small_lexicon(spark))


def phone_region_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region of a column in which one number of four is international, and its numbers by second grade."""
    numbers = _planted(spark, sf_dir, ("phone",)).select("object", "field", F.regexp_replace("value", "^call ", "").alias("raw"))
    return E.counted_numbers(E.regional_phones(numbers))


_ADDRESSES = ("12 rue de la Paix", "Hauptstraße 5", "75001 Paris", "PO Box 77", "no address", "221b Baker Street")


def address_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses made from customers beside their own columns, and the texts of documents."""
    k = F.col("c_custkey")
    made = _values(read(spark, sf_dir, "customer"), "customer", {"address": pick(k, _ADDRESSES), "town": F.lit("75001 Paris"), "name": F.col("c_name")})
    texts = _values(read(spark, sf_dir, "documents"), "documents", {"text": F.col("text")})
    return E.address_columns(made.unionByName(texts))


def heavy_failed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    failures = access_events(spark, sf_dir).where("action = 'auth_failure'").withColumn("one", F.lit(1))
    return H.heavy_groups(failures, "target", "principal", "one", 20_000)


def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values of columns of orders: exact for few, estimated for many, and which are constant."""
    columns = {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "customer": F.col("o_custkey"), "key": F.col("o_orderkey"), "constant": F.lit("x")}
    sketch = H.bounded_distinct(_values(read(spark, sf_dir, "orders"), "orders", columns), ["object", "field"], F.col("value"), 256)
    return sketch.select("object", "field", "distinct", "exact", (F.col("exact") & (F.col("distinct") == 1)).alias("constant"))


_STATEMENTS = ("select * from a", "START TRANSACTION WITH CONSISTENT SNAPSHOT", "select SQL_NO_CACHE * from b", "SHOW CREATE TABLE t")
_APPLICATIONS = ("psql", "pg_dump", "bcp", "mongodump/100", "gbak", "mongoexport x", "app")


def session_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A principal's day is a session; a third of its events read whole relations, some of a catalog."""
    events = access_events(spark, sf_dir).select(
        "event_id", "ts", "action", "rows", F.concat_ws("/", "principal", F.to_date("ts").cast("string")).alias("session"), (F.col("k") % 3 == 0).alias("whole_relation"),
        F.array(F.when(F.col("k") % 9 == 0, F.lit("pg_catalog.pg_class")).otherwise(F.lower("object"))).alias("relations"), F.lit(None).cast("string").alias("copy_to"), pick(F.col("event_id"), _APPLICATIONS).alias("application"),
        pick(F.col("event_id"), _STATEMENTS).alias("statement"),
    )
    return S.session_signals(events).select("event_id", F.array_join("signals", ",").alias("signals"))


_MSSQL = ("SL", "IN", "LGIF", "CR", "G", "VSST")


def sqlserver_audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as audit rows: two objects, the text in two parts."""
    events = access_events(spark, sf_dir)
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("sequence_number"), F.lit(obj).alias("object_name"), F.lit(text).alias("statement")) for obj in ("A", "b") for n, text in ((1, "select * "), (2, "from a, b"))]))
    rows = events.select(
        F.col("ts").alias("event_time"), F.rpad(pick(F.col("event_id"), _MSSQL), 4, " ").alias("action_id"), F.lit(True).alias("succeeded"), F.col("event_id").alias("session_id"), F.col("principal").alias("server_principal_name"),
        F.lit("10.0.0.9").alias("client_ip"), F.lit("").alias("application_name"), F.lit("crm").alias("database_name"), F.lit("dbo").alias("schema_name"), F.col("rows").alias("affected_rows"), parts.alias("p"),
    ).select("*", "p.*").drop("p")
    return L.sqlserver_audit(rows).select("ts", "principal", "action", "database", "statement", "rows", F.array_join("objects", ",").alias("objects"))


_COMMANDS = ("GET a", "MSET a 1 b 2", "PING", "ZUNION 2 a b", "ACL SETUSER x", "CONFIG SET a b", "KEYS *", "DEL b a")
_COMMAND_ACTIONS, _COMMAND_KEYS = ("read", "write", "", "read", "dcl", "ddl", "read", "write"), ("a", "a,b", "", "a,b", "*", "*", "*", "b,a")


def redis_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = access_events(spark, sf_dir).select(F.col("event_id").alias("ts"), F.lit("c").alias("client"), F.split(pick(F.col("k"), _COMMANDS), " ").alias("args"))
    return L.redis_commands(entries).select(F.col("ts").alias("event_id"), "command", "action", F.array_join("objects", ",").alias("objects"), F.array_join("signals", ",").alias("signals"))


def finding_batch_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as items of batches of a hundred: each batch is of a job, and some items are wrong."""
    key = F.col("finding_id")
    items = sample_findings(spark, sf_dir).select(
        F.floor(key / 100).cast("long").alias("batch"), (key % 100).alias("item"), F.floor(key / 100).cast("long").alias("job"), (key % 3).alias("agent"), "target", F.when(key % 50 == 0, "redis").otherwise("mysql").alias("engine"),
        F.when(key % 41 == 0, "shoe_size").otherwise(F.col("classifier")).alias("classifier"), (F.col("matched") + 40).alias("matched"), "sampled",
    )
    jobs = items.select("job").distinct().where("job % 7 <> 3").select("job", F.concat(F.lit("target_"), (F.col("job") % 5).cast("string")).alias("job_target"), F.when(F.col("job") % 2 == 0, 150).otherwise(500).alias("sample_rows"), F.when(F.col("job") % 3 == 0, F.array(F.lit("email"), F.lit("phone"))).alias("job_classifiers"))
    targets = items.select("agent", "target").distinct().where("not (agent = 1 and target = 'target_4')").withColumn("known_engine", F.lit("mysql"))
    return W.batch_errors(items, jobs, targets)


def due_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as deliveries: which are claimed at some time, and what becomes of them."""
    k, now = F.col("o_orderkey"), F.to_timestamp(F.lit("1996-01-01 00:00:00"))
    rows = read(spark, sf_dir, "orders").select(
        k.alias("id"), pick(k, ("pending", "sending", "delivered")).alias("status"), F.col("o_orderdate").cast("timestamp").alias("next_attempt_at"), (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 90 SECONDS")).alias("lease_until"), (k % 9).alias("attempts"),
    )
    claimed = W.claimed_deliveries(rows, now, 500)
    outcome = W.delivery_outcome(F.col("id") % 5 == 0, F.when(F.col("id") % 7 == 0, "channel_disabled"), F.col("id") % 2 == 0, F.col("attempts"))
    return claimed.select("id", "status", "attempts", "lease_until", outcome.alias("outcome"))


QUERIES = {f.__name__: f for f in (finding_batch_errors, due_deliveries, birth_date_columns, name_columns, address_columns, phone_region_columns, heavy_failed_groups, distinct_values, session_signals, sqlserver_audit_rows, redis_access)}

# ---- SQL ----------------------------------------------------------------------------------------
_WHOLE = "k % 3 = 0 AND k % 9 <> 0"

ORACLE_SQL = {
    "finding_batch_errors": f"""WITH {FINDINGS_SQL}, i AS (SELECT finding_id // 100 AS batch, finding_id % 100 AS item, finding_id % 3 AS agent, target, CASE WHEN finding_id % 50 = 0 THEN 'redis' ELSE 'mysql' END AS engine,
        CASE WHEN finding_id % 41 = 0 THEN 'shoe_size' ELSE classifier END AS classifier, matched + 40 AS matched, sampled FROM fi),
      m AS (SELECT *, batch % 7 <> 3 AS known, NOT (agent = 1 AND target = 'target_4') AS reported, '/findings/' || CAST(item AS VARCHAR) || '/' AS ptr FROM i), e AS (
        SELECT batch, item, '/job_id' AS pointer, 'not_found' AS keyword FROM m WHERE NOT known UNION ALL SELECT batch, item, ptr || 'target_id', 'not_found' FROM m WHERE NOT reported
        UNION ALL SELECT batch, item, ptr || 'target_id', 'const' FROM m WHERE known AND target <> 'target_' || CAST(batch % 5 AS VARCHAR) UNION ALL SELECT batch, item, ptr || 'location/engine', 'const' FROM m WHERE reported AND engine <> 'mysql'
        UNION ALL SELECT batch, item, ptr || 'matched', 'maximum' FROM m WHERE matched > sampled UNION ALL SELECT batch, item, ptr || 'sampled', 'maximum' FROM m WHERE known AND batch % 2 = 0 AND sampled > 150
        UNION ALL SELECT batch, item, ptr || 'classifier', 'enum' FROM m WHERE classifier NOT IN ({", ".join(f"'{c}'" for c in WEIGHTS)}) OR (known AND batch % 3 = 0 AND classifier NOT IN ('email', 'phone'))) SELECT * FROM e""",
    "due_deliveries": f"""WITH d AS (SELECT o_orderkey AS id, {pick_sql('o_orderkey', ('pending', 'sending', 'delivered'))} AS status, CAST(o_orderdate AS TIMESTAMP) AS due, o_orderkey % 9 + 1 AS attempts FROM orders),
      c AS (SELECT * FROM d WHERE (status = 'pending' AND due <= TIMESTAMP '1996-01-01') OR (status = 'sending' AND due + INTERVAL 90 SECOND < TIMESTAMP '1996-01-01') ORDER BY due, id LIMIT 500)
      SELECT id, 'sending' AS status, attempts, TIMESTAMP '1996-01-01 00:01:00' AS lease_until, CASE WHEN id % 5 = 0 THEN 'delivered' WHEN id % 7 = 0 THEN 'skipped' WHEN id % 2 = 0 AND attempts < 8 THEN 'retry' ELSE 'failed' END AS outcome FROM c""",
    "birth_date_columns": """WITH y AS (SELECT *, CAST(1930 + o_orderkey % 70 AS INTEGER) AS y, o_orderkey % 28 + 1 AS d FROM orders), v AS (
      SELECT 'iso' AS field, y, d FROM y UNION ALL SELECT 'french', y, d FROM y UNION ALL SELECT 'english', CASE WHEN o_orderkey % 3 > 0 THEN y END, d FROM y
      UNION ALL SELECT 'ordered', CAST(year(o_orderdate) AS INTEGER), day(o_orderdate) FROM y UNION ALL SELECT 'key', NULL, NULL FROM y),
      s AS (SELECT field, count(*) AS n, count(y) AS dated, list_sort(list(y) FILTER (y IS NOT NULL)) AS ys, count(*) FILTER (y >= 2015) AS recent, max(y) AS latest, count(*) FILTER (d > 1 AND y IS NOT NULL) AS other FROM v GROUP BY 1),
      q AS (SELECT *, ys[dated // 10 + 1] AS low, ys[dated // 2 + 1] AS middle, ys[least(9 * dated // 10, dated - 1) + 1] AS high FROM s)
      SELECT 'orders' AS object, field, n, dated, low, middle, high, coalesce(2 * dated >= n AND middle <= 2002 AND high - low >= 10 AND recent <= 0.15 * dated AND latest <= 2026 AND other > 0, false) AS birth_date FROM q""",
    "name_columns": """WITH n AS (SELECT count(*) AS n FROM customer) SELECT 'customer' AS object, field, n, CASE WHEN field = 'person' THEN n ELSE 0 END AS named, CASE WHEN field = 'person' THEN n ELSE 0 END AS given,
      CASE WHEN field = 'place' THEN n ELSE 0 END AS entities, field = 'person' AS person_name FROM n CROSS JOIN (VALUES ('person'), ('place'), ('name'), ('segment')) f(field)""",
    "address_columns": f"""WITH v AS (SELECT 'customer' AS object, unnest(['address', 'town', 'name']) AS field, unnest([{pick_sql('c_custkey', _ADDRESSES)}, '75001 Paris', c_name]) AS value FROM customer
      UNION ALL SELECT 'documents', 'text', text FROM documents),
      g AS (SELECT object, field, {" OR ".join(f"regexp_matches(value, '{p.replace(chr(39), chr(39) * 2)}')" for p in addresses.STRONG)} AS strong, regexp_matches(value, '{addresses.WEAK}') AS weak FROM v WHERE trim(value, chr(32)) <> ''),
      s AS (SELECT object, field, count(*) AS n, count(*) FILTER (strong) AS strong, count(*) FILTER (weak AND NOT strong) AS weak FROM g GROUP BY 1, 2)
      SELECT *, strong >= 0.5 * n OR (strong + weak >= 0.8 * n AND strong >= 0.25 * n) OR (strong >= 3 AND strong >= 0.1 * n) AS postal_address FROM s""",
    "phone_region_columns": f"""WITH {_PLANT}, p AS (SELECT regexp_replace(value, '[^0-9]', '', 'g') AS d, starts_with(value, 'call') AS abroad FROM smp WHERE field = 'phone')
      SELECT 'orders' AS object, 'phone' AS field, 'FR' AS region, 3 AS grade, count(*) AS n, count(DISTINCT CASE WHEN abroad THEN d ELSE '33' || substr(d, 2) END) AS numbers FROM p""",
    "heavy_failed_groups": f"WITH {EVENTS_SQL} SELECT target, principal, count(*) AS n, CAST(0 AS BIGINT) AS error FROM ev WHERE action = 'auth_failure' GROUP BY 1, 2",
    "distinct_values": """WITH v AS (SELECT unnest(['status', 'priority', 'customer', 'key', 'constant']) AS field, unnest([o_orderstatus, o_orderpriority, CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR), 'x']) AS x FROM orders),
      h AS (SELECT DISTINCT field, CAST('0x' || substr(sha256(x), 1, 15) AS BIGINT) AS h FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY h) AS r FROM h), s AS (SELECT field, count(*) AS size, max(h) AS last FROM r WHERE r <= 256 GROUP BY 1)
      SELECT 'orders' AS object, field, CASE WHEN size < 256 THEN size ELSE greatest(CAST(round(255 / (last / 1152921504606846976.0)) AS BIGINT), 256) END AS distinct, size < 256 AS exact, size = 1 AS constant FROM s""",
    "session_signals": f"""WITH {EVENTS_SQL}, e AS (SELECT *, principal || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session, lower(object) AS relation, {pick_sql('event_id', _APPLICATIONS)} AS app, event_id % 4 AS st, {_WHOLE} AS w FROM ev),
      f AS (SELECT *, CASE WHEN w AND action = 'read' THEN (row_number() OVER (PARTITION BY session, relation, w AND action = 'read' ORDER BY ts, event_id) = 1)::INT ELSE 0 END AS new FROM e),
      g AS (SELECT *, sum(new) OVER s AS relations, coalesce(bool_or(st IN (1, 3)) OVER (PARTITION BY session ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS snapshot FROM f WINDOW s AS (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
      SELECT event_id, concat_ws(',', CASE WHEN w AND action = 'read' THEN 'shape.full_table_read' END, CASE WHEN app = 'gbak' THEN 'signature.backup_database' END, CASE WHEN w AND app = 'bcp' THEN 'signature.bcp' END,
        CASE WHEN w AND app = 'mongodump/100' THEN 'signature.mongodump' END, CASE WHEN w AND app = 'mongoexport x' THEN 'signature.mongoexport' END, CASE WHEN w AND (snapshot OR st = 2) THEN 'signature.mysqldump' END,
        CASE WHEN (w AND app = 'pg_dump') OR (w AND action = 'read' AND relations >= 3) THEN 'signature.pg_dump' END, CASE WHEN rows > 10000 THEN 'volume.large_result' END) AS signals FROM g""",
    "sqlserver_audit_rows": f"""WITH {EVENTS_SQL}, e AS (SELECT *, {pick_sql('event_id', ('read', 'write', 'auth_failure', 'ddl', 'dcl', ''))} AS done FROM ev) SELECT ts, principal, done AS action, 'crm' AS database,
      CASE WHEN done IN ('read', 'write') THEN 'select * from a, b' END AS statement, rows, 'dbo.a,dbo.b' AS objects FROM e WHERE done <> ''""",
    "redis_access": f"""WITH {EVENTS_SQL} SELECT event_id, split_part({pick_sql('k', _COMMANDS)}, ' ', 1) AS command, {pick_sql('k', _COMMAND_ACTIONS)} AS action, {pick_sql('k', _COMMAND_KEYS)} AS objects,
      CASE WHEN k % 8 = 6 THEN 'shape.keyspace_enumeration' ELSE '' END AS signals FROM ev WHERE k % 8 <> 2""",
}
