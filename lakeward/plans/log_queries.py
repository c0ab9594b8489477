"""Log formats: lines are written from the events and read back, so that the SQL is that of the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward.plans.base import EVENTS_SQL, access_events, pick, pick_sql, read
from lakeward.session import shared_folder
from lakeward.sources import logs as L
from lakeward.sources.framing import csv_records, header_records

_STATES = ("42P01", "57014", "28P01", "25P02", "22012", "3D000", "bad")
_OUT = ("ts", "principal", "client", "action", "database", "rows")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.date_format(F.date_trunc("second", "ts"), "yyyy-MM-dd HH:mm:ss")
    return access_events(spark, sf_dir).withColumn("at", seconds).withColumn("host", F.concat(F.lit("10.0.0."), (F.col("k") % 250).cast("string")))


def csv_framing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in text files, half of them with a line break and quotes in a field, framed in byte ranges."""
    text = F.when(F.col("k") % 2 == 0, F.lit('"select ""a""\nfrom t"')).otherwise(F.lit("plain"))
    folder = shared_folder(spark, "csv-log")
    _events(spark, sf_dir).select(F.concat_ws(",", F.col("event_id").cast("string"), text).alias("value")).write.text(folder)
    found = csv_records(spark, folder)
    return found.select(F.regexp_extract("record", "^([0-9]+),", 1).cast("long").alias("event_id"), F.length("record").cast("long").alias("length"), "oversized")


def pg_audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.concat(F.lit('AUDIT: SESSION,1,1,'), F.when(F.col("action") == "write", "WRITE,INSERT").otherwise("READ,SELECT"), F.lit(',TABLE,t,""select 1, 2"",<none>,'), F.col("rows").cast("string"))
    line = F.concat(F.col("at"), F.lit(" UTC,"), "principal", F.lit(",crm,1,"), "host", F.lit(":5000,s,1,SELECT,x,1/1,0,LOG,00000,\""), F.replace(message, F.lit('"'), F.lit('""')), F.lit('"'))
    lines = _events(spark, sf_dir).select(F.regexp_replace(line, '""""', '""').alias("value"))
    return L.pg_csvlog(lines).select(*_OUT)


def pg_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = pick(F.col("k"), _STATES)
    severity = F.when(F.col("event_id") % 3 == 0, "FATAL").when(F.col("event_id") % 3 == 1, "ERROR").otherwise("LOG")
    context = F.when(F.col("event_id") % 5 == 0, "function f")
    line = F.concat(F.col("at"), F.lit(" UTC,"), "principal", F.lit(",crm,1,h:1,s"), F.col("k").cast("string"), F.lit(",1,SELECT,x,1/1,0,"), severity, F.lit(","), state, F.lit(",\"never, read\",,,,,"), F.coalesce(context, F.lit("")), F.lit(","), F.when(F.col("k") % 4 > 0, "select 1").otherwise(""), F.lit(",,"))
    return L.pg_failures(_events(spark, sf_dir).select(line.alias("value")))


def mysql_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    verb = pick(F.col("k"), ("select", "insert", "create_table", "grant"))
    failed = F.when(F.col("k") % 9 == 0, 1045).otherwise(0)
    flat = F.to_json(F.struct(F.struct(F.when(F.col("k") % 3 == 0, "Connect").otherwise("Query").alias("name"), F.concat(F.replace("at", F.lit(" "), F.lit("T")), F.lit("Z")).alias("timestamp"), F.concat("principal", F.lit("[x] @ h [1]")).alias("user"), F.col("host").alias("ip"), F.lit("crm").alias("db"), verb.alias("command_class"), F.lit("q").alias("sqltext"), failed.alias("status")).alias("audit_record")))
    login = F.to_json(F.struct(F.col("at").alias("timestamp"), F.lit("connection").alias("class"), F.lit("connect").alias("event"), F.struct(F.col("principal").alias("user"), F.lit("h").alias("host")).alias("account"), F.struct(F.col("host").alias("ip")).alias("login"), F.struct(failed.alias("status"), F.lit("").alias("db")).alias("connection_data")))
    lines = _events(spark, sf_dir).select(F.when(F.col("event_id") % 2 == 0, flat).otherwise(login).alias("value"))
    return L.mysql_json(lines).select(*_OUT[:5], "statement")


_OPERATIONS = (
    "CONNECT,crm,,0", "CONNECT,crm,,1045", "FAILED_CONNECT,,,1045", "DISCONNECT,,,0", "QUERY,crm,'select \\'a,b\\' from t',0", "QUERY,crm,'insert into t values (1)',0",
    "QUERY,crm,'drop table t',0", "QUERY,crm,'set x=1',0", "READ,crm,t,", "WRITE,crm,t,", "RENAME,crm,t,", "SHUTDOWN,,,",
)
_OPERATION_ACTIONS = ("connect", "auth_failure", "auth_failure", "", "read", "write", "ddl", "", "read", "write", "ddl", "")


def mariadb_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a server audit: connections, statements and table accesses; some are no access at all."""
    line = F.concat_ws(",", F.date_format("ts", "yyyyMMdd HH:mm:ss"), F.lit("db1"), "principal", "host", F.lit("7"), F.lit("9"), pick(F.col("event_id"), _OPERATIONS))
    return L.mariadb_server_audit(_events(spark, sf_dir).select(line.alias("value"))).select("ts", "principal", "client", "action", "database", "statement")


_ZONES = (" UTC", "+02", " -0530", " CEST", "Z", "")
_CLASSES = ("READ", "WRITE", "DDL", "ROLE", "MISC", "FUNCTION")


def pg_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON log lines in several zones: a time in one that is not told by an offset is null."""
    message = F.concat(F.lit("AUDIT: SESSION,1,1,"), pick(F.col("k"), _CLASSES), F.lit(",X,TABLE,t,select 1,<none>,"), F.col("rows").cast("string"))
    fields = {"timestamp": F.concat("at", pick(F.col("event_id"), _ZONES)), "user": F.col("principal"), "dbname": F.lit("crm"), "remote_host": F.col("host"), "application_name": F.lit("tool"), "message": message}
    lines = _events(spark, sf_dir).select(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("value"))
    return L.pg_jsonlog(lines).select(*_OUT, "application")


def polled_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a poll finds again after the one before: by thread and statement."""
    rows = access_events(spark, sf_dir).select(F.col("principal").alias("thread"), (F.col("event_id") % 600).alias("statement"), "event_id")
    return L.new_history(rows.where("event_id >= 5000").select("thread", "statement"), rows.where("event_id < 5000"), ["thread", "statement"])


def mongo_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.struct(F.concat(F.replace("at", F.lit(" "), F.lit("T")), F.lit(".000Z")).alias("$date")).alias("ts")
    command = pick(F.col("k"), ("find", "insert", "aggregate", "dropCollection", "createUser"))
    args = F.when(F.col("k") % 7 == 0, F.lit('{"$where": "x"}')).otherwise(F.lit('{"a": 1}'))
    check = F.concat(F.lit('{"atype": "authCheck", "ts": {"$date": "'), F.replace("at", F.lit(" "), F.lit("T")), F.lit('.000Z"}, "remote": {"ip": "'), "host", F.lit('"}, "users": [{"user": "'), "principal", F.lit('", "db": "admin"}], "param": {"command": "'), command, F.lit('", "ns": "app.t", "args": '), args, F.lit('}, "result": 0}'))
    login = F.to_json(F.struct(F.lit("authenticate").alias("atype"), date, F.struct(F.col("host").alias("ip")).alias("remote"), F.array().cast("array<struct<user:string>>").alias("users"), F.struct(F.col("principal").alias("user"), F.lit("admin").alias("db")).alias("param"), pick(F.col("k"), ("0", "18", "337")).cast("int").alias("result")))
    lines = _events(spark, sf_dir).select(F.when(F.col("action") == "connect", login).otherwise(check).alias("value"))
    return L.mongo_audit(lines).select("ts", "principal", "client", "action", "statement")


def mongo_slow(spark: SparkSession, sf_dir: str) -> DataFrame:
    command = F.concat(F.lit('{"'), pick(F.col("k"), ("find", "update", "aggregate")), F.lit('": "t"}'))
    line = F.concat(F.lit('{"t": {"$date": "'), F.replace("at", F.lit(" "), F.lit("T")), F.lit('.000+00:00"}, "s": "I", "msg": "'), pick(F.col("event_id"), ("Slow query", "Other")), F.lit('", "attr": {"ns": "app.t", "appName": "tool", "user": "'), "principal", F.lit('", "remote": "'), "host", F.lit(':500", "nreturned": '), F.col("rows").cast("string"), F.lit(', "command": '), command, F.lit("}}"))
    return L.mongo_slow(_events(spark, sf_dir).select(line.alias("value"))).select(*_OUT)


def ldap_accesslog(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _events(spark, sf_dir).select(
        pick(F.col("k"), ("search", "bind", "modify", "abandon")).alias("reqType"), F.concat(F.date_format("ts", "yyyyMMddHHmmss"), F.lit(".000001Z")).alias("reqStart"), F.concat(F.lit("dn:"), "principal").alias("reqAuthzID"),
        F.concat(F.lit("uid=u"), "principal", F.lit(",ou=people,dc=x")).alias("reqDN"), F.when(F.col("k") % 3 == 0, 49).otherwise(0).alias("reqResult"), F.col("rows").alias("reqEntries"),
        pick(F.col("event_id"), ("(objectClass=*)", "(&(objectClass=*)(uid=ana))")).alias("reqFilter"),
    )
    return L.ldap_accesslog(entries).select("ts", "principal", "action", "database", "statement", "rows")


def xe_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = lambda n, v: F.concat(F.lit(f'<data name="{n}"><value>'), v, F.lit("</value></data>"))
    act = lambda n, v: F.concat(F.lit(f'<action name="{n}"><value>'), v, F.lit("</value></action>"))
    line = F.concat(F.lit('<event name="'), pick(F.col("event_id"), ("sql_batch_completed", "rpc_completed", "login")), F.lit('" timestamp="'), F.replace("at", F.lit(" "), F.lit("T")), F.lit('Z">'), data("row_count", F.col("rows").cast("string")), data("batch_text", pick(F.col("k"), ("select * from t where a &lt; 3", "delete from t"))), act("username", F.col("principal")), act("client_hostname", F.col("host")), act("database_name", F.lit("crm")), F.lit("</event>"))
    return L.xe_events(_events(spark, sf_dir).select(line.alias("value"))).select(*_OUT, "statement")


def firebird_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule, end = F.lit("\n" + "-" * 79 + "\n"), F.lit("\n" + "^" * 79 + "\n")
    head = F.concat(F.replace("at", F.lit(" "), F.lit("T")), F.lit(".0000 (123:0x7f) "), pick(F.col("event_id"), ("EXECUTE_STATEMENT_FINISH", "ATTACH_DATABASE", "DETACH_DATABASE")), F.lit("\n\t/db/crm.fdb (ATT_12, U"), "principal", F.lit(":NONE, UTF8, TCPv4:"), "host", F.lit("/5000)\n"))
    body = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("\nStatement 5:"), rule, F.lit("select *\nfrom t"), end, F.col("rows").cast("string"), F.lit(" records fetched\n"))).otherwise(F.lit(""))
    folder = shared_folder(spark, "trace")
    _events(spark, sf_dir).select(F.concat(head, body).alias("value")).write.text(folder)
    records = header_records(spark, folder, f"^{L.TRACE_HEADER}$").withColumnRenamed("record", "value")
    return L.firebird_trace(records).select(*_OUT, "statement")


def login_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.to_json(F.struct(F.when(F.col("k") % 5 == 0, "audit:unknown").otherwise(F.col("principal")).alias("who"), pick(F.col("k"), tuple(L.LOGIN)).alias("action"), F.lit("CAS").alias("application"), F.concat(F.replace("at", F.lit(" "), F.lit("T")), F.lit("Z")).alias("when"), F.col("host").alias("clientIpAddress")))
    return L.login_audit(_events(spark, sf_dir).select(line.alias("value"))).select("ts", "principal", "client", "action")


def redis_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = pick(F.col("k"), ("user:1", "TGT-1-abc", "cas_ticket_registry:7"))
    entries = _events(spark, sf_dir).select("event_id", F.col("event_id").alias("ts"), F.col("host").alias("client"), F.array(pick(F.col("event_id"), ("get", "SET")), key).alias("args"), (F.col("rows") * 100).alias("reply_bytes"))
    return L.redis_replies(entries).select(F.col("ts").alias("event_id"), "command", F.array_join("signals", ",").alias("signals"))


def redis_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _events(spark, sf_dir).select("ts", pick(F.col("k"), ("auth", "command", "key")).alias("reason"), F.col("principal").alias("username"), F.concat(F.lit("id=1 addr="), "host", F.lit(":77 laddr=x:1")).alias("client"))
    return L.redis_refusals(entries)


def full_syncs(spark: SparkSession, sf_dir: str) -> DataFrame:
    polls = access_events(spark, sf_dir).groupBy("target", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg((F.max("k") % 7).cast("long").alias("sync_full"))
    return L.full_syncs(polls, ["target"], "day")


def registry_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    service = F.to_json(F.struct(F.lit("x.Service").alias("@class"), F.concat(F.lit("^https://"), "s_name").alias("serviceId"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("id")))
    return L.registry_values(read(spark, sf_dir, "supplier").select(service.alias("value")))


def server_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    command = pick(F.col("k"), ('{"find": "t", "filter": {"$where": "f()"}}', '{"aggregate": "t", "pipeline": [{"$group": {"x": {"$accumulator": {}}}}]}', '{"find": "t", "filter": {"where": 1}}', '{"find": "t", "filter": {}}'))
    return access_events(spark, sf_dir).groupBy(L.server_code(command).alias("code"), L.whole_collection_read(command).alias("whole")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        csv_framing, pg_audit_lines, pg_json_lines, pg_failures, mariadb_audit, mysql_json, polled_history, mongo_audit, mongo_slow, ldap_accesslog, xe_events, firebird_trace, login_lines, redis_log, redis_refusals, full_syncs,
        registry_values, server_code,
    )
}

# ---- SQL ----------------------------------------------------------------------------------------
_EV = f"{EVENTS_SQL}, e AS (SELECT * EXCLUDE (ts), ts AS exact, date_trunc('second', ts) AS ts, '10.0.0.' || CAST(k % 250 AS VARCHAR) AS client FROM ev)"

ORACLE_SQL = {
    "csv_framing": f"WITH {_EV} SELECT event_id, CAST(length(CAST(event_id AS VARCHAR)) + 1 + CASE WHEN k % 2 = 0 THEN 21 ELSE 5 END AS BIGINT) AS length, false AS oversized FROM e",
    "pg_audit_lines": f"WITH {_EV} SELECT ts, principal, client, CASE WHEN action = 'write' THEN 'write' ELSE 'read' END AS action, 'crm' AS database, rows FROM e",
    "pg_failures": f"""WITH {_EV}, s AS (SELECT *, {pick_sql('k', _STATES)} AS state, k % 4 > 0 AS st, event_id % 5 = 0 AS cx FROM e WHERE event_id % 3 < 2)
      SELECT ts, principal, 's' || CAST(k AS VARCHAR) AS session, state, CASE WHEN NOT st AND state IN ('28P01', '3D000') THEN 'refused' WHEN state = '25P02' AND NOT cx THEN 'refused' WHEN state IN ('42P01', '57014', '25P02') THEN 'quiet' ELSE 'telling' END AS class,
      CASE WHEN event_id % 3 = 0 AND state = '28P01' THEN 'auth_failure' ELSE 'read' END AS action FROM s""",
    "mariadb_audit": f"""WITH {_EV}, o AS (SELECT *, {pick_sql('event_id', _OPERATION_ACTIONS)} AS done FROM e) SELECT ts, principal, client, done AS action, CASE WHEN event_id % 12 = 2 THEN NULL ELSE 'crm' END AS database,
      CASE event_id % 12 WHEN 4 THEN 'select \\''a,b\\'' from t' WHEN 5 THEN 'insert into t values (1)' WHEN 6 THEN 'drop table t' WHEN 8 THEN 't' WHEN 9 THEN 't' WHEN 10 THEN 't' END AS statement FROM o WHERE done <> ''""",
    "pg_json_lines": f"""WITH {_EV} SELECT CASE event_id % 6 WHEN 3 THEN NULL WHEN 1 THEN ts - INTERVAL 2 HOUR WHEN 2 THEN ts + INTERVAL 330 MINUTE ELSE ts END AS ts, principal, client, {pick_sql('k', ('read', 'write', 'ddl', 'dcl', '', ''))} AS action,
      'crm' AS database, rows, 'tool' AS application FROM e WHERE k % 6 < 4""",
    "mysql_json": f"""WITH {_EV} SELECT ts, principal, client, CASE WHEN event_id % 2 = 1 OR k % 3 = 0 THEN CASE WHEN k % 9 = 0 THEN 'auth_failure' ELSE 'connect' END ELSE {pick_sql('k', ('read', 'write', 'ddl', 'dcl'))} END AS action,
      CASE WHEN event_id % 2 = 0 THEN 'crm' END AS database, CASE WHEN event_id % 2 = 0 THEN 'q' END AS statement FROM e""",
    "polled_history": f"WITH {EVENTS_SQL} SELECT DISTINCT principal AS thread, event_id % 600 AS statement FROM ev WHERE event_id >= 5000 EXCEPT SELECT principal, event_id % 600 FROM ev WHERE event_id < 5000",
    "mongo_audit": f"""WITH {_EV} SELECT ts, principal, client, CASE WHEN action = 'connect' THEN CASE WHEN k % 3 = 0 THEN 'connect' ELSE 'auth_failure' END ELSE {pick_sql('k', ('read', 'write', 'read', 'ddl', 'dcl'))} END AS action,
      CASE WHEN action <> 'connect' AND k % 7 = 0 THEN '*' END AS statement FROM e WHERE NOT (action = 'connect' AND k % 3 = 2)""",
    "mongo_slow": f"WITH {_EV} SELECT ts, principal, client, {pick_sql('k', ('read', 'write', 'read'))} AS action, 'app' AS database, rows FROM e WHERE event_id % 2 = 0",
    "ldap_accesslog": f"""WITH {_EV} SELECT ts, CASE WHEN k % 4 = 1 THEN 'uid=u' || principal || ',ou=people,dc=x' ELSE 'dn:' || principal END AS principal, CASE k % 4 WHEN 0 THEN 'read' WHEN 2 THEN 'write' ELSE CASE WHEN k % 3 = 0 THEN 'auth_failure' ELSE 'connect' END END AS action,
      'uid=*,ou=people,dc=x' AS database, CASE WHEN k % 4 = 0 AND event_id % 2 = 0 THEN 'shape.bulk_search' END AS statement, rows FROM e WHERE k % 4 < 3""",
    "xe_events": f"WITH {_EV} SELECT ts, principal, client, {pick_sql('k', ('read', 'write'))} AS action, 'crm' AS database, rows, {pick_sql('k', ('select * from t where a < 3', 'delete from t'))} AS statement FROM e WHERE event_id % 3 < 2",
    "firebird_trace": f"""WITH {_EV} SELECT ts, 'U' || principal AS principal, client, CASE WHEN event_id % 3 = 0 THEN 'read' ELSE 'connect' END AS action, '/db/crm.fdb' AS database, CASE WHEN event_id % 3 = 0 THEN rows END AS rows,
      CASE WHEN event_id % 3 = 0 THEN 'select *' || chr(10) || 'from t' END AS statement FROM e WHERE event_id % 3 < 2""",
    "login_lines": f"WITH {_EV} SELECT ts, CASE WHEN k % 5 > 0 THEN principal END AS principal, client, {pick_sql('k', tuple(L.LOGIN.values()))} AS action FROM e",
    "redis_log": f"""WITH {_EV} SELECT event_id, {pick_sql('event_id', ('GET', 'SET'))} AS command, concat_ws(',', CASE WHEN event_id % 2 = 0 AND k % 3 > 0 THEN 'signature.cas_ticket_read' END, CASE WHEN rows * 100 >= 1048576 THEN 'volume.large_reply' END) AS signals FROM e""",
    "redis_refusals": f"WITH {_EV} SELECT exact AS ts, principal, client, 'auth_failure' AS action FROM e WHERE k % 3 = 0",
    "full_syncs": f"""WITH {EVENTS_SQL}, p AS (SELECT target, strftime(ts, '%Y-%m-%d') AS day, CAST(max(k) % 7 AS BIGINT) AS s FROM ev GROUP BY 1, 2), l AS (SELECT *, lag(s) OVER (PARTITION BY target ORDER BY day) AS b FROM p),
      d AS (SELECT target, day, CASE WHEN s < b THEN s ELSE s - b END AS copies FROM l WHERE b IS NOT NULL) SELECT target, day, 'signature.full_sync' AS signal, copies FROM d WHERE copies > 0""",
    "registry_values": """SELECT s_name AS object, 'serviceId' AS field, '^https://' || s_name AS value FROM supplier UNION ALL SELECT s_name, 'name', s_name FROM supplier UNION ALL SELECT s_name, 'id', CAST(s_suppkey AS VARCHAR) FROM supplier""",
    "server_code": f"WITH {EVENTS_SQL} SELECT k % 4 < 2 AS code, k % 4 = 3 AS whole, count(*) AS n FROM ev GROUP BY 1, 2",
}
