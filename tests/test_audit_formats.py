"""Command tables, audit rows, and signals of sessions."""

import datetime as dt

from pyspark.sql import functions as F

from lakeward.operators import signals as S
from lakeward.sources import logs as L

AT = dt.datetime(2026, 9, 29, 10)


def test_redis_actions_and_keys(spark):
    cases = {
        "GET k": ("read", ["k"]), "set k v": ("write", ["k"]), "MGET a b a": ("read", ["a", "b"]), "MSET a 1 b 2": ("write", ["a", "b"]), "RENAME a b": ("write", ["a", "b"]), "ZUNION 2 a b WEIGHTS 1 2": ("read", ["a", "b"]),
        "ZINTERCARD 9 a b": ("read", ["*"]), "ZDIFF x a": ("read", ["*"]), "FLUSHALL": ("write", ["*"]), "EVAL script 1 k": ("write", ["*"]), "ACL SETUSER x": ("dcl", ["*"]), "CONFIG SET a b": ("ddl", ["*"]), "NEWCMD k": ("read", ["k"]),
        "PING": None, "AUTH user secret": None, "HELLO 3 AUTH u p": None, "DEL a b": ("write", ["a", "b"]), "KEYS *": ("read", ["*"]), "HGETALL h": ("read", ["h"]), "GET": ("read", ["*"]), "UNLINK x": ("write", ["x"]),
    }
    entries = spark.createDataFrame([(i, "c", c.split()) for i, c in enumerate(cases)], "ts int, client string, args array<string>")
    got = {r.ts: (r.action, list(r.objects)) for r in L.redis_commands(entries).collect()}
    assert {c: got.get(i) for i, c in enumerate(cases)} == cases


def test_sqlserver_audit_rows(spark):
    names = "event_time timestamp, sequence_number int, action_id string, succeeded boolean, session_id int, server_principal_name string, client_ip string, application_name string, database_name string, schema_name string, object_name string, statement string, affected_rows long"
    row = lambda action, obj="", text="", n=1, schema="dbo", sid=1, who="ana", rows=None: (AT, n, action, True, sid, who, "10.0.0.9", "app", "crm", schema, obj, text, rows)
    rows = [
        row("SL  ", "Customers", "SELECT * FROM customers WHERE ", 1), row("SL  ", "Customers", "id = 1", 2), row("SL", "T1", "select * from t1 join t2", sid=2), row("SL", "T2", "select * from t1 join t2", sid=2),
        row("SL", "objects$", "select * from t1 join t2", schema="sys", sid=2), row("IN", "t", "insert into t values (1)", sid=3, rows=1), row("LGIF", "", "Login failed for 'x'", sid=4, schema="", who=""), row("LGIS", sid=5, schema=""),
        row("G", "t", "GRANT SELECT ON t TO x", sid=6), row("CR", "t", "create table t", sid=7), row("AUSC", "", "", sid=8), row("VSST", "", "", sid=9), row("BA", "", "BACKUP DATABASE crm", sid=10, schema=""),
    ]
    got = sorted((r.action, r.statement, tuple(r.objects), r.principal, r.rows) for r in L.sqlserver_audit(spark.createDataFrame(rows, names)).collect())
    assert got == sorted([
        ("read", "SELECT * FROM customers WHERE id = 1", ("dbo.customers",), "ana", None), ("read", "select * from t1 join t2", ("dbo.t1", "dbo.t2"), "ana", None), ("write", "insert into t values (1)", ("dbo.t",), "ana", 1),
        ("auth_failure", None, (), None, None), ("connect", None, (), "ana", None), ("dcl", None, ("dbo.t",), "ana", None), ("ddl", None, ("dbo.t",), "ana", None), ("read", "BACKUP DATABASE crm", (), "ana", None),
    ])


def test_signals_of_sessions(spark):
    kind = "event_id long, session string, ts timestamp, action string, rows long, whole_relation boolean, relations array<string>, copy_to string, application string, statement string"
    at = lambda m: AT + dt.timedelta(minutes=m)
    event = lambda i, session, m, relations, application="psql", statement="select", whole=True, action="read", copy_to=None: (i, session, at(m), action, 1, whole, relations, copy_to, application, statement)
    rows = [
        event(1, "s", 0, ["a"]), event(2, "s", 1, ["b"]), event(3, "s", 2, ["a"]), event(4, "s", 3, ["c"]), event(5, "s", 4, ["pg_catalog.pg_class"]), event(6, "t", 0, ["information_schema.tables", "x"]),
        event(7, "m", 0, [], statement="START TRANSACTION  WITH CONSISTENT SNAPSHOT", whole=False), event(8, "m", 1, ["x"]), event(9, "n", 1, ["x"], statement="SELECT /*!40001 SQL_NO_CACHE */ * FROM x"), event(10, "n", 2, ["y"], whole=False),
        event(11, "p", 0, ["x"], "pg_dump"), event(12, "p", 1, ["pg_authid"], "pg_dump"), event(13, None, 0, ["x"], "mongodump/100"), event(14, None, 0, ["x"], "mongodumper"), event(15, None, 1, ["x"], "BCP"), event(16, None, 2, ["x"], "/opt/fb/bin/gbak"),
        event(17, None, 3, ["x"], copy_to="file"), event(18, None, 3, None, whole=None), event(19, None, 4, ["y"], "mongoexport", whole=False),
    ]
    got = {r.event_id: list(r.signals) for r in S.session_signals(spark.createDataFrame(rows, kind)).collect()}
    full, dump, sql = "shape.full_table_read", "signature.pg_dump", "signature.mysqldump"
    assert got == {
        1: [full], 2: [full], 3: [full], 4: [full, dump], 5: [], 6: [full], 7: [], 8: [full, sql], 9: [full, sql], 10: [], 11: [full, dump], 12: [], 13: [full, "signature.mongodump"], 14: [full], 15: [full, "signature.bcp"],
        16: [full, "signature.backup_database"], 17: ["shape.full_table_copy", "signature.copy_to_file"], 18: [], 19: [],
    }


def test_searches_of_one_entry_are_not_wide(spark):
    entries = spark.createDataFrame([(s, "search", "20240101000000Z", "u", "dc=x", 0, 5, "(objectClass=*)") for s in ("base", "SUB", None)], "reqScope string, reqType string, reqStart string, reqAuthzID string, reqDN string, reqResult int, reqEntries long, reqFilter string")
    assert [r.statement for r in L.ldap_accesslog(entries).collect()] == [None, "shape.bulk_search", "shape.bulk_search"]
    assert [r.statement for r in L.ldap_accesslog(entries.drop("reqScope")).select("statement").collect()] == ["shape.bulk_search"] * 3
    assert L.ldap_accesslog(entries.where(F.lit(False))).count() == 0


def test_extended_events_are_parsed_once(spark):
    """What a value is stays what XPath says; the fields of a row come from one parse."""
    data = lambda n, v: f'<data name="{n}"><type name="t" package="p"/><value>{v}</value><text>x</text></data>'
    head = '<event name="rpc_completed" package="s" timestamp="2024-01-05T10:00:00.123Z">'
    texts = {
        data("statement", "  select 1\n from t "): "  select 1\n from t ", data("statement", "<![CDATA[select a < 3 & b]]>"): "select a < 3 & b", data("batch_text", "") + data("statement", "delete &lt; &amp;"): "delete < &",
        data("batch_text", "select <b>1</b>"): "select 1", data("batch_text", "a") + data("batch_text", "b"): "a", '<data name="batch_text"/>': None,
    }
    rows = [(head + body + "</event>",) for body in texts] + [(None,), ("",), ('<x name="rpc_completed"/>',), ('<event name="login"/>',)]
    lines = spark.createDataFrame(rows, "value string")
    found = L.xe_events(lines)
    got = found.collect()
    assert [r.statement for r in got] == list(texts.values()) and len({r.ts for r in got}) == 1
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "from_xml" in plan or "xmltostructs" in plan
