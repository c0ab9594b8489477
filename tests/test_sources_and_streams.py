"""Log parsers, flattening, key patterns and streams."""

import datetime as dt

from pyspark.sql import functions as F

from lakeward.operators.correlation import baselines
from lakeward.operators.validation import learned_pattern

from lakeward.operators import audit as A
from lakeward.sources import logs as L
from lakeward.sources import sampling as P
from lakeward.streaming import audit_stream as S


def test_pgaudit_csv_and_json(spark):
    message = 'AUDIT: SESSION,1,1,READ,SELECT,TABLE,crm.t,"select * from crm.t",<none>,42'
    line = '2024-01-02 03:04:05.678 UTC,ana,crm,1,"10.0.0.9:5000",s,1,SELECT,2024-01-02,1/1,0,LOG,00000,"' + message.replace('"', '""') + '"'
    row = L.pg_csvlog(spark.createDataFrame([(line,), ("broken",)], "value string")).collect()
    assert [(r.principal, r.client, r.action, r.statement, r.rows) for r in row] == [("ana", "10.0.0.9", "read", "select * from crm.t", 42)]
    import json

    entry = json.dumps({"timestamp": "2024-01-02 03:04:05.678 UTC", "user": "ana", "dbname": "crm", "remote_host": "10.0.0.9", "application_name": "psql", "message": message})
    row = L.pg_jsonlog(spark.createDataFrame([(entry,)], "value string")).first()
    assert (row.application, row.rows, str(row.ts)) == ("psql", 42, "2024-01-02 03:04:05.678000")


def test_server_audit_and_logins(spark):
    line = "20240102 03:04:05,db1,ana,10.0.0.9,7,9,QUERY,crm,'select \\'a,b\\' from t',0"
    row = L.mariadb_server_audit(spark.createDataFrame([(line,)], "value string")).first()
    assert (row.principal, row.client, row.action, row.database) == ("ana", "10.0.0.9", "read", "crm") and "a,b" in row.statement
    lines = ['{"who":"ana","action":"AUTHENTICATION_FAILED","when":"2024-01-02T03:04:05Z","clientIpAddress":"10.0.0.9"}', "no json"]
    rows = L.login_audit(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert rows[0].action == "auth_failure" and rows[1].principal is None


def test_commands_filters_and_parts(spark):
    entries = spark.createDataFrame([(1, "c", ["scan", "0", "COUNT", "5000"]), (2, "c", ["SET", "k", "v"])], "ts int, client string, args array<string>")
    rows = L.redis_commands(entries).orderBy("ts").collect()
    assert [(r.action, list(r.objects), list(r.signals)) for r in rows] == [("read", ["*"], ["shape.keyspace_enumeration"]), ("write", ["k"], [])]
    filters = spark.createDataFrame([("(objectClass=person)",), ("(&(objectClass=*)(uid=ana))",), ("(|(mail=*)(uid=*))",)], "f string")
    assert [r[0] for r in filters.select(L.unselective_filter(F.col("f"))).collect()] == [True, False, True]
    parts = spark.createDataFrame([("a", 2, "t"), ("a", 1, "select * from ")], "id string, n int, s string")
    assert L.reassemble(parts, ["id"], "n", "s").first().s == "select * from t"


def test_flatten_and_patterns(spark):
    frame = spark.sql("select 1 as id, named_struct('a', array(named_struct('b', 'x'), named_struct('b', 'y')), 'm', map('k1', 5), 'n', null) as d")
    assert sorted(tuple(r)[1:] for r in P.flatten(frame, "id", "d").collect()) == [("a[].b", "x"), ("a[].b", "y"), ("m.*", "5")]
    keys = spark.createDataFrame([(f"customer:{i}:email",) for i in range(30)] + [(f"tag:{chr(97 + i)}{chr(98 + i)}:x",) for i in range(20)] + [("cfg:mode",)], "k string")
    assert {r.pattern: r.n for r in P.key_patterns(keys, "k").collect()} == {"customer:*:email": 30, "tag:*:x": 20, "cfg:mode": 1}


def test_patterns_of_deep_keys_and_same_suffixes(spark):
    letters = [chr(97 + k) for k in range(20)]
    deep = [(f"a:b:c:d:{x}:z{x}",) for x in letters]
    suffix = [("session:jane:cart",), ("session:joe:cart",), ("phone:1",), ("addressbook:2",), ("one:two:three:four",), (None,)]
    got = {r.pattern: r.n for r in P.key_patterns(spark.createDataFrame(deep + suffix, "k string"), "k").collect()}
    assert got == {"a:b:c:d:*:*": 20, "session:*:cart": 2, "*:*": 2, "one:two:three:four": 1, None: 1}


def test_empty_and_null_events(spark):
    kind = "ts timestamp, ts_last timestamp, k string, aggregated_count int, rows long, bytes long, signals array<string>, overflowed boolean"
    assert A.aggregate_events(spark.createDataFrame([], kind), ["k"]).count() == 0
    rows = spark.sql(f"select timestamp'2024-01-01 00:00:10' ts, null ts_last, 'a' k, 1 aggregated_count, x rows, cast(null as bigint) bytes, array('s') signals, false overflowed from values (cast(null as bigint)), (5) t(x)")
    row = A.aggregate_events(rows, ["k"]).first()
    assert (row.rows, row.bytes, row.aggregated_count, list(row.signals)) == (5, None, 2, ["s"])


def test_object_bound_and_reopening(spark):
    frame = spark.createDataFrame([([f"o{i:02}" for i in range(20)],), (["b", "a", "b"],), ([],)], "o array<string>")
    got = [r[0] for r in frame.select(A.bound_objects(F.col("o"))).collect()]
    assert got[0] == [f"o{i:02}" for i in range(15)] + ["*"] and got[1:] == [["a", "b"], []]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.range(600).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(1_704_067_200 + F.col("id") * 7).alias("ts"), F.lit(None).cast("timestamp").alias("ts_last"), (F.col("id") % 3).cast("string").alias("principal"),
        F.lit("read").alias("action"), F.lit(1).alias("aggregated_count"), F.when(F.col("id") == 599, 1_000_000).otherwise(10 + F.col("id") % 5).cast("long").alias("rows"), F.lit(None).cast("long").alias("bytes"),
        F.array(F.lit("s")).alias("signals"), F.lit(False).alias("overflowed"),
    )
    source = str(tmp_path / "in")
    events.repartition(3, "event_id").write.parquet(source)
    stream = S.read_events(spark, source, events.schema.simpleString()[7:-1].replace(":", " "))
    query = S.write_idempotent(S.window_events(stream, ["principal"], 60, "0 seconds"), str(tmp_path / "out"), str(tmp_path / "c1"))
    query.awaitTermination(120)
    got = {(r.principal, r.window_start): (r.aggregated_count, r.rows) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    expected = {(r.principal, r.window_start): (r.aggregated_count, r.rows) for r in A.aggregate_events(events, ["principal"], 60).collect()}
    assert got and all(expected[k] == v for k, v in got.items()) and len(got) >= len(expected) - 6
    query = S.write_idempotent(S.baseline_verdicts(S.read_events(spark, source, events.schema.simpleString()[7:-1].replace(":", " "))), str(tmp_path / "verdicts"), str(tmp_path / "c2"))
    query.awaitTermination(120)
    verdicts = spark.read.parquet(str(tmp_path / "verdicts"))
    assert verdicts.count() == 600 and [r.event_id for r in verdicts.where("anomaly").collect()] == [599]


def test_log_times(spark):
    zones = ["UTC", "GMT", "Z", "+02", "-0530", "+05:45", "CEST", "PST", "", "x"]
    rows = spark.createDataFrame([(f"2026-09-29 10:00:00.5 {z}".rstrip(),) for z in zones] + [(None,), ("2026-13-29 10:00:00 UTC",), ("2026-09-29 25:00:00 UTC",)], "t string")
    got = [r[0] for r in rows.select(L.log_time(F.col("t")).cast("string")).collect()]
    at = lambda h, m: f"2026-09-29 {h:02}:{m:02}:00.5"
    assert got == [at(10, 0)] * 3 + [at(8, 0), at(15, 30), at(4, 15), None, None, at(10, 0), None, None, None, None]


def test_pgaudit_classes(spark):
    line = lambda c: f'2026-09-29 10:00:00 UTC,ana,crm,1,"h:1",s,1,SELECT,x,1/1,0,LOG,00000,"AUDIT: SESSION,1,1,{c},X,TABLE,t,select 1,<none>,1"'
    lines = spark.createDataFrame([(line(c),) for c in ("READ", "WRITE", "DDL", "ROLE", "MISC", "FUNCTION", "MISC_SET", "")], "value string")
    assert [r.action for r in L.pg_csvlog(lines).collect()] == ["read", "write", "ddl", "dcl"]


def test_server_audit_operations(spark):
    lines = [
        "20260929 09:40:35,h,Secr3t,10.0.0.9,12,0,FAILED_CONNECT,,,1045", "20260929 09:40:35,h,,127.0.0.1,15,0,FAILED_CONNECT,,,1158", "20260929 09:40:35,h,app,10.0.0.9,13,0,CONNECT,shop,,0",
        "20260929 09:40:35,h,app,10.0.0.9,13,0,CONNECT,shop,,1045", "20260929 09:40:35,h,app,10.0.0.9,13,0,DISCONNECT,,,0", "20260929 09:40:35,h,hr,10.0.0.9,20,1,QUERY,hr,'insert into t values (\\'a,b\\')',0",
        "20260929 09:40:35,h,hr,10.0.0.9,20,2,QUERY,hr,'DROP TABLE `t`',0", "20260929 09:40:35,h,hr,10.0.0.9,20,3,QUERY,hr,'GRANT SELECT ON `s`.* TO `x`@`%`',0", "20260929 09:40:35,h,hr,10.0.0.9,20,4,QUERY,hr,'set autocommit=1',0",
        "20260929 09:40:35,h,hr,10.0.0.9,20,5,READ,hr,t,", "20260929 09:40:35,h,hr,10.0.0.9,20,6,ALTER,hr,t,", "20260929 09:40:35,h,hr,10.0.0.9,20,7,SHUTDOWN,hr,t,",
    ]
    got = L.mariadb_server_audit(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r.action for r in got] == ["auth_failure", "connect", "auth_failure", "write", "ddl", "dcl", "read", "ddl"] and "a,b" in got[3].statement and got[0].database is None


def test_windows_without_times_and_keys(spark):
    at = lambda m: dt.datetime(2026, 9, 29, 10, m)
    rows = [(1, None), (1, at(0)), (1, at(30)), (None, at(0)), (None, at(5)), ((1 << 60) + 1, at(0)), ((1 << 60) + 2, at(0))]
    got = A.first_event_windows(spark.createDataFrame(rows, "k long, ts timestamp"), ["k"], 600).collect()
    assert sorted((r.k or 0, r.opened_us) for r in got) == sorted((k or 0, int(at(m).replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000) for k, m in ((1, 0), (1, 30), (None, 0), ((1 << 60) + 1, 0), ((1 << 60) + 2, 0)))


def test_baselines_of_null_keys(spark):
    rows = [(1, "t", None, 5, "read"), (2, None, "t", 5, "read"), (3, "t", None, 5, "read"), (4, "t", "", 5, "read")]
    got = {r.event_id: r.n for r in baselines(spark.createDataFrame(rows, "event_id long, a string, b string, rows long, action string"), ["a", "b"], ["event_id"]).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 0}


def test_learned_patterns_fit_their_keys(spark):
    keys = spark.createDataFrame([(f"user:{i}:mail",) for i in range(30)] + [(f"sess/{chr(97 + i)}x:{i}",) for i in range(20)] + [("cfg:mode",)], "k string")
    patterns = [r.pattern for r in P.key_patterns(keys, "k").collect()]
    found = keys.select("k", learned_pattern(F.col("k"), patterns).alias("p"))
    assert {r.p for r in found.collect()} == set(patterns) == {"user:*:mail", "sess/*:*", "cfg:mode"}
    assert spark.range(1).select(learned_pattern(F.lit("new/key:1"), patterns)).first()[0] == "new/*"
