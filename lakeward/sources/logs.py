"""Audit logs of engines as access events: text or JSON lines in, one schema out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeward.functions.sqlshape import statement_kind
from lakeward.sources.framing import MOST_BYTES

EVENT = ("ts", "principal", "client", "application", "action", "database", "statement", "rows")
# Classes of pgaudit that are accesses, table operations of a server audit, command words of
# key-value stores, actions of login services.
PGAUDIT = {"READ": "read", "WRITE": "write", "DDL": "ddl", "ROLE": "dcl"}
SERVER_AUDIT = {"CONNECT": "connect", "FAILED_CONNECT": "auth_failure", "READ": "read", "WRITE": "write", "CREATE": "ddl", "ALTER": "ddl", "DROP": "ddl", "RENAME": "ddl"}
REDIS_WRITE = tuple(
    "APPEND BITFIELD BITOP BLMOVE BLMPOP BLPOP BRPOP BRPOPLPUSH BZMPOP BZPOPMAX BZPOPMIN COPY DECR DECRBY DEL EXPIRE EXPIREAT FLUSHALL FLUSHDB GEOADD GEORADIUS GEORADIUSBYMEMBER GEOSEARCHSTORE GETDEL GETEX GETSET "
    "HDEL HEXPIRE HEXPIREAT HINCRBY HINCRBYFLOAT HMSET HPERSIST HPEXPIRE HPEXPIREAT HSET HSETNX INCR INCRBY INCRBYFLOAT LINSERT LMOVE LMPOP LPOP LPUSH LPUSHX LREM LSET LTRIM MIGRATE MOVE MSET MSETNX "
    "PERSIST PEXPIRE PEXPIREAT PFADD PFMERGE PSETEX RENAME RENAMENX RESTORE RPOP RPOPLPUSH RPUSH RPUSHX SADD SDIFFSTORE SET SETBIT SETEX SETNX SETRANGE SINTERSTORE SMOVE SORT SPOP SREM SUNIONSTORE SWAPDB UNLINK "
    "XACK XADD XAUTOCLAIM XCLAIM XDEL XGROUP XREADGROUP XSETID XTRIM ZADD ZDIFFSTORE ZINCRBY ZINTERSTORE ZMPOP ZPOPMAX ZPOPMIN ZRANGESTORE ZREM ZREMRANGEBYLEX ZREMRANGEBYRANK ZREMRANGEBYSCORE ZUNIONSTORE "
    "EVAL EVALSHA FCALL".split()
)
#: Commands that neither read nor change data; changes of accounts; changes of the server and its code.
REDIS_IGNORED = tuple("ASKING AUTH CLIENT COMMAND DISCARD ECHO EXEC HELLO INFO LASTSAVE LATENCY MULTI PING PSUBSCRIBE PUNSUBSCRIBE QUIT READONLY READWRITE RESET ROLE SELECT SLOWLOG SSUBSCRIBE SUBSCRIBE SUNSUBSCRIBE TIME UNSUBSCRIBE UNWATCH WAIT WATCH".split())
REDIS_DCL, REDIS_DDL = ("ACL",), ("CONFIG", "FUNCTION", "MODULE", "REPLICAOF", "SCRIPT", "SHUTDOWN", "SLAVEOF")
#: Where the keys of a command are: all arguments, every second one; the first two; behind a number of keys. Others have one key.
REDIS_ALL_KEYS = tuple("DEL EXISTS MGET PFCOUNT SDIFF SINTER SUNION TOUCH UNLINK".split())
REDIS_PAIRS, REDIS_TWO_KEYS = ("MSET", "MSETNX"), tuple("COPY LMOVE RENAME RENAMENX RPOPLPUSH SMOVE GEOSEARCHSTORE ZRANGESTORE".split())
REDIS_COUNTED = tuple("LMPOP SINTERCARD ZDIFF ZINTER ZINTERCARD ZMPOP ZUNION".split())
REDIS_NO_KEY = tuple("DBSIZE EVAL EVALSHA FCALL FLUSHALL FLUSHDB KEYS RANDOMKEY SCAN SWAPDB SYNC PSYNC BGSAVE SAVE MONITOR MIGRATE SORT XREAD XREADGROUP GEORADIUS GEORADIUSBYMEMBER ACL CONFIG FUNCTION MODULE SCRIPT DEBUG DUMP-ALL".split())
#: Action ids of SQL Server Audit.
MSSQL_ACTIONS = {
    **dict.fromkeys(("SL", "RC", "EX", "DBCC", "BA", "BAL"), "read"), **dict.fromkeys(("IN", "UP", "DL", "SN"), "write"), **dict.fromkeys(("LGIF", "DBAF"), "auth_failure"), **dict.fromkeys(("LGIS", "DBAS"), "connect"),
    **dict.fromkeys(("CR", "AL", "DR", "TRUN", "RN"), "ddl"), **dict.fromkeys(("G", "GWG", "D", "DWC", "R", "RWG", "RWC", "APRL", "DPRL", "PWC", "PWR"), "dcl"),
}
LOGIN = {"AUTHENTICATION_SUCCESS": "connect", "AUTHENTICATION_FAILED": "auth_failure", "SERVICE_TICKET_CREATED": "read", "TICKET_GRANTING_TICKET_CREATED": "connect"}


def lookup(table: dict[str, str], key: Column, default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key), F.lit(default))


def _event(frame: DataFrame, **columns: Column) -> DataFrame:
    """The columns of EVENT, null where none is given, and those that are given besides."""
    more = [c.alias(n) for n, c in columns.items() if n not in EVENT]
    return frame.select(*[columns.get(c, F.lit(None).cast("long" if c == "rows" else "string")).alias(c) for c in EVENT], *more)


def log_time(text: Column) -> Column:
    """A server's log time: UTC, GMT, Z, an offset (+02, -0530), or no zone, which is UTC. Abbreviations of other
    zones are ambiguous: null."""
    clock = "^([0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.][0-9]+)?)"
    zone = F.regexp_extract(text, clock + " ?(UTC|GMT|Z|[+-][0-9]{2}(?::?[0-9]{2})?|)$", 2)
    offset = F.when(zone.isin("", "UTC", "GMT", "Z"), F.lit("Z")).otherwise(F.concat(F.substring(zone, 1, 3), F.lit(":"), F.rpad(F.regexp_replace(F.substr(zone, F.lit(4)), ":", ""), 2, "0")))
    known = text.rlike(clock + " ?(UTC|GMT|Z|[+-][0-9]{2}(?::?[0-9]{2})?|)$")
    return F.when(known, F.try_to_timestamp(F.concat(F.regexp_extract(text, clock, 1), offset)))


def pg_csvlog(lines: DataFrame, value: str = "value") -> DataFrame:
    """csvlog records (one logical record a row) with pgaudit messages; other records are dropped."""
    names = "log_time string, user_name string, database_name string, process_id string, connection_from string, session_id string, line_num string, command_tag string, session_start string, vxid string, txid string, severity string, state string, message string"
    parsed = lines.select(F.from_csv(F.col(value), F.lit(names), {"quote": '"', "escape": '"'}).alias("r")).select("r.*")
    return _pgaudit(parsed, F.col("log_time"), F.lit(None).cast("string"))


def pg_jsonlog(lines: DataFrame, value: str = "value") -> DataFrame:
    names = "timestamp string, user string, dbname string, remote_host string, application_name string, state_code string, message string"
    parsed = lines.select(F.from_json(F.col(value), F.lit(names)).alias("r")).select(
        F.col("r.timestamp").alias("log_time"), F.col("r.user").alias("user_name"), F.col("r.dbname").alias("database_name"),
        F.col("r.remote_host").alias("connection_from"), F.col("r.message").alias("message"), F.col("r.application_name").alias("app"),
    )
    return _pgaudit(parsed, F.col("log_time"), F.col("app"))


def _pgaudit(parsed: DataFrame, time: Column, application: Column) -> DataFrame:
    """Records of the classes that are accesses; calls and statements like BEGIN are none."""
    audit = parsed.where(F.col("message").startswith("AUDIT: "))
    fields = "kind string, statement_id string, substatement_id string, class string, command string, object_type string, object_name string, statement string, parameter string, rows string"
    audit = audit.withColumn("a", F.from_csv(F.expr("substring(message, 8)"), F.lit(fields), {"quote": '"', "escape": '"'})).where(F.col("a.class").isin(*PGAUDIT))
    return _event(
        audit,
        ts=log_time(time),
        principal=F.col("user_name"),
        client=F.regexp_replace(F.col("connection_from"), ":[0-9]+$", ""),
        application=application,
        action=lookup(PGAUDIT, F.col("a.class"), "read"),
        database=F.col("database_name"),
        statement=F.col("a.statement"),
        rows=F.expr("try_cast(a.rows as bigint)"),
    )


def mariadb_server_audit(lines: DataFrame, value: str = "value") -> DataFrame:
    """timestamp,host,user,client,connection,query,operation,database,object,code. A statement counts by its kind;
    disconnections, operations that are not known and statements of no kind are left out. A connection
    without an account is a health check."""
    row = F.regexp_extract_all(F.col(value), F.lit("('(?:[^'\\\\]|\\\\.)*'|[^,]*)(?:,|$)"), F.lit(1))
    field = lambda i: F.get("f", F.lit(i))
    text = F.regexp_replace(field(8), "^'|'$", "")
    failed = (field(6) == "CONNECT") & (F.coalesce(F.expr("try_cast(f[9] as int)"), F.lit(0)) != 0)
    kind = F.when(field(6) == "QUERY", F.nullif(statement_kind(text), F.lit("other"))).when(failed, "auth_failure").otherwise(F.nullif(lookup(SERVER_AUDIT, field(6), ""), F.lit("")))
    parsed = lines.select(row.alias("f")).withColumn("_action", kind).where(F.col("_action").isNotNull() & ~(F.col("_action").isin("connect", "auth_failure") & (field(2) == "")))
    return _event(parsed, ts=F.try_to_timestamp(field(0), F.lit("yyyyMMdd HH:mm:ss")), principal=field(2), client=field(3), action=F.col("_action"), database=F.nullif(field(7), F.lit("")), statement=F.nullif(text, F.lit("")))


def login_audit(lines: DataFrame, value: str = "value") -> DataFrame:
    """JSON lines of a login service: who, what, action, application, when (ISO), clientIpAddress."""
    names = "who string, what string, action string, application string, when string, clientIpAddress string"
    parsed = lines.select(F.from_json(F.col(value), F.lit(names)).alias("r")).select("r.*")
    return _event(
        parsed, ts=F.try_to_timestamp("when"), principal=F.nullif(F.col("who"), F.lit("audit:unknown")), client=F.col("clientIpAddress"), application=F.col("application"),
        action=lookup(LOGIN, F.col("action"), "read"),
    )


# ---- framing: whole texts as logical records (files that are read in ranges: sources/framing.py) -------------


def records(texts: DataFrame, framing: str, value: str = "value") -> DataFrame:
    """The logical records of whole texts: lines, or CSV records whose quoted fields may hold line breaks; with
    `oversized`, whether a record is too long to be parsed. Blank records are left out. A record must not go on in
    another row."""
    shape = '((?:[^"\\n]++|"[^"]*+")++)' if framing == "csv" else "([^\\n]++)"
    found = texts.select(F.explode(F.regexp_extract_all(F.col(value), F.lit(shape), F.lit(1))).alias("record"))
    return found.where(F.trim("record") != "").withColumn("oversized", F.octet_length("record") > MOST_BYTES)


# SQLSTATE codes and classes after which nothing tells of a value.
QUIET_CODES = ("57014", "57P01", "57P02", "57P03", "57P04", "57P05", "40001", "40P01", "55P03")
QUIET_CLASSES = ("42", "3F", "0A", "25", "53", "54", "08", "58")
_PG_ERROR = "log_time string, user_name string, database_name string, process_id string, connection_from string, session_id string, line_num string, command_tag string, session_start string, vxid string, txid string, severity string, state string, message string, detail string, hint string, internal_query string, internal_position string, context string, query string"


def failure_class(state: Column, has_context: Column, has_statement: Column) -> Column:
    """`refused` (nothing was read), `quiet` or `telling`; an unknown code tells."""
    known = F.coalesce(state.rlike("^[0-9A-Z]{5}$"), F.lit(False))
    group = F.substring(state, 1, 2)
    return (
        F.when(known & ~has_statement & ((group == "28") | (state == "3D000")), "refused")
        .when(known & (state == "25P02") & ~has_context, "refused")
        .when(known & (group.isin(*QUIET_CLASSES) | state.isin(*QUIET_CODES)), "quiet")
        .otherwise("telling")
    )


def pg_failures(lines: DataFrame, value: str = "value") -> DataFrame:
    """ERROR and FATAL records of a csvlog: when, who, the SQLSTATE and its class. Messages are never read."""
    parsed = lines.select(F.from_csv(F.col(value), F.lit(_PG_ERROR), {"quote": '"', "escape": '"'}).alias("r")).select("r.*").where(F.col("severity").isin("ERROR", "FATAL"))
    given = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    login = (F.col("severity") == "FATAL") & F.col("state").startswith("28")
    return parsed.select(
        log_time(F.col("log_time")).alias("ts"), F.col("user_name").alias("principal"), F.col("session_id").alias("session"), F.col("state"),
        failure_class(F.col("state"), given("context"), given("query")).alias("class"), F.when(login, "auth_failure").otherwise("read").alias("action"),
    )


def mysql_json(lines: DataFrame, value: str = "value") -> DataFrame:
    """Records of the JSON audit files: `{"audit_record": {...}}` (a flat record), or a record with `class`, `event`
    and `account` (a filtered log)."""
    flat = "name string, timestamp string, user string, ip string, db string, sqltext string, status int, command_class string"
    names = f"audit_record struct<{flat.replace(' ', ':').replace(',:', ', ')}>, timestamp string, class string, event string, account struct<user:string, host:string>, login struct<ip:string>, general_data struct<command:string, sql_command:string, query:string, status:int>, connection_data struct<status:int, db:string>"
    r = lines.select(F.from_json(F.col(value), F.lit(names)).alias("r")).select("r.*")
    a, g, c = (lambda f: F.col(f"audit_record.{f}")), (lambda f: F.col(f"general_data.{f}")), F.col("connection_data.status")
    failed = F.coalesce(a("status"), c, F.lit(0)) != 0
    connect = (a("name") == "Connect") | (F.col("class") == "connection")
    verb = F.lower(F.coalesce(a("command_class"), g("sql_command")))
    action = (
        F.when(connect & failed, "auth_failure").when(connect, "connect").when(verb.isin("insert", "update", "delete", "replace", "load"), "write")
        .when(verb.rlike("^(?:create|alter|drop|rename|truncate)"), "ddl").when(verb.isin("grant", "revoke"), "dcl").otherwise("read")
    )
    return _event(
        r, ts=F.try_to_timestamp(F.regexp_replace(F.coalesce(a("timestamp"), "timestamp"), "T|Z| UTC", " ")), principal=F.coalesce(F.regexp_extract(a("user"), "^([^\\[]*)", 1), "account.user"),
        client=F.coalesce(a("ip"), "login.ip", "account.host"), action=action, database=F.nullif(F.coalesce(a("db"), "connection_data.db"), F.lit("")), statement=F.coalesce(a("sqltext"), g("query")),
    )


def new_history(polls: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a polled history table that no earlier poll had, once each."""
    return polls.join(seen.select(*keys), keys, "left_anti").dropDuplicates(keys)


# Document-store commands and authentication results.
MONGO_ACTIONS = {c: "write" for c in ("insert", "update", "delete", "findAndModify")} | {c: "ddl" for c in ("create", "drop", "createIndexes", "dropCollection", "dropDatabase", "createCollection")} | {c: "dcl" for c in ("createUser", "updateUser", "dropUser", "grantRolesToUser", "createRole")}
MONGO_ABANDONED = 337


def mongo_audit(lines: DataFrame, value: str = "value") -> DataFrame:
    """Records of the auditLog: checked commands, logins, changes of users and collections. Arguments are only
    asked whether the filter is empty and for server-side code."""
    names = "atype string, ts struct<`$date`:string>, remote struct<ip:string>, users array<struct<user:string, db:string>>, param struct<command:string, ns:string, user:string, db:string, args:string>, result int"
    r = lines.select(F.from_json(F.col(value), F.lit(names)).alias("r"), F.col(value).alias("_line")).select("r.*", "_line").where(F.col("atype").isNotNull())
    who = F.coalesce(F.get("users", F.lit(0))["user"], "param.user")
    login = F.col("atype") == "authenticate"
    action = F.when(login, F.when(F.col("result") == 0, "connect").otherwise("auth_failure")).otherwise(lookup(MONGO_ACTIONS, F.coalesce("param.command", "atype"), "read"))
    kept = r.where(~(login & (F.col("result") == MONGO_ABANDONED)))  # a driver's first try, left unfinished
    return _event(
        kept, ts=F.try_to_timestamp(F.regexp_replace(F.col("ts.$date"), "T|Z|\\+00:00", " ")), principal=who, client=F.col("remote.ip"), action=action,
        database=F.substring_index("param.ns", ".", 1), statement=F.when(server_code(F.col("_line")), F.lit("*")),
    )


def mongo_slow(lines: DataFrame, value: str = "value") -> DataFrame:
    """Slow queries of the structured server log (and of the profiler, which has the same attributes): rows are
    the documents that were returned."""
    attr = "ns:string, appName:string, remote:string, nreturned:bigint, command:string, user:string"
    names = f"t struct<`$date`:string>, msg string, attr struct<{attr}>"
    r = lines.select(F.from_json(F.col(value), F.lit(names)).alias("r")).select("r.*").where("msg = 'Slow query'")
    verb = F.regexp_extract("attr.command", '^\\s*[{]\\s*"([A-Za-z]+)"', 1)
    return _event(
        r, ts=F.try_to_timestamp(F.regexp_replace(F.col("t.$date"), "T|Z|\\+00:00", " ")), principal=F.col("attr.user"), client=F.regexp_replace("attr.remote", ":[0-9]+$", ""), application=F.col("attr.appName"),
        action=lookup(MONGO_ACTIONS, verb, "read"), database=F.substring_index("attr.ns", ".", 1), rows=F.col("attr.nreturned"),
    )


def server_code(command: Column) -> Column:
    """Whether a command holds server-side code at any depth."""
    return F.coalesce(command.rlike('"[$](?:where|function|accumulator)"\\s*:'), F.lit(False))


LDAP_ACTIONS = {"search": "read", "compare": "read", "add": "write", "delete": "write", "modify": "write", "modrdn": "write"}


def ldap_accesslog(entries: DataFrame) -> DataFrame:
    """Entries of an access log (reqType, reqStart, reqAuthzID, reqDN, reqResult, reqEntries, reqFilter): binds and
    what LDAP_ACTIONS names; the name of an entry keeps its domain and units. `statement` marks a search that
    selects nothing (a search of one entry alone, reqScope `base`, is none)."""
    bind = F.col("reqType") == "bind"
    known = entries.where(bind | F.col("reqType").isin(*LDAP_ACTIONS))
    failed = F.col("reqResult") != 0
    dn = F.array_join(F.transform(F.split("reqDN", ","), lambda p: F.when(F.lower(F.trim(p)).rlike("^(?:dc|ou|o)="), p).otherwise(F.concat(F.substring_index(p, "=", 1), F.lit("=*")))), ",")
    action = F.when(bind, F.when(failed, "auth_failure").otherwise("connect")).otherwise(lookup(LDAP_ACTIONS, F.col("reqType"), "read"))
    ts = F.try_to_timestamp(F.regexp_replace("reqStart", "^([0-9]{4})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2}).*$", "$1-$2-$3 $4:$5:$6"))
    scope = F.lower("reqScope") if "reqScope" in entries.columns else F.lit("sub")
    wide = F.coalesce(unselective_filter(F.col("reqFilter")), F.lit(False)) & (F.col("reqType") == "search") & (F.coalesce(scope, F.lit("sub")) != "base")
    return _event(known, ts=ts, principal=F.when(bind, F.col("reqDN")).otherwise(F.col("reqAuthzID")), action=action, database=dn, statement=F.when(wide, F.lit("shape.bulk_search")), rows=F.col("reqEntries").cast("long"))


_XE_OTHER_ROOT = "^\\s*(?:<[?!][^>]*>\\s*)*<(?!event[\\s/>])[A-Za-z_]"
#: An element that is not one of an event's own, or attributes or elements in a value.
_XE_NESTED = "<(?!/?(?:event|data|action|type|value|text)\\b|[?!])|<value\\s|<value>[^<]*<[A-Za-z_]"
_XE_EVENT = "_name string, _timestamp string, data array<struct<_name: string, value: string>>, action array<struct<_name: string, value: string>>"


def xe_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """Extended Events (one `<event>` a row): completed batches and calls. A row is parsed as a whole, not once for each field,
    unless it has elements inside of values, which XPath reads as their text."""
    x = F.col(value)
    event = F.from_xml(F.col(value), _XE_EVENT, {"ignoreSurroundingSpaces": "false", "mode": "FAILFAST"})
    one = lambda kind, name: F.get(F.filter(f"e.{kind}", lambda d: d["_name"] == name), F.lit(0))["value"]
    at = lambda kind, name: F.nullif(F.when(F.col("nested"), F.xpath_string("x", F.lit(f"/event/{kind}[@name='{name}']/value"))).otherwise(one(kind, name)), F.lit(""))
    events = lines.where((F.trim(x) != "") & ~x.rlike(_XE_OTHER_ROOT))
    known = events.select(x.alias("x"), x.rlike(_XE_NESTED).alias("nested"), event.alias("e")).where(F.col("e._name").isin("sql_batch_completed", "rpc_completed"))
    text = F.coalesce(at("data", "batch_text"), at("data", "statement"))
    return _event(
        known, ts=F.try_to_timestamp(F.regexp_replace("e._timestamp", "T|Z", " ")), principal=at("action", "username"), client=at("action", "client_hostname"),
        application=at("action", "client_app_name"), action=statement_kind(text), database=at("action", "database_name"), statement=text, rows=at("data", "row_count").cast("long"),
    )


#: The line that a record of a trace begins with: time, process and event.
TRACE_HEADER = "[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.]+ \\([0-9]+:[0-9a-fx]+\\) [A-Z_]+"


def firebird_trace(files: DataFrame, value: str = "value") -> DataFrame:
    """Records of a text trace, one or more in a row: a header line and the lines up to the next one. Of a finished
    statement the account, the address, its text and the fetched records are kept."""
    header = TRACE_HEADER
    framed = files.select(F.explode(F.split(F.regexp_replace(F.col(value), f"(?m)^({header})$", "\u0001$1"), "\u0001")).alias("r")).where(F.col("r").rlike(f"^{header}"))
    get = lambda p, i=1: F.nullif(F.regexp_extract("r", p, i), F.lit(""))
    kind = get("^\\S+ \\S+ ([A-Z_]+)")
    who, text = get("\\(ATT_[0-9]+, ([^:,]+):"), get("(?s)\n-{20,}\n(.*?)\n(?:\\^{20,}|\n|[0-9]+ records)")
    action = F.when(kind == "ATTACH_DATABASE", "connect").when(kind.isin("FAILED", "UNAUTHORIZED"), "auth_failure").when(kind == "EXECUTE_STATEMENT_FINISH", statement_kind(text))
    return _event(
        framed.withColumn("_action", action).where("_action is not null"), ts=F.try_to_timestamp(F.regexp_replace(get("^(\\S+)"), "T", " ")), principal=who, client=get("TCPv[46]:([0-9a-fA-F.:]+?)/"),
        action=F.col("_action"), database=get("\n\\s+(\\S+) \\(ATT_"), statement=text, rows=get("\n([0-9]+) records fetched").cast("long"),
    )


LARGE_REPLY, TICKET_KEYS = 1 << 20, "^(?:TGT|ST|PT|PGT|PGTIOU|OC|AT|RT)-|^cas_ticket_registry:"


def redis_replies(entries: DataFrame) -> DataFrame:
    """Command-log entries (ts, client, args, reply_bytes) with their signals: large replies, ticket reads."""
    command, key = F.upper(F.get("args", F.lit(0))), F.get("args", F.lit(1))
    read = ~command.isin(*REDIS_WRITE)
    found = F.array(F.when(read & key.rlike(TICKET_KEYS), "signature.cas_ticket_read"), F.when(F.col("reply_bytes") >= LARGE_REPLY, "volume.large_reply"))
    return entries.select("ts", "client", command.alias("command"), F.filter(found, lambda s: s.isNotNull()).alias("signals"))


def redis_refusals(entries: DataFrame) -> DataFrame:
    """Entries of the ACL log (ts, reason, username, client): failed logins; what was only forbidden is no login."""
    return entries.where("reason = 'auth'").select("ts", F.col("username").alias("principal"), F.regexp_extract("client", "addr=([^ ]+):[0-9]+", 1).alias("client"), F.lit("auth_failure").alias("action"))


def full_syncs(polls: DataFrame, keys: list[str], order: str) -> DataFrame:
    """`signature.full_sync` for each poll in which the counter of full copies has grown (after its first one)."""
    from lakeward.operators.audit import counter_delta

    before = Window.partitionBy(*keys).orderBy(order)
    grown = counter_delta(polls.withColumn("_first", F.row_number().over(before) == 1), keys, order, "sync_full", F.lit(None)).where("not _first and delta > 0")
    return grown.select(*keys, order, F.lit("signature.full_sync").alias("signal"), F.col("delta").alias("copies"))


def registry_values(files: DataFrame, value: str = "value") -> DataFrame:
    """Service definitions (a JSON object a row) as object, field, value: what a scan classifies."""
    pairs = files.select(F.from_json(F.col(value), F.lit("map<string,string>")).alias("m")).where("m is not null")
    named = pairs.select(F.coalesce(F.try_element_at("m", F.lit("name")), F.lit("*")).alias("object"), F.explode(F.map_filter("m", lambda k, v: ~k.startswith("@"))).alias("field", "value"))
    return named.where("value is not null")


def redis_action(command: Column) -> Column:
    """Action of a command word in upper case; null for what is no access, `read` for what is not known."""
    return F.when(command.isin(*REDIS_IGNORED), F.lit(None).cast("string")).when(command.isin(*REDIS_WRITE), "write").when(command.isin(*REDIS_DCL), "dcl").when(command.isin(*REDIS_DDL), "ddl").otherwise("read")


def redis_keys(args: Column) -> Column:
    """The keys among a command's arguments, by where its kind has them; `*` if it names none or does not fit."""
    command, rest, star = F.upper(F.get(args, F.lit(0))), F.slice(args, F.lit(2), F.greatest(F.size(args) - 1, F.lit(0))), F.array(F.lit("*"))
    number = F.coalesce(F.get(args, F.lit(1)).try_cast("int"), F.lit(-1))
    counted = F.when(number.between(1, F.size(args) - 2), F.slice(args, F.lit(3), F.greatest(number, F.lit(0)))).otherwise(star)
    found = (
        F.when(command.isin(*REDIS_NO_KEY) | (F.size(args) < 2), star).when(command.isin(*REDIS_ALL_KEYS), rest).when(command.isin(*REDIS_PAIRS), F.filter(rest, lambda _, i: i % 2 == 0))
        .when(command.isin(*REDIS_TWO_KEYS), F.slice(args, 2, 2)).when(command.isin(*REDIS_COUNTED), counted).otherwise(F.slice(args, 2, 1))
    )
    return F.array_distinct(found)


def redis_commands(entries: DataFrame) -> DataFrame:
    """Command-log entries (ts, client, args array) with action, keys and enumeration signals; entries that are no access
    are left out."""
    command = F.upper(F.get("args", F.lit(0)))
    count = F.filter(F.transform("args", lambda a, i: F.when(F.upper(a) == "COUNT", F.get("args", i + 1))), lambda a: a.isNotNull())
    scan = (command == "KEYS") | ((command == "SCAN") & (F.coalesce(F.expr("try_cast(c[0] as int)"), F.lit(10)) > 1000))
    rows = entries.withColumn("c", F.when(F.size(count) > 0, count).otherwise(F.array(F.lit("10"))))
    return rows.where(redis_action(command).isNotNull()).select(
        "ts", "client", command.alias("command"), redis_action(command).alias("action"), redis_keys(F.col("args")).alias("objects"),
        F.filter(F.array(F.when(scan, F.lit("shape.keyspace_enumeration"))), lambda s: s.isNotNull()).alias("signals"),
    )


def sqlserver_audit(rows: DataFrame) -> DataFrame:
    """Rows of the audit function (event_time, sequence_number, action_id, succeeded, session_id, server_principal_name, client_ip,
    application_name, database_name, schema_name, object_name, statement, affected_rows) as events with `objects`.

    Parts of a statement are joined in order; rows of one statement, one for each object that its permission check
    covered, are one event. System helper objects and actions that are no access are left out; a refused access of
    any kind stays what it was. Texts of logins and of account changes are not kept.
    """
    # Sequence numbers of one record's parts rise from 1; all other columns are alike.
    record = ["event_time", "action_id", "session_id", "server_principal_name", "client_ip", "application_name", "database_name", "schema_name", "object_name", "affected_rows"]
    action = lookup(MSSQL_ACTIONS, F.upper(F.trim("action_id")), "")
    known = rows.withColumn("action_id", F.upper(F.trim("action_id"))).where((action != "") & ~F.coalesce((F.lower("schema_name") == "sys") & F.lower("object_name").rlike("[$]$|^syspalvalues$"), F.lit(False)))
    whole = reassemble(known.withColumn("statement", F.coalesce("statement", F.lit(""))), record, "sequence_number", "statement")
    name = F.when(F.col("object_name") != "", F.lower(F.concat_ws(".", F.nullif("schema_name", F.lit("")), "object_name")))
    event = [c for c in record if c not in ("schema_name", "object_name")] + ["statement"]
    grouped = whole.withColumn("_name", name).groupBy(*event).agg(F.sort_array(F.collect_set("_name")).alias("objects"))
    done = lookup(MSSQL_ACTIONS, F.col("action_id"), "")
    return _event(
        grouped, ts=F.col("event_time").cast("timestamp"), principal=F.nullif("server_principal_name", F.lit("")), client=F.nullif("client_ip", F.lit("")), application=F.nullif("application_name", F.lit("")),
        action=done, database=F.nullif("database_name", F.lit("")), statement=F.when(done.isin("read", "write"), F.nullif("statement", F.lit(""))), rows=F.col("affected_rows").cast("long"),
        objects=F.col("objects"),
    )


def reassemble(parts: DataFrame, key: list[str], number: str, text: str) -> DataFrame:
    """Statements that were logged in numbered parts, joined in order."""
    return parts.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(number, text))), lambda p: p[text]), "").alias(text))


def unselective_filter(text: Column) -> Column:
    """Whether an LDAP filter is only presence or objectClass terms under AND and OR."""
    terms = F.regexp_extract_all(text, F.lit("\\(([^()&|!][^()]*)\\)"), F.lit(1))
    return ~text.contains("(!") & (F.size(terms) > 0) & F.forall(terms, lambda t: t.rlike("(?i)^(?:[a-z0-9.;-]+=\\*|objectClass=.*)$"))


def whole_collection_read(command: Column) -> Column:
    """Whether a document-store command (JSON) reads a whole collection: an empty filter or pipeline."""
    filtered = F.get_json_object(command, "$.filter")
    pipeline = F.get_json_object(command, "$.pipeline")
    return (F.get_json_object(command, "$.find").isNotNull() & (filtered.isNull() | (filtered == "{}"))) | (F.get_json_object(command, "$.aggregate").isNotNull() & (pipeline == "[]"))
