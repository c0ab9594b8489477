"""Exfiltration signals as predicates over parsed access events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeward.operators.audit import dump_sessions

LARGE_ROWS = 10_000
# Application names of export and dump tools.
TOOLS = {
    "signature.pg_dump": ("pg_dump", "pg_dumpall"),
    "signature.mysqldump": ("mysqldump", "mariadb-dump"),
    "signature.mongodump": ("mongodump",),
    "signature.mongoexport": ("mongoexport",),
    "signature.bcp": ("bcp",),
}
# Backup tools of Firebird, and schemas of catalogs.
BACKUP_TOOLS = ("gbak", "nbackup", "fbsvcmgr")
CATALOGS = ("pg_catalog", "information_schema", "pg_toast", "mysql", "performance_schema", "sys")


def tool_name(application: Column, names: tuple[str, ...]) -> Column:
    """The name begins the application, and an end, a space, slash, hyphen or digit follows."""
    return F.coalesce(application.rlike("(?i)^(?:" + "|".join(names) + ")(?:$|[ /\\-0-9])"), F.lit(False))


def rules() -> dict[str, Column]:
    """Signal name to predicate. Columns: rows, action, whole_relation, copy_to, application, statement."""
    col = F.col
    read = col("action") == "read"
    text = F.upper(col("statement"))
    has = lambda p: F.coalesce(text.rlike(p), F.lit(False))
    out = {
        "volume.large_result": col("rows") > LARGE_ROWS,
        "shape.full_table_read": read & col("whole_relation") & col("copy_to").isNull(),
        "shape.full_table_copy": col("whole_relation") & col("copy_to").isNotNull(),
        "signature.copy_to_file": col("copy_to") == "file",
        "signature.copy_to_program": col("copy_to") == "program",
        "signature.into_outfile": has("\\bINTO\\s+(?:OUTFILE|DUMPFILE)\\b"),
        "signature.backup_database": has("^\\s*(?:BACKUP\\s+(?:DATABASE|LOG)|DBCC\\s+CLONEDATABASE)|\\bSP_DETACH_DB\\b"),
        "signature.remote_data_access": has("\\b(?:OPENROWSET|OPENDATASOURCE|OPENQUERY|XP_CMDSHELL)\\b"),
    }
    for name, tools in TOOLS.items():
        out[name] = tool_name(col("application"), tools) & col("whole_relation")
    return out


def signals_column() -> Column:
    """Sorted array of the signals that hold."""
    found = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in sorted(rules().items())])
    return F.filter(found, lambda s: s.isNotNull())


def union_signals(signals: Column, most: int = 16) -> Column:
    """Signatures first, then the others, both in order, at most 16."""
    distinct = F.array_sort(F.array_distinct(signals))
    ranked = F.concat(F.filter(distinct, lambda s: s.startswith("signature.")), F.filter(distinct, lambda s: ~s.startswith("signature.")))
    return F.slice(ranked, 1, most)


def signal_selected(signals: Column, selector: str) -> Column:
    """Whether the signals hold the one that is named, or any of a family (`signature.*`)."""
    family = selector.removesuffix("*")
    return F.exists(signals, lambda s: s.startswith(family)) if family.endswith(".") else F.array_contains(signals, selector)


def catalog_relation(name: Column) -> Column:
    """Whether a relation belongs to a catalog, by its schema or the prefix of its name."""
    low = F.lower(name)
    return F.substring_index(low, ".", 1).isin(*CATALOGS) & low.contains(".") | low.startswith("pg_")


def session_signals(events: DataFrame) -> DataFrame:
    """event_id and sorted `signals` of events (session, ts, event_id, action, rows, whole_relation, relations, copy_to, application,
    statement): the rules of single events, and those that look back over a session.

    A read of whole relations counts where one is none of a catalog. Three different whole relations in a session are
    a dump; so is a whole read after a consistent snapshot or SHOW CREATE TABLE in its session, or one that asks for
    no cache. A session's rows are one sort; events without a session are judged alone.
    """
    own = F.exists(F.coalesce("relations", F.array().cast("array<string>")), lambda r: ~catalog_relation(r))
    whole = F.coalesce(F.col("whole_relation"), F.lit(False)) & own
    marked = events.withColumn("whole_relation", whole)
    read = F.coalesce(whole & F.col("action").isin("read") & F.col("session").isNotNull(), F.lit(False))
    reads = marked.where(read).select("event_id", "ts", "session", F.explode(F.filter("relations", lambda r: ~catalog_relation(r))).alias("relation"))
    dumped = dump_sessions(reads).groupBy("event_id").agg(F.bool_or("dump").alias("_dump"))
    text = F.upper(F.coalesce("statement", F.lit("")))
    snapshot = text.rlike("START\\s+TRANSACTION\\s+WITH\\s+CONSISTENT\\s+SNAPSHOT|^\\s*SHOW\\s+CREATE\\s+TABLE")
    before = Window.partitionBy("session").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = marked.withColumn("_snapshot", F.col("session").isNotNull() & F.coalesce(F.max(snapshot).over(before), F.lit(False)))
    met = seen.join(dumped, "event_id", "left")
    mysql = F.col("whole_relation") & (F.col("_snapshot") | text.rlike("\\bSQL_NO_CACHE\\b") | tool_name(F.col("application"), TOOLS["signature.mysqldump"]))
    more = {
        "signature.pg_dump": F.coalesce("_dump", F.lit(False)) | (F.col("whole_relation") & tool_name(F.col("application"), TOOLS["signature.pg_dump"])),
        "signature.mysqldump": mysql, "signature.backup_database": tool_name(F.regexp_replace("application", "^.*[/\\\\\\\\]", ""), BACKUP_TOOLS),
    }
    found = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in more.items()])
    signals = F.array_sort(F.array_union(signals_column(), F.filter(found, lambda x: x.isNotNull())))
    return met.select("event_id", signals.alias("signals"))
