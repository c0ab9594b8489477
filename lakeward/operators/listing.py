"""Filters, joins and set comparisons behind the listings of findings, events, incidents and principals."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from lakeward.functions.names import glob_match
from lakeward.operators.signals import signal_selected

# What listings show at most, states of incidents, parts of a location in order, engines whose
# names may compare with case.
MOST_ROWS, MOST_PRINCIPALS, MOST_INCIDENT_EVENTS = 500, 200, 50
STATUSES, ACTIVE = ("open", "acknowledged", "resolved", "false_positive"), ("open", "acknowledged")
LOCATION_PARTS = ("database", "schema", "object", "field")
CASED_ENGINES = ("mysql", "mariadb", "sqlserver")

_NAME, _FAMILY = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]{0,63}"), re.compile(r"(?:signature|shape|volume)\.(?:\*|[a-z_]+)")
_TIME = re.compile(r"\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?Z?)?")
_FLAG = re.compile("1")
_FIELDS = {
    "findings": {"agent": _NAME, "target": _NAME, "classifier": _NAME, "engine": _NAME, "fp": _FLAG},
    "events": {"agent": _NAME, "target": _NAME, "principal": _NAME, "signal": _FAMILY, "from": _TIME, "to": _TIME, "anomaly": _FLAG},
    "incidents": {"status": re.compile("|".join(STATUSES)), "severity": re.compile("critical|high|medium|low"), "agent": _NAME, "target": _NAME},
}


def parse_filter(kind: str, params: dict[str, str | list[str]]) -> dict[str, list[str]]:
    """The parameters of a listing's address that it knows, in the form that it expects; all else is ignored."""
    out: dict[str, list[str]] = {}
    for name, shape in _FIELDS[kind].items():
        given = params.get(name, [])
        values = [v for v in ([given] if isinstance(given, str) else given) if isinstance(v, str) and shape.fullmatch(v)]
        if values:
            out[name] = values if name == "status" else values[:1]
    return out


def predicate(kind: str, wanted: dict[str, list[str]]) -> Column:
    """What a parsed filter asks of a row. Findings leave false positives out unless `fp` is given."""
    met = F.lit(True)
    for name, values in wanted.items():
        if name in ("from", "to"):
            at = F.to_timestamp(F.lit(values[0].replace("T", " ").rstrip("Z")))
            met &= F.col("ts") >= at if name == "from" else F.col("ts") <= at
        elif name == "signal":
            met &= signal_selected(F.col("signals"), values[0])
        elif name == "anomaly":
            met &= F.col("anomaly")
        elif name != "fp":
            met &= F.col(name).isin(*values)
    if kind == "findings" and "fp" not in wanted:
        met &= ~F.col("false_positive")
    return F.coalesce(met, F.lit(False))


def finding_list(findings: DataFrame, agents: DataFrame, wanted: dict, most: int = MOST_ROWS) -> DataFrame:
    """Findings of known agents: every target's latest one before any second one."""
    rows = findings.where(predicate("findings", wanted)).join(agents, "agent")
    turn = F.row_number().over(Window.partitionBy("agent", "target").orderBy(F.desc("last_seen"), "finding_id"))
    ranked = rows.withColumn("turn", turn).where(F.col("turn") <= most)
    return ranked.orderBy("turn", "agent_name", "target", "classifier", "object", "finding_id").limit(most)


def incident_list(incidents: DataFrame, agents: DataFrame, findings: DataFrame, targets: DataFrame, wanted: dict, rank, most: int = MOST_ROWS) -> DataFrame:
    """Incidents with what is known of agent and finding; the engine is the finding's, else the target's."""
    chosen = incidents.where(predicate("incidents", wanted)).orderBy(rank(F.col("severity")), F.desc("ts"), "incident_id").limit(most)
    facts = findings.select("finding_id", "object", F.col("engine").alias("_engine"))
    engines = targets.select("agent", "target", F.col("engine").alias("_target_engine"))
    joined = chosen.join(agents, "agent", "left").join(facts, "finding_id", "left").join(engines, ["agent", "target"], "left")
    return joined.withColumn("engine", F.coalesce("_engine", "_target_engine")).drop("_engine", "_target_engine")


def event_list(events: DataFrame, agents: DataFrame, wanted: dict, most: int = MOST_ROWS) -> DataFrame:
    return events.where(predicate("events", wanted)).join(agents, "agent").orderBy(F.desc("ts"), F.desc("event_id")).limit(most)


def linked_events(events: DataFrame, links: DataFrame, incidents: DataFrame, most: int = MOST_INCIDENT_EVENTS) -> DataFrame:
    """The newest events that are linked to any of the incidents."""
    ids = links.join(incidents.select("incident_id"), "incident_id", "left_semi").select("event_id")
    return events.join(ids, "event_id", "left_semi").orderBy(F.desc("ts"), F.desc("event_id")).limit(most)


def rows_since(incidents: DataFrame, links: DataFrame, events: DataFrame) -> DataFrame:
    """Rows of the events linked to each false-positive incident since it was marked; zero for none."""
    marked = incidents.where("status = 'false_positive'").select("incident_id", "marked_at")
    late = links.join(marked, "incident_id").where("linked_at >= marked_at").join(events.select("event_id", "rows"), "event_id")
    sums = late.groupBy("incident_id").agg(F.sum("rows").alias("rows_since"))
    return incidents.select("incident_id", "status").join(sums, "incident_id", "left").withColumn("rows_since", F.coalesce("rows_since", F.lit(0)).cast("long"))


def principal_list(baselines: DataFrame, agents: DataFrame, most: int = MOST_PRINCIPALS) -> DataFrame:
    return baselines.join(agents, "agent").orderBy(F.desc("max_score"), "target", "principal").limit(most)


def named_objects(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of the named (schema, object) pairs; a missing schema equals a missing one."""
    return rows.alias("r").join(names.alias("n"), F.col("r.schema").eqNullSafe(F.col("n.schema")) & (F.col("r.object") == F.col("n.object")), "left_semi")


def unsent(alerts: DataFrame, deliveries: DataFrame, key: list[str]) -> DataFrame:
    """Alerts of which none is pending or sent."""
    return alerts.join(deliveries.select(*key), key, "left_anti")


def list_changes(old: DataFrame, new: DataFrame, group: list[str], item: str) -> DataFrame:
    """For each group how many items of its list came and went, and its sizes before and after."""
    before, after = old.select(*group, item).distinct().withColumn("_b", F.lit(1)), new.select(*group, item).distinct().withColumn("_a", F.lit(1))
    both = before.join(after, [*group, item], "full_outer")
    count = lambda test: F.count_if(test)
    return both.groupBy(*group).agg(
        count(F.col("_b").isNotNull()).alias("old_size"), count(F.col("_a").isNotNull()).alias("new_size"), count(F.col("_b").isNull()).alias("added"), count(F.col("_a").isNull()).alias("removed")
    )


def merged_parts(parts: Column) -> Column:
    """The altered parts that any of the lists names, in the order of a location; null for none."""
    named = F.filter(F.array(*map(F.lit, LOCATION_PARTS)), lambda p: F.array_contains(parts, p))
    return F.when(F.size(named) > 0, named)


def shared_patterns(lists: DataFrame, group: list[str], patterns: str) -> DataFrame:
    """The patterns that all lists of a group have, sorted."""
    counted = lists.select(*group, F.explode(F.array_distinct(patterns)).alias("_p")).groupBy(*group, "_p").agg(F.count("*").alias("_n"))
    sizes = lists.groupBy(*group).agg(F.count("*").alias("_lists"))
    common = counted.join(sizes, group).groupBy(*group).agg(F.sort_array(F.collect_list(F.when(F.col("_n") == F.col("_lists"), F.col("_p")))).alias("patterns"))
    return common


def cased(engine: Column, rule: Column) -> Column:
    """Whether object names compare with case: only on some engines, and then unless known to be insensitive."""
    return F.coalesce(engine.isin(*CASED_ENGINES) & rule.isNotNull() & (rule != "insensitive"), F.lit(False))


def name_matches(name: Column, glob: str, engine: Column, rule: Column) -> Column:
    return F.when(cased(engine, rule), glob_match(name, glob, fold=False)).otherwise(glob_match(name, glob))


def case_changes(names: DataFrame, globs: list[str]) -> DataFrame:
    """Names (engine, name_case, object) and exceptions of which the name is covered without case alone. The
    exceptions are few documents and are compiled; no join is needed."""
    name = F.col("object")
    changed = [F.when(glob_match(name, g) & ~name_matches(name, g, F.col("engine"), F.col("name_case")), F.lit(g)) for g in globs]
    return names.withColumn("exception", F.explode(F.filter(F.array(*changed), lambda x: x.isNotNull())))


def canonical(value: Column, kind: DataType) -> Column:
    """The value with the fields of all structs and the keys of all maps in order; arrays keep theirs."""
    if isinstance(kind, StructType):
        fields = [canonical(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda v: canonical(v, kind.elementType))
    if isinstance(kind, MapType):
        return F.map_from_entries(F.transform(F.array_sort(F.map_entries(value)), lambda e: F.struct(e["key"], canonical(e["value"], kind.valueType))))
    return value


def content_hash(frame: DataFrame, column: str) -> Column:
    """SHA-256 of a column as JSON in canonical form: neither the order of keys nor absent fields count."""
    return F.sha2(F.to_json(canonical(F.col(column), frame.schema[column].dataType)), 256)


def checked_events(events: DataFrame, targets: DataFrame) -> DataFrame:
    """`unexpected` (the agent does not report the target) and `mismatch` (the source is of another engine)."""
    known = targets.select("agent", "target", F.col("engine").alias("target_engine"))
    joined = events.join(known, ["agent", "target"], "left")
    return joined.withColumn("unexpected", F.col("target_engine").isNull()).withColumn("mismatch", F.coalesce(F.col("engine") != F.col("target_engine"), F.lit(True)))


def apply_false_positives(incidents: DataFrame, marks: DataFrame) -> DataFrame:
    """Incidents after findings were marked (finding_id, marked): active ones of a marked finding are closed."""
    joined = incidents.join(marks, "finding_id", "left")
    closes = F.coalesce("marked", F.lit(False)) & F.col("status").isin(*ACTIVE)
    return joined.withColumn("status", F.when(closes, "false_positive").otherwise(F.col("status"))).drop("marked")


def pending_findings(findings: DataFrame, marks: DataFrame) -> DataFrame:
    """Findings whose mark was taken back: policies look at them again."""
    return findings.join(marks.where("not marked").select("finding_id"), "finding_id", "left_semi")


def agent_list(agents: DataFrame, targets: DataFrame) -> DataFrame:
    """Every agent with its targets and engines, none included."""
    listed = targets.groupBy("agent").agg(F.array_join(F.sort_array(F.collect_set("target")), ",").alias("targets"), F.count_distinct("engine").alias("engines"))
    return agents.join(listed, "agent", "left").withColumn("targets", F.coalesce("targets", F.lit(""))).withColumn("engines", F.coalesce("engines", F.lit(0)).cast("long"))


def budgeted(rows: DataFrame, source: str, order: list[str], most: int) -> DataFrame:
    """The rows that a source may write in an hour, each with how many were left out since its last one."""
    place = F.row_number().over(Window.partitionBy(source, F.date_trunc("hour", "ts")).orderBy(*order))
    marked = rows.withColumn("_kept", place <= most)
    so_far = Window.partitionBy(source).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = marked.withColumn("_left", F.sum((~F.col("_kept")).cast("long")).over(so_far)).where("_kept")
    return counted.withColumn("suppressed_before", F.col("_left") - F.coalesce(F.lag("_left").over(Window.partitionBy(source).orderBy(*order)), F.lit(0))).drop("_kept", "_left")


def guarded(findings: DataFrame, never: list[str], unsampled: list[str], secrets: tuple[str, ...] = ("aws_key", "password_hash")) -> DataFrame:
    """Findings under the rules of guarded stores: objects that are never read go; of others no masked samples
    stay, and of secrets no fingerprints either."""
    any_of = lambda globs: F.exists(F.array(*[glob_match(F.col("object"), g) for g in globs]), lambda x: x) if globs else F.lit(False)
    rule = any_of(unsampled)
    kept = findings.where(~any_of(never))
    return kept.withColumn("fingerprints", F.when(~(rule & F.col("classifier").isin(*secrets)), F.col("fingerprints"))).withColumn("samples", F.when(~rule, F.col("samples")))
