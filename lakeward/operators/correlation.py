"""Correlation of access events with findings: sensitivity, scores, baselines, policies, incidents."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeward.functions.names import fold_name, glob_match
from lakeward.operators.policies import EVENT_FIELDS, FINDING_FIELDS, checked_conditions
from lakeward.operators.signals import signal_selected, union_signals

# Weights of classifiers, cap of sensitivity, baseline parameters, incident bounds.
WEIGHTS = {"aws_key": 10, "password_hash": 8, "card_number": 8, "iban": 7, "nir": 7, "birth_date": 3, "email": 3, "phone": 3, "postal_address": 3, "person_name": 2}
FALLBACK_WEIGHT, SENSITIVITY_CAP = 1, 30.0
WARM_EVENTS, LEAST_ALPHA, BASELINE_FACTOR, BASELINE_SIGMAS, BASELINE_ROWS = 20, 0.05, 10.0, 3.0, 1000
INCIDENT_CAP, TOP_OBJECTS, OBJECT_CLASSIFIERS = 50, 1000, 32


def weight(classifier: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, classifier), F.lit(FALLBACK_WEIGHT))


def object_sensitivity(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted sum of each classifier's best confidence, at most 30, two decimals."""
    best = findings.groupBy(*keys, "classifier").agg(F.max("confidence").alias("c"))
    return best.groupBy(*keys).agg(F.round(F.least(F.sum(F.col("c") * weight(F.col("classifier"))), F.lit(SENSITIVITY_CAP)), 2).alias("sensitivity"))


def event_score(sensitivity: Column, rows: Column) -> Column:
    """sensitivity * log10(1 + rows), two decimals; 0 without rows or sensitivity."""
    return F.when((rows > 0) & (sensitivity > 0), F.round(sensitivity * F.log10(1 + rows), 2)).otherwise(F.lit(0.0))


def with_schema_wildcard(findings: DataFrame) -> DataFrame:
    """Each finding under its schema and under `*`, which an event without schema is joined to."""
    any_schema = findings.withColumn("schema_key", F.lit("*"))
    return findings.withColumn("schema_key", F.coalesce(fold_name(F.col("schema")), F.lit("*"))).unionByName(any_schema).distinct()


def bounds(sensitivities: DataFrame, target: str, database: str) -> DataFrame:
    """Greatest sensitivity of each database, and of each target as database `*`."""
    by_database = sensitivities.groupBy(target, database).agg(F.max("sensitivity").alias("sensitivity"))
    by_target = sensitivities.groupBy(target).agg(F.max("sensitivity").alias("sensitivity")).withColumn(database, F.lit("*"))
    return by_database.unionByName(by_target)


def derive_objects(findings: DataFrame, keys: list[str], most: int = OBJECT_CLASSIFIERS) -> DataFrame:
    """Each object's classifiers, sorted, at most 32."""
    return findings.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_set("classifier")), 1, most).alias("classifiers"))


def merge_objects(derived: DataFrame, manual: DataFrame, keys: list[str], most: int = TOP_OBJECTS) -> DataFrame:
    """Manual objects before derived ones, then by sensitivity and name: the first `most`."""
    ranked = derived.select(*keys, F.col("sensitivity").alias("rank")).unionByName(manual.select(*keys, F.lit(float("inf")).alias("rank")))
    return ranked.groupBy(*keys).agg(F.max("rank").alias("rank")).orderBy(F.desc("rank"), *keys).limit(most)


# Policies: documents are few and are compiled on the driver into predicates; no join is needed.
def policy_predicate(conditions: dict) -> Column:
    """All of the conditions; a list is met by any of its items. A document that is not right is refused."""
    met = F.lit(True)
    checked_conditions(conditions, {**FINDING_FIELDS, **EVENT_FIELDS})
    for key, value in conditions.items():
        if key in ("actions", "classifiers", "engines", "targets", "principals"):
            column = {"actions": "action", "engines": "engine", "targets": "target", "principals": "principal"}.get(key)
            met &= F.arrays_overlap("classifiers", F.array(*map(F.lit, value))) if column is None else F.col(column).isin(*value)
        elif key == "objects":
            any_glob = F.lit(False)
            for glob in value:
                any_glob |= glob_match(F.col("object"), glob)
            met &= any_glob
        elif key == "signals":
            wanted = F.lit(False)
            for s in value:
                wanted |= signal_selected(F.col("signals"), s)
            met &= wanted
        elif key in ("min_rows", "min_score", "min_confidence", "min_matched", "min_match_ratio"):
            met &= F.col({"min_rows": "rows", "min_score": "score", "min_confidence": "confidence", "min_matched": "matched", "min_match_ratio": "match_ratio"}[key]) >= value
        elif key == "anomaly":
            met &= F.col("anomaly") == value
        elif key == "hours":
            low, high = value
            hour = F.hour("ts")
            met &= hour.between(low, high) if low <= high else (hour >= low) | (hour <= high)
    return F.coalesce(met, F.lit(False))


def match_policies(facts: DataFrame, policies: list[dict], exceptions: list[dict] = ()) -> DataFrame:
    """One row for each event and policy that matches and that no exception covers.

    A policy has id, conditions; an exception conditions, and optionally policy and expires (ISO time).
    """
    return facts.withColumn("policy", F.explode(policy_marks(policies, exceptions)))


def policy_marks(policies: list[dict], exceptions: list[dict] = ()) -> Column:
    """Array of the ids of the policies that match a row and that no exception covers."""
    marks = []
    for p in policies:
        covered = F.lit(False)
        for e in exceptions:
            if e.get("policy") in (None, p["id"]):
                alive = F.col("ts") < F.to_timestamp(F.lit(e["expires"])) if e.get("expires") else F.lit(True)
                covered |= policy_predicate(e["conditions"]) & alive
        marks.append(F.when(policy_predicate(p["conditions"]) & ~covered, F.lit(p["id"])))
    return F.filter(F.array(*marks).cast("array<string>"), lambda x: x.isNotNull())


# Baselines: an ordered fold for each principal; a window that is as long as the group has no bound, so
# the fold keeps five numbers and reads its group as a stream.
BASELINE = "event_id long, n long, mean double, variance double, limit_log double, warm boolean, anomaly boolean"


def fold_baseline(state: tuple[int, float, float], rows: float) -> tuple[tuple[int, float, float], tuple]:
    """Verdict on the state before the event, and the state after it: (n, mean, variance) of ln(1+rows)."""
    n, mean, variance = state
    x = math.log1p(rows)
    warm = n >= WARM_EVENTS
    limit = mean + max(math.log(BASELINE_FACTOR), BASELINE_SIGMAS * math.sqrt(variance))
    anomaly = warm and rows >= BASELINE_ROWS and x > limit
    if warm:
        x = min(x, limit)
    alpha = max(LEAST_ALPHA, 1.0 / (n + 1))
    d = x - mean
    return (n + 1, mean + alpha * d, max(0.0, (1 - alpha) * (variance + d * alpha * d))), (n, mean, variance, limit, warm, anomaly)


def baselines(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Verdict of each eligible event (rows known, neither connect nor failed login) against its group's
    baseline before it. Rows are sorted within hash partitions and folded in one pass over batches."""
    eligible = events.where(F.col("rows").isNotNull() & (F.col("rows") >= 0) & ~F.col("action").isin("connect", "auth_failure"))
    part = lambda k: F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("-"))  # noqa: E731  a null is a part
    spread = eligible.select("event_id", F.concat_ws("\x1f", *map(part, keys)).alias("_group"), F.col("rows").cast("double").alias("rows"), *order)
    ordered = spread.repartition("_group").sortWithinPartitions("_group", *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, state = None, (0, 0.0, 0.0)
        for pdf in batches:
            out = []
            for event, name, rows in zip(pdf["event_id"], pdf["_group"], pdf["rows"], strict=True):
                if name != group:
                    group, state = name, (0, 0.0, 0.0)
                state, verdict = fold_baseline(state, rows)
                out.append((event, *verdict))
            yield pd.DataFrame(out, columns=["event_id", "n", "mean", "variance", "limit_log", "warm", "anomaly"])

    return ordered.select("event_id", "_group", "rows").mapInPandas(run, BASELINE)


def dedup_key(policy: Column, target: Column, principal: Column, database: Column, ts: Column) -> Column:
    """One incident for each policy, target, principal, database and UTC hour of the event."""
    hour = F.date_format(F.date_trunc("hour", ts), "yyyy-MM-dd HH")
    return F.sha2(F.concat_ws("|", policy, target, principal, F.coalesce(fold_name(database), F.lit("-")), hour), 256)


def dedup_principal(user: Column, address_network: Column, account_not_recorded: Column) -> Column:
    """The account, or the network where no account is known."""
    network = F.coalesce(address_network, F.lit("none"))
    return F.when(F.coalesce(account_not_recorded, F.lit(False)), F.concat(F.lit("unrecorded:"), network)).otherwise(F.coalesce(user, F.concat(F.lit("unknown:"), network)))


def incidents(matches: DataFrame) -> DataFrame:
    """Matches merged by `dedup`: counts, greatest score, summed rows, signals, first and last time."""
    grouped = matches.groupBy("dedup", "policy").agg(
        F.count("*").alias("match_count"),
        F.max("score").alias("max_score"),
        F.sum("rows").cast("long").alias("total_rows"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.bool_or("anomaly").alias("anomaly"),
        F.flatten(F.collect_set("signals")).alias("_signals"),
    )
    return grouped.withColumn("signals", union_signals(F.col("_signals"))).drop("_signals")


def cap_incidents(opened: DataFrame, keys: list[str], order: list[str], most: int = INCIDENT_CAP) -> DataFrame:
    """The first `most` incidents of each key and hour, and severe ones (a signature or an anomaly);
    the others are counted in one overflow row each."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    severe = F.exists("signals", lambda s: s.startswith("signature.")) | F.col("anomaly")
    marked = opened.withColumn("overflow", (place > most) & ~severe)
    return marked.groupBy(*keys, "overflow", F.when(F.col("overflow"), F.lit("*")).otherwise(F.col("dedup")).alias("dedup")).agg(
        F.sum("match_count").cast("long").alias("match_count"), F.max("max_score").alias("max_score")
    )


def reopens(status: Column, old: Column, score: Column, anomaly: Column, signals: Column, rows_since: Column) -> Column:
    """Whether a match opens a new incident after the closed one `old` (struct of score, anomaly, signals, rows):
    after a resolution if it scores higher, is an anomaly where that was none, or has a new signal; after a
    false positive if it scores higher, if the rows since (this event's included) exceed what was judged, or if
    it has a new signature."""
    fresh = F.array_except(signals, F.coalesce(old["signals"], F.array().cast("array<string>")))
    higher = score > F.coalesce(old["score"], F.lit(0.0))
    resolved = higher | (anomaly & ~F.coalesce(old["anomaly"], F.lit(False))) | (F.size(fresh) > 0)
    judged = higher | ((rows_since > 0) & (rows_since > F.coalesce(old["rows"], F.lit(0)))) | F.exists(fresh, lambda s: s.startswith("signature."))
    return F.when(status == "resolved", resolved).when(status == "false_positive", judged).otherwise(F.lit(False))


def rematch(stored: DataFrame, matches: DataFrame) -> DataFrame:
    """Active incidents after the matches of their `dedup` keys: counts and rows add up, the score, the last
    time and the anomaly are the greatest, signals are united. Both have the columns of `incidents`."""
    merged = stored.unionByName(matches).groupBy("dedup", "policy").agg(
        F.sum("match_count").alias("match_count"), F.max("max_score").alias("max_score"), F.sum("total_rows").cast("long").alias("total_rows"), F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"), F.bool_or("anomaly").alias("anomaly"), F.flatten(F.collect_list("signals")).alias("_signals"),
    )
    return merged.withColumn("signals", union_signals(F.col("_signals"))).drop("_signals")


def upsert_findings(stored: DataFrame, batch: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Stored findings after a batch: the last item of each location wins, first_seen is kept; a location that
    the batch does not name stays as it is."""
    last = batch.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(o) for o in order]))).where("_r = 1").drop("_r")
    old = stored.select(*key, F.col("first_seen").alias("_first"), F.col("last_seen").alias("_last"), F.col("confidence").alias("_confidence"))
    merged = last.join(old, key, "full_outer")
    return merged.select(*key, F.coalesce("_first", "seen").alias("first_seen"), F.coalesce("seen", "_last").alias("last_seen"), F.coalesce("confidence", "_confidence").alias("confidence"))


STAR = "*"


def overflow_star(overflowed: Column, object_name: Column) -> Column:
    """Whether an object stands for those that an event had no place for."""
    return F.coalesce(overflowed, F.lit(False)) & (object_name == STAR)


def star_matches(pattern_database: str | None, database: Column) -> Column:
    """Whether an objects condition retains an overflow `*`: by its database alone; `*` may be any database."""
    return (database == STAR) | (F.lit(True) if pattern_database is None else glob_match(database, pattern_database))


def exception_covers_star(parts: dict[str, str], database: Column) -> Column:
    """Whether an exception covers an overflow `*`: only if it would cover every object of the database."""
    if any(parts.get(p, STAR) != STAR for p in ("schema", "object")):
        return F.lit(False)
    if "database" not in parts:
        return F.lit(True)
    return F.when(database == STAR, F.lit(parts["database"] == STAR)).otherwise(glob_match(database, parts["database"]))


def dedup_object(sensitivities: Column) -> Column:
    """Index (from 0) of the most sensitive object, the first of equal ones; null for none."""
    return F.when(F.size(sensitivities) > 0, F.array_position(sensitivities, F.array_max(sensitivities)).cast("int") - 1)


def pending_order(events: DataFrame, agent: str, order: list[str], per_agent: int = 50, chunk: int = 200) -> DataFrame:
    """The first chunk of pending events: each agent's earliest, at most `per_agent` of one, agents in turn;
    `place` counts from 1. Every agent's rows are ranked within the agent, so no backlog is sorted as a whole."""
    ranked = events.withColumn("_turn", F.row_number().over(Window.partitionBy(agent).orderBy(*order))).where(F.col("_turn") <= per_agent)
    first = ranked.orderBy("_turn", *order).limit(chunk)
    return first.withColumn("place", F.row_number().over(Window.orderBy("_turn", *order))).drop("_turn")  # `chunk` rows


def evaluate_events(events: DataFrame, sensitivities: DataFrame, bounds: DataFrame, policies: list[dict], exceptions: list[dict] = ()) -> DataFrame:
    """One batch from end to end: sensitivity, score, their bounds, the verdict on the baseline before each event,
    and the policies that match and that no exception covers.

    `sensitivities`: target, name (folded), sensitivity; `bounds`: target, bound. An event has event_id, ts,
    target, principal, action, rows, object, overflowed, signals.
    """
    named = events.withColumn("name", fold_name(F.col("object"))).join(sensitivities, ["target", "name"], "left").join(bounds, "target", "left")
    own = F.coalesce("sensitivity", F.lit(0.0))
    bound = F.when(overflow_star(F.col("overflowed"), F.col("object")), F.greatest(own, F.coalesce("bound", F.lit(0.0)))).otherwise(own)
    scored = named.withColumn("bound_sensitivity", bound).withColumn("sensitivity", own)
    scored = scored.withColumn("named_score", event_score(F.col("sensitivity"), F.col("rows"))).withColumn("score", event_score(F.col("bound_sensitivity"), F.col("rows")))
    verdicts = baselines(events, ["target", "principal"], ["ts", "event_id"]).select("event_id", "anomaly")
    facts = scored.join(verdicts, "event_id", "left").withColumn("anomaly", F.coalesce("anomaly", F.lit(False)))
    marks = policy_marks(policies, exceptions)
    return facts.select("event_id", "sensitivity", F.col("named_score").alias("score"), "bound_sensitivity", F.col("score").alias("bound_score"), "anomaly", F.array_sort(marks).alias("policies"))


def apply_finding_policies(findings: DataFrame, incidents: DataFrame, policies: list[dict], exceptions: list[dict] = ()) -> DataFrame:
    """`outcome` for each finding (finding_id, last_seen, matched, false_positive, ts and what policies ask for) and
    policy that matches: excepted, created, rematched (once for each new sighting), unchanged, or suppressed
    (resolved, and nothing new was read since). `incidents`: incident_id, policy, finding_id, status, created_at,
    finding_seen, finding_matched, resolved_at; the latest of a key counts."""
    real = findings.where(~F.col("false_positive"))
    matched = real.withColumn("policy", F.explode(policy_marks(policies))).withColumn("_kept", F.array_contains(policy_marks(policies, exceptions), F.col("policy")))
    order = Window.partitionBy("policy", "finding_id").orderBy(F.desc("created_at"), F.desc("incident_id"))
    latest = incidents.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("policy", "finding_id", "status", "finding_seen", "finding_matched", "resolved_at")
    seen = matched.join(latest, ["policy", "finding_id"], "left")
    news = F.col("resolved_at").isNull() | (F.col("last_seen") > F.col("resolved_at")) | (F.col("matched") > F.coalesce("finding_matched", F.lit(0)))
    outcome = (
        F.when(~F.col("_kept"), "excepted")
        .when(F.col("status").isin("open", "acknowledged"), F.when(F.col("finding_seen").isNull() | (F.col("finding_seen") < F.col("last_seen")), "rematched").otherwise("unchanged"))
        .when((F.col("status") == "resolved") & ~news, "suppressed")
        .otherwise("created")
    )
    return seen.withColumn("outcome", outcome)


def ingest_batches(batches: DataFrame) -> DataFrame:
    """Repeated batches: the same content again is a duplicate, other content under the id a conflict."""
    order = Window.partitionBy("batch_id").orderBy("received", "content_hash")
    first = F.first("content_hash").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    place = F.row_number().over(order)
    return batches.withColumn("outcome", F.when(place == 1, "accepted").when(F.col("content_hash") == first, "duplicate").otherwise("conflict"))


LIFECYCLE = {"open": ("acknowledged", "resolved", "false_positive"), "acknowledged": ("resolved", "false_positive"), "resolved": ("open",), "false_positive": ("open",)}


def lifecycle_allows(old: Column, new: Column) -> Column:
    allowed = F.lit(False)
    for a, bs in LIFECYCLE.items():
        allowed |= (old == a) & new.isin(*bs)
    return allowed


def own_activity(events: DataFrame, principal: str, budget: int) -> DataFrame:
    """Events without the engine's own reads, as long as these stay within a daily budget for an object."""
    from lakeward.operators.audit import own_budget

    spent = own_budget(events)
    own = (F.col("principal") == principal) & (F.col("action") == "read") & (F.col("spent") <= budget)
    return spent.where(~F.coalesce(own, F.lit(False))).drop("spent")


def evict_baselines(states: DataFrame, target: str, updated: str, name: str, most: int = 10_000) -> DataFrame:
    """The most recently updated baselines of each target, at most `most`."""
    place = F.row_number().over(Window.partitionBy(target).orderBy(F.desc(updated), name))
    return states.withColumn("_r", place).where(F.col("_r") <= most).drop("_r")


def location_key(*parts: Column) -> Column:
    """Identity of a location: a hash of its folded parts; an absent part differs from an empty one."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), fold_name(p)), F.lit("-")) for p in parts]), 256)


def name_inventory(names: DataFrame, keys: list[str], bound: int) -> DataFrame:
    """Distinct names with their counts, one more than `bound` at most, so that a caller sees an overflow."""
    return names.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys).limit(bound + 1)
