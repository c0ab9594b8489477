"""Row validation, budgets and alerts over stored findings and events."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeward.operators.audit import MAX_EVENTS, counter_delta
from lakeward.operators.correlation import WEIGHTS
from lakeward.operators.signals import rules

ACTIONS = ("connect", "auth_failure", "read", "write", "ddl", "dcl")
#: Names of the signals that events may carry beside those that are predicates here.
OTHER_SIGNALS = ("shape.bulk_search", "volume.failed_logins_many_accounts", "volume.failed_logins_one_account", "shape.keyspace_enumeration", "signature.cas_ticket_read", "signature.full_sync", "volume.large_reply")


def finding_errors() -> Column:
    """What is wrong with a finding (an empty array: nothing)."""
    checks = {
        "classifier": ~F.col("classifier").isin(*WEIGHTS),
        "confidence": ~F.col("confidence").between(0, 1),
        "matched": F.col("matched") > F.col("sampled"),
        "sampled": ~F.col("sampled").between(0, 10_000),
    }
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in checks.items()]), lambda x: x.isNotNull())


def batch_errors(findings: DataFrame, jobs: DataFrame, targets: DataFrame) -> DataFrame:
    """batch, item, pointer, keyword: what the items of batches (batch, item, job, agent, target, engine, classifier, matched, sampled)
    have against their job (job, job_target, sample_rows, job_classifiers: null for all) and the targets that the agent has
    reported (agent, target, known_engine). A job that is not known and a target that was not reported are errors of
    their own; a batch without errors has no rows."""
    met = findings.join(jobs, "job", "left").join(targets, ["agent", "target"], "left")
    known, allowed = F.col("job_target").isNotNull(), F.col("job_classifiers")
    checks = {
        "job_id": (~known, "not_found"), "target_id": (F.col("known_engine").isNull(), "not_found"), "target_id ": (known & (F.col("target") != F.col("job_target")), "const"),
        "location/engine": (~F.col("known_engine").eqNullSafe(F.col("engine")) & F.col("known_engine").isNotNull(), "const"), "matched": (F.col("matched") > F.col("sampled"), "maximum"), "sampled": (known & (F.col("sampled") > F.col("sample_rows")), "maximum"),
        "classifier": (~F.col("classifier").isin(*WEIGHTS) | (allowed.isNotNull() & ~F.array_contains(allowed, F.col("classifier"))), "enum"),
    }
    at = lambda name: F.lit("/job_id") if name == "job_id" else F.concat(F.lit("/findings/"), F.col("item").cast("string"), F.lit("/" + name.strip()))
    found = F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.struct(at(name).alias("pointer"), F.lit(keyword).alias("keyword"))) for name, (bad, keyword) in checks.items()])
    return met.select("batch", "item", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("e")).select("batch", "item", "e.pointer", "e.keyword")


def event_errors() -> Column:
    checks = {"action": ~F.col("action").isin(*ACTIONS), "rows": F.col("rows") < 0, "aggregated_count": ~F.col("aggregated_count").between(1, MAX_EVENTS)}
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks.items()]), lambda x: x.isNotNull())


def unregistered_signals(signals: Column) -> Column:
    """Signals that no rule of the registry names."""
    return F.array_except(signals, F.array(*map(F.lit, sorted({*rules(), *OTHER_SIGNALS}))))


def hourly_budget(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """`sent`: whether a row is within its key's budget for the hour."""
    place = F.row_number().over(Window.partitionBy(*keys, F.date_trunc("hour", "ts")).orderBy(*order))
    return rows.withColumn("sent", place <= most)


LEASE_SECONDS, MOST_CLAIMED, MOST_ATTEMPTS = 60, 50, 8


def claimed_deliveries(deliveries: DataFrame, now: Column, most: int = MOST_CLAIMED) -> DataFrame:
    """The deliveries (id, status, next_attempt_at, lease_until, attempts) that are due, or whose sender has let its lease run
    out, the longest waiting first and at most `most`; as they are once claimed: sending, with one attempt more and a new lease."""
    due = (F.col("status") == "pending") & (F.col("next_attempt_at") <= now) | (F.col("status") == "sending") & (F.col("lease_until") < now)
    claimed = deliveries.where(due).orderBy("next_attempt_at", "id").limit(most)
    return claimed.withColumns({"status": F.lit("sending"), "attempts": F.col("attempts") + 1, "lease_until": now + F.expr(f"INTERVAL {LEASE_SECONDS} SECONDS")})


def delivery_outcome(ok: Column, code: Column, retryable: Column, attempts: Column, most: int = MOST_ATTEMPTS) -> Column:
    """`delivered`, `skipped` (the channel is off), `retry`, or `failed` for good."""
    return F.when(ok, "delivered").when(code == "channel_disabled", "skipped").when(retryable & (attempts < most), "retry").otherwise("failed")


def dropped_batch_alerts(reports: DataFrame, source: str, counter: str) -> DataFrame:
    """One alert for a source and hour in which its counter of dropped batches grew."""
    grown = counter_delta(reports, [source], "ts", counter, F.lit(None).cast("timestamp")).where("delta > 0")
    return grown.groupBy(source, F.date_trunc("hour", "ts").alias("hour")).agg(F.sum("delta").cast("long").alias("dropped"))


_VALUE = "(?i)^(?:[0-9]+|[0-9a-f]{8,}|.*[0-9]{4,}.*|.*@.*)$"
_PERSON_LIKE = "(?i)^(?:export|archive|backup|client|user|customer|dossier)[_-].*[_-].*$"


def normalize_identifier(name: Column, separator: str = ".") -> Column:
    """A name of segments with those that carry data as `*`."""
    segments = F.split(name, f"[{re.escape(separator)}]", -1)
    return F.array_join(F.transform(segments, lambda s: F.when(s.rlike(_VALUE) | s.rlike(_PERSON_LIKE), F.lit("*")).otherwise(s)), separator)


def normalize_dn(dn: Column) -> Column:
    """An LDAP name with the values of its leaf attributes as `*`; domain components and units stay. A comma behind a
    backslash belongs to its value."""
    parts = F.split(dn, "(?<!\\\\),", -1)
    return F.array_join(F.transform(parts, lambda p: F.when(F.lower(F.trim(p)).rlike("^(?:dc|ou|o)="), p).otherwise(F.concat(F.substring_index(p, "=", 1), F.lit("=*")))), ",")


def learned_pattern(key: Column, patterns: list[str], separators: str = ":/") -> Column:
    """The first pattern that a key fits, the longest first, or its first segment with `*`. A `*` stands for one
    segment, whatever the separators of `key_patterns` were."""
    segment = f"[^{re.escape(separators)}]"
    chosen = F
    for p in sorted(patterns, key=lambda p: (-len(p), p)):
        chosen = chosen.when(key.rlike("^" + f"{segment}*".join(map(re.escape, p.split("*"))) + "$"), F.lit(p))
    rest = F.concat(F.regexp_extract(key, f"^{segment}*", 0), F.coalesce(F.nullif(F.regexp_extract(key, f"[{re.escape(separators)}]", 0), F.lit("")), F.lit(separators[0])), F.lit("*"))
    return chosen.otherwise(rest) if patterns else rest
