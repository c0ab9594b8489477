"""Listings, summaries, digests and metrics over findings, events and incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITIES = ("critical", "high", "medium", "low")


def fair_listing(rows: DataFrame, group: list[str], order: list[Column], most: int) -> DataFrame:
    """Round robin: every group's first row before any second one; at most `most` rows."""
    ranked = rows.withColumn("round", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("round") <= most).orderBy("round", *order).limit(most)  # later rounds cannot be listed


def summary(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Count and greatest confidence of each group, ranked by its last sighting."""
    grouped = findings.groupBy(*keys).agg(F.count("*").alias("findings"), F.max("confidence").alias("confidence"), F.max("last_seen").alias("last_seen"))
    return grouped.withColumn("rank", F.row_number().over(Window.partitionBy(keys[0]).orderBy(F.desc("last_seen"), *keys)))


def latest_per(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def severity_rank(severity: Column) -> Column:
    rank = F
    for i, s in enumerate(SEVERITIES):
        rank = rank.when(severity == s, i)
    return rank.otherwise(len(SEVERITIES))


def newest(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """Top-k; each task sends at most `most` rows."""
    return rows.orderBy(*order).limit(most)


def counts_by_severity(incidents: DataFrame) -> DataFrame:
    """Active incidents of each severity, zero where there is none."""
    listed = incidents.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    active = incidents.where(F.col("status").isin("open", "acknowledged")).groupBy("severity").agg(F.count("*").alias("n"))
    return listed.join(F.broadcast(active), "severity", "left").select("severity", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def hourly_digest(rows: DataFrame, channel: str) -> DataFrame:
    return rows.groupBy(channel, F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))


def suppression_digests(rows: DataFrame, channel: str, now: Column, days: int = 2) -> DataFrame:
    """channel, window_start, window_end, n, key: what was held back in each closed clock hour of the last days. The hour
    of `now` is still open; the key is the same each time, so a digest is queued once."""
    recent = rows.where((F.col("ts") >= now - F.expr(f"INTERVAL {days} DAYS")) & (F.col("ts") < F.date_trunc("hour", now)) & F.col(channel).isNotNull())
    closed = hourly_digest(recent, channel).withColumnRenamed("hour", "window_start")
    key = F.concat(F.lit("digest:"), channel, F.lit("|"), F.date_format("window_start", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return closed.select(channel, "window_start", (F.col("window_start") + F.expr("INTERVAL 1 HOUR")).alias("window_end"), "n", key.alias("key"))


def event_digest(rows: DataFrame, kind: str, source: str) -> DataFrame:
    """One row: events, distinct sources, and the count of each kind as JSON with sorted keys."""
    kinds = rows.groupBy(kind).agg(F.count("*").alias("n"))
    counts = kinds.agg(F.sum("n").alias("events"), F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(kind, "n"))))).alias("kinds"))
    return counts.crossJoin(rows.agg(F.count_distinct(source).alias("sources")))  # one row each


def coverage(jobs: DataFrame) -> DataFrame:
    """Objects that a scan did not reach, and whether that calls for a warning."""
    skipped = F.aggregate(F.map_values(F.map_filter("progress", lambda k, v: k.startswith("skipped_"))), F.lit(0.0), lambda a, b: a + b)
    total, done = F.coalesce(F.try_element_at("progress", F.lit("objects_total")), F.lit(0.0)), F.coalesce(F.try_element_at("progress", F.lit("objects_sampled")), F.lit(0.0))
    gap = F.greatest(total - done - skipped, F.lit(0.0))
    return jobs.select("*", skipped.alias("skipped"), gap.alias("unreached"), ((gap > 0) | (skipped > 0)).alias("warn"))


def shrink_warning(old_size: Column, removed: Column, new_size: Column) -> Column:
    """How a new list of sensitive objects compares with the one in force."""
    return F.when((old_size > 0) & (new_size == 0), "emptied").when((removed >= 20) | (2 * removed >= old_size) & (old_size > 0), "shrunk")


def silent(rows: DataFrame, source: str, now: Column, seconds: int) -> DataFrame:
    """Sources whose last row is older than the threshold."""
    last = rows.groupBy(source).agg(F.max("ts").alias("last_ts"))
    return last.withColumn("silent", F.unix_timestamp(now) - F.unix_timestamp("last_ts") > seconds)


def retained(rows: DataFrame, now: Column, days: int = 90) -> DataFrame:
    return rows.where(F.col("ts") >= now - F.expr(f"INTERVAL {days} DAYS"))


def prometheus(rows: DataFrame, metric: str, labels: list[str], value: str) -> DataFrame:
    """Text exposition lines, label values escaped."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), escaped(c), F.lit('"')) for c in labels])
    return rows.select(F.concat(F.lit(metric + "{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("line"))


def backoff_seconds(attempt: Column) -> Column:
    """Wait before the next attempt: 60 seconds, doubling, an hour at most."""
    return F.least(F.lit(3600), (60 * F.pow(F.lit(2.0), attempt - 1)).cast("int"))


def wilson_lower(hits: Column, n: Column, z: float = 1.96) -> Column:
    """Lower bound of a share's 95 % interval; 0 for no trials."""
    p = hits / n
    bound = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return F.when(n > 0, bound).otherwise(F.lit(0.0))


def evaluate(found: DataFrame, truth: DataFrame, key: list[str]) -> DataFrame:
    """True and false positives and misses of each classifier, with precision, recall and bounds."""
    joined = truth.withColumn("_t", F.lit(1)).join(found.withColumn("_f", F.lit(1)), [*key, "classifier"], "full_outer")
    sums = joined.groupBy("classifier").agg(
        F.sum(F.when(F.col("_t").isNotNull() & F.col("_f").isNotNull(), 1).otherwise(0)).cast("long").alias("tp"),
        F.sum(F.when(F.col("_t").isNull(), 1).otherwise(0)).cast("long").alias("fp"),
        F.sum(F.when(F.col("_f").isNull(), 1).otherwise(0)).cast("long").alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select("*", F.round(wilson_lower(tp, tp + fp), 6).alias("precision_bound"), F.round(wilson_lower(tp, tp + fn), 6).alias("recall_bound"))
