"""Access events: windows, merging, bounds, counters and filters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Counts stop here, a merged event names so many objects, windows are so long.
MAX_COUNT, MAX_EVENTS, NAMED_OBJECTS, WINDOW_SECONDS = (1 << 53) - 1, 1_000_000, 15, 60
FAILED_WINDOW_SECONDS, FAILED_PRINCIPALS, FAILED_LOGINS, FAILED_GROUPS = 600, 16, 20, 100


def bound_objects(objects: Column, named: int = NAMED_OBJECTS) -> Column:
    """Distinct objects in order, at most `named`; more become a last `*`."""
    ordered = F.array_sort(F.array_distinct(objects))
    return F.when(F.size(ordered) > named, F.concat(F.slice(ordered, 1, named), F.array(F.lit("*")))).otherwise(ordered)


def saturated(name: str, most: int) -> Column:
    """Sum up to `most`; null if no value is known (`least` alone would skip the null)."""
    total = F.sum(name)
    return F.when(total > most, F.lit(most)).otherwise(total).cast("long").alias(name)


def merge_measures() -> list[Column]:
    """Merged measures of events: known values win over null, sums stop at the largest exact count."""
    return [
        F.min("ts").alias("ts"),
        F.max(F.coalesce("ts_last", "ts")).alias("ts_last"),
        saturated("aggregated_count", MAX_EVENTS),
        saturated("rows", MAX_COUNT),
        saturated("bytes", MAX_COUNT),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("signals")))).alias("signals"),
        F.bool_or("overflowed").alias("overflowed"),
    ]


def aggregate_events(events: DataFrame, keys: list[str], seconds: int = WINDOW_SECONDS) -> DataFrame:
    """One event for each key and epoch-aligned window. Signals are a closed set, so the collected sets
    stay small. (A window that opens with a group's first event is `first_event_windows`.)"""
    return events.groupBy(*keys, F.window("ts", f"{seconds} seconds").alias("w")).agg(*merge_measures()).withColumn("window_start", F.col("w.start")).drop("w")


def first_event_windows(events: DataFrame, keys: list[str], seconds: int = WINDOW_SECONDS) -> DataFrame:
    """`opened_us`: when the window that an event falls in was opened by its group's first event. An ordered
    fold: rows are sorted within hash partitions and read as a stream, so a group needs no more than its
    last window. Events without a time open none; a null key is a key."""
    step = seconds * 1_000_000
    spread = events.select(*keys, F.expr("unix_micros(ts)").alias("_us")).where("_us is not null").repartition(*keys).sortWithinPartitions(*keys, "_us")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, opened = None, 0
        for batch in batches:
            at, times = [], []
            columns = [batch.column(i).to_pylist() for i in range(len(keys))]
            for i, us in enumerate(batch.column(len(keys)).to_pylist()):
                key = tuple(c[i] for c in columns)
                if key != group or us >= opened + step:
                    group, opened = key, us
                    at.append(i)
                    times.append(us)
            kept = batch.take(pa.array(at, pa.int64())).columns[: len(keys)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(times, pa.int64()), pa.array([t + step for t in times], pa.int64())], names=[*keys, "opened_us", "closed_us"])

    kind = StructType([*[events.schema[k] for k in keys], StructField("opened_us", LongType()), StructField("closed_us", LongType())])
    return spread.mapInArrow(run, kind)


def sliding(rows: DataFrame, keys: list[str], reach: int, measures: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Running totals over the last `reach` microseconds of `_us`: a row adds the first column of a measure at
    its time and the second one when it is `reach` old, so a window costs one sort, however many rows it has."""
    here = rows.select("*", F.col("_us").alias("_at"), F.lit(True).alias("_in"), *[enter.alias(f"_d_{n}") for n, (enter, _) in measures.items()])
    gone = rows.select(*keys, (F.col("_us") + reach).alias("_at"), F.lit(False).alias("_in"), *[leave.alias(f"_d_{n}") for n, (_, leave) in measures.items()])
    both, order = here.unionByName(gone, allowMissingColumns=True), Window.partitionBy(*keys).orderBy("_at")
    totals = both.select("*", *[F.sum(f"_d_{n}").over(order).cast("long").alias(n) for n in measures])
    return totals.where("_in").drop("_at", "_in", *[f"_d_{n}" for n in measures])


def failed_login_windows(failures: DataFrame, address: str, principal: str, seconds: int = FAILED_WINDOW_SECONDS) -> DataFrame:
    """For each failure the distinct principals at its address, and its principal's failures, in the
    time before it (age below `seconds`).

    Distinct principals are failures less the pairs of successive failures of one principal that both lie
    in the window; only pairs closer than the window can.
    """
    reach, us = seconds * 1_000_000, F.col("_us")
    same = Window.partitionBy(address, principal).orderBy("_us")
    timed = failures.withColumn("_us", F.expr("unix_micros(ts)")).withColumn("_before", F.lag("_us").over(same)).withColumn("_after", F.lead("_us").over(same))
    close = lambda gap: F.when(F.coalesce(gap < reach, F.lit(False)), 1).otherwise(0)
    named = lambda c: F.when(F.col(principal).isNotNull(), c).otherwise(0)
    counted = sliding(timed, [address], reach, {"principals": (named(1 - close(us - F.col("_before"))), named(close(F.col("_after") - us) - 1))})
    counted = sliding(counted, [principal], reach, {"failures": (F.lit(1), F.lit(-1))})
    return counted.withColumn("many_accounts", F.col("principals") >= FAILED_PRINCIPALS).withColumn("one_account", F.col("failures") >= FAILED_LOGINS).drop("_us", "_before", "_after")


def cap_groups(groups: DataFrame, partition: list[str], count: str, name: str, most: int = FAILED_GROUPS) -> DataFrame:
    """The largest `most` groups of each partition by name, all others summed in one row named `*`."""
    order = Window.partitionBy(*partition).orderBy(F.desc(count), name)
    ranked = groups.withColumn("_r", F.row_number().over(order)).withColumn(name, F.when(F.col("_r") <= most, F.col(name)).otherwise("*"))
    return ranked.groupBy(*partition, name).agg(F.sum(count).cast("long").alias(count))


def counter_delta(polls: DataFrame, keys: list[str], order: str, counter: str, first_order: Column) -> DataFrame:
    """Growth of a cumulative counter: the first poll of all is a baseline, a counter that went down has
    restarted, a key that comes later counts in full."""
    before = F.lag(counter).over(Window.partitionBy(*keys).orderBy(order))
    now = F.col(counter)
    delta = F.when(before.isNull() & (F.col(order) == first_order), F.lit(None)).when(before.isNull() | (now < before), now).otherwise(now - before)
    return polls.withColumn("delta", delta)


def reportable(events: DataFrame, sensitive: DataFrame, min_rows: int | None) -> DataFrame:
    """Events worth reporting: any signal, neither read nor write, enough rows, or a sensitive object.

    `sensitive` has the folded object names; only events that nothing else reports are looked up in it.
    """
    if min_rows is None:
        return events
    plain = F.coalesce((F.size("signals") > 0) | ~F.col("action").isin("read", "write") | (F.coalesce("rows", F.lit(0)) >= min_rows), F.lit(False))
    named = events.where(~plain).withColumn("_object", F.explode("objects")).join(sensitive.select(F.col("object").alias("_object")), "_object", "left_semi")
    return events.where(plain).unionByName(named.drop("_object").dropDuplicates(["event_id"]))


def dump_sessions(reads: DataFrame, least: int = 3) -> DataFrame:
    """For each whole-relation read of a session, how many distinct ones it has had; at least three look
    like a dump. A relation counts when it is first read, so no set has to be collected."""
    first = Window.partitionBy("session", "relation").orderBy("ts", "event_id")
    marked = reads.withColumn("_new", (F.row_number().over(first) == 1).cast("long"))
    so_far = Window.partitionBy("session").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("relations", F.sum("_new").over(so_far)).withColumn("dump", F.col("relations") >= least).drop("_new")


def own_budget(events: DataFrame, seconds: int = 86_400) -> DataFrame:
    """Rows that a principal has read of an object in the last day, this event included."""
    rows = F.coalesce("rows", F.lit(0))
    return sliding(events.withColumn("_us", F.expr("unix_micros(ts)")), ["principal", "object"], seconds * 1_000_000, {"spent": (rows, -rows)}).drop("_us")


def correlated(rows: DataFrame, keys: list[str], request: Column, seconds: int) -> DataFrame:
    """For each row that is no request, `request_id`: the event_id of the last request of its keys, if that is at
    most so many seconds old. One ordered pass: of all earlier requests only the last can be young enough."""
    us = F.expr("unix_micros(ts)")
    order = Window.partitionBy(*keys).orderBy(us, (~request).cast("int"), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(request, F.struct(us.alias("us"), "event_id")), ignorenulls=True).over(order)
    seen = rows.withColumn("_last", last).where(~request)
    return seen.withColumn("request_id", F.when(us - F.col("_last.us") <= seconds * 1_000_000, F.col("_last.event_id"))).drop("_last")
