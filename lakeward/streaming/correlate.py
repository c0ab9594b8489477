"""Streams that look back in event time: requests and responses, and failed logins in a sliding window.

Late rows count as long as the watermark allows, so results equal those of the batch operators over the same
rows, in whatever order these come.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lakeward.operators.audit import FAILED_WINDOW_SECONDS

#: A response belongs to a request of at most so many seconds before.
RESPONSE_SECONDS = 5
LATENESS = "10 minutes"


def _sides(rows: DataFrame, keys: list[str], request: Column, lateness: str) -> tuple[DataFrame, DataFrame]:
    asked = rows.where(request).select(*[F.col(k).alias(f"_q_{k}") for k in keys], F.col("ts").alias("_q_ts"), F.col("event_id").alias("_q_id")).withWatermark("_q_ts", lateness)
    return asked, rows.where(~request).select("event_id", "ts", *keys).withWatermark("ts", lateness)


def _within(keys: list[str], seconds: int) -> Column:
    met = (F.col("_q_ts") <= F.col("ts")) & (F.col("_q_ts") >= F.col("ts") - F.expr(f"interval {seconds} seconds"))
    for k in keys:
        met = met & (F.col(f"_q_{k}") == F.col(k))
    return met


def correlated_stream(rows: DataFrame, keys: list[str], request: Column, seconds: int = RESPONSE_SECONDS, lateness: str = LATENESS) -> DataFrame:
    """event_id, ts, keys and request_id of each row that is no request: `audit.correlated` as an interval join of two
    streams. A response has its last request (of one time the one of greatest id), or null once none can come."""
    asked, answered = _sides(rows, keys, request, lateness)
    pairs = answered.join(asked, _within(keys, seconds), "leftOuter").withColumn("_us", F.expr("unix_micros(ts)"))  # a stream has one event time
    last = F.max(F.when(F.col("_q_id").isNotNull(), F.struct("_q_ts", "_q_id")))
    grouped = pairs.groupBy(F.window("ts", f"{seconds} seconds"), "event_id", "_us", *keys).agg(last.alias("_last"))
    return grouped.select("event_id", F.timestamp_micros("_us").alias("ts"), *keys, F.col("_last._q_id").alias("request_id"))


def unanswered_stream(rows: DataFrame, keys: list[str], request: Column, seconds: int = RESPONSE_SECONDS, lateness: str = LATENESS) -> DataFrame:
    """event_id, ts and keys of requests without any response in time; they come when the time is out."""
    asked, answered = _sides(rows, keys, request, lateness)
    alone = asked.join(answered, _within(keys, seconds), "leftOuter").where("event_id is null")
    return alone.select(F.col("_q_id").alias("event_id"), F.col("_q_ts").alias("ts"), *[F.col(f"_q_{k}").alias(k) for k in keys])


_STATE = "us array<long>, value array<string>, id array<long>, done array<boolean>"


def sliding_failures(failures: DataFrame, key: str, value: str, seconds: int = FAILED_WINDOW_SECONDS, lateness: str = LATENESS) -> DataFrame:
    """key, event_id, ts, failures (rows of the key in the last `seconds`, itself included) and different (its values there).

    A row is judged when the watermark has passed it, in order of time and id, so late rows are in their places; a row
    that comes again (the same event_id) counts once. A key's state is its rows of the last window and those
    that still wait. Rows without a value count as failures and not as values.
    """
    reach = seconds * 1_000_000

    def judge(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = {i: (us, v, i, done) for us, v, i, done in zip(*state.get)} if state.exists else {}
        for pdf in batches:
            for us, v, i in zip(pdf["us"].tolist(), pdf["value"].tolist(), pdf["event_id"].tolist()):
                rows.setdefault(i, (us, v if isinstance(v, str) else None, i, False))
        mark = state.getCurrentWatermarkMs() * 1000
        ordered = sorted(rows.values(), key=lambda r: (r[0], r[2]))
        out, kept, low, counts = [], [], 0, Counter()
        for n, (us, v, i, done) in enumerate(ordered):
            if us >= mark:
                break
            counts[v] += 1
            while ordered[low][0] <= us - reach:
                counts[ordered[low][1]] -= 1
                low += 1
            if not done:
                # Rows of the same time are in the window of each other.
                peers = [r[1] for r in ordered[n + 1 :] if r[0] == us] if n + 1 < len(ordered) and ordered[n + 1][0] == us else []
                seen = {x for x, k in counts.items() if k > 0 and x is not None} | {x for x in peers if x is not None}
                out.append((group[0], i, us, n + 1 - low + len(peers), len(seen)))
        kept = [(us, v, i, us < mark) for us, v, i, _ in ordered if us >= mark or us > mark - reach]
        if kept:
            state.update(tuple(list(column) for column in zip(*kept)))
            state.setTimeoutTimestamp(max(min((r[0] if not r[3] else r[0] + reach) for r in kept) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "event_id", "us", "failures", "different"])

    timed = failures.withWatermark("ts", lateness).where("ts is not null").select(F.col(key).alias("key"), F.col(value).alias("value"), "event_id", "ts", F.expr("unix_micros(ts)").alias("us"))
    judged = timed.groupBy("key").applyInPandasWithState(judge, "key string, event_id long, us long, failures long, different long", _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return judged.select(F.col("key").alias(key), "event_id", F.timestamp_micros("us").alias("ts"), "failures", "different")
