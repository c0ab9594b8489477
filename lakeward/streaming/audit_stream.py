"""Access events as a stream: windowed aggregation, idempotent sinks, and stateful baselines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lakeward.operators.audit import WINDOW_SECONDS, merge_measures
from lakeward.operators.correlation import fold_baseline

#: Late events are accepted for a day, as late batches are.
LATENESS = "24 hours"
_STATE = "n long, mean double, variance double"
_VERDICT = "event_id long, principal string, rows long, warm boolean, anomaly boolean"


def read_events(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream; the checkpoint of the query is its cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def window_events(events: DataFrame, keys: list[str], seconds: int = WINDOW_SECONDS, lateness: str = LATENESS) -> DataFrame:
    """The batch operator's aggregate with a watermark: a window is emitted once it is complete."""
    grouped = events.withWatermark("ts", lateness).groupBy(*keys, F.window("ts", f"{seconds} seconds").alias("w"))
    return grouped.agg(*merge_measures()).withColumn("window_start", F.col("w.start")).drop("w")


def baseline_verdicts(events: DataFrame) -> DataFrame:
    """Verdict of each event against its principal's baseline before it, kept as keyed state.

    Within a micro-batch a principal's events are taken in order of time; across batches in order of
    arrival, like the fold over stored events that arrive in time.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (0, 0.0, 0.0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        out = []
        for event, n in zip(rows["event_id"], rows["rows"], strict=True):
            now, verdict = fold_baseline(tuple(now), float(n))
            out.append((event, key[0], int(n), verdict[4], verdict[5]))
        state.update(tuple(now))
        yield pd.DataFrame(out, columns=["event_id", "principal", "rows", "warm", "anomaly"])

    eligible = events.where("rows is not null and rows >= 0 and action not in ('connect', 'auth_failure')").select("principal", "event_id", "ts", "rows")
    return eligible.groupBy("principal").applyInPandasWithState(update, _VERDICT, _STATE, "append", GroupStateTimeout.NoTimeout)


def write_idempotent(frame: DataFrame, path: str, checkpoint: str):
    """Each micro-batch replaces its own folder, so a batch that is run again leaves no rows twice."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return frame.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start()
