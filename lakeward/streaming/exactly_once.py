"""A sink in which each batch of a stream is there once, whatever is killed and started again.

A batch is written to a folder of its number and its content's hash, and then named in the list of commits, which is
replaced as a whole. Readers take only what is in the list. A batch that runs again finds its entry and is
left out; one that was written in part has none and is written anew. Events that a source sends twice are dropped
before, within the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

_COMMIT = "batch long, content string, rows long"


def once(events: DataFrame, keys: list[str], time: str = "ts", lateness: str = "24 hours") -> DataFrame:
    """The stream without repetitions of its keys within the watermark."""
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def content_hash(rows: DataFrame) -> tuple[str, int]:
    """A hash of rows that does not depend on their order, and their number."""
    digest = F.xxhash64(*[F.col(c) for c in rows.columns])
    parts = rows.agg(F.count("*").alias("n"), *[F.sum(F.pmod(F.shiftright(digest, shift), F.lit(1 << 32))).alias(f"s{shift}") for shift in (0, 32)]).first()
    return f"{(parts.s0 or 0) & 0xFFFFFFFFFFFF:012x}{(parts.s32 or 0) & 0xFFFFFFFFFFFF:012x}", parts.n


def commits(spark: SparkSession, path: str) -> DataFrame:
    """batch, content, rows: what is committed below the path."""
    try:
        return spark.read.schema(_COMMIT).json(f"{path}/_commits/*.json")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], _COMMIT)


def read_committed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of all committed batches."""
    folders = [f"{path}/batch={r.batch}/content={r.content}" for r in commits(spark, path).collect()]  # one row a batch
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def commit_batch(batch: DataFrame, number: int, path: str, fail_before_commit: bool = False) -> bool:
    """Write and commit a batch; False if it was committed before."""
    spark = batch.sparkSession
    if not commits(spark, path).where(F.col("batch") == number).isEmpty():
        return False
    kept = batch.persist()
    try:
        content, rows = content_hash(kept)
        kept.write.mode("overwrite").parquet(f"{path}/batch={number}/content={content}")
    finally:
        kept.unpersist()
    if fail_before_commit:
        raise RuntimeError("stopped between the rows and their commit")
    _put(spark, f"{path}/_commits/{number}.json", f'{{"batch": {number}, "content": "{content}", "rows": {rows}}}\n')
    return True


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file and give it its name at once, so that no reader sees it in part."""
    jvm, target = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), "." + target.getName())
    stream = fs.create(draft, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not fs.rename(draft, target):
        fs.delete(draft, False)


def write_once(events: DataFrame, path: str, checkpoint: str, fail_at: int | None = None) -> StreamingQuery:
    """Run the stream over what is there into the sink. `fail_at`: for tests, the batch in which it is killed."""

    def save(batch: DataFrame, number: int) -> None:
        commit_batch(batch, number, path, number == fail_at)

    return events.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start()
