"""Sketches that tasks build on their own and Spark merges: heavy hitters, and bounded distinct sets.

Space-saving counters hold the largest groups of a stream in bounded space; a KMV sketch (the k least hashes) counts
distinct values, exactly while there are fewer than k. Both are monoids: neither the order of rows nor of
merges changes more than the counters' stated errors, and KMV not at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType


class SpaceSaving:
    """At most `capacity` counters: a name's count is too large by at most its error, and a name without a counter
    has at most the least count. That is at most the sum of all counts over the capacity."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.counts = capacity, {}

    @property
    def floor(self) -> int:
        """What a name that is not held can have at most."""
        return min((c for c, _ in self.counts.values()), default=0) if len(self.counts) >= self.capacity else 0

    def add(self, name: str, n: int, error: int = 0) -> None:
        count, wrong = self.counts.get(name, (0, 0))
        if name not in self.counts and len(self.counts) >= self.capacity:
            least = min(self.counts, key=lambda x: (self.counts[x][0], x))
            count = wrong = self.counts.pop(least)[0]
        self.counts[name] = (count + n, wrong + error)

    def merge(self, others: Iterable[tuple[str, int, int]], floor: int) -> None:
        """Take over the counters of another sketch with that floor: a name that one side lacks may have had up to its floor."""
        mine, theirs = self.floor, {name: (n, e) for name, n, e in others}
        joined = {}
        for name in self.counts.keys() | theirs.keys():
            a, b = self.counts.get(name, (mine, mine)), theirs.get(name, (floor, floor))
            joined[name] = (a[0] + b[0], a[1] + b[1])
        largest = sorted(joined, key=lambda x: (-joined[x][0], x))[: self.capacity]
        self.counts = {name: joined[name] for name in largest}


def heavy_groups(rows: DataFrame, partition: str, name: str, count: str, capacity: int) -> DataFrame:
    """partition, name, n, error: the space-saving counters of each partition over sums of `count`.

    Each task sends at most `capacity` counters of a partition, which are merged in one place; exact (error 0) where a
    partition has no more names than that. Null names count as `-`.
    """
    schema = StructType([rows.schema[partition], StructField(name, StringType()), StructField("n", LongType()), StructField("error", LongType()), StructField("floor", LongType()), StructField("part", LongType())])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found: dict[object, SpaceSaving] = {}
        for batch in batches:
            for key, who, n in zip(*(c.to_pylist() for c in batch.columns)):
                found.setdefault(key, SpaceSaving(capacity)).add("-" if who is None else who, n)
        part = TaskContext.get().partitionId()
        listed = [(key, who, n, e, s.floor, part) for key, s in found.items() for who, (n, e) in s.counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in listed], t) for i, t in enumerate(_arrow(schema))], names=schema.names)

    def merge(table: pa.Table) -> pa.Table:
        whole, parts = SpaceSaving(capacity), {}
        for r in table.to_pylist():
            parts.setdefault(r["part"], []).append(r)
        for p in sorted(parts):
            whole.merge(((r[name], r["n"], r["error"]) for r in parts[p]), parts[p][0]["floor"])
        listed = [(table[partition][0].as_py(), who, n, e) for who, (n, e) in whole.counts.items()]
        return pa.table([pa.array([r[i] for r in listed], t) for i, t in enumerate(_arrow(schema)[:4])], names=schema.names[:4])

    sums = rows.select(partition, F.col(name).cast("string").alias(name), F.col(count).cast("long").alias(count))
    return sums.mapInArrow(sketch, schema).groupBy(partition).applyInArrow(merge, StructType(schema.fields[:4]))


def _arrow(schema: StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema).types


def bounded_distinct(rows: DataFrame, keys: list[str], value: Column, k: int, digest: Callable[[Column], Column] | None = None) -> DataFrame:
    """keys, distinct (exact below k, else an estimate), exact, values (the k least hashes): a KMV sketch of each group.

    Tasks keep their own k least hashes of a group before any are moved, so a group's state is bounded everywhere, and
    the result does not depend on the order of merges. A group of one distinct value is constant.
    """
    digest = digest or (lambda v: F.conv(F.substring(F.sha2(v, 256), 1, 15), 16, 10).cast("long"))  # 60 bits
    hashes = rows.select(*keys, digest(value).alias("_h")).where("_h is not null").distinct()
    placed = hashes.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))).where(F.col("_place") <= k)
    sketch = placed.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias("values"))
    size, last = F.size("values").cast("long"), F.element_at("values", -1)
    estimate = F.round((k - 1) / (last / F.lit(float(1 << 60)))).cast("long")
    return sketch.select(*keys, F.when(size < k, size).otherwise(F.greatest(estimate, F.lit(k))).alias("distinct"), (size < k).alias("exact"), "values")


def merged_distinct(left: DataFrame, right: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The sketch of both sides' rows from their sketches."""
    both = left.select(*keys, "values").unionByName(right.select(*keys, "values")).select(*keys, F.explode("values").alias("_h"))
    return bounded_distinct(both, keys, F.col("_h"), k, digest=lambda v: v)
