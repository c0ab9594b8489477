"""Which rows of a source are read: selectors, sample fractions, rotation, flattening, key patterns."""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from lakeward.functions.names import glob_match
from lakeward.session import settled

#: No sampling below so many rows or multiples of the limit; how far documents are walked.
SAMPLED_FROM, SAMPLED_MULTIPLE, OVERSAMPLE = 10_000, 10, 3
DEPTH, ELEMENTS, MOST_LITERALS, ROUNDS = 20, 16, 16, 4


def sample_percent(rows: int, limit: int) -> float | None:
    """Share of a relation to sample so that `limit` rows are found; None: read from the start."""
    if rows < SAMPLED_FROM or rows < SAMPLED_MULTIPLE * limit:
        return None
    return min(100.0, max(0.0001, 100.0 * OVERSAMPLE * limit / rows))


# How engines sample a large object, and from how many documents of how many times the limit a document store does.
METHODS = {"postgresql": "blocks", "sqlserver": "blocks", "mysql": "first", "mariadb": "first", "firebird": "first", "redis": "hash", "openldap": "first", "sqlite": "range", "mongodb": "hash", "cas": "first"}
DOCUMENTS_FROM, DOCUMENTS_MULTIPLE = 100, 20


def sample_method(engine: Column, rows: Column, limit: int) -> Column:
    """How an object of so many rows (null: not known) is sampled: `first` rows, `blocks` of a share, a `range` of keys with a wrap, or
    rows by `hash`. Small objects are read from the start."""
    chain = F
    for name, method in METHODS.items():
        large = (rows > DOCUMENTS_FROM) & (rows > DOCUMENTS_MULTIPLE * limit) if name == "mongodb" else (rows >= SAMPLED_FROM) & (rows >= SAMPLED_MULTIPLE * limit)
        chain = chain.when(engine == name, F.when(F.coalesce(large, F.lit(False)), F.lit(method)).otherwise("first"))
    return chain.otherwise("first")


def engine_sample(frame: DataFrame, engine: str, key: str, limit: int, seed: int = 0) -> DataFrame:
    """About `limit` rows of a table, as its engine would sample it. Blocks are those of the scan (a share of its partitions is
    read by `Connector.discover`; here, of rows in the table's order)."""
    rows = frame.count()
    row = frame.sparkSession.range(1).select(sample_method(F.lit(engine), F.lit(rows), limit).alias("m")).first()
    if row.m == "range":
        return key_range_sample(frame, key, limit, seed)
    if row.m == "hash":
        return sample_rows(frame, key, limit, seed)
    if row.m == "blocks":
        return frame.sample(False, sample_percent(rows, limit) / 100, seed).limit(limit)
    return frame.limit(limit)


def sample_share(rows: Column, limit: int) -> Column:
    """`sample_percent` of a column of row counts."""
    percent = F.greatest(F.lit(0.0001), F.least(F.lit(100.0), 100.0 * OVERSAMPLE * limit / rows))
    return F.when((rows >= SAMPLED_FROM) & (rows >= SAMPLED_MULTIPLE * limit), percent)


def sample_rows(frame: DataFrame, key: str, limit: int, seed: int = 0) -> DataFrame:
    """The `limit` rows of least hash: the same rows however the table is partitioned."""
    return frame.orderBy(F.xxhash64(F.lit(seed), key), key).limit(limit)


def key_range_sample(frame: DataFrame, key: str, limit: int, seed: int = 0) -> DataFrame:
    """About `limit` rows or more from ranges of a whole-number key: from a seeded start, with a wrap at the greatest key.

    The ranges are as wide as the sampled share of all keys, and reach the scan as filters on the key, so row groups
    outside of them are not read. A range of sparse keys may hold fewer rows; then it is doubled. A small table is
    taken whole.
    """
    known = frame.agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("n")).first()  # from footers, where they have them
    percent = sample_percent(known.n, limit)
    if percent is None or known.low is None:
        return frame
    width = known.high - known.low + 1
    start = known.low + int(hashlib.md5(f"range/{seed}".encode()).hexdigest()[:15], 16) * width // 16**15
    span = max(1, math.ceil(width * percent / 100))
    while True:
        end = start + span  # exclusive
        if span >= width:
            return frame.where(F.col(key).isNotNull())
        wrapped = end - known.high - 1
        some = frame.where((F.col(key) >= start) & (F.col(key) < end) if wrapped <= 0 else (F.col(key) >= start) | (F.col(key) < known.low + wrapped))
        if some.count() >= min(limit, known.n):
            return some
        span *= 2


def rotate(objects: DataFrame, name: str, seed: int) -> DataFrame:
    """Objects in an order that depends on the seed, so that a scan cut short covers others next time."""
    return objects.withColumn("place", F.md5(F.concat_ws("/", F.lit(str(seed)), name))).orderBy("place", name)


def balance_families(rows: DataFrame, family: str, order: str, limit: int) -> DataFrame:
    """Round robin over families, so that no family takes all places of a sample."""
    ranked = rows.withColumn("_round", F.row_number().over(Window.partitionBy(family).orderBy(order)))
    return ranked.where(F.col("_round") <= limit).orderBy("_round", family).limit(limit).drop("_round")


def select_objects(objects: DataFrame, name: str, include: list[str], exclude: list[str]) -> DataFrame:
    wanted = F.lit(not include)
    for g in include:
        wanted |= glob_match(F.col(name), g)
    for g in exclude:
        wanted &= ~glob_match(F.col(name), g)
    return objects.where(wanted)


def catalog(frames: dict[str, DataFrame]) -> list[tuple[str, str, str]]:
    """(object, field, type) of frames, from their schemas."""
    return [(name, f.name, f.dataType.simpleString()) for name, frame in frames.items() for f in frame.schema.fields]


def flatten(frame: DataFrame, key: str, column: str) -> DataFrame:
    """key, path, value of every leaf of a nested column. Array levels are `[]`, map keys `*`; at most
    16 elements of an array are taken and 20 levels."""

    def leaves(value: Column, kind, path: str, depth: int) -> list[Column]:
        """Arrays of (path, value) structs."""
        if depth > DEPTH:
            return []
        if isinstance(kind, StructType):
            return [x for f in kind.fields for x in leaves(value[f.name], f.dataType, f"{path}.{f.name}" if path else f.name, depth + 1)]
        if isinstance(kind, ArrayType):
            return [F.flatten(F.transform(F.slice(value, 1, ELEMENTS), lambda v: F.concat(*leaves(v, kind.elementType, path + "[]", depth + 1))))]
        if isinstance(kind, MapType):
            return [F.flatten(F.transform(F.slice(F.map_values(value), 1, ELEMENTS), lambda v: F.concat(*leaves(v, kind.valueType, path + ".*" if path else "*", depth + 1))))]
        return [F.array(F.struct(F.lit(path).alias("path"), value.cast("string").alias("value")))]

    parts = leaves(F.col(column), frame.schema[column].dataType, "", 0)
    return frame.select(key, F.explode(F.flatten(F.filter(F.array(*parts), lambda a: a.isNotNull()))).alias("leaf")).select(key, "leaf.path", "leaf.value").where("value is not null")


_VALUE_TOKEN = "^(?:[0-9]+|[0-9a-fA-F]{8,}|.*[0-9]{4,}.*|.*@.*|[0-9]+\\..*)$"


def key_segments(key: Column, separators: str) -> Column:
    """The segments of a key, each with the separator that follows it; those that look like data are `*`."""
    end = _end(separators)
    return F.transform(F.split(key, f"(?<=[{re.escape(separators)}])"), lambda s: F.when(F.regexp_replace(s, end, "").rlike(_VALUE_TOKEN), _wild(s, end)).otherwise(s))


def _end(separators: str) -> str:
    return f"[{re.escape(separators)}]*$"


def _wild(segment: Column, end: str) -> Column:
    return F.concat(F.lit("*"), F.regexp_extract(segment, end, 0))


def collapsed_shapes(shapes: DataFrame, separators: str = ":/", literals: int = MOST_LITERALS, rounds: int = ROUNDS) -> DataFrame:
    """origin and p for distinct segment arrays `p`: in at most `rounds` rounds, positions collapse to `*`: those with
    more than `literals` different segments after the same beginning in keys of the same length, and those
    with two or more before the same rest."""
    mapped = settled(shapes.select(F.col("p").alias("origin"), "p").distinct())
    position, end = ["_size", "_i", "_head"], _end(separators)
    for _ in range(rounds):
        places = mapped.where("p is not null").select("p").distinct().select("p", F.size("p").alias("_size"), F.posexplode("p").alias("_i", "_s"))
        places = places.withColumn("_head", F.expr("slice(p, 1, _i)")).withColumn("_rest", F.expr("slice(p, _i + 2, _size)"))
        literal = places.where(~F.col("_s").startswith("*"))
        wide = literal.groupBy(*position).agg(F.count_distinct("_s").alias("_k")).where(F.col("_k") > literals)
        alike = literal.groupBy(*position, "_rest").agg(F.count("*").alias("_k")).where("_k > 1")
        decided = settled(wide.select(*position).unionByName(alike.select(*position)).distinct().withColumn("_w", F.lit(True)))
        if decided.isEmpty():
            break
        merged = places.join(decided, position, "left").withColumn("_s", F.when(F.col("_w"), _wild(F.col("_s"), end)).otherwise(F.col("_s")))
        merged = merged.groupBy("p").agg(F.sort_array(F.collect_list(F.struct("_i", "_s"))).alias("_u")).select("p", F.col("_u._s").alias("_p"))
        mapped = settled(mapped.join(merged, "p", "left").select("origin", F.coalesce("_p", "p").alias("p")))
    return mapped


def key_patterns(keys: DataFrame, key: str, separators: str = ":/", literals: int = MOST_LITERALS, rounds: int = ROUNDS) -> DataFrame:
    """pattern and n: keys with their data segments as `*`; separators stay as they are."""
    shapes = settled(keys.select(key_segments(F.col(key), separators).alias("p")).groupBy("p").agg(F.count("*").alias("n")))
    mapped = collapsed_shapes(shapes, separators, literals, rounds)
    named = shapes.join(mapped.withColumnRenamed("p", "_to"), F.col("p").eqNullSafe(F.col("origin")))
    return named.groupBy(F.array_join("_to", "").alias("pattern")).agg(F.sum("n").cast("long").alias("n"))


def key_family(key: Column, kind: Column, separators: str = ":/") -> Column:
    """Family of a key: its first segment (one mark for all that may be data), its number of segments, its type."""
    first = F.regexp_extract(key, f"^[^{re.escape(separators)}]*", 0)
    plain = first.rlike("^[A-Za-z_-]{1,64}$")
    return F.struct(F.when(plain, first).otherwise(F.lit("#")).alias("first"), F.size(F.split(key, f"[{re.escape(separators)}]")).alias("segments"), kind.alias("kind"))


def keyspace_walk(keys: DataFrame, key: str, kind: str, samples: int, separators: str = ":/", seed: int = 0) -> DataFrame:
    """pattern, n (keys), families, samples: for each learned pattern of a keyspace up to `samples` of its keys, taken in
    turn from its families, so that no family takes all places.

    A family's sample is a bottom-k by hash in each shape: tasks keep their own least keys before any are moved, so a
    family is never in one task, and the result does not depend on how the keys are dealt. Null keys are left out.
    """
    known = keys.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), key_segments(F.col(key), separators).alias("p"), key_family(F.col(key), F.col(kind), separators).alias("_family"))
    known = known.withColumn("_hash", F.xxhash64(F.lit(seed), "_key"))
    mapped = collapsed_shapes(known, separators).withColumnRenamed("p", "_to")
    counts = known.groupBy("p", "_family").agg(F.count("*").alias("n")).join(mapped, F.col("p") == F.col("origin")).groupBy("_to").agg(F.sum("n").cast("long").alias("n"), F.count_distinct("_family").alias("families"))
    least = lambda rows, by: rows.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy("_hash", "_key"))).where(F.col("_place") <= samples)
    reservoirs = least(least(known.distinct(), ["p", "_family"]).drop("_place").join(mapped, F.col("p") == F.col("origin")), ["_to", "_family"])
    turn = Window.partitionBy("_to").orderBy("_place", "_hash", "_key")
    taken = reservoirs.withColumn("_turn", F.row_number().over(turn)).where(F.col("_turn") <= samples)
    chosen = taken.groupBy("_to").agg(F.transform(F.sort_array(F.collect_list(F.struct("_turn", "_key"))), lambda x: x["_key"]).alias("samples"))
    return counts.join(chosen, "_to").select(F.array_join("_to", "").alias("pattern"), "n", F.col("families").cast("long").alias("families"), "samples")
