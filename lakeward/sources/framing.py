"""Records of text files whose quoted fields may hold line breaks, framed in byte ranges side by side.

Spark's text reader deals ranges of files to tasks and gives their lines in order. Whether a range begins
inside a quoted field is not known where it is read; so a first pass takes the parity of quotes of each
range, a scan over the ranges of a file (one row each) gives the state at every range's start, and a second
pass frames. What is open at a range's end travels to where its record began; nothing else is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeward.session import settled

#: Fixed value: a longer record is not parsed.
MOST_BYTES = 1 << 20
_RECORD = "file string, range long, place long, record string, owner long, bytes long"


def range_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, range (its first byte), line, quotes: lines of text files, in order within a range. Ranges follow
    spark.sql.files.maxPartitionBytes; a line belongs to the range that it begins in."""
    lines = spark.read.option("lineSep", "\n").text(paths)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.col("value").alias("line"), quotes.cast("long").alias("quotes"))


def range_states(lines: DataFrame) -> DataFrame:
    """For each range: `inside`, whether it begins in a quoted field, and `owner`, the range in which the record
    began that is open there."""
    odd = F.col("quotes") % 2 == 1
    place = lines.withColumn("_place", F.monotonically_increasing_id())  # rises along a range
    ranges = place.groupBy("file", "range").agg(
        (F.sum("quotes") % 2).alias("parity"), F.coalesce(F.min(F.when(odd, F.col("_place"))) < F.max("_place"), F.lit(False)).alias("opens_if_inside"),
    )
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    started = ranges.withColumn("inside", F.coalesce(F.sum("parity").over(before) % 2 == 1, F.lit(False)))
    # A range in which a record begins: the first line does if the range begins outside of quotes.
    begins = F.when(~F.col("inside") | F.col("opens_if_inside"), F.col("range"))
    return started.withColumn("owner", F.last(begins, ignorenulls=True).over(before)).select("file", "range", "inside", "owner")


def _framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of ranges, from their lines (file, range, line, quotes, inside, owner). A piece of a record that is open at the end
    of a range, or was so at its start, has the owner's range; a whole record has none."""
    current, inside, open_lines, owner, place = None, False, [], None, 0

    def closed(whole: bool) -> list[tuple]:
        text = "\n".join(open_lines)
        return [(*current, place, text, None if whole else owner if owner is not None else current[1], len(text.encode()))]

    for batch in batches:
        files, starts, quotes = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_numpy()
        changes = (i for i in range(1, batch.num_rows) if (files[i], starts[i]) != (files[i - 1], starts[i - 1]))
        bounds = [0, *changes, batch.num_rows] if batch.num_rows else []
        rows: list[tuple] = []
        for low, high in zip(bounds, bounds[1:]):
            if (files[low], starts[low]) != current:
                if open_lines:
                    rows += closed(whole=False)
                current, place, open_lines = (files[low], starts[low]), 0, []
                inside = batch.column(4)[low].as_py()
                owner = batch.column(5)[low].as_py() if inside else None
            after = (int(inside) + np.cumsum(quotes[low:high])) % 2 == 1  # open behind each line
            ends = np.flatnonzero(~after)
            if open_lines or inside:  # up to the line that ends what is open
                stop = int(ends[0]) + 1 if len(ends) else high - low
                open_lines += batch.column(2).slice(low, stop).to_pylist()
                if len(ends):
                    rows += closed(whole=owner is None)
                    open_lines, owner, place, ends = [], None, place + 1, ends[1:]
                at = stop
            else:
                at = 0
            if len(ends):  # records that begin and end here
                offsets = np.concatenate(([at], ends + 1))
                values = batch.column(2).slice(low, high - low).cast(pa.string())
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values), "\n").to_pylist()
                rows += [(*current, place + i, t, None, len(t.encode())) for i, t in enumerate(texts)]
                place, at = place + len(texts), int(ends[-1]) + 1
            if at < high - low and after[-1]:
                open_lines += batch.column(2).slice(low + at, high - low - at).to_pylist()
            inside = bool(after[-1])
        yield _batch(rows)
    if open_lines:
        yield _batch(closed(whole=False))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    fields = [part.split() for part in _RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def csv_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, range and place (where a record begins), record, oversized: the CSV records of text files, whatever their
    ranges. Blank records are left out; an unclosed quote at a file's end gives its last record."""
    lines = range_lines(spark, paths)
    states = settled(range_states(lines))  # one row for each range; lines stay where they are read, and in order
    pieces = settled(lines.join(F.broadcast(states), ["file", "range"]).select("file", "range", "line", "quotes", "inside", "owner").mapInArrow(_framed, _RECORD))
    whole = pieces.where("owner is null").select("file", "range", "place", "record", "bytes")
    first = F.min_by("place", "range")
    parts = F.array_sort(F.collect_list(F.struct("range", "record")))
    # A record over several ranges: its first piece is the last one of its owner, the others are first ones.
    stitched = pieces.where("owner is not null").groupBy("file", "owner").agg(first.alias("place"), F.array_join(F.transform(parts, lambda p: p["record"]), "\n").alias("record"), F.sum("bytes").alias("bytes"))
    both = whole.unionByName(stitched.select("file", F.col("owner").alias("range"), "place", "record", "bytes"))
    return both.where(F.trim("record") != "").select("file", "range", "place", "record", (F.col("bytes") > MOST_BYTES).alias("oversized"))


def header_records(spark: SparkSession, paths: str | list[str], header: str) -> DataFrame:
    """file, range, place, record: records that begin with a line of the form `header` and go on to the next such line, over
    ranges too. Lines before a file's first header are left out."""
    lines = range_lines(spark, paths).select("file", "range", "line", F.col("line").rlike(header).alias("begins"))
    ranges = lines.groupBy("file", "range").agg(F.bool_or("begins").alias("begins"))
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    owners = settled(ranges.select("file", "range", F.last(F.when(F.col("begins"), F.col("range")), ignorenulls=True).over(before).alias("owner")))
    pieces = settled(lines.join(F.broadcast(owners), ["file", "range"]).select("file", "range", "line", "begins", "owner").mapInArrow(_headed, _RECORD))
    parts = F.array_sort(F.collect_list(F.struct("range", "record")))
    # The last record of a range may go on in later ones; all its pieces have one owner.
    stitched = pieces.where("owner is not null").groupBy("file", "owner").agg(F.min_by("place", "range").alias("place"), F.array_join(F.transform(parts, lambda p: p["record"]), "\n").alias("record"))
    return pieces.where("owner is null").select("file", "range", "place", "record").unionByName(stitched.select("file", F.col("owner").alias("range"), "place", "record"))


def _headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of ranges: the lines before the first header belong to the owner's last record, the last record to this range."""
    current, owner, place, held = None, None, 0, []

    def closed(last: bool) -> list[tuple]:
        if not held or owner is None and place == 0:  # nothing, or what stands before a file's first header
            return []
        text = "\n".join(held)
        whose = owner if place == 0 else current[1] if last else None
        return [(*current, max(place - 1, 0), text, whose, len(text.encode()))]

    for batch in batches:
        rows: list[tuple] = []
        for file, start, line, begins, whose in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, start) != current:
                rows += closed(last=True)
                current, owner, place, held = (file, start), whose, 0, []
            if begins:
                rows += closed(last=False)
                place, held = place + 1, []
            held.append(line)
        yield _batch(rows)
    yield _batch(closed(last=True))


def line_records(spark: SparkSession, paths: str | list[str], keep_empty: bool = False) -> DataFrame:
    """file, range, record, oversized: one record a line; with `keep_empty` blank lines too."""
    lines = range_lines(spark, paths).select("file", "range", F.regexp_replace("line", "\r$", "").alias("record"))
    kept = lines if keep_empty else lines.where("record <> ''")
    return kept.withColumn("oversized", F.octet_length("record") > MOST_BYTES)
