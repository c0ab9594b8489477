"""Log files followed as a stream: what is appended, through rotation, truncation and restarts.

    spark.readStream.format("lakeward_tail").option("path", "/var/log/db/audit.log*").load()

The offset of the stream holds for each file (by device and inode, so a renamed file goes on where it was) the byte
behind its last complete line, and a digest of the bytes before it. A file whose digest differs, or that has
become shorter, was truncated or written anew and is read from its start. A last line without its end waits.
"""

from __future__ import annotations

import glob
import hashlib
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "lakeward_tail"
SCHEMA = "file string, at long, value string"
#: Bytes before an offset that its digest covers; bytes that one task reads.
PRINT_BYTES, RANGE_BYTES = 256, 32 << 20
_BLOCK = 64 << 10


@dataclass
class Range(InputPartition):
    """Whole lines of a file: from a line's start to a line's end."""

    file: str
    path: str
    low: int
    high: int


def file_id(path: str) -> str:
    status = os.stat(path)
    return f"{status.st_dev}:{status.st_ino}"


def print_of(path: str, at: int) -> str:
    """Digest of the bytes before `at`, and of the place."""
    with open(path, "rb") as f:
        f.seek(max(0, at - PRINT_BYTES))
        return hashlib.sha256(b"%d:" % at + f.read(min(at, PRINT_BYTES))).hexdigest()[:32]


def last_line_end(path: str, size: int) -> int:
    """The byte behind the last line break before `size`, 0 if there is none; read backwards in blocks."""
    with open(path, "rb") as f:
        while size > 0:
            low = max(0, size - _BLOCK)
            f.seek(low)
            found = f.read(size - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            size = low
    return 0


def next_line(path: str, at: int, high: int) -> int:
    """The first line's start at or after `at`, at most `high` (which is one)."""
    with open(path, "rb") as f:
        f.seek(at - 1)
        while at < high:
            block = f.read(_BLOCK)
            found = block.find(b"\n")
            if found >= 0:
                return min(high, f.tell() - len(block) + found + 1)
            at = f.tell()
    return high


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.pattern, self.from_end, self.range_bytes = options["path"], options.get("from", "start") == "end", int(options.get("rangebytes", RANGE_BYTES))

    def _files(self) -> dict[str, str]:
        """Path of each file by its id; of two names of one file the first."""
        found: dict[str, str] = {}
        for path in sorted(glob.glob(self.pattern)):
            try:
                found.setdefault(file_id(path), path)
            except OSError:  # renamed meanwhile; it has another name by the next batch
                continue
        return found

    def initialOffset(self) -> dict:
        return self.latestOffset() if self.from_end else {}

    def latestOffset(self) -> dict:
        out = {}
        for name, path in self._files().items():
            try:
                at = last_line_end(path, os.path.getsize(path))
                out[name] = {"at": at, "print": print_of(path, at)}
            except OSError:
                continue
        return out

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        paths, parts = self._files(), []
        for name, to in end.items():
            if (path := paths.get(name)) is None:
                continue
            seen = start.get(name)
            same = seen is not None and seen["at"] <= to["at"] and print_of(path, seen["at"]) == seen["print"]
            low, high = seen["at"] if same else 0, to["at"]
            while low < high:
                cut = high if high - low <= self.range_bytes else next_line(path, low + self.range_bytes, high)
                parts.append(Range(name, path, low, cut))
                low = cut
        return parts

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        """Lines and where they begin; the file is found by its id, should it have been renamed since it was planned."""
        path = partition.path
        if not os.path.exists(path) or file_id(path) != partition.file:
            path = self._files()[partition.file]
        with open(path, "rb") as f:
            f.seek(partition.low)
            at = partition.low
            while at < partition.high:
                lines = f.readlines(min(_BLOCK * 16, partition.high - at))
                places, values = [], []
                for line in lines:
                    if at >= partition.high:
                        break
                    places.append(at)
                    values.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
                    at += len(line)
                if not places:
                    return
                yield pa.RecordBatch.from_arrays([pa.array([partition.file] * len(places), pa.string()), pa.array(places, pa.int64()), pa.array(values, pa.string())], names=["file", "at", "value"])

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))


def follow(spark: SparkSession, pattern: str, start: str = "start", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Lines of the files of a pattern as a stream. The pattern has to match rotated names too (audit.log*). `start`:
    where a first run begins, `start` or `end` of what is there. All executors see the files, as on one host or a mount."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format(FORMAT).option("path", pattern).option("from", start).option("rangeBytes", range_bytes).load()
