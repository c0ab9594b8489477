"""The connector interface: one data source that checks a target, lists its catalog, and reads samples of it.

    spark.read.format("lakeward").option("path", folder).option("mode", "discover").load()

A target is a folder of tables (Parquet files or folders of them), of CSV files and of JSON lines. Modes: `check` (one row
for each object), `catalog` (for each field) and `discover` (object, field, value). Ranges of files are planned as
partitions: row groups of Parquet, and one partition for each text file. Selectors on object and field, as options or as
filters of a query, are pushed into the plan: what they leave out is not opened. With `sample` = rows, a
large table is read by a fraction of its row groups from a seeded start, with a wrap at its end.
"""

from __future__ import annotations

import fnmatch
import random
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
import pyarrow.fs
import pyarrow.json
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from lakeward.sources.sampling import sample_percent

FORMAT = "lakeward"
SCHEMAS = {
    "check": "object string, readable boolean, problem string, files int, rows long, bytes long",
    "catalog": "object string, field string, type string, rows long",
    "discover": "object string, field string, value string",
}
_KINDS = {".parquet": "parquet", ".csv": "csv", ".json": "json", ".jsonl": "json"}
_BATCH_ROWS, _BUFFER = 4096, 1 << 20


@dataclass
class Part(InputPartition):
    """Some row groups (or all of a text file) of an object, and at most how many rows to take."""

    object: str
    kind: str
    path: str
    groups: tuple[int, ...] = ()
    most: int | None = None


@dataclass
class Target:
    """A folder and what of it is wanted."""

    path: str
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), self.path)

    def objects(self) -> dict[str, list[tuple[str, str, int]]]:
        """Files of each object that is wanted, by name: (kind, path, bytes)."""
        found: dict[str, list[tuple[str, str, int]]] = {}
        for info in self.fs.get_file_info(pyarrow.fs.FileSelector(self.root, recursive=True)):
            parts = info.path.removeprefix(self.root).strip("/").split("/")
            if info.type != pyarrow.fs.FileType.File or any(p.startswith(("_", ".")) for p in parts):
                continue
            kind = next((k for end, k in _KINDS.items() if parts[0].endswith(end) or parts[-1].endswith(end)), None)
            name = parts[0]
            for end in _KINDS:
                name = name.removesuffix(end)
            if kind and self.wanted(name):
                found.setdefault(name, []).append((kind, info.path, info.size))
        return {name: sorted(found[name]) for name in sorted(found)}

    def wanted(self, name: str) -> bool:
        hit = lambda globs: any(fnmatch.fnmatchcase(name.lower(), g.lower()) for g in globs)
        return (not self.include or hit(self.include)) and not hit(self.exclude)


def chosen_groups(rows: Sequence[int], limit: int, seed: int) -> list[int]:
    """Row groups to read for a sample of `limit` rows: from the start if the table is small, else as many as hold the
    sampled share of all rows, from a seeded start and with a wrap."""
    percent = sample_percent(sum(rows), limit)
    at = 0 if percent is None or not rows else random.Random(seed).randrange(len(rows))
    wanted = limit if percent is None else max(limit, sum(rows) * percent / 100)
    groups, have = [], 0
    while have < wanted and len(groups) < len(rows):
        groups.append(at)
        have += rows[at]
        at = (at + 1) % len(rows)
    return groups


class TargetReader(DataSourceReader):
    def __init__(self, options: dict, mode: str) -> None:
        globs = lambda name: [g for g in options.get(name, "").split(",") if g]
        self.target_options, self.mode = (options["path"], globs("include"), globs("exclude")), mode
        self.sample, self.seed = int(options.get("sample", 0)), int(options.get("seed", 0))
        self.filters: dict[str, list] = {"object": [], "field": []}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equality, membership and beginnings of object and field names are applied here; all else is left to Spark."""
        for f in filters:
            known = isinstance(f, (EqualTo, In, StringStartsWith)) and len(f.attribute) == 1 and f.attribute[0] in self.filters
            if known and not (f.attribute[0] == "field" and self.mode == "check"):
                self.filters[f.attribute[0]].append((type(f).__name__, f.value))
            else:
                yield f

    def _passes(self, column: str, name: str) -> bool:
        tests = {"EqualTo": lambda v: name == v, "In": lambda v: name in v, "StringStartsWith": lambda v: name.startswith(v)}
        return all(tests[kind](value) for kind, value in self.filters[column])

    def partitions(self) -> Sequence[InputPartition]:
        target, parts = Target(*self.target_options), []
        for name, files in target.objects().items():
            if not self._passes("object", name):
                continue
            if self.mode != "discover":
                parts.append(Part(name, self.mode, ""))
                continue
            groups: list[tuple[str, int, int]] = []  # path, row group, rows
            for kind, path, _ in files:
                if kind == "parquet":
                    meta = pq.read_metadata(path, filesystem=target.fs)
                    groups += [(path, g, meta.row_group(g).num_rows) for g in range(meta.num_row_groups)]
                else:
                    parts.append(Part(name, kind, path, most=self.sample or None))
            read = chosen_groups([n for _, _, n in groups], self.sample, self.seed) if self.sample else range(len(groups))
            left = self.sample or None
            for g in read:
                path, number, rows = groups[g]
                share = None if left is None else -(-self.sample // len(read))
                parts.append(Part(name, "parquet", path, (number,), share))
        return parts or [Part("", "none", "")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        target = Target(*self.target_options)
        if partition.kind == "check":
            yield self._checked(target, partition.object)
        elif partition.kind == "catalog":
            yield self._catalog(target, partition.object)
        elif partition.kind != "none":
            yield from self._values(target, partition)

    def _checked(self, target: Target, name: str) -> pa.RecordBatch:
        files, rows, problem = target.objects().get(name, []), 0, None
        try:
            for kind, path, _ in files:
                rows += pq.read_metadata(path, filesystem=target.fs).num_rows if kind == "parquet" else sum(b.num_rows for b in _text_batches(target, kind, path))
        except (OSError, pa.ArrowInvalid) as error:  # told by its kind only; messages may hold values
            problem = type(error).__name__
        row = {"object": name, "readable": problem is None, "problem": problem, "files": len(files), "rows": rows if problem is None else None, "bytes": sum(n for _, _, n in files)}
        types = [pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_pylist([row], schema=pa.schema(list(zip(row, types))))

    def _catalog(self, target: Target, name: str) -> pa.RecordBatch:
        known: dict[str, str] = {}
        rows: int | None = 0
        for kind, path, _ in target.objects().get(name, []):
            if kind == "parquet":
                meta = pq.read_metadata(path, filesystem=target.fs)
                rows = None if rows is None else rows + meta.num_rows
                schema = meta.schema.to_arrow_schema()
            else:
                rows, schema = None, next(_text_batches(target, kind, path)).schema  # not counted
            for f in schema:
                known.setdefault(f.name, str(f.type))
        listed = [{"object": name, "field": f, "type": t, "rows": rows} for f, t in known.items() if self._passes("field", f)]
        return pa.RecordBatch.from_pylist(listed, schema=pa.schema([("object", pa.string()), ("field", pa.string()), ("type", pa.string()), ("rows", pa.int64())]))

    def _values(self, target: Target, part: Part) -> Iterator[pa.RecordBatch]:
        schema, left = pa.schema([("object", pa.string()), ("field", pa.string()), ("value", pa.string())]), part.most
        if part.kind == "parquet":
            file = pq.ParquetFile(part.path, filesystem=target.fs, buffer_size=_BUFFER)  # else whole column chunks are held
            names = [n for n in file.schema_arrow.names if self._passes("field", n)]
            batches = file.iter_batches(_BATCH_ROWS, row_groups=list(part.groups), columns=names) if names else iter(())
        else:
            batches = _text_batches(target, part.kind, part.path)
        for batch in batches:
            batch = batch if left is None else batch.slice(0, left)
            left = None if left is None else left - batch.num_rows
            for name, column in zip(batch.schema.names, batch.columns):
                if self._passes("field", name):
                    values = _as_text(column)
                    yield pa.RecordBatch.from_arrays([pa.array([part.object] * len(values), pa.string()), pa.array([name] * len(values), pa.string()), values], schema=schema)
            if left == 0:
                return


def _text_batches(target: Target, kind: str, path: str) -> Iterator[pa.RecordBatch]:
    """CSV in blocks (all columns as they are typed by the first block); JSON lines in one read."""
    if kind == "csv":
        yield from pyarrow.csv.open_csv(target.fs.open_input_stream(path))
    else:
        yield from pyarrow.json.read_json(target.fs.open_input_stream(path)).to_batches(_BATCH_ROWS)


def _as_text(column: pa.Array) -> pa.Array:
    if pa.types.is_string(column.type):
        return column
    if pa.types.is_nested(column.type) or pa.types.is_binary(column.type):
        return pa.array([None if v is None else str(v) for v in column.to_pylist()], pa.string())
    return pc.cast(column, pa.string())


class TargetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    @property
    def mode(self) -> str:
        mode = self.options.get("mode", "discover")
        if mode not in SCHEMAS:
            raise ValueError(f"mode is one of {', '.join(SCHEMAS)}")
        return mode

    def schema(self) -> str:
        return SCHEMAS[self.mode]

    def reader(self, schema) -> TargetReader:
        return TargetReader(dict(self.options), self.mode)


class Connector:
    """What an engine's connector offers: whether a target can be read, what it holds, and its access events."""

    def __init__(self, spark: SparkSession, path: str, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> None:
        spark.dataSource.register(TargetSource)
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        self.spark, self.options = spark, {"path": path, "include": ",".join(include), "exclude": ",".join(exclude)}

    def _load(self, mode: str, **options) -> DataFrame:
        return self.spark.read.format(FORMAT).options(**self.options, mode=mode, **options).load()

    def check(self) -> DataFrame:
        """object, readable, problem (a kind, never a message), files, rows, bytes."""
        return self._load("check")

    def catalog(self) -> DataFrame:
        """object, field, type, rows."""
        return self._load("catalog")

    def discover(self, sample: int = 0, seed: int = 0) -> DataFrame:
        """object, field, value of all rows, or of about `sample` rows of each object."""
        return self._load("discover", sample=sample, seed=seed)

    def audit_stream(self, pattern: str = "*.log*", **options) -> DataFrame:
        """file, at, value: the lines of the target's logs as a stream (`sources/tail.py`)."""
        from lakeward.sources.tail import follow

        return follow(self.spark, f"{self.options['path'].rstrip('/')}/{pattern}", **options)
