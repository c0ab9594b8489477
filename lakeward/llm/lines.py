"""Line dedup: a sharded minimal perfect hash over repeated lines, probed by the lines of documents.

Lines travel as digests of 16 bytes. Those that at least two documents hold are dealt to shards by hash.
A shard is a minimal perfect hash function (levels of bit arrays and their ranks) over arrays: a
fingerprint (the digest's second half), the number of rows, and the least document. Lines of documents meet the shard of
their hash and probe its arrays. The few lines that are more frequent than 1 of FREQUENT are a shard of
their own that every task has, so no line makes its shard large.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeward.llm.common import free_name, materialize, mix64, released, reread, shared_folder, shuffle_partitions, small_batches, table, text_chunks, text_buffers

#: Code points that a line's key must have, and documents that must hold it.
LEAST_CHARS = 10
#: At most so many lines can make up 1 of FREQUENT of all line places each; they are the bound of the broadcast.
FREQUENT = 4096
#: Lines of a shard, about.
SHARD_LINES = 1 << 16
_BLANK = b" \t\n\x0b\x0c\r"
#: Stands for a missing id; rows without id count as one document, the last.
NO_ID = (1 << 63) - 1


def line_digest(line: bytes, least_chars: int = LEAST_CHARS) -> bytes | None:
    """128 bits of the key's hash; None if the key is too short to count."""
    key = line.strip(_BLANK).lower()  # of bytes, so A-Z only
    if len(key) < least_chars or len(key) < 4 * least_chars and len(key.decode("utf-8", "replace")) < least_chars:
        return None
    return xxhash.xxh3_128_digest(key)


@dataclass
class LineIndex:
    """A minimal perfect hash over digests and the arrays it points into."""

    levels: list[np.ndarray]  # bits of each level, as bytes of 0 and 1
    starts: list[np.ndarray]  # set bits before each place of a level, all levels before it included
    fingerprints: np.ndarray
    counts: np.ndarray
    firsts: np.ndarray

    @staticmethod
    def _places(digests: np.ndarray, level: int, size: int) -> np.ndarray:
        salted = mix64(digests[:, 0] + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64)))
        return (mix64(salted ^ digests[:, 1]) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, digests: np.ndarray, counts: np.ndarray, firsts: np.ndarray) -> "LineIndex":
        """Digests that share a place go on to the next, smaller level, until each has one of its own."""
        left, levels, starts, slots, seen = np.arange(len(digests)), [], [], np.empty(len(digests), np.int64), 0
        while len(left):
            size = max(64, 2 * len(left))
            at = cls._places(digests[left], len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            rank = seen + np.cumsum(alone) - alone
            placed = alone[at]
            slots[left[placed]] = rank[at[placed]]
            levels.append(alone)
            starts.append(rank)
            seen += int(alone.sum())
            left = left[~placed]
        order = np.empty(len(digests), np.int64)
        order[slots] = np.arange(len(digests))
        return cls(levels, starts, digests[order, 1], counts[order], firsts[order])

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """Where each digest is in the arrays; -1 if its fingerprint says that it is not there."""
        found, left = np.full(len(digests), -1, np.int64), np.arange(len(digests))
        for level, (bits, rank) in enumerate(zip(self.levels, self.starts)):
            at = self._places(digests[left], level, len(bits))
            here = bits[at]
            slot = rank[at[here]]
            same = self.fingerprints[slot] == digests[left[here], 1]
            found[left[here][same]] = slot[same]
            left = left[~here]
        return found

    def to_bytes(self) -> bytes:
        """Bits packed; ranks are worked out again when it is read."""
        head = np.array([len(self.fingerprints), len(self.levels), *map(len, self.levels)], dtype="<i8")
        packed = [np.packbits(bits).tobytes() for bits in self.levels]
        return b"".join([head.tobytes(), *packed, self.fingerprints.astype("<u8").tobytes(), self.counts.astype("<i8").tobytes(), self.firsts.astype("<i8").tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> "LineIndex":
        n, depth = np.frombuffer(data, "<i8", 2).tolist()
        sizes = np.frombuffer(data, "<i8", depth, 16).tolist()
        at, levels, starts, seen = 16 + 8 * depth, [], [], 0
        for size in sizes:
            bits = np.unpackbits(np.frombuffer(data, np.uint8, -(-size // 8), at))[:size].astype(bool)
            levels.append(bits)
            starts.append(seen + np.cumsum(bits) - bits)
            seen += int(bits.sum())
            at += -(-size // 8)
        return cls(levels, starts, *(np.frombuffer(data, kind, n, at + 8 * n * k) for k, kind in enumerate(("<u8", "<i8", "<i8"))))


def digest_rows(digests: list[bytes]) -> np.ndarray:
    """Digests as rows of two 64-bit numbers, hash and fingerprint."""
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)


def _row_key() -> list[Column]:
    """What a row is known by: id and text. Rows alike in both have the same lines to drop."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash")]


def line_places(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc, text_hash and line (digest), once for each row and line that counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            for low, high in text_chunks(offsets):
                found, rows = [], []
                for row in range(low, high):
                    lines = {line_digest(x, least_chars) for x in data[offsets[row] : offsets[row + 1]].tobytes().split(b"\n")}
                    lines.discard(None)
                    found += lines
                    rows += [row] * len(lines)
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(found, pa.binary())], names=["doc", "text_hash", "line"])

    return docs.select(*_row_key(), "text").mapInArrow(released(run), "doc long, text_hash long, line binary")


def repeated_lines(places: DataFrame) -> DataFrame:
    """line, n (rows that hold it), first (least document), for lines of at least two documents."""
    counted = places.groupBy("line").agg(F.count("*").alias("n"), F.min("doc").alias("first"), F.max("doc").alias("last"))
    return counted.where("first <> last").drop("last")


def build_shards(lines: DataFrame, shards: int) -> DataFrame:
    """shard and its index as bytes. Hashes deal lines evenly, so a shard has about as many as any other."""

    def build(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        index = LineIndex.build(digest_rows(group["line"].to_pylist()), group["n"].to_numpy(), group["first"].to_numpy())
        return pa.table({"shard": pa.array([group["shard"][0].as_py()], pa.int64()), "index": pa.array([index.to_bytes()], pa.binary())})

    return lines.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(build, "shard long, index binary")


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("line"), F.lit(shards)).cast("long")


def _drops(index: LineIndex | None, batch: pa.RecordBatch) -> np.ndarray:
    """Which places of the batch hold a line whose first document is another one."""
    if index is None or not batch.num_rows:
        return np.zeros(batch.num_rows, bool)
    slots = index.slots(digest_rows(batch.column("line").to_pylist()))
    gone = slots >= 0
    gone[gone] = index.firsts[slots[gone]] != batch.column("doc").to_numpy(zero_copy_only=False)[gone]
    return gone


def lines_to_drop(places: DataFrame, lines: DataFrame) -> DataFrame:
    """doc, text_hash and line of every place that goes."""
    spark = places.sparkSession
    total = lines.agg(F.count("*").alias("lines"), F.sum("n").alias("places")).first()
    often = [] if not total.lines else lines.where(F.col("n") * FREQUENT >= total.places).collect()  # at most FREQUENT rows
    numbers = [np.array([r[k] for r in often], np.int64) for k in ("n", "first")]
    frequent = LineIndex.build(digest_rows([bytes(r.line) for r in often]), *numbers)
    shared = spark.sparkContext.broadcast(frequent.to_bytes())
    shards = max(4 * shuffle_partitions(spark), total.lines // SHARD_LINES)
    schema = "doc long, text_hash long, line binary"

    def of_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places of frequent lines are decided here; the others go on to their shards."""
        index = LineIndex.from_bytes(shared.value)
        for batch in batches:
            known = index.slots(digest_rows(batch.column("line").to_pylist())) >= 0
            gone = _drops(index, batch)
            yield batch.filter(pa.array(~known | gone)).append_column("decided", pa.array(gone[~known | gone]))

    def of_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's index comes before its places; a shard of unrepeated lines has none."""
        index, current = None, None
        for batch in batches:
            edges = np.flatnonzero(np.diff(batch.column("shard").to_numpy(), prepend=-1))
            for low, high in zip(edges, [*edges[1:], batch.num_rows]):
                part = batch.slice(low, high - low)
                if (shard := part.column("shard")[0].as_py()) != current:
                    index, current = None, shard
                if part.column("index")[0].is_valid:
                    index, part = LineIndex.from_bytes(part.column("index")[0].as_py()), part.slice(1)
                gone = pa.array(_drops(index, part))
                yield part.select(["doc", "text_hash", "line"]).filter(gone)

    sorted_out = materialize(places.mapInArrow(released(of_frequent), f"{schema}, decided boolean"))
    indexes = build_shards(lines.where(F.col("n") * FREQUENT < F.lit(total.places or 0)), shards)
    probes = sorted_out.where("not decided").select(_shard(shards).alias("shard"), F.lit(None).cast("binary").alias("index"), "doc", "text_hash", "line")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("doc", "long"), ("text_hash", "long"), ("line", "binary"))]
    met = indexes.select("shard", "index", *none).unionByName(probes).repartition("shard").sortWithinPartitions("shard", F.col("index").isNull())
    probed = met.mapInArrow(released(of_shards), schema)
    return probed.unionByName(sorted_out.where("decided").drop("decided"))


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """The documents without lines that an earlier document holds, with n_lines and n_dropped.

    A line's key is the line without blanks at its ends, A-Z in lower case; keys of fewer than `least_chars`
    code points never count. A key stays in the least doc_id that holds it, however often, and goes from
    all others. Rows of one id are one document, so lines that only these share stay; rows without id
    are one document that comes last. A null text becomes one empty line. Repeated rows stay; other
    columns stay as they are (`n_lines` and `n_dropped` of the input are replaced); an empty table gives no rows. A text
    of any length is cut in its own task. Two lines are taken for one if 128 bits of their hashes agree.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("n_lines", "n_dropped")
    folder = shared_folder(spark, "lines")
    places = reread(line_places(docs, least_chars), folder, "places")
    lines = materialize(repeated_lines(places))
    drops = materialize(lines_to_drop(places, lines).groupBy("doc", "text_hash").agg(F.collect_set("line").alias("lines")))
    keys = [free_name(docs, n) for n in ("_doc", "_text_hash", "_lines")]
    keyed = docs.withColumns({n: c for n, c in zip(keys, _row_key())})
    joined = keyed.join(drops.toDF(*keys), keys[:2], "left").drop(*keys[:2])
    names, columns_of = docs.columns, joined.columns
    at, gone_at = columns_of.index("text"), columns_of.index(keys[2])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(at))
            for low, high in text_chunks(offsets):
                texts, n_lines, n_dropped = [], [], []
                for row in range(low, high):
                    lines = data[offsets[row] : offsets[row + 1]].tobytes().split(b"\n")
                    gone = set(batch.column(gone_at)[row].as_py() or ())
                    kept = [x for x in lines if line_digest(x, least_chars) not in gone] if gone else lines
                    texts.append(b"\n".join(kept).decode("utf-8", "replace"))
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(kept))
                columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(columns_of.index(n)).slice(low, high - low) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    return joined.mapInArrow(released(cut), StructType(list(docs.schema)).add("n_lines", "long").add("n_dropped", "long"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_OP12 = r"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM s),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.line, k.pos, r.key IS NOT NULL AND k.doc_id <> r.first AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
