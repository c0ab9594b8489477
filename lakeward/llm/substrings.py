"""Removal of word windows that start more than once in the corpus, with a count-min prefilter.

Every window of 35 words has an anchor: the 8-word run in it with the least hash, the leftmost of
equal ones. Equal windows at different places have equal anchors at different places, so an anchor
occurs at least as often as each of its windows, and a count-min sketch over anchors overestimates
window counts. The first pass sketches each partition; the merged sketch keeps one bit a cell (two or
more). The second pass passes on only windows whose anchor is estimated to repeat, and groups them
exactly: windows next to each other that share an anchor form a context. A context that occurs twice
settles all its windows; what else shares an anchor is grouped window by window. Words are compared by
two 64-bit hashes that must both agree: that of the 8-word anchor, and that of the window or context.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward.llm.common import CHUNK, POWERS, free_name, materialize, mix64, released, reread, run_hashes, shared_folder, shuffle_partitions, small_batches, span_hashes, table, text_buffers, text_chunks, word_bounds

WINDOW, ANCHOR = 35, 8
#: Cells of a sketch row, as a power of two: four or more for each anchor (one in about ANCHOR_CHARS characters),
#: at most 2^MOST_BITS. The merged sketch is one bit a cell, so at most 2 * 2^28 / 8 = 64 MB go to the executors.
#: With more anchors than cells the prefilter only lets more through.
SKETCH_ROWS, BLOCK_BITS, LEAST_BITS, MOST_BITS, ANCHOR_CHARS = 2, 20, 16, 28, 90
#: Windows that a row of equal contexts is gathered from at most (about).
GATHERED = 1 << 21
_PLACE = np.uint64((1 << 30) - 1)


@dataclass
class Contexts:
    """Runs of neighbouring windows with one anchor, over the rows of a chunk of texts."""

    row: np.ndarray
    first: np.ndarray  # word of the row at which the first window starts
    count: np.ndarray  # windows
    anchor: np.ndarray
    content: np.ndarray  # hash of all words of the context and of the anchor's place
    window_at: np.ndarray  # index of the first window in `windows`
    windows: np.ndarray  # window hashes of the chunk


def contexts_of(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> Iterator[Contexts]:
    """Contexts of a chunk of texts. A single long text comes in parts of at most CHUNK windows; a context that
    goes over a part's end is two contexts, which the comparison by windows brings together."""
    starts, ends, first_word = word_bounds(data, offsets)
    words = span_hashes(data, starts, ends)
    if len(words) < window:
        return
    if len(offsets) > 2 or len(words) < CHUNK + window:
        yield _contexts(words, first_word, window, anchor)
        return
    for low in range(0, len(words) - window + 1, CHUNK):
        part = words[low : low + CHUNK + window - 1]
        found = _contexts(part, np.array([0, len(part)]), window, anchor)
        found.first += low
        yield found


def _contexts(words: np.ndarray, first_word: np.ndarray, window: int, anchor: int) -> Contexts:
    grams = run_hashes(words, anchor)
    span = window - anchor + 1
    least, width = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), 1
    while 2 * width <= span:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    windows = run_hashes(words, window)
    counts = np.maximum(np.diff(first_word) - window + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(rows)) + np.repeat(first_word[:-1] - (np.cumsum(counts) - counts), counts)
    place = (least[at] & _PLACE).astype(np.int64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (rows[1:] != rows[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(at)))
    low = at[begin]
    up, down = POWERS.upto(len(words) + 1)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    size = count + window - 1
    body = (sums[low + size] - sums[low]) * down[low]
    content = mix64(body ^ mix64((size * 64 + place[begin] - low).astype(np.uint64)))
    return Contexts(rows[begin], low - first_word[:-1][rows[begin]], count, mix64(grams[place[begin]]), content, low, windows)


def _cells(anchors: np.ndarray, bits: int) -> list[np.ndarray]:
    return [((anchors >> np.uint64(32 * k)) & np.uint64((1 << bits) - 1)).astype(np.int64) for k in range(SKETCH_ROWS)]


def sketch_bits(docs: DataFrame) -> int:
    """Size of the sketch, from the characters of the table."""
    chars = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(chars / ANCHOR_CHARS + 1)) + 2))


def repeated_cells(docs: DataFrame, bits: int) -> np.ndarray:
    """Merged count-min sketch of all anchors: for each row and cell, whether it was hit twice or more."""
    block_bits = min(BLOCK_BITS, bits)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            anchors = [c.anchor for a, b in text_chunks(offsets) for c in contexts_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]
            if not anchors:
                continue
            out: tuple[list, list, list] = ([], [], [])
            for k, cells in enumerate(_cells(np.concatenate(anchors), bits)):
                cells, times = np.unique(cells, return_counts=True)
                packed = ((cells & ((1 << block_bits) - 1)) | (times > 1).astype(np.int64) << 31).astype("<u4")
                blocks = cells >> block_bits
                edges = np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1], [True]))) if len(cells) else np.zeros(1, np.int64)
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    out[0].append(k)
                    out[1].append(int(blocks[a]))
                    out[2].append(packed[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], names=["line", "block", "cells"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bitmap_of(key: tuple[int, int], counts: np.ndarray) -> pa.RecordBatch:
            columns = [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([np.packbits(counts > 1).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["line", "block", "cells"])

        last, counts = None, np.zeros(1 << block_bits, dtype=np.uint8)
        for batch in batches:
            for line, block, cells in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (line, block) != last:
                    if last is not None:
                        yield bitmap_of(last, counts)
                    last = (line, block)
                    counts[:] = 0
                cells = np.frombuffer(cells, dtype="<u4")
                at = (cells & np.uint32(0x7FFFFFFF)).astype(np.int64)
                counts[at] = np.minimum(counts[at] + 1 + (cells >> np.uint32(31)).astype(np.uint8), 2)
        if last is not None:
            yield bitmap_of(last, counts)

    kind = "line int, block int, cells binary"
    parts = docs.select("text").mapInArrow(released(sketch), kind).repartition(shuffle_partitions(docs.sparkSession), "line", "block")
    merged = parts.sortWithinPartitions("line", "block").mapInArrow(released(merge), kind)
    bitmap = np.zeros((SKETCH_ROWS, 1 << bits >> 3), dtype=np.uint8)
    size = 1 << block_bits >> 3
    for r in merged.toLocalIterator():  # bounded: SKETCH_ROWS * 2^MOST_BITS / 8 bytes
        bitmap[r.line, r.block * size : (r.block + 1) * size] = np.frombuffer(r.cells, dtype=np.uint8)
    return bitmap


#: Anchors that are sent to every task at most: 8 MB of them.
MOST_SENT = 1 << 20
_CONTEXT = "anchor long, content long, n long, windows array<long>, doc array<long>, tie array<long>, first array<int>"


def candidate_contexts(docs: DataFrame, bitmap: Broadcast, bits: int) -> DataFrame:
    """Contexts whose anchor is estimated to repeat; equal ones that are gathered together are one row with
    all places."""

    def repeats(anchors: np.ndarray) -> np.ndarray:
        on = np.ones(len(anchors), dtype=bool)
        for line, cells in zip(bitmap.value, _cells(anchors, bits), strict=True):
            on &= (line[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool)
        return on

    def rows_of(parts: list[list[np.ndarray]], kept_windows: list[np.ndarray]) -> pa.RecordBatch:
        anchor, content, docs_at, ties, first, count, window_at = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((content, anchor))
        anchor, content = anchor[order], content[order]
        edge = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1]), [True])))
        lead, n = edge[:-1], np.diff(edge)
        size, begin = count[order][lead], window_at[order][lead]
        at = np.cumsum(size) - size
        windows = np.concatenate(kept_windows)[np.repeat(begin - at, size) + np.arange(int(size.sum()))]
        lists = lambda to, values: pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(values))
        columns = [pa.array(anchor[lead].view(np.int64)), pa.array(content[lead].view(np.int64)), pa.array(n), lists(np.append(at, len(windows)), windows.view(np.int64))]
        columns += [lists(edge, x[order]) for x in (docs_at, ties, first.astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=["anchor", "content", "n", "windows", "doc", "tie", "first"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        kept_windows, base = [], 0
        for batch in batches:
            doc, tie = (batch.column(k).to_numpy() for k in (0, 1))
            data, offsets = text_buffers(batch.column(2))
            for a, b in text_chunks(offsets):
                for c in contexts_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                    on = np.flatnonzero(repeats(c.anchor))
                    count = c.count[on]
                    start = np.cumsum(count) - count
                    kept_windows.append(c.windows[np.repeat(c.window_at[on] - start, count) + np.arange(int(count.sum()))])
                    parts.append([c.anchor[on], c.content[on], doc[a + c.row[on]], tie[a + c.row[on]], c.first[on], count, base + start])
                    base += int(count.sum())
                    if base > GATHERED:
                        yield rows_of(parts, kept_windows)
                        parts, kept_windows, base = [], [], 0
        if base:
            yield rows_of(parts, kept_windows)

    return docs.select("_doc", "_tie", "text").mapInArrow(released(run), _CONTEXT)


def repeated_spans(docs: DataFrame, bits: int | None = None) -> DataFrame:
    """For each (doc, tie) the starts of contexts and the bits of their windows that repeat."""
    # Compressed columns take about half of a checkpoint's space; the table is read three times.
    folder = shared_folder(docs.sparkSession, "contexts")
    bits = bits or sketch_bits(docs)
    bitmap = docs.sparkSession.sparkContext.broadcast(repeated_cells(docs, bits))
    found = reread(candidate_contexts(docs, bitmap, bits), folder, "candidates")
    bitmap.destroy()  # the candidates are written
    totals = materialize(found.groupBy("anchor", "content").agg(F.sum("n").alias("n")))
    # Anchors whose contexts have to be compared window by window: one occurs once, and is not alone.
    open_anchors = materialize(totals.groupBy("anchor").agg(F.count("*").alias("k"), F.min("n").alias("least")).where("k > 1 and least = 1").select("anchor"))
    # Few anchors go to every task: then contexts stay where they are, those of a common anchor too. Many are joined
    # as Spark sees fit, which splits a common one.
    few = open_anchors.count() <= MOST_SENT
    unsettled = found.join(F.broadcast(open_anchors) if few else open_anchors, "anchor", "left_semi")
    repeated = materialize(
        unsettled.select("anchor", "n", F.explode("windows").alias("w")).groupBy("anchor", "w").agg(F.sum("n").alias("n")).where("n > 1").select("anchor", "w")
    )
    single = totals.where("n = 1").select("anchor", "content")
    alone = unsettled.where("n = 1").select("anchor", "content", "windows").join(single, ["anchor", "content"], "left_semi")
    hits = alone.select("anchor", "content", F.posexplode("windows").alias("k", "w")).join(repeated, ["anchor", "w"], "left_semi")
    masks = hits.groupBy("anchor", "content").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("mask"))
    settled = totals.where("n > 1").select("anchor", "content", F.lit(-1).cast("long").alias("mask"))
    verdict = settled.unionByName(masks)
    places = found.select("anchor", "content", F.size("windows").alias("count"), F.arrays_zip("doc", "tie", "first").alias("places")).join(verdict, ["anchor", "content"])
    spans = places.select(F.explode("places").alias("p"), "count", "mask").select("p.doc", "p.tie", F.struct("p.first", "count", "mask").alias("span"))
    return spans.groupBy(F.col("doc").alias("_doc"), F.col("tie").alias("_tie")).agg(F.collect_list("span").alias("spans"))


def covered_words(n: int, spans: list[dict], window: int = WINDOW) -> np.ndarray:
    """Which of n words lie in a repeated window."""
    change = np.zeros(n + 1, dtype=np.int64)
    for s in spans:
        first, count, mask = s["first"], s["count"], s["mask"]
        if mask == -1:
            change[first] += 1
            change[first + count - 1 + window] -= 1
        else:
            for k in range(count):
                if mask >> k & 1:
                    change[first + k] += 1
                    change[first + k + window] -= 1
    return np.cumsum(change[:n]) > 0


def with_spans(docs: DataFrame, bits: int | None = None) -> tuple[DataFrame, str]:
    """Each row of `docs` with its spans in one more column, whose name is free in `docs`; rows with equal
    id and text have equal spans."""
    doc, tie, spans = (free_name(docs, n) for n in ("_doc", "_tie", "_spans"))
    keyed = docs.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn(tie, F.xxhash64(F.coalesce("text", F.lit(""))))
    found = repeated_spans(keyed.select(F.col(doc).alias("_doc"), F.col(tie).alias("_tie"), "text"), bits)
    found = found.select(F.col("_doc").alias(doc), F.col("_tie").alias(tie), F.col("spans").alias(spans))
    return keyed.join(found.hint("shuffle_hash"), [doc, tie], "left").drop(doc, tie), spans


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def kept_words(docs: DataFrame, bits: int | None = None) -> DataFrame:
    """n_words, n_removed and the digest of the words left, one row per input row.

    A null or empty text has no words, and a text shorter than a window loses none. Repeated rows are
    occurrences of their own, so they lose every word that a window covers. Other columns are not
    read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or "").encode().split()
                n, spans = len(words), spans.as_py()
                if spans:
                    gone = covered_words(n, spans).tolist()
                    words = [w for w, g in zip(words, gone, strict=True) if not g]
                out[0].append(n)
                out[1].append(n - len(words))
                out[2].append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], schema=_SCHEMA)

    rows, spans_of = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), bits)
    return rows.select("doc_id", "text", spans_of).mapInArrow(released(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated windows; text between kept words stays as it is. A document that
    loses all its words goes; one that had none stays. An empty table gives no rows."""
    small_batches(spark)
    names, kinds = docs.columns, docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            texts, lengths, good = [], [], []
            for text, spans in zip(batch.column(at), batch.column(len(names)), strict=True):
                text, spans, keep = text.as_py(), spans.as_py(), True
                if spans:
                    data = text.encode()
                    starts, ends, _ = word_bounds(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]))
                    stay = ~covered_words(len(starts), spans)
                    edge = np.diff(stay.astype(np.int8), prepend=0, append=0)
                    runs = zip(starts[np.flatnonzero(edge == 1)].tolist(), ends[np.flatnonzero(edge == -1) - 1].tolist(), strict=True)
                    text, keep = b"\n".join([data[a:b] for a, b in runs]).decode(), bool(stay.any())
                texts.append(text)
                lengths.append(None if text is None else len(text))
                good.append(keep)
            columns = [batch.column(k) for k in range(len(names))]
            columns[at] = pa.array(texts, columns[at].type)
            if "n_chars" in names:
                columns[names.index("n_chars")] = pa.array(lengths, columns[names.index("n_chars")].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(good, pa.bool_()))

    rows, spans_of = with_spans(docs)
    return rows.select(*names, spans_of).mapInArrow(released(cut), kinds)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_words(table(spark, sf_dir, "documents"))
