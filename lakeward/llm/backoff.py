"""Stupid-backoff scores of documents from n-gram counts of the whole corpus.

Documents are dealt to batches by hash; batches hold about BATCH characters. A batch sends each of its
distinct n-grams once, with its count, to the partition of the count table that the n-gram's hash names
(so a common n-gram arrives once a batch, however often it occurs). The partition adds up the counts, and
the total of every n-gram is joined back to the batches that sent it, where the joined counts are turned
into scores that are summed for each document. A document is scored by the counts of all the others: its
own occurrences are taken off the n-gram and off its context alike.

N-grams travel as columns: one row holds all that a batch has for a partition. There are never more such
rows than (batch, distinct n-gram) pairs, which grow in proportion to the corpus.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward.llm.common import give_back, mix64, span_hashes, table, text_buffers, text_chunks, word_bounds

ORDER, DISCOUNT = 2, 0.4
#: Characters of a batch (about); as many partitions of the count table, so both keep their size.
BATCH = 8_000_000
_TOTAL = np.uint64(1)  # stands for the empty n-gram: its count is the number of words
_MESSAGE = "part long, batch long, grams binary, counts binary"
_SCORES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_backed_off", pa.int64()), ("log_score", pa.float64()), ("mean_log_score", pa.float64())])


def pack(values: np.ndarray) -> bytes:
    """The length and compressed bytes of an array of unsigned numbers, like bytes together."""
    data = values.view(np.uint8).reshape(len(values), -1).T if len(values) else values
    return len(values).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(data).tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, kind: str) -> np.ndarray:
    size, n = np.dtype(kind).itemsize, int.from_bytes(data[:8], "little")
    if not n:
        return np.zeros(0, dtype=kind)
    raw = np.frombuffer(pa.decompress(data[8:], decompressed_size=n * size, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(kind).reshape(n)


def word_hashes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string column, and the row of each."""
    hashes, rows, base = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for chunk in column.chunks:
        data, offsets = text_buffers(chunk)
        for low, high in text_chunks(offsets):
            part = data[offsets[low] : offsets[high]]
            starts, ends, first = word_bounds(part, offsets[low : high + 1] - offsets[low])
            if len(starts):
                hashes.append(span_hashes(part, starts, ends))
                rows.append(base + low + np.repeat(np.arange(high - low), np.diff(first)))
        base += len(chunk)
    return np.concatenate(hashes), np.concatenate(rows)


def gram_hashes(words: np.ndarray, rows: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 1..order the hash of the k words that end at each word; 0 where the text has fewer."""
    grams = [mix64(words ^ np.uint64(0x5851F42D4C957F2D))]
    start = np.concatenate(([True], rows[1:] != rows[:-1])) if len(rows) else np.zeros(0, bool)
    place = np.arange(len(rows)) - np.maximum.accumulate(np.where(start, np.arange(len(rows)), 0))
    for k in range(2, order + 1):
        longer = np.zeros(len(words), dtype=np.uint64)
        longer[1:] = mix64(grams[-1][:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:] + np.uint64(k))
        longer[place < k - 1] = 0
        grams.append(longer)
    return grams


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(at, weights=np.concatenate([c for _, c in parts]), minlength=len(grams)).astype(np.uint64)


def score_documents(docs: DataFrame, order: int = ORDER, discount: float = DISCOUNT, batch: int = BATCH) -> DataFrame:
    """n_words, n_backed_off (words without a seen n-gram of full order), log_score (the sum of natural
    logarithms) and mean_log_score of each row's whole text.

    The score of a word is count(n-gram) / count(its first n - 1 words) for the longest n-gram that
    occurs outside of the row, times `discount` for each order less, all counts without the row's own; a
    word that occurs nowhere else counts as one occurrence of all words. A null or empty text has no
    words, score 0 and a null mean. Repeated rows are documents of their own; other columns are not read;
    an empty table gives no rows. A batch holds at least one whole text, however long.
    """
    chars = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    parts = max(1, math.ceil(chars / batch))
    key = F.pmod(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), F.lit(parts)).alias("batch")
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), key)

    def grams_of(text: pa.ChunkedArray) -> tuple[list[np.ndarray], np.ndarray]:
        words, rows = word_hashes(text)
        return gram_hashes(words, rows, order), rows

    def request(group: pa.Table) -> pa.Table:
        """The distinct n-grams of a batch with their counts, by partition of the count table."""
        levels, rows = grams_of(group["text"])
        flat = np.concatenate(levels)
        grams, counts = np.unique(flat[flat != 0], return_counts=True)
        grams, counts = np.append(grams, _TOTAL), np.append(counts, len(rows)).astype(np.uint32)
        part = (grams % np.uint64(parts)).astype(np.int64)
        order_of = np.lexsort((grams, part))
        grams, counts, part = grams[order_of], counts[order_of], part[order_of]
        edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
        out: list[tuple] = []
        number = group["batch"][0].as_py()
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            out.append((int(part[a]), number, pack(np.diff(grams[a:b], prepend=np.uint64(0))), pack(counts[a:b])))
        give_back()
        return _messages(out)

    def count(group: pa.Table) -> pa.Table:
        """Total counts of a partition's n-grams, for each batch in the order in which it sent them."""
        sent = []
        for grams, counts in zip(group["grams"].to_pylist(), group["counts"].to_pylist(), strict=True):
            sent.append((np.cumsum(unpack(grams, "<u8"), dtype=np.uint64), unpack(counts, "<u4")))
        grams, totals = _merge(sent)
        names = zip(group["part"].to_pylist(), group["batch"].to_pylist(), sent, strict=True)
        told = _messages([(p, b, b"", pack(totals[np.searchsorted(grams, g)])) for p, b, (g, _) in names])
        give_back()
        return told

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        levels, rows = grams_of(texts["text"])
        flat = np.concatenate(levels)
        grams = np.append(np.unique(flat[flat != 0]), _TOTAL)
        part = (grams % np.uint64(parts)).astype(np.int64)
        totals = np.zeros(len(grams), dtype=np.float64)
        order_of = np.lexsort((grams, part))
        edge = np.searchsorted(part[order_of], np.arange(parts + 1)) if parts < 1 << 20 else None
        for p, counts in zip(answers["part"].to_pylist(), answers["counts"].to_pylist(), strict=True):
            a, b = (edge[p], edge[p + 1]) if edge is not None else np.searchsorted(part[order_of], [p, p + 1])
            totals[order_of[a:b]] = unpack(counts, "<u8")
        n_docs, total = texts.num_rows, totals[-1]
        del flat, part, order_of
        sums, backed = np.zeros(len(rows)), np.zeros(len(rows), dtype=bool)
        open_words, n_words = np.ones(len(rows), dtype=bool), np.bincount(rows, minlength=n_docs)
        at = [np.searchsorted(grams[:-1], level) for level in levels]
        own = []  # for each level, its (row, n-gram) pairs and how often each occurs in its row
        for level, gram in zip(levels, at, strict=True):
            every = np.flatnonzero(level != 0)
            pairs, count = np.unique(rows[every] * np.int64(len(grams)) + gram[every], return_counts=True)
            own.append((pairs, count.astype(np.int32)))

        def others(k: int, i: np.ndarray, word: np.ndarray) -> np.ndarray:
            """Count outside of the row of word i of the k-gram that ends at `word`."""
            pairs, count = own[k - 1]
            gram = at[k - 1][word]
            return totals[gram] - count[np.searchsorted(pairs, rows[i] * np.int64(len(grams)) + gram)]

        for k in range(order, 0, -1):
            i = np.flatnonzero(open_words & (levels[k - 1] != 0))
            other = others(k, i, i)
            context = others(k - 1, i, i - 1) if k > 1 else np.maximum(total - n_words[rows[i]], 1)
            seen = (other > 0) if k > 1 else np.ones(len(i), dtype=bool)
            hit = i[seen]
            sums[hit] = np.log(np.maximum(other[seen], 1) / context[seen]) + (order - k) * math.log(discount)
            backed[hit] = k < order
            open_words[hit] = False
        log_score = np.bincount(rows, weights=sums, minlength=n_docs)
        give_back()
        mean = pa.array(log_score / np.maximum(n_words, 1), mask=n_words == 0)
        return pa.Table.from_arrays(
            [texts["doc_id"], pa.array(n_words), pa.array(np.bincount(rows[backed], minlength=n_docs)), pa.array(log_score), mean], schema=_SCORES
        )

    asked = dealt.groupBy("batch").applyInArrow(request, _MESSAGE)
    told = asked.groupBy("part").applyInArrow(count, _MESSAGE)
    kind = "doc_id long, n_words long, n_backed_off long, log_score double, mean_log_score double"
    return dealt.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(score, kind)


def _messages(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.table({"part": pa.array(columns[0], pa.int64()), "batch": pa.array(columns[1], pa.int64()), "grams": pa.array(columns[2], pa.binary()), "counts": pa.array(columns[3], pa.binary())})


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents`, scored by bigram and unigram counts of all documents."""
    return score_documents(table(spark, sf_dir, "documents"))
