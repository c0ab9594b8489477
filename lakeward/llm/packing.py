"""Sum-of-squares online packing of tokenised documents into fixed windows.

Each scan partition packs its own rows, so nothing is shuffled and a lost task is simply read and
packed again. A document longer than a window is cut into full windows; what is left is placed by
the sum-of-squares rule over an array that counts the open windows of each fill level. A level is
some tokens wide, so that windows often reach the highest one; the few tokens that such a window lacks come
from the head of a later document. When a partition ends, the least filled windows are cut up to fill
the others, and the last one is cut at powers of two, so nothing is padded.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward.llm.common import CHUNK, released, small_batches, table, text_slices
from lakeward.llm.merges import MergeTable

#: A level of a window is one part in so many of it (16 tokens of 4096).
WINDOW, LEVELS = 4096, 256
#: Windows of the highest level that wait for a long document (which is cut anyway) to fill them.
MOST_WAITING = 64
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
# Texts with other characters than ASCII and the letters U+00C0 to U+00FF, or with an apostrophe
# (which may begin a contraction), are left to the library.
_UNCOMMON = re.compile("[^\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]|'")
# Byte classes of the tokenizer's word pattern: white space, letters, single digits, all else.
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_tokenizers: dict[str, "WordTokenizer"] = {}


class WordTokenizer:
    """Ids of whole texts; equal words of a batch are merged once.

    Texts of ASCII and common Latin letters are cut into the words of the tokenizer's own pattern by
    byte classes, and their new words merged together; any other text goes to the library.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the executor's tasks share its cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model = whole["model"]
        # Texts that spell an added token (in whatever case, as texts are lower-cased) are left to the library.
        added = [re.escape(t["content"]) for t in whole.get("added_tokens", []) if t["content"]]
        self.special = re.compile("|".join(added), re.IGNORECASE) if added else None
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"]
        pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pairs.setdefault((vocabulary[left], vocabulary[right]), (vocabulary[left + right], rank))
        self.merges = MergeTable(pairs)
        byte_symbol = _byte_symbols()
        self.inner = np.array([vocabulary[c] for c in byte_symbol], dtype=np.int32)
        self.last = np.array([vocabulary[c + suffix] for c in byte_symbol], dtype=np.int32)

    def encode_words(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that lie end to end in `data`, and how many each has."""
        if not len(lengths):
            return np.zeros(0, np.int32), lengths
        symbols, ends = self.inner[data], np.cumsum(lengths) - 1
        symbols[ends] = self.last[data[ends]]
        return self.merges.rounds(symbols, lengths)

    def encode_common(self, texts: list[str]) -> list[bytes]:
        encoded = [t.encode() for t in texts]
        data = np.frombuffer(b"".join(encoded), dtype=np.uint8)
        if not len(data):
            return [b""] * len(texts)
        upper = (data >= 0x41) & (data <= 0x5A)
        upper[1:] |= (data[:-1] == 0xC3) & (data[1:] <= 0x9E)
        data = data + (upper.astype(np.uint8) << 5)
        row_end = np.cumsum([len(e) for e in encoded])
        kind = _KIND[data]
        first = np.ones(len(data), dtype=bool)
        first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        first[row_end[row_end < len(data)]] = True
        first &= kind != _SPACE
        starts = np.flatnonzero(first)
        inside = kind != _SPACE
        packed = data[inside]
        place = np.cumsum(inside)
        offsets = np.append(place[starts] - 1, len(packed)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()
        unique, index = words.dictionary, words.indices.to_numpy()
        at = np.frombuffer(unique.buffers()[1], dtype=np.int64)[: len(unique) + 1]
        flat = np.frombuffer(unique.buffers()[2], dtype=np.uint8)[: at[-1]] if len(unique) else packed[:0]
        ids, sizes = self.encode_words(flat, np.diff(at))
        first_id = np.cumsum(sizes) - sizes
        count = sizes[index]
        end = np.cumsum(count)
        out = ids[np.repeat(first_id[index] - (end - count), count) + np.arange(end[-1] if len(end) else 0)].astype("<u4")
        # Ids before the end of each text.
        cut = np.append(0, np.append(0, end)[np.searchsorted(starts, row_end)])
        return [out[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        common = [i for i, t in enumerate(texts) if t and not _UNCOMMON.search(t) and not (self.special and self.special.search(t))]
        out = [b""] * len(texts)
        for i, ids in zip(common, self.encode_common([texts[i] for i in common]), strict=True):
            out[i] = ids
        for i in set(range(len(texts))).difference(common):
            if texts[i]:
                out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, dtype="<u4").tobytes()
        return out


def _byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def tokenizer_of(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


class Window:
    """Pieces (key, start, ids, total) that lie end to end, and how many ids they have."""

    __slots__ = ("filled", "pieces")

    def __init__(self) -> None:
        self.pieces, self.filled = [], 0

    def add(self, piece: tuple, most: int) -> tuple | None:
        """Takes up to `most` ids of a piece; what is left of it."""
        key, start, ids, total = piece
        take = ids[: 4 * most]
        self.pieces.append((key, start, take, total))
        self.filled += len(take) // 4
        return (key, start + most, ids[4 * most :], total) if len(take) < len(ids) else None


class SumOfSquaresPacker:
    """Places items in windows of `size`; `emit(pieces)` gets each full window.

    `levels[h]` counts the open windows filled to h units. An item
    goes where the sum of squared counts of partially filled windows grows least. `placed` counts the
    ids that lie where the rule (or the cut of a long document into whole windows) put them, `moved`
    those that were cut off to fill other windows.
    """

    def __init__(self, size: int, emit, unit: int | None = None) -> None:
        self.size, self.unit, self.emit = size, unit or max(1, size // LEVELS), emit
        self.top = -(-size // self.unit)
        self.levels = np.zeros(self.top + 1, dtype=np.int64)
        self.open: dict[int, list[Window]] = {}
        self.waiting: list[Window] = []  # windows of the highest level that are not quite full
        self.placed = self.moved = 0

    def add(self, key, ids: bytes, total: int) -> None:
        n, rest = len(ids) // 4, (key, 0, ids, total)
        while rest and self.waiting and (n >= self.size or len(self.waiting) > MOST_WAITING):
            rest = self._fill(self.waiting[-1], rest)
            if self.waiting[-1].filled == self.size:
                self.emit(self.waiting.pop().pieces)
        while rest and len(rest[2]) // 4 >= self.size:
            window = Window()
            rest = window.add(rest, self.size)
            self.placed += self.size
            self.emit(window.pieces)
        if rest and rest[2]:
            self.placed += len(rest[2]) // 4
            self._place(rest, len(rest[2]) // 4)

    def _fill(self, window: Window, piece: tuple) -> tuple | None:
        before = window.filled
        rest = window.add(piece, self.size - before)
        self.moved += window.filled - before
        return rest

    def _place(self, piece: tuple, length: int) -> None:
        at = self._best(-(-length // self.unit))
        window = self.open[at].pop() if at else Window()
        self.levels[at] -= at > 0
        window.add(piece, length)
        level = -(-window.filled // self.unit)
        if window.filled == self.size:
            self.emit(window.pieces)
        elif level == self.top:
            self.waiting.append(window)
        else:
            self.levels[level] += 1
            self.open.setdefault(level, []).append(window)

    def _best(self, length: int) -> int:
        """The fill level (0: a new window) whose use leaves the least sum of squared counts."""
        room = self.top - length
        here, there = self.levels[: room + 1], self.levels[length:].copy()
        growth = 2 * (there - here) + 2
        growth[room] = 1 - 2 * here[room]
        growth[here == 0] = np.iinfo(np.int64).max
        growth[0] = 2 * there[0] + 1
        return int(growth[::-1].argmin() * -1 + room)

    def close(self) -> None:
        """Fill the fullest windows with cuts of the least filled; the rest goes to windows of a power of two."""
        left = [*self.waiting, *(w for level in sorted(self.open, reverse=True) for w in self.open[level])]
        self.waiting, self.open, self.levels[:] = [], {}, 0
        low, high, donor = 0, len(left) - 1, []
        while low < high or (donor and low <= high):
            if not donor:
                donor, high = left[high].pieces, high - 1
                self.placed -= sum(len(p[2]) // 4 for p in donor)
            while donor and left[low].filled < self.size:
                rest = self._fill(left[low], donor.pop())
                if rest:
                    donor.append(rest)
            if left[low].filled == self.size:
                self.emit(left[low].pieces)
                low += 1
        window = donor or (left[low].pieces if low <= high else [])
        filled = sum(len(p[2]) // 4 for p in window)
        self.moved += filled if donor else 0
        while filled:
            part, rest, goal = Window(), [], 1 << (filled.bit_length() - 1)
            for piece in window:
                over = part.add(piece, goal - part.filled) if part.filled < goal else piece
                if over:
                    rest.append(over)
            self.emit(part.pieces)
            window, filled = rest, filled - goal


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = 2) -> DataFrame:
    """One row per piece of each document, with the sequence and offset that hold it.

    A null or empty text is the end id alone. Repeated rows are packed as often as they occur; other
    columns, whatever their names, are not read. An empty table gives no rows. A null id stays null.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, tail = tokenizer_of(tokenizer_path), int(end_id).to_bytes(4, "little")
        sequence, rows = TaskContext.get().partitionId() << 32, []

        def emit(pieces: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for key, start, ids, total in pieces:
                rows.append((key, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset))
                offset += len(ids) // 4
            sequence += 1

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, schema=_ARROW)

        packer = SumOfSquaresPacker(window, emit)
        for batch in batches:
            for low, texts in text_slices(batch.column(1), 8 * CHUNK):
                for key, ids in zip(batch.column(0).slice(low, len(texts)).to_pylist(), tokenizer.encode_batch(texts), strict=True):
                    ids += tail
                    packer.add(key, ids, len(ids) // 4)
                if rows:
                    yield flush()
        packer.close()
        yield flush()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(released(pack), PIECES)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences of all rows (see `pack_documents`)."""
    import public_tokenizers

    small_batches(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_stage(spark, table(spark, sf_dir, "documents"), sf_dir)
