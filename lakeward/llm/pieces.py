"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Segments that no merge can cross (a run of spaces with the characters after it, or a line break) are
encoded once for each Python worker. All new segments of a batch lie in one flat symbol array; each
round finds the least pair rank of every segment, merges its leftmost non-overlapping occurrences at
once, and drops segments that have no pair left (merges.py). The rounds of a segment grow with its
length, so one of thousands of characters is merged from a queue instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward.llm.common import CHUNK, released, table, text_slices
from lakeward.llm.merges import MergeTable

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_CACHE_SEGMENTS, _CACHE_BYTES = 700_000, 1 << 24
_FOREIGN = 1 << 24  # symbols from here on are characters without a piece
_codecs: dict[str, "PieceCodec"] = {}


class PieceCodec:
    """Encoder and decoder of one model file; `pairs` maps two adjacent symbols to the piece they form."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        text = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        of = {text[i]: i for i in plain}
        self.byte_id = np.zeros(256, dtype=np.int32)
        self.decoded: list[bytes] = [b""] * size
        for i in range(size):
            if model.is_byte(i):
                self.byte_id[int(text[i][1:-1], 16)] = i
                self.decoded[i] = bytes([int(text[i][1:-1], 16)])
        for i in plain:
            self.decoded[i] = text[i].replace("▁", " ").encode()
        if any("▁" in t.lstrip("▁") or "\n" in t for t in of):
            raise ValueError("a piece of this model crosses the segments that the encoder cuts at")
        self.end_id = model.eos_id()
        # Symbols: the pieces, then characters that occur in pieces only.
        symbol = dict(of)
        for t in list(of):
            for ch in t:
                symbol.setdefault(ch, size + len(symbol) - len(of))
        self.of_char = np.arange(0x110000, dtype=np.int32) + _FOREIGN
        for t, i in symbol.items():
            if len(t) == 1:
                self.of_char[ord(t)] = i
        self.text_of_extra = {i: t for t, i in symbol.items() if i >= size}
        self.size = size
        order = {s: r for r, s in enumerate(sorted({model.get_score(i) for i in plain}, reverse=True))}
        pairs = {}
        for t, i in of.items():
            for k in range(1, len(t)):
                a, b = symbol.get(t[:k]), symbol.get(t[k:])
                if a is not None and b is not None:
                    pairs[(a, b)] = (i, order[model.get_score(i)])
        self.table = MergeTable(pairs)
        self.decimal = [b"%d " % i for i in range(size)]
        self.decimal_length = np.array([len(d) for d in self.decimal])
        self.decoded_length = np.array([len(d) for d in self.decoded])
        self.cache: dict[bytes, tuple[bytes, bytes]] = {}
        self.cached = 0  # bytes of segments

    def learn(self, segments: list[bytes]) -> None:
        self.cached += sum(map(len, segments))
        for low in range(0, len(segments), 50_000):
            part = segments[low : low + 50_000]
            flat = np.frombuffer(b"".join(part).decode().replace(" ", "▁").encode("utf-32-le"), dtype="<u4")
            data = np.frombuffer(b"".join(part), dtype=np.uint8)
            ends = np.cumsum([len(s) for s in part])
            chars = np.cumsum((data & 0xC0) != 0x80)[ends - 1]
            ids, sizes = self.table.rounds(self.of_char[flat], np.diff(chars, prepend=0))
            if ids.max() >= self.size:
                ids, sizes = self._with_bytes(ids, sizes)
            listed = ids.tolist()
            decimal = b"".join([self.decimal[i] for i in listed])
            decoded = b"".join([self.decoded[i] for i in listed])
            last = np.cumsum(sizes) - 1
            d1 = np.cumsum(self.decimal_length[ids])[last].tolist()
            d2 = np.cumsum(self.decoded_length[ids])[last].tolist()
            self.cache.update(
                (s, (decimal[a:b], decoded[c:d]))
                for s, a, b, c, d in zip(part, [0, *d1[:-1]], d1, [0, *d2[:-1]], d2, strict=True)
            )

    def _with_bytes(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become their UTF-8 bytes' pieces."""
        spelled = [self._bytes_of(i) for i in ids.tolist()]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        return np.array([b for x in spelled for b in x]), np.bincount(owner, weights=[len(x) for x in spelled], minlength=len(sizes)).astype(np.int64)

    def _bytes_of(self, symbol: int) -> list[int]:
        if symbol < self.size:
            return [symbol]
        ch = chr(symbol - _FOREIGN) if symbol >= _FOREIGN else self.text_of_extra[symbol]
        return self.byte_id[list(ch.encode())].tolist()

    def encode_batch(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """For each text, its decimal ids (each with a space after it) and its decoded bytes."""
        if len(self.cache) > _CACHE_SEGMENTS or self.cached > _CACHE_BYTES:
            self.cache.clear()
            self.cached = 0
        encoded = [(" " + t).replace("▁", " ").encode() if t else b"" for t in texts]
        data = np.frombuffer(b"".join(encoded), dtype=np.uint8)
        row_end = np.cumsum([len(e) for e in encoded])
        if not len(data):
            return iter([(b"", b"")] * len(texts))
        space, line = data == 0x20, data == 0x0A
        first = line.copy()
        first[0] = True
        first[1:] |= line[:-1] | (space[1:] & ~space[:-1])
        first[row_end[row_end < len(data)]] = True
        offsets = np.append(np.flatnonzero(first), len(data)).astype(np.int64)
        segments = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        unique = _listed(segments.dictionary)
        self.learn([s for s in unique if s not in self.cache])
        decimal, decoded = zip(*map(self.cache.__getitem__, unique), strict=True)
        index = segments.indices.to_numpy().tolist()
        cut = [0, *np.searchsorted(offsets[:-1], row_end).tolist()]
        return (
            (b"".join([decimal[i] for i in index[a:b]]), b"".join([decoded[i] for i in index[a:b]]))
            for a, b in zip(cut[:-1], cut[1:], strict=True)
        )

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in next(self.encode_batch([text]))[0].split()]

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD, the leading space of the encoder goes."""
        data = b"".join([self.decoded[i] for i in ids])
        return (data[1:] if data[:1] == b" " else data).decode(errors="replace")


def _listed(column: pa.Array) -> list[bytes]:
    data = column.buffers()[2].to_pybytes()
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[: len(column) + 1].tolist()
    return [data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def codec_of(path: str) -> PieceCodec:
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token count and digests of ids (end id last) and of the decoded text, one row per input row.

    A null or empty text has the end id alone and decodes to an empty text. Repeated rows and ids stay
    as they are, other columns are not read, and an empty table gives no rows. A segment without white
    space is merged whole, however long.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model_path)
        end = str(codec.end_id).encode()
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for _, texts in text_slices(batch.column(1), 8 * CHUNK):
                for ids, decoded in codec.encode_batch(texts):
                    ids += end
                    out[0].append(ids.count(b" ") + 1)
                    out[1].append(hashlib.sha256(ids).hexdigest())
                    out[2].append(hashlib.sha256(decoded[1:] if decoded[:1] == b" " else decoded).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)] if out[0] else [pa.array([], f.type) for f in _SCHEMA], schema=_SCHEMA)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return source.mapInArrow(released(encode), ENCODED)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
