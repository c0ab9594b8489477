"""Language identification with bit-sliced Bloom filters over letter trigrams.

One array of language masks stands for the Bloom filters of all languages: a probe reads a row of
bits, and the conjunction of a trigram's rows has one bit for every language that holds it. The
per-language popcounts over a text, corrected for the filters' false positives, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeward.llm.common import CHUNK, different, hash_share, materialize, mix64, released, small_batches, table, text_slices

#: At most about so many documents are used to fit the filters; they are chosen by a hash of the id.
FIT_ROWS = 20_000
#: A trigram is kept for a language if it makes up at least this share of it, so at most 50,000 are.
LEAST_SHARE = 2e-5
#: ... and at least this part of its share in the language where it is most common.
LEAST_PART = 0.3
PROBES = 3
UNDETERMINED = "und"
#: Below this share of known trigrams the pipeline takes a text for no language.
LEAST_SCORE = 0.2
_PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
_letters: list[np.ndarray] = []


def letter_codes() -> np.ndarray:
    """For each code point the lower-case letter, or 0 if it is no letter."""
    if not _letters:
        codes = np.zeros(0x110000, dtype=np.uint64)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                codes[i] = ord(low) if len(low) == 1 else i
        _letters.append(codes)
    return _letters[0]


def text_trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the trigrams around each letter (a word's ends are marked), and the row of each."""
    joined = "\n".join(t or "" for t in texts) + "\n"
    codes = letter_codes()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    rows = np.repeat(np.arange(len(texts)), [len(t or "") + 1 for t in texts])
    keep = codes != 0
    keep[1:] |= codes[:-1] != 0
    codes, rows = codes[keep], rows[keep]
    before = np.concatenate((np.zeros(1, np.uint64), codes[:-1]))
    after = np.concatenate((codes[1:], np.zeros(1, np.uint64)))
    at = np.flatnonzero(codes)
    return mix64(before[at] | codes[at] << np.uint64(21) | after[at] << np.uint64(42)), rows[at]


def bounded_parts(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts as they are, or one long text in parts, cut behind the last space of each CHUNK characters
    (where there is none, between letters, whose two trigrams over the cut are then marked as word ends)."""
    text = texts[0] if len(texts) == 1 else None
    if not text or len(text) <= CHUNK:
        yield texts
        return
    low = 0
    while low < len(text):
        high = low + CHUNK
        high = (text.rfind(" ", low, high) + 1 or high) if high < len(text) else high
        yield [text[low:high]]
        low = high


@dataclass
class LanguageFilters:
    languages: list[str]
    masks: np.ndarray  # one bit for each language, in rows of 64 languages
    false_positives: np.ndarray

    @classmethod
    def build(cls, grams: dict[str, np.ndarray]) -> "LanguageFilters":
        languages = sorted(grams)
        most = max((len(g) for g in grams.values()), default=1)
        size = 1 << max(10, (8 * most - 1).bit_length())
        masks = np.zeros((-(-len(languages) // 64), size), dtype=np.uint64)
        for bit, name in enumerate(languages):
            for at in cls._probes(grams[name], size):
                masks[bit // 64, at] |= np.uint64(1 << bit % 64)
        fill = np.array([((masks[b // 64] >> np.uint64(b % 64)) & np.uint64(1)).mean() for b in range(len(languages))])
        return cls(languages, masks, fill**PROBES)

    @staticmethod
    def _probes(hashes: np.ndarray, size: int) -> list[np.ndarray]:
        return [((hashes >> np.uint64(20 * k)) & np.uint64(size - 1)).astype(np.int64) for k in range(PROBES)]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        hits, total = np.zeros((len(self.languages), len(texts))), np.zeros(len(texts))
        for part in bounded_parts(texts):
            hashes, rows = text_trigrams(part)
            held = np.bitwise_and.reduce([self.masks[:, at] for at in self._probes(hashes, self.masks.shape[1])])
            total += np.bincount(rows, minlength=len(texts))
            for b in range(len(self.languages)):
                hits[b] += np.bincount(rows[(held[b // 64] >> np.uint64(b % 64)) & np.uint64(1) == 1], minlength=len(texts))
        false = self.false_positives[:, None]
        corrected = np.clip((hits - total * false) / np.maximum(1 - false, 1e-9), 0, None)
        best = corrected.argmax(axis=0)
        score = np.clip(corrected[best, np.arange(len(texts))] / np.maximum(total, 1), 0, 1)
        return [self.languages[b] if n else UNDETERMINED for b, n in zip(best.tolist(), total.tolist(), strict=True)], score.tolist()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def fit_filters(docs: DataFrame, rows: int = FIT_ROWS) -> LanguageFilters:
    """Filters from the text and lang of at most about `rows` documents that are not held out, chosen by a hash of id and
    text; rows alike in these count once."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    key = (F.lit("language"), F.col("doc_id"), F.col("text"))
    known = known.where(hash_share(rows, different(known, *key), *key)).dropDuplicates()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            found: dict[str, list] = {}
            for low, texts in text_slices(batch.column(1)):
                for part in bounded_parts(texts):
                    hashes, rows_of = text_trigrams(part)
                    for name in set(names[low : low + len(texts)]):
                        mine = hashes[(names[low : low + len(texts)] == name)[rows_of]]
                        found.setdefault(name, []).append(np.unique(mine, return_counts=True))
            for name, parts in found.items():
                grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                times = np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(grams)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams)), pa.array(grams.view(np.int64)), pa.array(times)], names=["lang", "gram", "n"])

    counted = known.select("lang", "text").mapInArrow(released(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = materialize(counted)  # used twice
    common = _with_share(counts).withColumn("most", F.max("share").over(Window.partitionBy("gram")))
    kept = common.where((F.col("share") >= LEAST_SHARE) & (F.col("share") >= LEAST_PART * F.col("most")))
    grams: dict[str, list[int]] = {}
    for r in kept.select("lang", "gram").collect():
        grams.setdefault(r.lang, []).append(r.gram)
    return LanguageFilters.build({k: np.array(sorted(v), dtype=np.int64).view(np.uint64) for k, v in grams.items()})


def _with_share(counts: DataFrame) -> DataFrame:
    """Share of each trigram in its language; the totals, one row for each language, go to every task."""
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(totals), "lang").withColumn("share", F.col("n") / F.col("total")).drop("total")


def predict_languages(docs: DataFrame, filters: LanguageFilters) -> DataFrame:
    """lang_pred and score of each row's whole text.

    A null text or one without letters is `und` with score 0. Ties go to the first language by name.
    Repeated rows and null ids stay; other columns are not read; an empty table gives no rows. A very
    long text is read in parts, whose counts add up.
    """

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, texts in text_slices(batch.column(1)):
                names, scores = filters.predict(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(texts)), pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema=_PREDICTED)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(predict), "doc_id long, lang_pred string, score double")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a known language; the rest go, null and empty texts too.

    Each row is judged by its own text, so repeated rows and ids need no join. Other columns stay as they
    are; an empty table gives no rows. Where no row has a `lang` to learn from, nothing can be rejected,
    and all rows stay.
    """
    small_batches(spark)
    filters = fit_filters(docs)
    if not filters.languages:
        return docs
    names, types = docs.columns, docs.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            good: list[bool] = []
            for _, texts in text_slices(batch.column(at)):
                good += [s >= LEAST_SCORE and p != UNDETERMINED for p, s in zip(*filters.predict(texts), strict=True)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(released(keep), types)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    predicted = predict_languages(docs, fit_filters(docs))
    return predicted.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
