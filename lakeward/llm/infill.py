"""Fill-in-middle transformation over ropes.

A text is a balanced tree whose leaves are slices that cache how many units and code points they hold.
Two splits at unit ranks give prefix, middle and suffix; the output is a concatenation of subtrees and
sentinels. The way back builds a rope of the output and splits it at the sentinels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeward.llm.common import released, table, text_slices

#: Units of a leaf.
LEAF = 1024
PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True, slots=True)
class Leaf:
    """Code points `low` to `high` of a text. `ends` are where its units end; None if each code point is one."""

    text: str
    low: int
    high: int
    ends: tuple[int, ...] | None = None

    @property
    def points(self) -> int:
        return self.high - self.low

    @property
    def units(self) -> int:
        return self.points if self.ends is None else len(self.ends)

    def split(self, rank: int) -> tuple[Leaf, Leaf]:
        at = self.low + rank if self.ends is None else self.ends[rank - 1]
        first, rest = (None, None) if self.ends is None else (self.ends[:rank], self.ends[rank:])
        return Leaf(self.text, self.low, at, first), Leaf(self.text, at, self.high, rest)


@dataclass(frozen=True, slots=True)
class Node:
    left: Rope
    right: Rope
    units: int
    points: int


Rope = Leaf | Node
EMPTY = Leaf("", 0, 0)


def concat(*ropes: Rope) -> Rope:
    whole: Rope = EMPTY
    for rope in ropes:
        if not whole.points:
            whole = rope
        elif rope.points:
            whole = Node(whole, rope, whole.units + rope.units, whole.points + rope.points)
    return whole


def build(text: str, unit: re.Pattern | None = None) -> Rope:
    """A balanced rope. Units are code points, or what `unit` matches, each with what stands before it; what
    follows the last match is a unit too."""
    if unit is None:
        row: list[Rope] = [Leaf(text, low, min(low + LEAF, len(text))) for low in range(0, len(text), LEAF)]
    else:
        ends = [m.end() for m in unit.finditer(text) if m.end() > m.start()]
        if text and (not ends or ends[-1] < len(text)):
            ends.append(len(text))
        parts = [tuple(ends[low : low + LEAF]) for low in range(0, len(ends), LEAF)]
        row = [Leaf(text, low, part[-1], part) for low, part in zip([0, *(part[-1] for part in parts)], parts)]
    while len(row) > 1:
        row = [concat(*row[i : i + 2]) for i in range(0, len(row), 2)]
    return row[0] if row else EMPTY


def split(rope: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first `rank` units, and the rest."""
    if rank <= 0:
        return EMPTY, rope
    if rank >= rope.units:
        return rope, EMPTY
    if isinstance(rope, Leaf):
        return rope.split(rank)
    if rank <= rope.left.units:
        first, rest = split(rope.left, rank)
        return first, concat(rest, rope.right)
    first, rest = split(rope.right, rank - rope.left.units)
    return concat(rope.left, first), rest


def flatten(rope: Rope) -> str:
    parts, waiting = [], [rope]
    while waiting:
        top = waiting.pop()
        if isinstance(top, Leaf):
            parts.append(top.text[top.low : top.high])
        else:
            waiting += (top.right, top.left)
    return "".join(parts)


def sentinel(text: str) -> Leaf:
    """A sentinel counts as one unit."""
    return Leaf(text, 0, len(text), (len(text),))


def holds_sentinel(text: str, sentinels: Sequence[str] = SENTINELS) -> bool:
    return any(s in text for s in sentinels)


def rearrange(rope: Rope, low: int, high: int, form: str, sentinels: Sequence[str] = SENTINELS) -> tuple[Rope, int, int]:
    """The output's rope, and the code points of prefix and middle. low, high: unit ranks."""
    rest, tail = split(rope, high)
    head, body = split(rest, low)
    p, s, m = map(sentinel, sentinels)
    parts = (p, head, s, tail, m, body) if form == PSM else (s, tail, p, head, m, body)
    return concat(*parts), head.points, body.points


def restore(output: str, form: str, sentinels: Sequence[str] = SENTINELS) -> str:
    """The text that gave the output. No sentinel occurs in a rearranged text, nor across its parts' ends, so the
    first of each is the one that was put there."""
    if form == PLAIN:
        return output
    p, s, m = sentinels
    one, two = (p, s) if form == PSM else (s, p)
    rope, at_two, at_middle = build(output), output.index(two), output.index(m)
    rest, body = split(rope, at_middle)
    first, second = split(rest, at_two)
    first, second, body = (split(part, len(mark))[1] for part, mark in ((first, one), (second, two), (body, m)))
    return flatten(concat(first, body, second) if form == PSM else concat(second, body, first))


def draws(doc_id: Column, seed: int = 1, n: int = 4) -> list[Column]:
    """n numbers below 2^32 from the hash of the seed and an id (no id: of the seed alone)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"_h{k + 1}") for k in range(n)]


def transform_documents(
    docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, sentinels: Sequence[str] = SENTINELS, unit: str | None = None
) -> DataFrame:
    """doc_id, n_units, form, prefix_chars, middle_chars and output of each row's whole text.

    Both cuts, the form and its order come from a hash of seed and id, so rows of one id and length are cut
    alike, and rows without id as well. A null or empty text, and one that holds a sentinel, stays plain, with
    null prefix_chars and middle_chars. Rows are independent: repeated ones stay, other columns are not read,
    an empty table gives no rows, and a long text is a deeper tree in its own task.
    """
    pattern = re.compile(unit) if unit else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = list(zip(*(batch.column(k).to_pylist() for k in range(2, 6))))
            for low, texts in text_slices(batch.column(1)):
                rows = []
                for text, (h1, h2, h3, h4) in zip(texts, numbers[low : low + len(texts)]):
                    text = text or ""
                    rope = build(text, pattern)
                    n, row = rope.units, (PLAIN, None, None, text)
                    if text and h3 % 100 < 100 - plain_percent and not holds_sentinel(text, sentinels):
                        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
                        form = SPM if h4 % 100 < spm_percent else PSM
                        made, prefix, middle = rearrange(rope, a, b, form, sentinels)
                        row = (form, prefix, middle, flatten(made))
                    rows.append((n, *row))
                columns = zip(*rows) if rows else [[]] * 5
                arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(texts)), *arrays], names=["doc_id", "n_units", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *draws(F.col("doc_id"), seed))
    return rows.mapInArrow(released(run), "doc_id long, n_units long, form string, prefix_chars long, middle_chars long, output string")


def restore_documents(rows: DataFrame, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """The rows with `text`, rebuilt from `output` and `form` alone, in place of `output`.

    A null output or form gives a null text. Other columns stay as they are; repeated rows stay; an empty
    table gives no rows.
    """
    names = rows.columns
    kept = [n for n in names if n not in ("output", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = batch.column(names.index("form")).to_pylist()
            for low, outputs in text_slices(batch.column(names.index("output"))):
                texts = [None if o is None or f is None else restore(o, f, sentinels) for o, f in zip(outputs, forms[low : low + len(outputs)])]
                columns = [batch.column(names.index(k)).slice(low, len(outputs)) for k in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=[*kept, "text"])

    return rows.mapInArrow(released(run), StructType([rows.schema[n] for n in kept]).add("text", "string"))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform_documents(table(spark, sf_dir, "documents"))
    digested = made.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), "output")
    return restore_documents(digested).withColumn("restored_sha256", F.sha2("text", 256)).drop("text")


ORACLE_OP11 = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
d AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS c2,
  CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS p, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS q FROM t),
f AS (SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b, CASE WHEN n = 0 OR p >= 90 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
  THEN 'plain' WHEN q < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
x AS (SELECT *, substring(text, 1, a) AS pre, substring(text, a + 1, b - a) AS mid, substring(text, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM x
"""
