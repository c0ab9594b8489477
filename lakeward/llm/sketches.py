"""Invertible Bloom lookup sketches of a text's paragraphs, in built-in functions only.

A paragraph is a run of at most 16 words in one of the first four lines of a text, or of at most 64
words in a later line, so that short texts have several; its digest is a 64-bit hash.
A sketch has three rows of cells; a digest is added to one cell of each row (count, xor of digests,
xor of checks). Sketches are linear: the difference of two holds only the digests in which the texts
differ, and peeling single-digest cells recovers these. A difference too large for the stored sketch
is taken again with larger ones: digests are dealt to sub-sketches of about six, and a sub-sketch
that does not peel is built anew with other cell hashes, four and sixteen times as wide.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeward.llm.common import shuffle_partitions, table
from lakeward.llm.quality import bind

ROWS = 3
WIDTH = 8
FINE_LINES = 4
FINE_UNIT, UNIT = ("(?:[^\\s]++[^\\S\\n]*+){1,%d}+" % n for n in (16, 64))
_CELL = "struct<n:int,k:bigint,c:int>"


def paragraph_digests(text: Column) -> Column:
    """Distinct digests of the paragraphs (a set, as array<long>)."""
    cut = lambda lines, unit: F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(unit), F.lit(0))))
    first = lambda x: cut(F.slice(x, 1, FINE_LINES), FINE_UNIT)
    units = bind(F.split(text, "\n"), lambda x: F.concat(first(x), cut(F.slice(x, F.lit(FINE_LINES + 1), F.size(x)), UNIT)))
    return F.array_distinct(F.transform(units, lambda u: F.xxhash64(u)))


def _placed(digest: Column, sign: Column, width: int, salt: int) -> Column:
    """A digest with its sign, check and cell of each row; a row's cell is 16 bits of a second hash."""

    def place(h: Column) -> Column:
        cells = [F.shiftrightunsigned(h, 16 * r).bitwiseAND(F.lit(width - 1)).cast("int").alias(f"at{r}") for r in range(ROWS)]
        return F.struct(digest.alias("k"), sign.alias("n"), F.hash(digest).alias("c"), *cells)

    return bind(F.xxhash64(digest, F.lit(salt)), place)


def _added(cell: Column, elements: Column, sign: int = 1) -> Column:
    """A cell after the elements are added to it (or, with sign -1, taken from it)."""
    return F.aggregate(
        elements, cell, lambda s, e: F.struct((s["n"] + e["n"] * sign).alias("n"), s["k"].bitwiseXOR(e["k"]).alias("k"), s["c"].bitwiseXOR(e["c"]).alias("c"))
    )


def _cells(elements: Column, width: int) -> Column:
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).alias("c")).cast(_CELL)
    slots = F.array(*[F.lit(i) for i in range(width)])
    row = lambda r: F.transform(slots, lambda at: _added(empty, F.filter(elements, lambda e: e[f"at{r}"] == at)))
    return F.concat(*[row(r) for r in range(ROWS)])


def build_sketch(digests: Column, width: int = WIDTH, salt: int = 0) -> Column:
    """Array of ROWS * width cells; `width` is a power of two, at most 65536."""
    return bind(F.transform(digests, lambda d: _placed(d, F.lit(1), width, salt)), lambda e: _cells(e, width))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(
        a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["c"].bitwiseXOR(y["c"]).alias("c"))
    )


def _occupied(c: Column) -> Column:
    return (c["n"] != 0) | (c["k"] != 0)


def peel(cells: Column, width: int = WIDTH, salt: int = 0, rounds: int = 4) -> Column:
    """Digests that a difference holds (array<long>), or null if something is left after `rounds`."""
    state_type = f"struct<cells:array<{_CELL}>,found:array<bigint>>"

    def step(state: Column) -> Column:
        pure = F.filter(state["cells"], lambda c: ((c["n"] == 1) | (c["n"] == -1)) & (F.hash(c["k"]) == c["c"]))
        single = F.array_distinct(F.transform(pure, lambda c: F.struct(c["k"].alias("k"), c["n"].alias("n"))))

        def without(elements: Column) -> Column:
            def row(r: int) -> Column:
                cells_of_row = F.slice(state["cells"], r * width + 1, width)
                return F.transform(cells_of_row, lambda c, at: _added(c, F.filter(elements, lambda e: e[f"at{r}"] == at), -1))

            return F.struct(F.concat(*map(row, range(ROWS))).alias("cells"), F.concat(state["found"], F.transform(elements, lambda e: e["k"])).alias("found")).cast(state_type)

        placed = F.transform(single, lambda e: _placed(e["k"], e["n"], width, salt))
        return F.when(~F.exists(state["cells"], _occupied), state).otherwise(bind(placed, without))

    start = F.struct(cells.alias("cells"), F.array().cast("array<bigint>").alias("found")).cast(state_type)
    end = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda s, _: step(s))
    return bind(end, lambda s: F.when(~F.exists(s["cells"], _occupied), s["found"]))


def _sub_difference(a: Column, b: Column) -> Column:
    """Difference of two small digest sets by sketches of growing width; exact at the very last."""

    def attempt(width: int, salt: int) -> Column:
        signed = F.concat(F.transform(a, lambda d: _placed(d, F.lit(1), width, salt)), F.transform(b, lambda d: _placed(d, F.lit(-1), width, salt)))
        return bind(signed, lambda e: peel(_cells(e, width), width, salt))

    return F.coalesce(attempt(WIDTH, 1), attempt(4 * WIDTH, 2), attempt(16 * WIDTH, 3), F.concat(F.array_except(a, b), F.array_except(b, a)))


def retried_difference(a: Column, b: Column) -> Column:
    """Differing digests by sub-sketches of about six digests each, dealt in two steps."""
    wide = F.greatest(F.lit(1), F.ceil(F.sqrt((F.size(a) + F.size(b)) / 6.0))).cast("long")

    def dealt(pair: Column, parts: Column, shift: int, body) -> Column:
        part = lambda v, i: F.filter(v, lambda d: F.pmod(F.shiftrightunsigned(d, shift), parts) == i)
        each = lambda i: bind(F.struct(part(pair["a"], i).alias("a"), part(pair["b"], i).alias("b")), body)
        return F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), each))

    pair = F.struct(a.alias("a"), b.alias("b"))
    return bind(wide, lambda w: bind(pair, lambda p: dealt(p, w, 7, lambda q: dealt(q, w, 33, lambda s: _sub_difference(s["a"], s["b"])))))


def difference(digests_a: Column, sketch_a: Column, digests_b: Column, sketch_b: Column) -> Column:
    """Differing digests: from the stored sketches, or retried larger where these do not peel."""
    promising = lambda d: F.size(F.filter(d, _occupied)) <= ROWS * WIDTH * 3 // 4
    small = bind(subtract(sketch_a, sketch_b), lambda d: F.when(promising(d), peel(d)))
    return F.coalesce(small, retried_difference(digests_a, digests_b))


def likeness(size_a: Column, size_b: Column, differing: Column) -> Column:
    """Share of the larger set that both have; 1 for two empty sets."""
    shared = (size_a + size_b - differing) / 2
    return F.when(F.greatest(size_a, size_b) == 0, F.lit(1.0)).otherwise(shared / F.greatest(size_a, size_b)).cast("double")


def sketch_text(sketch: Column) -> Column:
    """Hexadecimal form: count, digests and checks of each cell."""
    byte = lambda v, n: F.lpad(F.hex(v), n, "0")
    cells = F.transform(sketch, lambda c: F.concat(byte(c["n"].bitwiseAND(0xFFFF), 4), byte(c["k"], 16), byte(c["c"].cast("long").bitwiseAND(0xFFFFFFFF), 8)))
    return F.lower(F.array_join(cells, ""))


def with_next_text(docs: DataFrame, key: str, carried: list[str], buckets: int) -> DataFrame:
    """Each row with the `carried` columns of the next one in order of key (the last gets the first's).

    Rows are dealt to ranges of keys; the first row of a range also goes to the range before, so no
    range needs another and there is one shuffle. Only `buckets` quantiles of the key reach the driver.
    """
    shares = [i / buckets for i in range(buckets)]
    bounds = docs.agg(F.percentile_approx(key, F.array(*map(F.lit, shares)), F.lit(20 * buckets)).alias("b"), F.min(key).alias("low")).first()
    if bounds["low"] is None:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in carried])
    edges = sorted({bounds["low"], *bounds["b"]})
    listed = F.array(*[F.lit(e).cast("long") for e in edges])
    last = len(edges) - 1
    # Which range a key is in: first among every step-th edge, then among the edges from there.
    step = math.isqrt(last) + 1
    below = lambda among: F.size(F.filter(among, lambda e: e <= F.col(key))) - 1
    coarse = F.array(*[F.lit(e).cast("long") for e in edges[::step]])
    rows = docs.withColumn("_mine", below(coarse) * step)
    rows = rows.withColumn("_mine", F.col("_mine") + below(F.slice(listed, F.col("_mine") + 1, F.lit(step))))
    at_edge = F.get(listed, F.col("_mine")) == F.col(key)
    copy = F.struct(F.when(F.col("_mine") == 0, last).otherwise(F.col("_mine") - 1).alias("bucket"), F.lit(True).alias("copy"), (F.col("_mine") == 0).alias("wraps"))
    own = F.struct(F.col("_mine").alias("bucket"), F.lit(False).alias("copy"), F.lit(False).alias("wraps"))
    rows = rows.withColumn("_place", F.explode(F.when(at_edge, F.array(own, copy)).otherwise(F.array(own))))
    order = Window.partitionBy("_bucket").orderBy("_wraps", key, "_tie")
    rows = rows.select("*", F.col("_place.bucket").alias("_bucket"), F.col("_place.copy").alias("_copy"), F.col("_place.wraps").alias("_wraps"))
    rows = rows.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried]).where(~F.col("_copy"))
    return rows.drop("_mine", "_place", "_bucket", "_copy", "_wraps")


def fingerprint_versions(docs: DataFrame) -> DataFrame:
    """Sketches of each text and of its edited text (see `op6_fingerprints`), and their likeness.

    Rows are ordered by doc_id (a null id counts as the lowest), ties by the text's hash; a null or
    empty text has an empty sketch, and two empty ones are alike (1). The next row of the last is the
    first, so a single row is its own next. Repeated rows follow one another. Other columns are not
    read; an empty table gives no rows. Paragraphs count once however often a text repeats them.
    """
    lowest = -(1 << 63)
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)))
    source = source.withColumn("_tie", F.xxhash64("text")).withColumn("digests", paragraph_digests(F.col("text")))
    buckets = max(48, 4 * shuffle_partitions(docs.sparkSession))
    rows = with_next_text(source, "_key", ["text", "digests"], buckets)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half)))
    rows = rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "digests",
        "next_digests",
        paragraph_digests(F.col("edited")).alias("edited_digests"),
    )
    for name in ("digests", "next_digests", "edited_digests"):
        rows = rows.withColumn(f"{name}_sketch", build_sketch(F.col(name)))
    near = lambda other: likeness(F.size("digests"), F.size(other), F.size(difference(F.col("digests"), F.col("digests_sketch"), F.col(other), F.col(f"{other}_sketch"))))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        sketch_text(F.col("digests_sketch")).alias("fingerprint"),
        sketch_text(F.col("edited_digests_sketch")).alias("edited_fingerprint"),
        near("edited_digests").alias("near_edited"),
        near("next_digests").alias("near_next"),
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text against its edited text: its last half replaced by the beginning of the next document."""
    return fingerprint_versions(table(spark, sf_dir, "documents"))
