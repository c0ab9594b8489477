"""Merkle manifest of a dataset: a root for each source and one over all, and for each row a proof.

Rows get positions in their source by a range partition, whose tasks are counted and then numbered. Blocks
of ARITY ** LEVELS positions are trees of their own: a recursion returns the digest of each subtree and, while
it unwinds, appends the siblings to the leaves below. The blocks' roots are the leaves of the next such
traversal, until a source has one node left. Proofs go down the same way, block by block, and in the
last pass each row folds its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeward.llm.common import materialize, released, table, text_slices

ARITY = 3
#: Levels of a block's tree: a block has at most 3 ** 7 = 2,187 leaves.
LEVELS = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
Path = list[tuple[str, str]]  # digests before and after one's own, level by level


def hashed(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def depth_of(n: int, arity: int = ARITY) -> int:
    """Levels above n leaves."""
    depth = 0
    while n > 1:
        n, depth = -(-n // arity), depth + 1
    return depth


def block_tree(digests: Sequence[str], levels: int, arity: int = ARITY) -> tuple[str, list[Path]]:
    """The digest `levels` above the leaves, and the path of each leaf to it."""
    paths: list[Path] = [[] for _ in digests]

    def visit(low: int, high: int, level: int) -> str:
        if level == 0:
            return digests[low]
        step = arity ** (level - 1)
        nodes = [visit(at, min(at + step, high), level - 1) for at in range(low, high, step)]
        for i, at in enumerate(range(low, high, step)):
            siblings = ("".join(nodes[:i]), "".join(nodes[i + 1 :]))
            for leaf in range(at, min(at + step, high)):
                paths[leaf].append(siblings)
        return hashed("".join(nodes))

    return visit(0, len(digests), levels), paths


def fold(digest: str, path: Path) -> str:
    """The root that a leaf and its path give."""
    for before, after in path:
        digest = hashed(before + digest + after)
    return digest


def written(path: Path) -> str:
    return "".join(f"{before},{after};" for before, after in path)


def read_path(text: str) -> Path:
    return [tuple(x.split(",")) for x in text.split(";")[:-1]]


def record_digest(values: Sequence[bytes | None]) -> str:
    """Lowercase hex SHA-256 of the values, each `-` if null, else its number of bytes, `:` and the value."""
    digest = hashlib.sha256()
    for value in values:
        digest.update(b"-" if value is None else b"%d:" % len(value))
        if value is not None:
            digest.update(value)
    return digest.hexdigest()


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows with `pos`, from 0 in each `tree` by the order. Rows that are alike in it are interchangeable; the last
    column of the order sorts only rows that are alike in the others.

    The driver gets one row of counts from each partition (and Spark's own sample for the ranges).
    """
    ordered = materialize(rows.repartitionByRange("tree", *(order[:-1] or order)).sortWithinPartitions("tree", *order))
    counted = pa.schema([("part", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("n", pa.int64()), ("several", pa.bool_())])

    def runs(batch: pa.RecordBatch) -> list[tuple[str | None, int]]:
        return [(tree, len(list(group))) for tree, group in groupby(batch.column("tree").to_pylist())]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The partition's first and last tree, the last one's rows, and whether there are several trees."""
        row: dict | None = None
        for batch in batches:
            for tree, n in runs(batch):
                if row is None:
                    row = {"part": TaskContext.get().partitionId(), "first": tree, "last": tree, "n": n, "several": False}
                elif tree == row["last"]:
                    row["n"] += n
                else:
                    row |= {"last": tree, "n": n, "several": True}
        if row:
            yield pa.RecordBatch.from_pylist([row], schema=counted)

    begin: dict[int, int] = {}
    before: tuple[str | None, int] | None = None  # the tree that the partitions so far end with, and its rows
    counts = ordered.select("tree").mapInArrow(released(count), "part long, first string, last string, n long, several boolean").collect()
    for r in sorted(counts, key=lambda r: r.part):
        begin[r.part] = before[1] if before and before[0] == r.first else 0
        before = (r.last, r.n if r.several else begin[r.part] + r.n)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, at = None, -1
        for batch in batches:
            positions: list[int] = []
            for tree, n in runs(batch):
                if at < 0:
                    at = begin[TaskContext.get().partitionId()]
                elif tree != current:
                    at = 0
                positions += range(at, at + n)
                current, at = tree, at + n
            yield batch.append_column("pos", pa.array(positions, pa.int64()))

    return ordered.mapInArrow(released(number), StructType(list(ordered.schema)).add("pos", "long"))


def by_block(rows: DataFrame, visit: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """visit(rows) for each tree and block, its upper row first and the others by position; a task holds one block."""
    dealt = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", F.col("upper").desc(), "pos")
    kinds = {"long": pa.int64(), "string": pa.string()}
    types = pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            made: list[dict] = []
            for (tree, block), group in groupby(batch.to_pylist(), key=lambda r: (r["tree"], r["block"])):
                if held and (tree, block) != (held[0]["tree"], held[0]["block"]):
                    made += visit(held)
                    held = []
                held += group
            yield pa.RecordBatch.from_pylist(made, schema=types)
        if held:
            yield pa.RecordBatch.from_pylist(visit(held), schema=types)

    return dealt.mapInArrow(released(run), schema)


@dataclass(frozen=True)
class Shape:
    """What tasks need to know of the trees."""

    arity: int
    levels: int

    @property
    def size(self) -> int:
        return self.arity**self.levels

    def tree(self, rows: list[dict]) -> tuple[str, list[Path]]:
        """All levels of a block; fewer if it is its whole tree."""
        whole = rows[0]["block"] == 0 and len(rows) < self.size
        return block_tree([r["digest"] for r in rows], depth_of(len(rows), self.arity) if whole else self.levels, self.arity)

    def root(self, rows: list[dict]) -> list[dict]:
        return [{"tree": rows[0]["tree"], "pos": rows[0]["block"], "digest": self.tree(rows)[0]}]


class Forest:
    """Trees of one shape over nodes (tree, pos, digest and other columns), worked on in blocks."""

    def __init__(self, nodes: DataFrame, shape: Shape) -> None:
        self.shape, self.floors = shape, [nodes]
        while len(self.floors) == 1 or not self.floors[-1].where("pos > 0").isEmpty():
            self.floors.append(materialize(by_block(self._blocks(self.floors[-1]), shape.root, "tree string, pos long, digest string")))

    @property
    def roots(self) -> DataFrame:
        return self.floors[-1]

    def _blocks(self, nodes: DataFrame) -> DataFrame:
        return nodes.withColumns({"block": F.floor(F.col("pos") / self.shape.size).cast("long"), "upper": F.lit(False)})

    def unwind(self, tops: DataFrame, visit: Callable[[dict, dict, Path], dict], schema: str) -> DataFrame:
        """visit(upper row, node, path to its block's root) for all nodes of the lowest floor. `tops` has tree, pos, proof,
        subroot and root of the roots; the upper row has those of the node's block."""
        tree_of = self.shape.tree

        def each(call: Callable[[dict, dict, Path], dict]) -> Callable[[list[dict]], list[dict]]:
            return lambda rows: [call(rows[0], r, path) for r, path in zip(rows[1:], tree_of(rows[1:])[1])]

        def onward(upper: dict, node: dict, path: Path) -> dict:
            return {k: node[k] for k in ("tree", "pos")} | {"proof": written(path) + upper["proof"], "subroot": upper["subroot"], "root": upper["root"]}

        for nodes in self.floors[-2:0:-1]:
            tops = materialize(by_block(self._met(nodes, tops), each(onward), "tree string, pos long, proof string, subroot string, root string"))
        return by_block(self._met(self.floors[0], tops), each(visit), schema)

    def _met(self, nodes: DataFrame, tops: DataFrame) -> DataFrame:
        upper = tops.select("tree", F.col("pos").alias("block"), F.lit(True).alias("upper"), "proof", "subroot", "root")
        return self._blocks(nodes).unionByName(upper, allowMissingColumns=True)


def merkle_manifest(leaves: DataFrame, arity: int = ARITY, levels: int = LEVELS, proofs: bool = False) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root (and the proof itself) for leaves with tree, id, digest, probe.

    Leaves ascend by id in their tree (no id first; of one id by digest, then probe), each `arity` nodes have
    one above, a last one fewer, until a tree has one. Trees, by name (null first), are the leaves of
    the tree over all. A proof is the siblings from leaf to root; folded_root is what it makes of the
    probe, a digest that is checked in the leaf's stead. A lone leaf of a lone tree is the root and has no
    siblings. Repeated leaves keep places of their own; no leaves give no rows.
    """
    shape = Shape(arity, levels)
    forest = Forest(numbered(leaves, ["id", "digest", "probe"]), shape)
    names = forest.roots.select(F.lit("").alias("tree"), F.coalesce(F.concat(F.lit("="), "tree"), F.lit("")).alias("name"), "digest")
    above = Forest(numbered(names, ["name"]), shape)
    top = above.roots.select("tree", "pos", F.lit("").alias("proof"), F.lit("").alias("subroot"), F.col("digest").alias("root"))

    def of_tree(upper: dict, node: dict, path: Path) -> dict:
        return {"tree": node["name"][1:] if node["name"] else None, "pos": 0, "proof": written(path) + upper["proof"], "subroot": node["digest"], "root": upper["root"]}

    def of_leaf(upper: dict, node: dict, path: Path) -> dict:
        path = path + read_path(upper["proof"])
        proof = "".join(before + after for before, after in path)
        row = {"id": node["id"], "leaf": node["digest"], "subroot": upper["subroot"], "root": upper["root"], "proof_sha256": hashed(proof), "folded_root": fold(node["probe"], path)}
        return row | {"proof": written(path)} if proofs else row

    tops = materialize(above.unwind(top, of_tree, "tree string, pos long, proof string, subroot string, root string"))
    columns = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    return forest.unwind(tops, of_leaf, columns + ", proof string" if proofs else columns)


def document_leaves(docs: DataFrame, tampered: Column, alter: Callable[[bytes], bytes] = lambda text: text.replace(b"\n", b"")) -> DataFrame:
    """tree (source), id, digest, and as probe the digest of the row with an altered text where `tampered` holds.

    Nulls of any column count as such (a null text is not altered); all other columns of the table are left out of the
    digest. Repeated rows stay; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = [[None if v is None else v.encode() for v in batch.column(i).to_pylist()] for i in range(3, 3 + len(FIELDS) - 1)]
            marked, digests, probes = batch.column(2).to_pylist(), [], []
            for low, texts in text_slices(batch.column(2 + len(FIELDS))):
                for row, text in enumerate(texts, low):
                    values, text = [f[row] for f in fields], None if text is None else text.encode()
                    digests.append(record_digest([*values, text]))
                    probes.append(record_digest([*values, alter(text)]) if marked[row] and text is not None else digests[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.string()), pa.array(probes, pa.string())], names=["tree", "id", "digest", "probe"])

    rows = docs.select(F.col("source").cast("string"), F.col("doc_id").cast("long"), F.coalesce(tampered, F.lit(False)), *[F.col(name).cast("string").alias(f"f_{name}") for name in FIELDS])
    return materialize(rows.mapInArrow(released(run), "tree string, id long, digest string, probe string"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = merkle_manifest(document_leaves(docs, F.crc32(F.col("doc_id").cast("string")) % 2 == 0))
    return made.withColumnRenamed("id", "doc_id").withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle(leaf_levels: int = 14, tree_levels: int = 8) -> str:
    """The same by window functions, level by level, for at most 3 ** 14 rows of a source and 3 ** 8 sources."""

    def tree(name: str, key: str, levels: int) -> list[str]:
        found = []
        for k in range(levels):
            run = f"OVER (PARTITION BY {key}, i // 3 ORDER BY i)"
            c = f"(SELECT *, count(*) OVER (PARTITION BY {key}) AS c FROM {name}{k})"
            near = [f"CASE WHEN c > 1 THEN coalesce({a}(d, {x}) {run}, '') || coalesce({a}(d, {y}) {run}, '') ELSE '' END" for a, x, y in (("lag", 2, 1), ("lead", 1, 2))]
            found.append(f"{name}s{k} AS MATERIALIZED (SELECT {key}, i, c, {near[0]} AS b, {near[1]} AS a FROM {c})")
            found.append(f"{name}{k + 1} AS MATERIALIZED (SELECT {key}, i // 3 AS i, CASE WHEN max(c) = 1 THEN max(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d FROM {c} GROUP BY {key}, i // 3)")
        return found

    def joins(name: str, levels: int, row: str, key: str) -> str:
        return " ".join(f"JOIN {name}s{k} {name}x{k} ON {name}x{k}.{key} IS NOT DISTINCT FROM {row}.{key} AND {name}x{k}.i = {row}.i // {3**k}" for k in range(levels))

    fields = lambda text: " || ".join(f"CASE WHEN {x} IS NULL THEN '-' ELSE CAST(strlen(CAST({x} AS VARCHAR)) AS VARCHAR) || ':' || CAST({x} AS VARCHAR) END" for x in [*FIELDS[:-1], text])
    steps = [f"fx{k}" for k in range(leaf_levels)] + [f"gx{k}" for k in range(tree_levels)]
    byte = "list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, y: xor(v >> 1, 3988292384 * (v & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda z: CAST(ascii(z) AS BIGINT))), lambda c, x: {byte}), 4294967295)"
    rounds = [f"z{k + 1} AS MATERIALIZED (SELECT *, CASE WHEN p{k}.c > 1 THEN sha256(p{k}.b || f{k} || p{k}.a) ELSE f{k} END AS f{k + 1} FROM z{k})" for k in range(len(steps))]
    parts = ", ".join(f"struct_pack(b := {s}.b, a := {s}.a, c := {s}.c) AS p{k}" for k, s in enumerate(steps))
    return f"""
WITH h AS (SELECT doc_id, source, sha256({fields("text")}) AS leaf, sha256({fields("replace(text, chr(10), '')")}) AS other, {crc} % 2 = 0 AS tampered FROM documents),
f AS (SELECT *, CASE WHEN tampered THEN other ELSE leaf END AS probe, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM h),
f0 AS MATERIALIZED (SELECT source, i, leaf AS d FROM f), {", ".join(tree("f", "source", leaf_levels))},
g AS (SELECT source, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS i, 0 AS one, d AS subroot FROM f{leaf_levels}),
g0 AS MATERIALIZED (SELECT one, i, subroot AS d FROM g), {", ".join(tree("g", "one", tree_levels))},
z0 AS MATERIALIZED (SELECT f.doc_id, f.leaf, g.subroot, r.d AS root, f.probe AS f0, {parts} FROM f {joins("f", leaf_levels, "f", "source")}
  JOIN g ON g.source IS NOT DISTINCT FROM f.source {joins("g", tree_levels, "g", "one")} CROSS JOIN g{tree_levels} r), {", ".join(rounds)}
SELECT doc_id, leaf, subroot, root, sha256({" || ".join(f"p{k}.b || p{k}.a" for k in range(len(steps)))}) AS proof_sha256, f{len(steps)} AS folded_root, f{len(steps)} = root AS verified FROM z{len(steps)}
"""


ORACLE_OP13 = _oracle()
