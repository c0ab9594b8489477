"""Shapes of nested documents: which keys are fields, and which are data.

A document store's map keyed by data (`{"ana": 3, "joe": 5}`) would make a field of each key. The objects of all documents
are observed as pairs of level and key; sums over pairs are a monoid, so tasks add up their own and Spark adds up
the tasks'. A level is dynamic if it has many keys, or only keys of single documents; its keys become `*`, which
gives the levels below it new paths: a few rounds settle nested maps.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Collection, Iterable, Iterator, Set
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of a document's walk, and when a level is dynamic.
DEPTH, ELEMENTS, MOST_VALUES, MOST_VISITS = 20, 16, 512, 4096
STATIC_KEYS, SINGLETON_KEYS, TRACKED_KEYS, ROUNDS = 16, 3, 64, 4
#: Documents that are looked at before all are read, and leaves of a batch.
FIRST_DOCUMENTS, _LEAVES = 256, 1 << 16
_SEPARATOR, INDEX, WILD = "\x1f", "[]", "*"
_STEP = re.compile("\x1f|\\[\\]")
_DATA = re.compile(r"^(?:[0-9]+|[0-9a-fA-F]{8,}|.*[0-9]{4,}.*|.*@.*|[0-9]+\..*)$", re.S)


@dataclass(frozen=True)
class Shape:
    """Levels whose keys are data, and the keys of those whose keys are fields (None: not learned, all are kept)."""

    dynamic: frozenset[str] = frozenset()
    fields: dict[str, frozenset[str]] | None = field(default=None, hash=False)

    def step(self, level: str, depth: int, key: str) -> str:
        """The key's name in a path. Keys at the top are fields; keys that look like data never are."""
        if depth and (level in self.dynamic or (self.fields is not None and key not in self.fields.get(level, ()))):
            return WILD
        return WILD if _DATA.match(key) else key


class Level(dict):
    """A level under a shape: its name, its path, and the levels below it by their keys, which are made as they are met. What is
    below a level in `full` is not counted, whatever its keys are; `settled` has the keys of levels that are not counted any more."""

    __slots__ = ("shape", "full", "settled", "name", "path", "depth", "counted", "silent", "each", "other", "enough")

    def __init__(self, shape: Shape, full: Set[str] = frozenset(), settled: dict[str, set[str]] | None = None, name: str = "", depth: int = 0, silent: bool = False) -> None:
        self.shape, self.full, self.settled, self.name, self.depth, self.silent = shape, full, settled, name, depth, silent
        self.path, self.counted = name.replace(_SEPARATOR, "."), settled is not None and depth > 0 and not silent and name not in shape.dynamic and name not in full
        self.each = self.other = None
        self.enough = settled.setdefault(name, set()) if self.counted else set()

    def _below(self, name: str) -> Level:
        return Level(self.shape, self.full, self.settled, name, self.depth + 1, self.silent or self.name in self.full)

    def __missing__(self, key: str) -> Level:
        step = WILD if self.silent else self.shape.step(self.name, self.depth, key)
        name = f"{self.name}{_SEPARATOR}{step}" if self.name else step
        if step != WILD:
            self[key] = self._below(name)
            return self[key]
        if self.other is None:
            self.other = self._below(name)
        return self.other

    def note(self, found: Collection[str], keys: set[tuple[str, str]]) -> None:
        if self.counted and not self.enough.issuperset(found):
            keys.update([(self.name, key) for key in found])

    def elements(self) -> Level:
        if self.each is None:
            self.each = self._below(self.name + INDEX)
        return self.each


def parsed(text: str | None) -> object:
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


def walk(text: str | None, top: Level, keys: set[tuple[str, str]], paths: list[str], values: list) -> set[str]:
    """Adds a document's keys at counted levels to `keys`, and its leaves in their order to `paths` and `values`; tells why
    it was not walked whole. Depth first; arrays end after ELEMENTS, objects below DEPTH are left out, and all ends after
    MOST_VALUES values or MOST_VISITS elements. A text with few commas and brackets cannot have so many."""
    cut: set[str] = set()
    document = parsed(text)
    if type(document) in (dict, list) and text.count(",") + text.count("{") + text.count("[") < MOST_VALUES:
        _walk_small(document, top, keys, paths, values, cut)
        return cut
    visits, left = MOST_VISITS, MOST_VALUES
    waiting = [(top, document)]
    while waiting:
        level, value = waiting.pop()
        kind = type(value)
        if (kind is dict or kind is list) and level.depth > DEPTH:
            cut.add("depth")
        elif kind is dict:
            level.note(list(value)[:visits], keys)
            waiting += [(level[key], value[key]) for key in list(value)[:visits][::-1]]
        elif kind is list:
            if len(value) > ELEMENTS:
                cut.add("elements")
            each = level.elements()
            waiting += [(each, v) for v in value[ELEMENTS - 1 :: -1]]
        elif value is not None:
            if left == 0:
                cut.add("values")
                break
            left -= 1
            paths.append(level.path)
            values.append(value)
        visits -= 1
        if visits == 0:
            cut.add("visits")
            break
    return cut


def _walk_small(document: dict | list, level: Level, keys: set[tuple[str, str]], paths: list[str], values: list, cut: set[str]) -> None:
    if level.depth > DEPTH:
        cut.add("depth")
    elif type(document) is dict:
        level.note(document, keys)
        for key, value in document.items():
            below, kind = level[key], type(value)
            if kind is dict or kind is list:
                _walk_small(value, below, keys, paths, values, cut)
            elif value is not None:
                paths.append(below.path)
                values.append(value)
    else:
        if len(document) > ELEMENTS:
            cut.add("elements")
        each = level.elements()
        for value in document[:ELEMENTS]:
            kind = type(value)
            if kind is dict or kind is list:
                _walk_small(value, each, keys, paths, values, cut)
            elif value is not None:
                paths.append(each.path)
                values.append(value)


def _tallied(batches: Iterable[list[str | None]], shape: Shape) -> dict[str, Counter]:
    """For each level the documents with each of its keys (None: with the level), where 2 stands for more. Of a level with more than
    TRACKED_KEYS keys only that is kept (key \x00), and of the levels below it nothing."""
    counts: dict[str, Counter] = {}
    full: set[str] = set()  # uppermost levels with too many keys
    for texts in batches:
        settled = {level: {key for key, n in known.items() if n > 1} for level, known in counts.items()}
        top = Level(shape, full, settled)  # of this batch, so that it does not grow with the names of all documents
        for text in texts:
            pairs: set[tuple[str, str]] = set()
            walk(text, top, pairs, [], [])
            if not pairs:
                continue
            for level, key in pairs | {(x, None) for x, _ in pairs}:
                known = counts.setdefault(level, Counter())
                if key not in known and len(known) > TRACKED_KEYS:
                    known["\0"] = 1
                elif known[key] < 2:
                    known[key] += 1
                    if known[key] == 2:
                        settled[level].add(key)
            reached = {x for x, _ in pairs if "\0" in counts[x]}
            if reached:
                for level in reached:
                    counts[level] = Counter({"\0": 1})
                full |= reached
                for level in [x for x in counts if any(up in full for up in _above(x))]:
                    del counts[level]
                full = {x for x in full if x in counts}
                top = Level(shape, full, settled)
    return counts


def _observed(column: str, docs: DataFrame, shape: Shape) -> DataFrame:
    """level, key (null: the level itself), n (documents; each task tells 2 of more), over all documents. A task that has met more than TRACKED_KEYS keys of a
    level knows that it is dynamic and says only so (key \x00); of the levels below, which get new paths, it keeps nothing."""

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _tallied((batch.column(0).to_pylist() for batch in batches), shape)
        rows = [(level, key, n) for level, known in counts.items() for key, n in known.items()]
        columns = zip(*rows) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], names=["level", "key", "n"])

    pairs = docs.select(column).mapInArrow(observe, "level string, key string, n long")
    return pairs.groupBy("level", "key").agg(F.sum("n").alias("n"))


def _dynamic_at_least(column: str, docs: DataFrame) -> frozenset[str]:
    """Levels that have many keys in the first documents, and so in all of them, whatever follows."""

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [batch.column(0).to_pylist() for batch in batches]
        dynamic: frozenset[str] = frozenset()
        for _ in range(ROUNDS):
            dynamic |= _uppermost([level for level, known in _tallied(texts, Shape(dynamic)).items() if "\0" in known or len(known) > STATIC_KEYS + 1])
        yield pa.RecordBatch.from_arrays([pa.array(sorted(dynamic), pa.string())], names=["level"])

    return frozenset(r.level for r in docs.select(column).limit(FIRST_DOCUMENTS).mapInArrow(observe, "level string").collect())


def learn_shape(docs: DataFrame, column: str) -> Shape:
    """The shape of JSON documents in a column. The driver gets the uppermost dynamic levels of each round, and at the
    end the static levels, which have at most STATIC_KEYS keys each. Levels below ROUNDS dynamic ones are not learned.

    Each round reads all documents. Levels that have many keys among the first ones are known before that, so the first round is most
    often the last; what the others tell beyond that takes rounds of its own."""
    dynamic = _dynamic_at_least(column, docs)
    for number in range(ROUNDS):
        counted = _observed(column, docs, Shape(dynamic))
        key = F.col("key").isNotNull()
        levels = counted.groupBy("level").agg(
            F.max(F.when(~key, F.col("n"))).alias("documents"), F.count_if(key).alias("keys"), F.max(F.when(key, F.col("n"))).alias("most"), F.bool_or(F.coalesce(F.col("key") == "\0", F.lit(False))).alias("many"),
            F.slice(F.sort_array(F.collect_set("key")), 1, STATIC_KEYS + 1).alias("names"),
        )
        is_dynamic = F.col("many") | (F.col("keys") > STATIC_KEYS) | ((F.col("documents") >= 2) & (F.col("keys") >= SINGLETON_KEYS) & (F.col("most") == 1))
        marked = levels.withColumn("dynamic", is_dynamic).persist()  # both questions are about one reading
        try:
            learned = lambda level: sum(up in dynamic for up in _above(level)) < ROUNDS
            found = _uppermost([r.level for r in marked.where("dynamic").select("level").collect() if learned(r.level)])
            if not found or number + 1 == ROUNDS:
                static = marked.where("not dynamic").select("level", "names").collect()
                fields = {r.level: frozenset(r.names) for r in static if learned(r.level) and not _is_below(r.level, found)}
                return Shape(_without(dynamic, found) | found, fields)
        finally:
            marked.unpersist()
        dynamic = _without(dynamic, found) | found  # what is below gets a new path in the next round
    return Shape(dynamic)


def _without(levels: frozenset[str], found: frozenset[str]) -> frozenset[str]:
    return frozenset(x for x in levels if not _is_below(x, found))


def _above(level: str) -> list[str]:
    """The levels that a level is below of."""
    return [level[: m.start()] for m in _STEP.finditer(level) if m.start()]


def _is_below(level: str, levels: frozenset[str]) -> bool:
    return any(level.startswith((x + _SEPARATOR, x + INDEX)) for x in levels)


def _uppermost(levels: list[str]) -> frozenset[str]:
    every = set(levels)
    return frozenset(x for x in every if not any(up in every for up in _above(x)))


def flatten_documents(docs: DataFrame, key: str, column: str, shape: Shape) -> DataFrame:
    """key, path, value of each leaf of JSON documents (nulls left out), and one row with a null path and the reasons in
    `cut` for each document that was not walked whole. Text that is no JSON has no leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            top, texts, begin = Level(shape), batch.column(1).to_pylist(), 0
            while begin < len(texts):
                at, paths, values, cuts = [], [], [], {}
                for i in range(begin, len(texts)):
                    cut = walk(texts[i], top, set(), paths, values)
                    if cut:
                        cuts[len(paths)] = ",".join(sorted(cut))
                        paths.append(None)
                        values.append(None)
                    at += [i] * (len(paths) - len(at))
                    if len(paths) >= _LEAVES:
                        break
                begin = i + 1
                reasons = [None] * len(paths)
                for k, reason in cuts.items():
                    reasons[k] = reason
                columns = [paths, [v if type(v) is str else str(v) if type(v) is int else None if v is None else json.dumps(v) for v in values], reasons]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.string()) for c in columns)], names=[key, "path", "value", "cut"])

    return docs.select(key, column).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, path string, value string, cut string")
