"""Shape learning and keyspace walks against one process, however rows are dealt."""

import json
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lakeward.sources import sampling as P
from lakeward.sources import shapes as S


def letters(n):
    return "".join(chr(97 + int(c)) for c in str(n))


def frame(spark, docs, parts=3):
    return spark.createDataFrame([(i, d if isinstance(d, (str, type(None))) else json.dumps(d)) for i, d in enumerate(docs)], "id long, doc string").repartition(parts)


def paths(spark, docs, shape):
    return Counter(r.path for r in S.flatten_documents(frame(spark, docs), "id", "doc", shape).where("path is not null").collect())


def test_maps_collapse_and_fields_stay(spark):
    docs = [{"name": "x", "address": {"city": "a", "zip": "b"}, "scores": {letters(i): {"won": 1, letters(i + 7): {"deep": 2}}}, "few": {letters(3 * i + k): k for k in range(3)}, "items": [{"sku": "s", "m": {letters(i): i}}] * 2} for i in range(40)]
    for parts in (1, 5):
        shape = S.learn_shape(frame(spark, docs, parts), "doc")
        assert set(shape.dynamic) == {"scores", "few", "items[]\x1fm", "scores\x1f*"}
        assert shape.fields["address"] == {"city", "zip"} and shape.fields["items[]"] == {"sku", "m"}
    got = paths(spark, docs, shape)
    assert got == {"name": 40, "address.city": 40, "address.zip": 40, "scores.*.*": 40, "scores.*.*.deep": 40, "few.*": 120, "items[].sku": 80, "items[].m.*": 80}


def test_a_task_keeps_nothing_below_a_level_of_many_keys(spark):
    docs = [{"by": {letters(i): {"seen": {letters(7 * i): i}, "known": True}}, "t": {"a": 1}} for i in range(2000)]
    for parts in (1, 4):
        rows = S._observed("doc", frame(spark, docs, parts), S.Shape()).collect()
        assert {r.level for r in rows} == {"by", "t"}
        shape = S.learn_shape(frame(spark, docs, parts), "doc")
        assert set(shape.dynamic) == {"by", "by\x1f*\x1fseen"} and shape.fields == {"t": {"a"}, "by\x1f*": {"seen", "known"}}


def test_levels_that_stay_and_unknown_keys(spark):
    docs = [{"a": {f"f{k}": 1 for k in "abcdefghijklmnop"}, "one": {"p": 1, "q": 2, "r": 3}}, {"a": {"fa": 2}}]
    shape = S.learn_shape(frame(spark, docs), "doc")
    assert not shape.dynamic  # sixteen keys, and three of one document alone
    assert paths(spark, [{"a": {"fa": 1, "new": 2}, "b": {"c": 3}, "2024": 5, "x@y": 1}], shape) == {"a.fa": 1, "a.*": 1, "b.*": 1, "*": 2}
    assert paths(spark, [{"a": {"new": 2}}], S.Shape()) == {"a.new": 1}


def test_budgets_and_odd_documents(spark):
    deep = {}
    for _ in range(30):
        deep = {"d": deep, "v": 1}
    docs = [None, "", "no json", "[1, 2]", "3", {"a": list(range(40))}, deep, {"n": None, "t": True, "f": 1.5}, {"rows": [[[7] * 16] * 16] * 16}, {letters(k) + "z": {} for k in range(5000)}]
    rows = S.flatten_documents(frame(spark, docs), "id", "doc", S.Shape()).collect()
    cut = {r.id: r.cut for r in rows if r.cut}
    assert cut == {5: "elements", 6: "depth", 8: "values", 9: "visits"}
    assert {(r.path, r.value) for r in rows if r.id == 7} == {("t", "true"), ("f", "1.5")} and sum(r.id == 8 and r.path is not None for r in rows) == S.MOST_VALUES
    assert [r.value for r in rows if r.id == 4] == ["3"] and sorted(r.value for r in rows if r.id == 3) == ["1", "2"]
    assert S.flatten_documents(frame(spark, docs).where("false"), "id", "doc", S.Shape()).count() == 0 and S.learn_shape(frame(spark, docs).where("false"), "doc") == S.Shape(frozenset(), {})


def test_nested_maps_take_one_reading_of_all_documents(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    docs = [{"by": {letters(i): {"seen": {letters(7 * i): {"at": {letters(5 * i): i}}}}}, "rare": {letters(3 * i + k): k for k in range(3)} if i > 1900 else {}} for i in range(2000)]
    counted = frame(spark, docs, 2).mapInArrow(count, "id long, doc string")
    shape = S.learn_shape(counted, "doc")
    assert set(shape.dynamic) == {"by", "by\x1f*\x1fseen", "by\x1f*\x1fseen\x1f*\x1fat", "rare"} and shape.fields == {"by\x1f*": {"seen"}, "by\x1f*\x1fseen\x1f*": {"at"}}
    assert seen.value <= 3 * len(docs)  # the first ones, all, and all again since `rare` is only told by later ones


def test_documents_of_orders_are_dealt_out(spark):
    from lakeward.plans.source_queries import _documents

    assert _documents(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4


def test_short_and_long_texts_are_walked_alike():
    rng = random.Random(4)

    def value(depth):
        if depth > rng.choice([2, 3, 24]) or rng.random() < 0.3:
            return rng.choice([None, 1, 0, True, 1.5, "s", ""])
        n = rng.choice([0, 1, 2, 3, 18]) if depth < 3 else rng.choice([1, 1, 2])
        return [value(depth + 1) for _ in range(n)] if rng.random() < 0.4 else {rng.choice(["a", "b", "2024", letters(k)]): value(depth + 1) for k in range(n)}

    def walked(doc, shape):
        keys, found, values = set(), [], []
        cut = S.walk(json.dumps(doc), S.Level(shape, frozenset(), {}), keys, found, values)
        return keys, list(zip(found, values)), cut

    pad, cuts = "," * S.MOST_VALUES, set()
    for shape in (S.Shape(), S.Shape(frozenset({"a", "d[]\x1fb"}), {"d": frozenset("ab"), "d[]": frozenset("ab")})):
        for i in range(300):
            doc = {"d": value(0)}
            for _ in range(i % 30):
                doc = {"d": doc} if i % 2 else {"d": [doc]}
            keys, leaves, cut = walked(doc, shape)
            assert walked({**doc, "pad": pad}, shape) == (keys, [*leaves, ("pad", pad)], cut) or cut & {"values", "visits"}
            cuts |= cut
    assert {"depth", "elements"} <= cuts


def test_walk_equals_a_global_sort(spark):
    rng = random.Random(2)
    keys = [(f"user:{i}:mail", "string") for i in range(3000)] + [(f"phone:{i}", "hash") for i in range(40)] + [(f"addressbook:{i}", "hash") for i in range(5)] + [("cfg/mode", "string"), (None, "string"), ("user:1:mail", "string")]
    rng.shuffle(keys)
    got = None
    for parts in (1, 7):
        frame = spark.createDataFrame(keys, "k string, t string").repartition(parts)
        walked = P.keyspace_walk(frame, "k", "t", 8)
        rows = {r.pattern: (r.n, r.families, tuple(r.samples)) for r in walked.collect()}
        assert got in (None, rows)
        got = rows
    assert "WindowGroupLimit" in walked._jdf.queryExecution().toString()
    assert {p: (n, f, len(s)) for p, (n, f, s) in got.items()} == {"user:*:mail": (3001, 1, 8), "*:*": (45, 2, 8), "*/mode": (1, 1, 1)}  # a position collapses for all keys of its length
    hashes = {r.k: r.h for r in frame.where("k is not null").select("k", F.xxhash64(F.lit(0), "k").alias("h")).collect()}
    by = defaultdict(list)
    for k in sorted(hashes, key=lambda k: (hashes[k], k)):
        by[k.split(":")[0]].append(k)
    assert list(got["user:*:mail"][2]) == by["user"][:8]
    assert Counter(k.split(":")[0] for k in got["*:*"][2]) == {"phone": 4, "addressbook": 4} and set(got["*:*"][2]) == {*by["phone"][:4], *by["addressbook"][:4]}
