"""Streams against the batch operators, on late and repeated rows; sinks through kills; mergeable sketches."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakeward.operators import audit as A
from lakeward.operators import heavy as H
from lakeward.streaming import correlate as K
from lakeward.streaming import exactly_once as X

EVENT = "event_id long, ts timestamp, token string, principal string, address string, kind string"


def events(spark, rows):
    made = spark.createDataFrame(rows, "event_id long, s double, token string, principal string, address string, kind string")
    return made.withColumn("ts", F.timestamp_micros((1_767_000_000_000_000 + F.col("s") * 1_000_000).cast("long"))).select(*[c.split()[0] for c in EVENT.split(", ")])


def fed(spark, rows, closing, folder, parts):
    """Rows in `parts` files by turn, read one file a batch, and then rows that move the watermark past all of them."""
    for some in [*(rows[k::parts] for k in range(parts)), *([c] for c in closing)]:
        events(spark, some).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(folder)


def ran(spark, stream, tmp_path, name):
    out = str(tmp_path / f"out-{name}")
    X.write_once(stream, out, str(tmp_path / f"mark-{name}")).awaitTermination(180)
    return X.read_committed(spark, out, stream.schema)


@pytest.fixture
def tokens():
    rng = random.Random(4)
    rows = [(i, rng.randrange(900) / 2, f"t{rng.randrange(12)}", f"u{rng.randrange(30)}", f"a{rng.randrange(3)}", rng.choice(["ask", "answer"])) for i in range(400)]
    rng.shuffle(rows)
    return rows


def test_correlation_stream_equals_batch(spark, tmp_path, tokens):
    closing = [(10_000 + k, 5000.0 + 2000 * k, "end", "u", "a", kind) for k in range(2) for kind in ("ask", "answer")]
    asked = F.col("kind") == "ask"
    batch = A.correlated(events(spark, tokens).select("event_id", "ts", "token", "kind"), ["token"], asked, 5)
    expected = {r.event_id: r.request_id for r in batch.collect()}
    got = ran(spark, K.correlated_stream(fed(spark, tokens, closing, str(tmp_path / "in"), 3), ["token"], asked), tmp_path, "answers").where("event_id < 10000").collect()
    assert {r.event_id: r.request_id for r in got} == expected and len(got) == len(expected) and None in expected.values()
    answered = {(t, s) for _, s, t, _, _, kind in tokens if kind == "answer"}
    alone = {i for i, s, t, _, _, kind in tokens if kind == "ask" and not any((t, s + d / 2) in answered for d in range(11))}
    stream = K.unanswered_stream(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), ["token"], asked)
    assert {r.event_id for r in ran(spark, stream, tmp_path, "alone").where("event_id < 10000").collect()} == alone != set()


def test_failures_stream_equals_batch(spark, tmp_path, tokens):
    rows = [(i, s * 6, None, None if i % 17 == 0 else p, a, k) for i, s, _, p, a, k in tokens]
    closing = [(10_000 + k, 20_000.0 + 5000 * k, None, "u", "end", "x") for k in range(2)]
    expected = {r.event_id: r.principals for r in A.failed_login_windows(events(spark, rows), "address", "principal").collect()}
    got = ran(spark, K.sliding_failures(fed(spark, rows + rows[::7], closing, str(tmp_path / "in"), 4), "address", "principal", lateness="3 hours"), tmp_path, "f").where("event_id < 10000").collect()
    assert {r.event_id: r.different for r in got} == expected and len(got) == len(rows)
    times = {i: (s, a) for i, s, _, _, a, _ in rows}
    for r in got:
        s, a = times[r.event_id]
        assert r.failures == sum(a == b and s - 600 < t <= s for t, b in times.values())


def test_batches_are_there_once(spark, tmp_path):
    source, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    rows = [(i, float(i), "t", "u", "a", "x") for i in range(60)]
    stream = lambda: X.once(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(source), ["event_id"])
    for k in range(3):
        events(spark, rows[k * 20 : k * 20 + 20] + rows[:5]).coalesce(1).write.mode("append").parquet(source)
    for fail_at in (0, 1, 1, 2):  # killed between the rows and their commit, again and again
        with pytest.raises(Exception, match="stopped between"):
            X.write_once(stream(), out, mark, fail_at).awaitTermination(180)
    X.write_once(stream(), out, mark).awaitTermination(180)
    got = [r.event_id for r in X.read_committed(spark, out, stream().schema).collect()]
    assert sorted(got) == list(range(60))
    listed = {r.batch: (r.content, r.rows) for r in X.commits(spark, out).collect()}
    batch = X.read_committed(spark, out, stream().schema).limit(7)
    first = min(listed)
    assert X.commit_batch(batch, first, out) is False and X.commits(spark, out).count() == len(listed)
    assert X.content_hash(batch) == X.content_hash(batch.orderBy(F.desc("event_id"))) != X.content_hash(batch.limit(6))
    assert X.read_committed(spark, str(tmp_path / "none"), stream().schema).count() == 0


def test_space_saving_bounds(spark):
    rng = random.Random(1)
    names = [f"n{min(int(rng.paretovariate(0.9)), 400)}" for _ in range(6000)]
    true = Counter(names)
    for order in range(3):
        parts = [H.SpaceSaving(50) for _ in range(4)]
        for i, n in enumerate(rng.sample(names, len(names))):
            parts[i % 4].add(n, 1)
        whole = H.SpaceSaving(50)
        for p in rng.sample(parts, 4):
            whole.merge(((n, c, e) for n, (c, e) in p.counts.items()), p.floor)
        for n, (c, e) in whole.counts.items():
            assert c - e <= true[n] <= c
        assert all(n in whole.counts for n, k in true.items() if k > 4 * len(names) / 50)
    rows = spark.createDataFrame([("p", n, 1) for n in names] + [("q", None, 2), ("q", "x", 3)], "p string, name string, k int").repartition(3)
    got = {(r.p, r.name): (r.n, r.error) for r in H.heavy_groups(rows, "p", "name", "k", 500).collect()}
    assert got == {**{("p", n): (k, 0) for n, k in true.items()}, ("q", "-"): (2, 0), ("q", "x"): (3, 0)}
    few = H.heavy_groups(rows, "p", "name", "k", 20).where("p = 'p'").collect()
    assert len(few) == 20 and all(r.n - r.error <= true[r.name] <= r.n for r in few)
    assert H.heavy_groups(rows.where("false"), "p", "name", "k", 5).count() == 0


def test_bounded_distinct_sets(spark):
    rows = spark.createDataFrame([("few", str(i % 7)) for i in range(200)] + [("many", str(i % 5000)) for i in range(10_000)] + [("one", "x")] * 9 + [("none", None)], "g string, v string").repartition(6)
    got = {r.g: r for r in H.bounded_distinct(rows, ["g"], F.col("v"), 256).collect()}
    assert set(got) == {"few", "many", "one"} and (got["few"].distinct, got["few"].exact) == (7, True) and got["one"].distinct == 1
    assert not got["many"].exact and abs(got["many"].distinct - 5000) < 5000 * 0.2 and len(got["many"]["values"]) == 256
    halves = [H.bounded_distinct(rows.where(f"pmod(hash(v), 2) = {k}"), ["g"], F.col("v"), 256) for k in (0, 1)]
    for a, b in (halves, halves[::-1]):
        assert {r.g: (r.distinct, r.exact, list(r["values"])) for r in H.merged_distinct(a, b, ["g"], 256).collect()} == {g: (r.distinct, r.exact, list(r["values"])) for g, r in got.items()}
