"""Strict policy documents, samples by key ranges and by hashes."""

import pytest
from pyspark.sql import functions as F

from lakeward.operators import discovery as V
from lakeward.operators import policies as P
from lakeward.sources import sampling as S


def test_right_conditions_pass():
    finding = {"classifiers": ["email"], "engines": ["redis"], "targets": ["t"], "objects": ["Crm.*"], "min_confidence": 1, "min_match_ratio": 0.5, "min_matched": 10_000}
    event = {"actions": ["read"], "principals": ["ana"], "signals": ["signature.*", "volume.large_result"], "min_rows": 0, "min_score": 1.5, "anomaly": False, "hours": [22, 6]}
    assert P.checked_conditions(finding, P.FINDING_FIELDS) is finding and P.checked_conditions(event, P.EVENT_FIELDS) is event and P.checked_conditions({}, P.EVENT_FIELDS) == {}


@pytest.mark.parametrize(
    ("conditions", "field"),
    [
        ([], "conditions"), (None, "conditions"), ({1: 2}, "conditions"), ({"min_rows": 1}, "unknown"), ({"classifiers": []}, "classifiers"), ({"classifiers": ["emial"]}, "classifiers"), ({"classifiers": "email"}, "classifiers"),
        ({"engines": ["redis", "redis"]}, "engines"), ({"targets": [""]}, "targets"), ({"targets": [None]}, "targets"), ({"objects": ["x" * 257]}, "objects"), ({"min_confidence": 1.01}, "min_confidence"), ({"min_confidence": True}, "min_confidence"),
        ({"min_confidence": float("nan")}, "min_confidence"), ({"min_confidence": None}, "min_confidence"), ({"min_matched": 2.5}, "min_matched"), ({"min_matched": -1}, "min_matched"), ({"targets": [f"t{i}" for i in range(101)]}, "targets"),
    ],
)
def test_wrong_conditions_are_refused(conditions, field):
    with pytest.raises(P.PolicyError, match=field):
        P.checked_conditions(conditions, P.FINDING_FIELDS)


@pytest.mark.parametrize("conditions", [{"hours": [1]}, {"hours": [1, 24]}, {"anomaly": 1}, {"signals": ["Volume.*"]}, {"signals": ["volume.*.x"]}, {"actions": ["select"]}, {"min_rows": 1 << 60}])
def test_wrong_event_conditions_are_refused(conditions):
    with pytest.raises(P.PolicyError, match=next(iter(conditions))):
        P.checked_conditions(conditions, P.EVENT_FIELDS)


def test_actions():
    incident, notify = {"type": "create_incident", "severity": "high"}, {"type": "notify", "channel": "ops"}
    assert P.checked_actions([incident, notify]) == [incident, notify]
    for wrong in ([], [notify], [incident, incident], [incident, notify, notify], [{**incident, "x": 1}], [{**incident, "severity": "huge"}], [incident, {"type": "notify", "channel": "Ops!"}], [incident, {"type": "mail"}], "x", [incident] + [{"type": "notify", "channel": f"c{i}"} for i in range(11)]):
        with pytest.raises(P.PolicyError, match="actions"):
            P.checked_actions(wrong)


def test_key_ranges_reach_the_scan_and_wrap(spark, tmp_path):
    spark.range(0, 200_000).withColumn("v", F.col("id") % 7).repartitionByRange(20, "id").sortWithinPartitions("id").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    wrapped = 0
    for seed in range(12):
        some = S.key_range_sample(table, "id", 500, seed)
        ids = sorted(r.id for r in some.select("id").collect())
        assert len(ids) == 1500 and ids == sorted(r.id for r in S.key_range_sample(table, "id", 500, seed).select("id").collect())
        gaps = [b - a for a, b in zip(ids, ids[1:]) if b - a > 1]
        wrapped += len(gaps)
        assert len(gaps) <= 1 and (not gaps or (ids[0], ids[-1]) == (0, 199_999))
        assert "PushedFilters: [" in (plan := some._jdf.queryExecution().toString()) and "(id," in plan.split("PushedFilters: [", 1)[1].split("]")[0]
    sparse = table.where("id < 10 or id > 190000")
    assert S.key_range_sample(sparse, "id", 500, 3).count() >= 500
    assert S.key_range_sample(table.limit(100), "id", 500).count() == 100 and S.key_range_sample(table.where("false"), "id", 5).count() == 0
    assert any(S.key_range_sample(table, "id", 500, s).agg(F.max("id") - F.min("id")).first()[0] > 1500 for s in range(200)) or wrapped


def test_a_sample_is_that_of_a_global_sort(spark):
    rows = spark.range(40_000).withColumn("v", F.lit("x")).repartition(7)
    digest = F.md5(F.col("id").cast("string"))
    least = {r.id for r in rows.orderBy(digest).limit(1000).collect()}
    assert {r.id for r in V.sampled(rows, ["id"], 1000).collect()} == least
    assert V.sampled(rows, ["id"], 40_000).count() == 40_000 == V.sampled(rows, ["id"], 10**6).count()
    one = rows.withColumn("k", F.when(F.col("id") < 39_990, 1).otherwise(F.col("id")))  # nearly all rows have one key
    assert V.sampled(one, ["k"], 100).count() in (39_990 + k for k in range(-39_990, 11))


def test_engines_sample_in_their_own_ways(spark):
    cases = spark.createDataFrame([(e, n) for e in (*S.METHODS, "other") for n in (None, 50, 150, 5_000, 9_999, 10_000, 10**9)], "engine string, n long")
    got = {(r.engine, r.n): r.m for r in cases.select("engine", "n", S.sample_method(F.col("engine"), F.col("n"), 100).alias("m")).collect()}
    assert {got[e, None] for e in S.METHODS} == {"first"} == {got["other", n] for n in (50, 10**9)} and {e: got[e, 10**9] for e in S.METHODS} == S.METHODS
    assert [got["mongodb", n] for n in (50, 150, 5_000)] == ["first", "first", "hash"] and [got["sqlite", n] for n in (9_999, 10_000)] == ["first", "range"]
    table = spark.range(50_000).withColumn("v", F.lit("x"))
    taken = {e: {r.id for r in S.engine_sample(table, e, "id", 100, 5).collect()} for e in ("postgresql", "mysql", "sqlite", "mongodb")}
    assert len(taken["mysql"]) == len(taken["mongodb"]) == len(taken["postgresql"]) == 100 and len(taken["sqlite"]) == 300
    assert taken["mongodb"] == {r.id for r in S.engine_sample(table.repartition(7), "mongodb", "id", 100, 5).collect()} != {r.id for r in S.engine_sample(table, "mongodb", "id", 100, 6).collect()}
    low = min(taken["sqlite"])
    assert taken["sqlite"] == set(range(low, low + 300)) or {0, 49_999} <= taken["sqlite"]


def test_column_statistics_need_no_sort(spark):
    """A task holds a row for each column and classifier, not its values; what is equal in all values is still told."""
    data = {"one": ["to a@x.org"] * 5, "two": ["a@x.org, b@x.org"] * 5, "last": ["a@x.org"] * 4 + ["b@x.org"], "few": ["a@x.org"] * 2, "none": ["a", "n/a"]}
    values = spark.createDataFrame([("t", f, v) for f, vs in data.items() for v in vs], "object string, field string, value string")
    stats = V.column_statistics(V.scanned(values, ("email", "card_number")))
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Sort" not in plan
    alike = {r.field: (r.least_code_0 == r.greatest_code_0, r.least_code_1 == r.greatest_code_1) for r in stats.where("matched > 0").collect()}
    assert alike == {"one": (True, True), "two": (False, False), "last": (False, False), "few": (True, True)}
    assert {r.field for r in V.findings(values, ("email", "card_number")).collect()} == {"two", "last", "few"}
