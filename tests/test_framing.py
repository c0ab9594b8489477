"""Byte-range framing against Python's csv rules, whatever the ranges."""

import random
import re

import pytest

from lakeward.sources import framing


def plain_records(text):
    return [r for r in re.findall(r'(?:[^"\n]|"[^"]*(?:"|$))+', text) if r.strip()]


@pytest.mark.parametrize("size", ["64b", "200b", "1k", "64m"])
def test_records_do_not_depend_on_ranges(spark, tmp_path, size):
    rng = random.Random(3)
    texts = []
    for f in range(3):
        rows = []
        for i in range(60):
            field = rng.choice(["plain", '"quoted"', '"a ""b"" c"', '"two\nlines"', '"é\n\n日本\n"', '"' + "long\n" * rng.randrange(60) + '"', "", '"x\n""\ny"'])
            rows.append(f"{f}-{i},{field},z")
        texts.append("\n".join(rows) + ("\n" if f else ""))
        (tmp_path / f"log{f}.csv").write_text(texts[-1])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = framing.csv_records(spark, str(tmp_path)).collect()
        ranges = framing.range_lines(spark, str(tmp_path)).select("file", "range").distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert ranges > 30 if size == "64b" else ranges >= 3
    for f, text in enumerate(texts):
        mine = sorted((r.range, r.place, r.record) for r in got if r.file.endswith(f"log{f}.csv"))
        assert [r for _, _, r in mine] == plain_records(text)


def test_open_quotes_blank_lines_and_long_records(spark, tmp_path):
    (tmp_path / "a").write_text('x,"never closed\nline\n' * 1)
    (tmp_path / "b").write_text("\n \n\n")
    (tmp_path / "c").write_text('"' + "y" * (framing.MOST_BYTES + 5) + '"\nshort\r\n')
    (tmp_path / "d").write_text("")
    got = {(r.file[-1], r.record[:9], r.oversized) for r in framing.csv_records(spark, str(tmp_path)).collect()}
    assert got == {("a", 'x,"never ', False), ("c", '"' + "y" * 8, True), ("c", "short\r", False)}
    assert sorted(r.record for r in framing.line_records(spark, str(tmp_path / "c")).select("record").collect())[1] == "short"
    assert framing.line_records(spark, str(tmp_path / "b"), keep_empty=True).count() == 3


@pytest.mark.parametrize("size", ["60b", "64m"])
def test_records_behind_headers(spark, tmp_path, size):
    rng = random.Random(9)
    texts = []
    for f in range(2):
        records = [f"== {f}-{i}" + "".join(f"\nbody {i} {k}" * rng.choice([1, 1, 9]) for k in range(rng.randrange(4))) for i in range(40)]
        texts.append(records)
        (tmp_path / f"t{f}").write_text(("lost\nlines\n" if f else "") + "\n".join(records) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = framing.header_records(spark, str(tmp_path), "^== ").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    for f, records in enumerate(texts):
        assert [r for *_, r in sorted((r.range, r.place, r.record) for r in got if r.file.endswith(f"t{f}"))] == records


def test_lines_stay_where_they_are_read(spark, tmp_path, monkeypatch):
    """Whatever Spark knows of sizes, lines are not shuffled and sorted to meet the one row of their range."""
    (tmp_path / "a.txt").write_text("== 1\na\n== 2\n" * 50)
    plans, settled = [], framing.settled
    monkeypatch.setattr(framing, "settled", lambda f: (plans.append(f._jdf.queryExecution().executedPlan().toString()), settled(f))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        records = [r.record for r in framing.header_records(spark, str(tmp_path), "^== ").collect()]
        framing.csv_records(spark, str(tmp_path)).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [p for p in plans if "Join" in p]
    assert len(joins) == 2 and all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in joins)
    assert sorted(records) == ["== 1\na"] * 50 + ["== 2"] * 50
