"""The data source against Spark's own readers, and logs followed through rotation, truncation and restarts."""

import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lakeward.plans import source_queries
from lakeward.sources import connector as C
from lakeward.sources import tail as T
from lakeward.streaming.audit_stream import write_idempotent

SF = "/root/testdata/sf0.001"


@pytest.fixture
def target(tmp_path):
    rows = 40_000
    pq.write_table(pa.table({"id": range(rows), "mail": [f"u{i}@x.org" for i in range(rows)], "n": [None if i % 3 else i for i in range(rows)]}), tmp_path / "people.parquet", row_group_size=1000)
    (tmp_path / "notes.csv").write_text("a,b\n1,x\n2,y\n")
    (tmp_path / "logs.jsonl").write_text('{"k": "v", "o": {"p": 1}}\n{"k": null, "o": null}\n')
    (tmp_path / "broken.parquet").write_text("no parquet")
    (tmp_path / "old.parquet").mkdir()
    for k in range(2):
        pq.write_table(pa.table({"x": [k]}), tmp_path / "old.parquet" / f"part-{k}.parquet")
    return str(tmp_path)


def test_check_and_catalog(spark, target):
    got = {r.object: (r.readable, r.problem, r.files, r.rows) for r in C.Connector(spark, target).check().collect()}
    assert got == {"people": (True, None, 1, 40_000), "notes": (True, None, 1, 2), "logs": (True, None, 1, 2), "broken": (False, "ArrowInvalid", 1, None), "old": (True, None, 2, 2)}
    fields = {(r.object, r.field, r.rows) for r in C.Connector(spark, target, exclude=["BRO*"]).catalog().collect()}
    assert fields == {("people", "id", 40_000), ("people", "mail", 40_000), ("people", "n", 40_000), ("notes", "a", None), ("notes", "b", None), ("logs", "k", None), ("logs", "o", None), ("old", "x", 2)}
    with pytest.raises(Exception, match="mode is one of"):
        spark.read.format(C.FORMAT).option("path", target).option("mode", "x").load().count()
    assert C.Connector(spark, target, include=["nothing"]).check().count() == 0


def test_discover_reads_what_is_selected(spark, target):
    all_values = C.Connector(spark, target, exclude=["broken"]).discover()
    counts = {(r.object, r.field): r["count"] for r in all_values.groupBy("object", "field").count().collect()}
    assert counts[("people", "n")] == 40_000 and counts[("logs", "o")] == 2 and len(counts) == 8
    assert all_values.where("object = 'people' and field = 'n' and value is null").count() == sum(i % 3 > 0 for i in range(40_000))
    # Filters of the query reach the plan: the broken file is not opened, and one partition is planned.
    some = C.Connector(spark, target).discover().where((F.col("object") == "old") & F.col("field").startswith("x"))
    assert sorted(r.value for r in some.collect()) == ["0", "1"] and some.rdd.getNumPartitions() == 2
    assert C.Connector(spark, target).discover().where(F.col("object").isin("notes", "logs")).where("value = 'y'").count() == 1


def test_a_sample_reads_a_fraction_of_row_groups(spark, target):
    reader = C.TargetReader({"path": target, "include": "people", "sample": "500", "seed": "7"}, "discover")
    parts = reader.partitions()
    assert len(parts) == 2 and sum(p.most for p in parts) == 500  # 3 x 500 of 40,000 rows are two row groups of 1,000
    values = C.Connector(spark, target, include=["people"]).discover(500, 7).where("field = 'mail'")
    assert values.count() == values.distinct().count() == 500
    begins = {C.TargetReader({"path": target, "include": "people", "sample": "500", "seed": str(s)}, "discover").partitions()[0].groups for s in range(30)}
    assert len(begins) > 10
    assert C.chosen_groups([1000] * 40, 39_000, 1) == list(range(39)) and C.chosen_groups([], 5, 1) == []
    wrapped = [C.chosen_groups([1000] * 40, 1000, s) for s in range(60)]
    assert all(len(g) == 3 for g in wrapped) and any(g[0] > g[-1] for g in wrapped)


def test_a_row_group_is_read_in_parts(tmp_path):
    """Column chunks are read as their pages are needed, so a task's memory doesn't follow the size of row groups."""
    texts = [os.urandom(1000).hex() for _ in range(20_000)]
    pq.write_table(pa.table({"text": texts}), tmp_path / "notes.parquet", row_group_size=len(texts), compression="none", use_dictionary=False)
    reader = C.TargetReader({"path": str(tmp_path)}, "discover")
    (part,) = reader.partitions()
    held, most, got = pa.total_allocated_bytes(), 0, []
    for batch in reader.read(part):
        most = max(most, pa.total_allocated_bytes() - held)
        got += batch.column(2).to_pylist()
    assert got == texts and most < 30_000_000  # of 40 MB


def test_discovery_scans_values_to_their_end(spark, tmp_path):
    card, far = "4111 1111 1111 1111", "word é, " * 40_000
    texts = [far + f"ann@corp.org or {card}", "x" * 8180 + f" {card} " + far, far + "bob@corp.org.", far, "none", None]
    pq.write_table(pa.table({"doc_id": range(len(texts)), "text": texts}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"page_id": [1, 2], "html": [far + "<p>\u00a04111\u20111111\u20111111\u20111111</p>", "<p>"], "url": ["http://a.org", None]}), tmp_path / "pages.parquet")
    pq.write_table(pa.table({"conv_id": [1], "turn": [0], "text": [far + "cy@corp.org" + far]}), tmp_path / "conversations.parquet")
    pq.write_table(pa.table({"c_custkey": [1], "c_name": ["Customer"], "c_mktsegment": ["X"]}), tmp_path / "customer.parquet")
    columns = ["object", "field", "classifier", "sampled", "n", "matched", "candidates", "reported", "confidence"]
    got = {tuple(r) for r in source_queries.connector_discovery(spark, str(tmp_path)).select(columns).collect()}
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "customer"):
        con.sql(f"create view {t} as from '{tmp_path}/{t}.parquet'")
    assert got == set(con.sql(f"select {', '.join(columns)} from ({source_queries.ORACLE_SQL['connector_discovery']})").fetchall())
    assert {r[:3]: r[5] for r in got if r[5]} == {("documents", "text", "email"): 2, ("documents", "text", "card_number"): 2, ("pages", "html", "card_number"): 1, ("conversations", "text", "email"): 1}


def lines_of(spark, out):
    return sorted(r.value for r in spark.read.parquet(out).collect())


def test_a_log_is_followed_through_rotation_and_restarts(spark, tmp_path):
    log, out, mark = tmp_path / "audit.log", str(tmp_path / "out"), str(tmp_path / "mark")

    def poll(pattern="audit.log*"):
        stream = T.follow(spark, str(tmp_path / pattern), range_bytes=40)
        write_idempotent(stream, out, mark).awaitTermination(120)

    def append(text, path=log):
        with open(path, "a") as f:
            f.write(text)

    append("one\ntwo\nthr")
    poll()
    assert lines_of(spark, out) == ["one", "two"]
    append("ee\n" + "".join(f"line {i:03}\n" for i in range(50)))  # restarted in mid-record; over many ranges
    poll()
    known = ["one", "two", "three", *(f"line {i:03}" for i in range(50))]
    assert lines_of(spark, out) == sorted(known)
    append("before rotation\nlast of old")
    os.rename(log, tmp_path / "audit.log.1")
    append("first of new\n")
    append(" file\n", tmp_path / "audit.log.1")
    poll()
    known += ["before rotation", "last of old file", "first of new"]
    assert lines_of(spark, out) == sorted(known)
    with open(log, "r+") as f:  # truncated in place, and grown past its old end
        f.truncate(0)
    append("again, and longer than before\r\nx\n")
    poll()
    known += ["again, and longer than before", "x"]
    assert lines_of(spark, out) == sorted(known)
    os.rename(tmp_path / "audit.log.1", tmp_path / "audit.log.2")
    poll()
    poll()
    assert lines_of(spark, out) == sorted(known)


def test_lines_that_are_there_can_be_skipped(spark, tmp_path):
    (tmp_path / "a.log").write_text("old\n")
    reader = T.TailReader({"path": str(tmp_path / "*.log"), "from": "end"})
    begin = reader.initialOffset()
    with open(tmp_path / "a.log", "a") as f:
        f.write("new\nopen")
    parts = reader.partitions(begin, reader.latestOffset())
    assert [v for p in parts for b in reader.read(p) for v in b.column(2).to_pylist()] == ["new"]
    assert T.TailReader({"path": str(tmp_path / "none*")}).latestOffset() == {}
    assert reader.partitions({}, {"0:0": {"at": 5, "print": ""}}) == []
    big = tmp_path / "big.log"
    big.write_text("x" * 200_000 + "\n" + "y" * 100_000)
    assert T.last_line_end(str(big), 300_001) == 200_001 and T.next_line(str(big), 10, 200_001) == 200_001
