"""Infill ropes, line dedup and the Merkle manifest against brute force, on odd rows and empty tables."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeward.llm import infill, lines, manifest, registry
from tests.llm.test_operators import ODD, SF, frame

BLANK = " \t\n\x0b\x0c\r"
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_infill", "op12_line_dedup", "op13_merkle_manifest"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as from '{SF}/documents.parquet'")
    out = registry.QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    expected = con.sql("select " + ", ".join(columns) + f" from ({registry.ORACLE_SQL[name]}) order by doc_id").fetchall()
    assert [tuple(r) for r in out.select(columns).orderBy("doc_id").collect()] == expected


# Infill


@given(st.text(max_size=40), st.data())
@settings(max_examples=150, deadline=None)
def test_rope_splits_equal_slices(text, data):
    unit = data.draw(st.sampled_from([None, re.compile(r"\w+"), re.compile(r"[^\n]*\n")]))
    small, infill.LEAF = infill.LEAF, 3
    try:
        rope = infill.build(text, unit)
    finally:
        infill.LEAF = small
    ends = list(range(1, len(text) + 1)) if unit is None else [m.end() for m in unit.finditer(text) if m.end() > m.start()]
    ends += [len(text)] if text and (not ends or ends[-1] < len(text)) else []
    assert (rope.units, rope.points, infill.flatten(rope)) == (len(ends), len(text), text)
    a, b = sorted(data.draw(st.lists(st.integers(0, len(ends)), min_size=2, max_size=2)))
    at, to = ([0, *ends][k] for k in (a, b))
    rest, tail = infill.split(rope, b)
    head, body = infill.split(rest, a)
    assert [infill.flatten(x) for x in (head, body, tail)] == [text[:at], text[at:to], text[to:]]
    assert [x.units for x in (head, body, tail)] == [a, b - a, len(ends) - b]
    for form in (infill.PSM, infill.SPM):
        if not infill.holds_sentinel(text):
            made, prefix, middle = infill.rearrange(rope, a, b, form)
            assert (prefix, middle) == (at, to - at) and infill.restore(infill.flatten(made), form) == text


def test_infill_of_odd_rows(spark):
    rows = [*ODD, (30, "<P>"), (31, "a <S> b"), (32, "<" * 9 + "S>"), (33, "S>" * 40 + "<P"), (34, "<M" * 50), (35, "𝒳é" * 3000)]
    docs = frame(spark, rows)
    got = collections.Counter((r.doc_id, r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output) for r in infill.transform_documents(docs).collect())
    expected = collections.Counter()
    for i, text in rows:
        text = text or ""
        n, h = len(text), hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
        if not text or any(s in text for s in infill.SENTINELS) or h3 % 100 >= 90:
            expected[i, n, "plain", None, None, text] += 1
            continue
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        p, m, s = text[:a], text[a:b], text[b:]
        out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
        expected[i, n, out[0], a, b - a, out[1]] += 1
    assert got == expected and len({k[2] for k in expected}) == 3
    back = infill.restore_documents(infill.transform_documents(docs).withColumn("extra", F.lit(1)))
    assert collections.Counter((r.doc_id, r.text) for r in back.collect()) == collections.Counter((i, t or "") for i, t in rows) and "extra" in back.columns
    assert infill.transform_documents(docs.where("false")).count() == 0 and infill.restore_documents(back.where("false").withColumn("output", F.col("text"))).count() == 0
    nulls = infill.restore_documents(spark.createDataFrame([(None, "psm"), ("x", None)], "output string, form string"))
    assert [r.text for r in nulls.collect()] == [None, None]


def test_infill_by_words_and_other_sentinels(spark):
    docs = frame(spark, [(i, f"one two  three {i}\nfour ") for i in range(40)])
    marks = ("[pre]", "[suf]", "[mid]")
    made = infill.transform_documents(docs, seed=7, plain_percent=0, spm_percent=50, sentinels=marks, unit=r"\w+").cache()
    rows = made.collect()
    assert {r.form for r in rows} == {"psm", "spm"} and {r.n_units for r in rows} == {6}
    for r in infill.restore_documents(made, marks).collect():
        assert r.text == f"one two  three {r.doc_id}\nfour "
        assert re.fullmatch(r"(\s*\w+)*\s*", r.text[: r.prefix_chars]) and (r.prefix_chars == 0 or r.text[r.prefix_chars - 1] not in " \n" or r.prefix_chars == len(r.text))


# Lines


def brute_lines(rows, least=10):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(BLANK))
    order = lambda i: lines.NO_ID if i is None else i
    holders = collections.defaultdict(set)
    for i, text in rows:
        for x in (text or "").split("\n"):
            if len(key(x)) >= least:
                holders[key(x)].add(order(i))
    out = []
    for i, text in rows:
        parts = (text or "").split("\n")
        kept = [x for x in parts if not (len(holders[key(x)]) > 1 and min(holders[key(x)]) != order(i))]
        out.append((i, "\n".join(kept), len(parts), len(parts) - len(kept)))
    return collections.Counter(out)


def test_line_dedup_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    stock = [f"{w} line of the stock {k}" for k, w in enumerate(["Plain", "ÀÉ", "日本語", "Tab\t"] * 10)] + ["short", "tiny 9 ch", "exactly 10", "É" * 9, "é" * 10]
    rows = [(rng.choice([None, *range(60)]), "\n".join(rng.choice(["", " ", "\t"]) + rng.choice([x, x.upper()]) + rng.choice(["", "\r", "  "]) for x in rng.choices(stock, k=rng.randrange(8)))) for _ in range(150)]
    rows += [*ODD, *((500 + k, "the one common line of all\n" + str(k) * 12) for k in range(300)), (7, rows[0][1]), (7, rows[0][1])]
    for often in (lines.FREQUENT, 3):  # all lines in the broadcast part, and nearly all in shards
        monkeypatch.setattr(lines, "FREQUENT", often)
        got = lines.dedup_lines(frame(spark, rows))
        assert got.columns == [*frame(spark, []).columns, "n_lines", "n_dropped"]
        assert collections.Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == brute_lines(rows)


def test_line_dedup_of_odd_tables(spark):
    assert lines.dedup_lines(frame(spark, ODD).where("false")).count() == 0
    clash = spark.createDataFrame([(1, "a line of text\nb", 5, 6, 7), (2, "A LINE OF TEXT", 5, 6, 7), (3, None, 5, 6, 7)], "doc_id int, text string, _lines int, n_lines int, doc int")
    got = {r.doc_id: (r.text, r._lines, r.doc, r.n_lines, r.n_dropped) for r in lines.dedup_lines(clash).collect()}
    assert got == {1: ("a line of text\nb", 5, 7, 2, 0), 2: ("", 5, 7, 1, 1), 3: ("", 5, 7, 1, 0)}
    alone = lines.dedup_lines(frame(spark, [(None, "one line of text"), (None, "one line of text"), (4, "another line 4\nanother line 4")])).collect()
    assert sorted(r.n_dropped for r in alone) == [0, 0, 0]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1000, 50_000])
def test_perfect_hash_is_minimal_and_knows_strangers(n):
    rng = np.random.default_rng(n)
    digests = rng.integers(0, 1 << 64, (n, 2), dtype=np.uint64)
    built = lines.LineIndex.build(digests, np.arange(n), np.arange(n) * 10)
    for index in (built, lines.LineIndex.from_bytes(built.to_bytes())):
        slots = index.slots(digests)
        assert sorted(slots.tolist()) == list(range(n))
        assert (index.counts[slots] == np.arange(n)).all() and (index.firsts[slots] == np.arange(n) * 10).all()
        assert (index.slots(rng.integers(0, 1 << 64, (5000, 2), dtype=np.uint64)) == -1).all()
    assert n < 1000 or len(built.to_bytes()) < 26 * n  # 24 bytes of arrays and under two of the function


# Manifest


def brute_tree(digests):
    """Root, and for each leaf the siblings as (before, after) by level."""
    paths, nodes, under = [[] for _ in digests], list(digests), [[i] for i in range(len(digests))]
    while len(nodes) > 1:
        runs = [range(k, min(k + 3, len(nodes))) for k in range(0, len(nodes), 3)]
        for run in runs:
            for at in run:
                for leaf in under[at]:
                    paths[leaf].append(("".join(nodes[j] for j in run if j < at), "".join(nodes[j] for j in run if j > at)))
        nodes, under = [sha("".join(nodes[j] for j in run)) for run in runs], [[x for j in run for x in under[j]] for run in runs]
    return nodes[0], paths


def brute_manifest(rows):
    """rows: (tree, id, digest, probe)."""
    by = collections.defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    names, subroots, paths = sorted(by, key=lambda x: (x is not None, (x or "").encode())), {}, {}
    for name in names:
        by[name].sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        subroots[name], paths[name] = brute_tree([r[2] for r in by[name]])
    root, above = brute_tree([subroots[n] for n in names])
    out = collections.Counter()
    for n, up in zip(names, above):
        for (_, i, leaf, probe), path in zip(by[n], paths[n]):
            folded = probe
            for b, a in path + up:
                folded = sha(b + folded + a)
            out[i, leaf, subroots[n], root, sha("".join(b + a for b, a in path + up)), folded] += 1
    return out


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_equals_brute_force(spark, levels):
    rng = random.Random(levels)
    rows = []
    for name, n in [(None, 5), ("", 1), ("big", 130), ("é", 3), ("z", 9), ("three", 27), ("b", 28), *((f"s{k}", k) for k in range(1, 6))]:
        rows += [(name, rng.choice([None, *range(40)]), sha(f"{name}{k // 2}"), sha(f"other{k // 2}")) for k in range(n)]
    leaves = spark.createDataFrame(rows, "tree string, id long, digest string, probe string").repartition(5)
    got = manifest.merkle_manifest(leaves, levels=levels, proofs=True).collect()
    assert collections.Counter(tuple(r)[:6] for r in got) == brute_manifest(rows)
    for r in got:
        assert sha(r.proof.replace(",", "").replace(";", "")) == r.proof_sha256
        assert manifest.fold(r.leaf, manifest.read_path(r.proof)) == r.root != r.folded_root


def test_manifest_of_one_leaf_and_of_none(spark):
    one = spark.createDataFrame([("s", 1, "ab", "ab")], "tree string, id long, digest string, probe string")
    assert [tuple(r) for r in manifest.merkle_manifest(one).collect()] == [(1, "ab", "ab", "ab", sha(""), "ab")]
    assert manifest.merkle_manifest(one.where("false")).count() == 0


def test_leaves_of_odd_rows(spark):
    rows = [(i, t, k, None if i == 9 else "s,;", n) for (i, t), k, n in zip(ODD, ["de", None] * 8, range(20))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"tree": F.lit(1), "id": F.lit(2), "digest": F.lit(3)})
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, k, s, n: sha("".join(map(field, (i, s, k, n, t))))
    got = collections.Counter(tuple(r) for r in manifest.document_leaves(docs, F.lit(True)).collect())
    assert got == collections.Counter((s, i, leaf(i, t, k, s, n), leaf(i, t and t.replace("\n", ""), k, s, n)) for i, t, k, s, n in rows)


def test_manifest_query_finds_the_tampered(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.verified for r in registry.QUERIES["op13_merkle_manifest"](spark, SF).collect()}
    assert got == {i: not ("\n" in (t or "") and zlib.crc32(str(i).encode()) % 2 == 0) for i, t in texts.items()} and len(set(got.values())) == 2
