"""The ten operators against brute force, round trips and held-out labels, and on odd rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from lakeward.llm import backoff, chat, language, packing, pieces, quality, simhash, sketches, substrings, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
KIND = "doc_id long, text string, lang string, source string, n_chars long, spans int, fp string, at int"
PASSAGE = " ".join(f"w{i}" for i in range(60))
ODD = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, PASSAGE), (6, "lead " + PASSAGE + " tail"), (7, PASSAGE), (7, PASSAGE), (8, "x " * 200), (9, "é▁ 日本 \x00 <s> </s>"),
    (10, "A b\nA b\nA b " * 30), (11, "y" * 5000), (12, "Don't 'S it's <|endoftext|> a <|StartOfText|>b"), (None, "no id at all"), (13, " ".join(f"q{i}" for i in range(9000))),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, 1, "clash", 2) for i, t in rows], KIND)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD).cache()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


RUNS = {
    "language": lambda d: language.predict_languages(d, language.fit_filters(d)),
    "substrings": lambda d: substrings.kept_words(d, bits=16),
    "packing": lambda d: packing.pack_documents(d, public_tokenizers.path("word_bpe_49k.json")),
    "backoff": lambda d: backoff.score_documents(d, batch=10_000),
    "simhash": simhash.near_duplicates,
    "sketches": sketches.fingerprint_versions,
    "toxicity": lambda d: toxicity.score_documents(d, toxicity.ToxicityModel(frozenset({"idiot"}))),
    "quality": lambda d: quality.judge_documents(d, []),
    "pieces": lambda d: pieces.encode_documents(d, public_tokenizers.path("piece_bpe_32k.model")),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_odd_rows_and_empty_tables(odd, name):
    out = RUNS[name](odd).collect()
    ids = collections.Counter(r.doc_id for r in out)
    if name == "packing":
        assert set(ids) == {i for i, _ in ODD}
    else:
        assert ids == collections.Counter(i for i, _ in ODD)
    assert RUNS[name](odd.where("false")).count() == 0


def test_language_held_out(docs):
    got = language.predict_languages(docs, language.fit_filters(docs)).join(docs.select("doc_id", "lang"), "doc_id").where(language.held_out(F.col("doc_id"))).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.9 * len(got)


def test_more_than_64_languages(spark):
    names = [f"l{k:02}" for k in range(80)]
    texts = {n: " ".join(chr(0x4E00 + 40 * k + j) * 2 for j in range(40)) for k, n in enumerate(names)}
    rows = [(100 * k + i, texts[n], n) for k, n in enumerate(names) for i in range(8)]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.predict_languages(known, language.fit_filters(known)).collect()}
    assert got == {i: n for i, _, n in rows}


def test_undetermined(odd):
    got = {r.doc_id: r.lang_pred for r in RUNS["language"](frame(odd.sparkSession, [(1, None), (2, "12 !"), (3, "a")])).collect()}
    assert got[1] == got[2] == "und"


def brute_windows(rows, window=35):
    cut = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = collections.Counter(tuple(w[k : k + window]) for _, w in cut for k in range(len(w) - window + 1))
    out = []
    for i, w in cut:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [8, 20])
def test_substrings_equal_brute_force(odd, bits):
    assert sorted((tuple(r) for r in substrings.kept_words(odd, bits=bits).collect()), key=repr) == brute_windows(ODD)


def test_substrings_on_documents(docs, texts):
    assert sorted((tuple(r) for r in substrings.kept_words(docs, bits=20).collect()), key=repr) == brute_windows(texts.items())


def test_substring_stage_keeps_text_between_words(spark):
    rows = [(1, "a  b\n" + PASSAGE + "\n c\td"), (2, PASSAGE), (3, "clean  text"), (4, None)]
    got = {r.doc_id: r.text for r in substrings.substring_stage(spark, frame(spark, rows), SF).collect()}
    assert got == {1: "a  b\nc\td", 3: "clean  text", 4: None}


def test_packing_holds_every_id_once(spark, docs, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    both = {**texts, **{i: t for i, t in ODD if i}}
    done = packing.pack_documents(frame(spark, [(i, t) for i, t in both.items()]), public_tokenizers.path("word_bpe_49k.json")).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in done:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, text in both.items():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 4096 or at & (at - 1) == 0


def test_sum_of_squares_rule():
    closed = []
    packer = packing.SumOfSquaresPacker(10, closed.append)
    for key, n in enumerate((6, 6, 4)):
        packer.add(key, b"\0\0\0\0" * n, n)
    assert [[p[0] for p in w] for w in closed] == [[1, 2]] and packer.levels[6] == 1


@pytest.mark.parametrize("batch", [20_000, 1_000_000])
def test_backoff_equals_brute_force(odd, batch):
    cut = [(i, WORD.findall(t or "")) for i, t in ODD]
    one = collections.Counter(w for _, ws in cut for w in ws)
    two = collections.Counter(p for _, ws in cut for p in zip(ws, ws[1:]))
    expected = []
    for i, ws in cut:
        mine, pairs, total, backed = collections.Counter(ws), collections.Counter(zip(ws, ws[1:])), 0.0, 0
        for k, w in enumerate(ws):
            other = two[ws[k - 1], w] - pairs[ws[k - 1], w] if k else 0
            if other > 0:
                total += math.log(other / (one[ws[k - 1]] - mine[ws[k - 1]]))
            else:
                total += math.log(0.4) + math.log(max(one[w] - mine[w], 1) / max(1, sum(one.values()) - len(ws)))
                backed += 1
        expected.append((str(i), len(ws), backed, round(total, 6)))
    got = [(str(r.doc_id), r.n_words, r.n_backed_off, round(r.log_score, 6)) for r in backoff.score_documents(odd, batch=batch).collect()]
    assert sorted(got) == sorted(expected)


def simhash_of(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def test_simhash_equals_brute_force(docs, texts):
    prints = {i: simhash_of(t) for i, t in texts.items()}
    least = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and least[a] != least[b]:
                    least[a] = least[b] = min(least[a], least[b])
                    changed = True
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{prints[i]:016x}", least[i]) for i in prints}


def test_bit_sliced_comparison():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = np.concatenate([base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in (0, 1, 2, 3, 4)])
    q, b = simhash.close_in_block(values, values, 2)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 2
    assert set(zip(q.tolist(), b.tolist())) == set(zip(*map(list, np.nonzero(near))))
    assert simhash.close_pairs(values[:-1], values[1:], 2).tolist() == np.flatnonzero(np.bitwise_count(values[:-1] ^ values[1:]) <= 2).tolist()


def test_large_groups_are_cut_into_blocks(spark):
    rng = np.random.default_rng(5)
    centre = 0x0123456789ABCDEF
    values = {centre} | {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 30, (150, 2))}
    nodes = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)), i) for i, v in enumerate(sorted(values))], "fp long, rep long")
    labels = simhash.components(nodes, simhash.near_links(nodes, block=16)).collect()
    assert len(labels) == len(values) and {r.label for r in labels} == {0}


def test_components_of_shared_reps(spark):
    shared = (1 << 63) - 1
    nodes = spark.createDataFrame([(0, shared), (1, shared), (3, shared), (12, 7), (13, 7), (15, 7), (40, 5), (41, shared)], "fp long, rep long")
    edges = spark.createDataFrame([(0, 1), (1, 3), (12, 13), (13, 15), (40, 41)], "a long, b long")
    got = sorted(tuple(r) for r in simhash.components(nodes, edges).select("fp", "label", "root").collect())
    assert got == [(0, shared, 0), (1, shared, 0), (3, shared, 0), (12, 7, 12), (13, 7, 12), (15, 7, 12), (40, 5, 40), (41, 5, 40)]


def test_near_texts_without_id_and_of_one_id(spark, monkeypatch):
    values = {"a": 0, "b": 1, "c": 3, "d": 0x0FF0, "e": 0x0FF1}
    monkeypatch.setattr(simhash, "fingerprint_documents", lambda d, shingle: d.select("doc_id", F.element_at(F.create_map(*[F.lit(x) for p in values.items() for x in p]), F.col("text")).cast("long").alias("fp")))
    got = sorted(((r.doc_id or 0), int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(frame(spark, [(None, "a"), (None, "b"), (None, "c"), (7, "d"), (7, "e")])).collect())
    assert got == [(0, 0, (1 << 63) - 1), (0, 1, (1 << 63) - 1), (0, 3, (1 << 63) - 1), (7, 0x0FF0, 7), (7, 0x0FF1, 7)]


def shingles_of(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def kept_near(rows):
    """Plain Python: the row of least (no id, id) of each component of similarity 0.8."""
    sets = [shingles_of(t) for _, t in rows]
    label, changed = list(range(len(rows))), True
    near = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] == sets[j] or (min(map(len, (sets[i], sets[j]))) * 5 >= 4 * max(map(len, (sets[i], sets[j]))) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))]
    while changed:
        changed = False
        for i, j in near:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    best = {}
    for k, (i, _) in enumerate(rows):
        best[label[k]] = min(best.get(label[k], (True, 0)), (i is None, i or 0))
    return collections.Counter(None if none else i for none, i in best.values())


@pytest.mark.parametrize("block", [1024, 2])
def test_simhash_stage_equals_brute_force(spark, docs, texts, monkeypatch, block):
    """Also with groups of over two sets compared by stars and rests."""
    monkeypatch.setattr(simhash, "GROUP_BLOCK", block)
    words = [f"v{i}" for i in range(300)]
    planted = [(100_000 + k, " ".join(words[:200] + [f"z{k}"] * k)) for k in range(0, 60, 12)]
    planted += [(100_100 + k, " ".join(f"u{k}x{i}" for i in range(100))) for k in range(3)]
    planted += [(100_200 + k, " ".join([f"u{k}x{i}" for i in range(50)] + ["new"] + [f"u{k}x{i}" for i in range(51, 100)])) for k in range(3)]
    planted += [(None, " ".join(words[100:])), (None, " ".join(words[100:] + ["end"])), (100_300, "first text of one id"), (100_300, "second, other text of that id")]
    rows = [*texts.items(), *planted, *ODD]
    got = collections.Counter(r.doc_id for r in simhash.simhash_stage(spark, frame(spark, rows), SF).select("doc_id").collect())
    assert got == kept_near(rows) and not any(got[100_200 + k] for k in range(3)) and got[100_300] == 2 and got[None] == 2


def test_sketches_equal_sets(docs, texts):
    fine, coarse = (re.compile(r"(?:[^ \t\n\x0b\x0c\r]++[ \t\x0b\x0c\r]*+){1,%d}+" % n) for n in (16, 64))

    def units(text):
        return {u for k, line in enumerate(text.split("\n")) for u in (fine if k < 4 else coarse).findall(line)}

    def near(a, b):
        a, b = units(a), units(b)
        return 1.0 if not a and not b else len(a & b) / max(len(a), len(b))

    ordered = sorted(texts.items())
    got = {r.doc_id: r for r in sketches.fingerprint_versions(docs).collect()}
    for k, (i, text) in enumerate(ordered):
        after, half = ordered[(k + 1) % len(ordered)][1], len(text) // 2
        edited, r = text[: len(text) - half] + after[:half], got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(near(text, edited)) and r.near_next == pytest.approx(near(text, after))


def test_chat_round_trip_with_attachments(spark):
    part = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
    rows = spark.createDataFrame(
        [
            (1, 0, "user", [("text", "a <|end|> [INST] & &a", None, None, None, None, None), ("image", None, "i.png", 28, 15, None, None)]),
            (1, 1, "assistant", [("text", "ok <|turn|>", None, None, None, None, None)]),
            (1, 2, "user", [("audio", None, "s.wav", None, None, 2.0, None), ("document", None, "d.pdf", None, None, None, 3)]),
            (2, 0, None, None),
        ],
        f"conv_id long, turn long, role string, parts array<{part}>",
    )
    done = chat.format_conversations(rows)
    got = done.withColumn("t", chat.read_turns(done["formatted"])).withColumn("l", chat.read_loss(done["formatted"], done["loss_spans"])).orderBy("conv_id").collect()
    assert [t.text for t in got[0].t][0].startswith("a <|end|> [INST] & &a") and got[0].l == "ok <|turn|>"
    assert [(a.ordinal, a.type, a.ref, a.tokens) for a in got[0].attachments] == [(0, "image", "i.png", 4), (1, "audio", "s.wav", 50), (2, "document", "d.pdf", 768)]
    assert (got[1].n_turns, got[1].l, [tuple(t) for t in got[1].t]) == (1, "", [("", "")])


def test_chat_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view conversations as from '{SF}/conversations.parquet'")
    out = chat.op7_chat_formatting(spark, SF)
    listed = ",".join(sorted(out.columns))
    assert sorted(map(tuple, out.select(sorted(out.columns)).collect())) == sorted(con.sql(f"select {listed} from ({chat.ORACLE_OP7})").fetchall())


def test_grammar_scores_clauses():
    model = toxicity.ToxicityModel(frozenset({"idiot"}), frozenset({"lowei"}))
    assert model.patterns("you are an idiot. fine") == {"insult+target": 1}
    assert model.patterns("he is not an idiot") == {"insult+negated": 1} or "insult+negated+target" in model.patterns("he is not an idiot")
    assert "insult+reported" in model.patterns("people said idiot") and model.patterns("I will kill you") == {"threat": 1}
    assert model.patterns("loweischaft") == {"insult": 1} and not model.patterns("idiotic")
    assert model.score(None) == model.score("fine words") < 0.5 < model.score("what an idiot")


def test_rules_are_learnt_and_ordered():
    rows = [{"a": i % 100, "b": i % 7, "bad": i % 100 > 80 and i % 7 > 2, "fold": i % 3} for i in range(3000)]
    rules = quality.learn_rules(rows, ("a", "b"))
    hit = lambda r: any(all(c.holds(r) for c in rule) for rule in rules)
    assert rules and sum(hit(r) == r["bad"] for r in rows) > 0.98 * len(rows)


def test_quality_statistics(odd):
    got = {r.doc_id: r for r in quality.judge_documents(odd, []).collect()}
    for i, text in ODD:
        words = WORD.findall(text or "")
        grams = collections.Counter(zip(words, words[1:], words[2:]))
        covered = {j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(words), sum(map(len, words)), len(covered), len(lines) - len(set(lines)))


def test_pieces_equal_the_library(texts):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, codec = sentencepiece.SentencePieceProcessor(model_file=path), pieces.codec_of(path)
    for text in [*texts.values(), *[t for _, t in ODD if t], "  a  b ", "aaaaaaaaaaaa", "ababababab", "\n\n x \n", "▁▁ a▁b", "😀😀"]:
        assert codec.encode(text) == library.encode(text)
        assert codec.decode(library.encode(text)) == library.decode(library.encode(text))


def test_pipeline(spark):
    import corpus_pipeline

    packed = corpus_pipeline.run(spark, SF)
    assert packed.count() > 0 and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "simhash_near_dedup", "substring_dedup", "packing"]


def test_large_groups_of_several_clusters(spark, monkeypatch):
    """Sets that meet in all bands: one cluster around the least node, others that touch it only over members, and loners."""
    monkeypatch.setattr(simhash, "GROUP_BLOCK", 5)
    monkeypatch.setattr(simhash, "STAGE_RADIUS", 64)
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(260)]
    cut = lambda low, high: " ".join(words[low:high])
    rows = [(k, cut(2 * k, 2 * k + 100)) for k in range(40)]  # a chain: neighbours and some after them are near, ends are not
    rows += [(100 + k, " ".join(rng.permutation(words)[:80])) for k in range(15)] + [(200 + k, cut(0, 100) + f" z{k}") for k in range(12)]
    marked_keys = simhash.set_keys

    def one_band(column, shingle=simhash.STAGE_SHINGLE):
        node, place, bands = marked_keys(column, shingle)
        return node, place, np.full_like(bands, 7)

    from pyspark.sql import types as T

    marked = frame(spark, rows).select("doc_id", "text")

    def mark(batches):
        import pyarrow as pa

        for batch in batches:
            node, place, bands = one_band(batch.column(1))
            keys = pa.array([bands[p].view(np.int64)[:1].tolist() if p >= 0 else None for p in place], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node.view(np.int64)), keys], names=["doc_id", "text", "node", "keys"])

    kind = T.StructType(list(marked.schema)).add("node", "long").add("keys", T.ArrayType(T.LongType()))
    spread = marked.mapInArrow(mark, kind).cache()
    edges = {(r.a, r.b) for r in simhash.similar_sets(spread, "node", "keys").collect()}
    ids = {r.node: r.doc_id for r in spread.select("node", "doc_id").collect()}
    sets = {i: shingles_of(t) for i, t in rows}
    near = lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    assert all(near(ids[a], ids[b]) for a, b in edges)

    def parts(pairs):
        label = {i: i for i in sets}
        changed = True
        while changed:
            changed = False
            for i, j in pairs:
                if label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
        return label

    assert parts([(ids[a], ids[b]) for a, b in edges]) == parts([(i, j) for i in sets for j in sets if i < j and near(i, j)])
    assert len(set(parts([(ids[a], ids[b]) for a, b in edges]).values())) == 16  # the chain with its copies, and fifteen loners
