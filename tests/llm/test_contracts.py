"""Stages, fits and queries: odd rows, empty tables, brute-force pipeline, ablation of the grammar, long texts."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeward.llm import backoff, common, language, packing, pieces, quality, registry, simhash, substrings, toxicity
from tests.llm.test_operators import ODD, SF, WORD, frame, kept_near

STAGES = {
    "language": language.language_stage, "toxicity": toxicity.toxicity_stage, "simhash": simhash.simhash_stage, "substrings": substrings.substring_stage,
}


@pytest.mark.parametrize("name", sorted(STAGES))
def test_stages_keep_columns_on_odd_rows_and_empty_tables(spark, name):
    odd = frame(spark, ODD)
    out = STAGES[name](spark, odd, SF)
    assert out.columns == odd.columns and 0 < out.count() <= len(ODD)
    assert STAGES[name](spark, odd.where("false"), SF).count() == 0
    assert packing.packing_stage(spark, odd.where("false"), SF).count() == 0


def test_stages_keep_clean_rows(spark):
    """No language to learn: all stay. Null and empty texts are not toxic. Repeated rows count as copies."""
    rows = [(1, "plain words"), (2, None), (3, ""), (None, "plain words too")]
    assert language.language_stage(spark, frame(spark, rows), SF).count() == 4
    assert toxicity.toxicity_stage(spark, frame(spark, rows), SF).count() == 4
    assert simhash.simhash_stage(spark, frame(spark, [*rows, (1, "plain words"), (5, "plain words")]), SF).count() == 3


def test_fits_without_labels(spark):
    docs, labels = frame(spark, ODD), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit_model(docs, labels)
    assert not model.words and not model.stems and model.score("I will kill you") > 0.5 > model.score("plain")
    assert language.fit_filters(docs).languages == [] and quality.fit_rules(docs, labels) == []


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_have_their_columns(spark, name):
    wanted = {
        "op1": {"doc_id", "held_out", "lang_pred", "score"}, "op2": {"doc_id", "n_words", "n_removed", "kept_sha256"}, "op3": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
        "op4": {"doc_id", "log_score"}, "op5": {"doc_id", "fingerprint", "component_id"}, "op6": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
        "op7": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"}, "op8": {"doc_id", "held_out", "score", "predicted"},
        "op9": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"}, "op10": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
        "op11": {"doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"}, "op12": {"doc_id", "n_lines", "n_dropped", "kept_sha256"},
        "op13": {"doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"},
    }
    op = name.split("_")[0]
    out = registry.QUERIES[name](spark, SF)
    assert wanted[op] <= set(out.columns)
    if op == "op7":
        return
    ids = sorted(r.doc_id for r in out.select("doc_id").collect())
    documents = sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    assert (sorted(set(ids)) if op == "op3" else ids) == documents


def test_held_out_columns(spark):
    for query, parts, rest in ((language.op1_language_id, 4, 2), (toxicity.op8_toxicity, 5, 0)):
        for r in query(spark, SF).collect():
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == rest) and 0 <= r.score <= 1
            assert not hasattr(r, "predicted") or r.predicted == int(r.score >= 0.5)


def test_language_counts_equal_sets(spark):
    """Filters without false positives count the trigrams that a language's set holds."""
    grams = {"a": np.unique(language.text_trigrams(["the cat sat"])[0]), "b": np.unique(language.text_trigrams(["le chat dort"])[0])}
    filters = language.LanguageFilters.build(grams)
    texts = ["the chat", "le le le", "", None, "12", "cat dort sat"]
    names, scores = filters.predict(texts)
    for text, name, score in zip(texts, names, scores):
        found = language.text_trigrams([text])[0]
        shares = {k: float(np.isin(found, g).mean()) if len(found) else 0.0 for k, g in grams.items()}
        best = max(sorted(shares), key=shares.get)
        assert name == (best if len(found) else "und") and score == pytest.approx(shares[best] if len(found) else 0, abs=0.02)


def test_quality_verdicts(spark):
    rows = [*ODD, (20, "### $$$ %%% " * 30), (21, " ".join(f"w{i}" for i in range(80))), (22, "a b c " * 40)]
    got = {r.doc_id: r for r in quality.judge_documents(frame(spark, rows), []).collect()}
    for i, text in rows:
        words = WORD.findall(text or "")
        grams = collections.Counter(zip(words, words[1:], words[2:]))
        repeated = {j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        assert (got[i].n_symbols, got[i].base_failed) == (sum(c in "#*$%&|<>" for c in text or ""), failed) and not (failed and got[i].kept)
    assert got[21].kept


def brute_cut(text, repeated, window=35):
    """The text without words of repeated windows; None if nothing is left of a text with words."""
    spans = [m.span() for m in WORD.finditer(text or "")]
    words = [text[a:b] for a, b in spans]
    gone = [False] * len(words)
    for k in range(len(words) - window + 1):
        if repeated[tuple(words[k : k + window])] > 1:
            gone[k : k + window] = [True] * window
    if not any(gone):
        return text
    runs, at = [], 0
    while at < len(words):
        end = at
        while end < len(words) and gone[end] == gone[at]:
            end += 1
        if not gone[at]:
            runs.append(text[spans[at][0] : spans[end - 1][1]])
        at = end
    return "\n".join(runs) if runs else None


def test_pipeline_equals_plain_python(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    names, scores = language.fit_filters(docs).predict([t for _, t in rows])
    rows = [r for r, n, s in zip(rows, names, scores) if n != "und" and s >= language.LEAST_SCORE]
    model = toxicity.fit_model(docs.where(F.col("doc_id").isin([i for i, _ in rows])), spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [r for r in rows if model.score(r[1]) < 0.5]
    near = kept_near(rows)
    rows = [r for r in rows if near[r[0]]]
    repeated = collections.Counter(tuple(w[k : k + 35]) for w in (WORD.findall(t or "") for _, t in rows) for k in range(len(w) - 34))
    rows = [(i, brute_cut(t, repeated)) for i, t in rows]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = {i: tokenizer.encode(t, add_special_tokens=False).ids + [2] for i, t in rows if t is not None}
    got = collections.defaultdict(dict)
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id][r.start] = (r.length, r.ids_crc32, r.doc_tokens)
    assert set(got) == set(expected)
    for i, ids in expected.items():
        for start, (length, crc, total) in got[i].items():
            assert total == len(ids) and crc == zlib.crc32(np.array(ids[start : start + length], dtype="<u4").tobytes())
        assert sum(length for length, _, _ in got[i].values()) == len(ids)


def test_every_step_of_the_grammar_decides(spark):
    """Words of all five classes are learned, and each step changes verdicts of documents that were held out."""
    rng = random.Random(11)
    filler = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(400)]
    some = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    kinds = [  # text, toxic, how many
        (lambda: f"{some(4)} glorp {some(3)}", 1, 500), (lambda: f"{some(3)}. They will zap you {some(3)}", 1, 60), (lambda: f"{some(3)} zap {some(4)}", 0, 60),
        (lambda: f"{some(3)} not glorp {some(3)}", 0, 60), (lambda: f"{some(2)} nope glorp {some(2)}", 0, 9), (lambda: f"{some(2)} said that {some(4)} glorp", 0, 60),
        (lambda: f"quoth {some(5)} glorp {some(2)}", 0, 9), (lambda: f"{some(3)} you are not glorp {some(3)}", 1, 60), (lambda: f"{some(9)}. {some(4)}", 0, 900),
    ]
    made = [(text(), toxic, k) for k, (text, toxic, n) in enumerate(kinds) for _ in range(n)]
    rng.shuffle(made)
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(made)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y, _) in enumerate(made)], "doc_id long, toxic int")
    model = toxicity.fit_model(docs, labels)
    assert model.words == {"glorp"} and "zap" in model.cues["threat"] and "nope" in model.cues["negation"] and "quoth" in model.cues["report"]
    held = [m for i, m in enumerate(made) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = lambda m: sum((m.score(t) >= 0.5) == bool(y) for t, y, _ in held)
    assert right(model) >= 0.97 * len(held)
    for step in toxicity.STEPS:
        assert right(model.ablated(step)) < right(model) - 2, step


def test_copies_do_not_make_entries(spark):
    words = [f"u{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}x" for i in range(100)]
    rng = random.Random(3)
    copies = [" ".join(w if rng.random() > 0.03 else "edited" + "abcdefgh"[rng.randrange(8)] for w in words) for _ in range(60)]
    rows = [(i, t, 1) for i, t in enumerate(copies)] + [(100 + i, f"word{'abcdefghij'[i % 10]} plain text", 0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit_model(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert not model.words & set(words)


def test_the_rule_places_nearly_all_ids():
    rng = np.random.default_rng(2)
    packer = packing.SumOfSquaresPacker(4096, lambda pieces: None)
    lengths = np.minimum(20_000, rng.lognormal(6, 1.3, 4000).astype(int) + 1)
    for k, n in enumerate(lengths.tolist()):
        packer.add(k, b"\0\0\0\0" * n, n)
    packer.close()
    assert packer.placed + packer.moved == lengths.sum() and packer.moved < 0.01 * lengths.sum()


def test_added_tokens_are_those_of_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["a <|endoftext|> b <|startoftext|> c", "x<|ENDOFTEXT|>y", "<|endoftext", "z" * 6000 + " end"]
    got = [np.frombuffer(b, "<u4").tolist() for b in packing.tokenizer_of(path).encode_batch(texts)]
    assert got == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]


def test_long_words_equal_the_library():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    rng = random.Random(4)
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(60_000)) + " a " + "a" * 9000
    assert pieces.codec_of(path).encode(text) == sentencepiece.SentencePieceProcessor(model_file=path).encode(text)


def test_parts_of_long_texts_change_nothing(monkeypatch):
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(3000)) + " " + "q" * 700
    column = pa.array([text])
    data, offsets = common.text_buffers(column)
    starts, ends, _ = common.word_bounds(data, offsets)
    whole = common.span_hashes(data, starts, ends)
    runs = common.run_hashes(whole, 5)
    contexts = list(substrings.contexts_of(data, offsets))
    prints = simhash.fingerprints(column)
    filters = language.LanguageFilters.build({"x": np.unique(language.text_trigrams(["abc dé cab"])[0])})
    score = filters.predict([text])
    monkeypatch.setattr(common, "CHUNK", 100)
    assert (common.span_hashes(data, starts, ends) == whole).all() and (common.run_hashes(whole, 5) == runs).all()
    for module in (substrings, simhash, language):
        monkeypatch.setattr(module, "CHUNK", 100)
    cut = list(substrings.contexts_of(data, offsets))
    assert len(contexts) == 1 and len(cut) > 10 and (np.concatenate([c.windows for c in cut]) == contexts[0].windows).all()
    assert sum(c.count.sum() for c in cut) == contexts[0].count.sum() and set(np.concatenate([c.anchor for c in cut])) == set(contexts[0].anchor)
    assert (simhash.fingerprints(column) == prints).all()
    assert filters.predict([text])[1] == pytest.approx(score[1], abs=1e-3)


def test_a_shared_folder_is_asked_for(monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.ensure_checkpoint_dir(Session())


def test_backoff_scores_are_probabilities(spark):
    got = backoff.score_documents(frame(spark, ODD)).collect()
    assert all(r.log_score <= 1e-9 and (r.mean_log_score is None) == (r.n_words == 0) for r in got)


def test_hash_share_of_any_number(spark):
    """A share of 64-bit hashes does not vanish for 10^11 rows, nor take more than its part."""
    ids = spark.range(1_000_000)
    for wanted, n in ((10**9, 10**11), (20_000, 1_000_000), (5 * 10**10, 10**11)):
        kept = ids.where(common.hash_share(wanted, n, F.col("id"))).count()
        assert kept == pytest.approx(1_000_000 * wanted / n, rel=0.05)
    assert ids.where(common.hash_share(10, 10, F.col("id"))).count() == 1_000_000
    assert 0 < spark.range(10**7).where(common.hash_share(20_000, 10**11, F.col("id"))).count() < 20


def test_samples_of_repeated_ids_and_contradictory_labels(spark):
    """One id on 500 different texts, 1,000 equal rows and 50 other ids: all take part, and the bound holds about."""
    rows = [(1, f"text of one id, number {k}") for k in range(500)] + [(2, "the same row")] * 1000 + [(k, f"text {k}") for k in range(10, 60)]
    labels = spark.createDataFrame([(i, v, v) for i in [1, 2, *range(10, 60)] for v in (1, 0)] + [(None, 0, 0), (99, None, None), (98, 1, 1)], "doc_id long, quality int, toxic int")
    whole = common.labelled_sample(frame(spark, rows), labels, "toxic", 10_000, "t").collect()
    assert len(whole) == 551 and {r.toxic for r in whole} == {0}
    part = common.labelled_sample(frame(spark, rows), labels, "toxic", 100, "t").collect()
    assert 50 < len(part) < 160 and len({(r.doc_id, r.text) for r in part}) == len(part)
    known = frame(spark, rows).withColumn("lang", F.when(F.col("doc_id") == 1, "aa").otherwise("bb"))
    assert language.fit_filters(known, 100).languages == ["aa", "bb"]


def test_links_do_not_depend_on_the_size_of_a_group():
    """A pair is judged alike alone and among many others, on either side of the radius."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64)) for _ in range(60)]
    near = np.sort(np.concatenate((sets[0][:-10], rng.integers(0, 1 << 63, 10, dtype=np.uint64))))
    prints = simhash.set_prints(np.cumsum([0, *map(len, sets)]), np.concatenate([*sets, near]))
    for apart in (0, simhash.STAGE_RADIUS, simhash.STAGE_RADIUS + 1):
        moved = prints.copy()
        moved[-1] = moved[0] ^ np.uint64((1 << apart) - 1)
        alone = simhash.similar_links(moved[[0, -1]], [sets[0], near], simhash.STAGE_RADIUS)
        among = simhash.similar_links(moved, [*sets, near], simhash.STAGE_RADIUS)
        assert bool(alone) == ((0, 60) in among) == (apart <= simhash.STAGE_RADIUS)


def test_stored_sketches_recover_small_edits(spark):
    """Two changed paragraphs are recovered from the stored sketches alone, without the digests."""
    from lakeward.llm import sketches

    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text and len(r.text.split()) > 60]
    rng = random.Random(8)

    def edited(text):
        words = text.split(" ")
        for at in (rng.randrange(len(words)), rng.randrange(len(words))):
            words[at] += "x"
        return " ".join(words)

    rows = spark.createDataFrame([(i, t, edited(t)) for i, t in enumerate(texts)], "i int, a string, b string")
    digests = rows.select("i", *[sketches.paragraph_digests(F.col(c)).alias(c) for c in "ab"])
    peeled = sketches.peel(sketches.subtract(sketches.build_sketch(F.col("a")), sketches.build_sketch(F.col("b"))))
    found = digests.select(F.array_sort(F.concat(F.array_except("a", "b"), F.array_except("b", "a"))).alias("true"), F.array_sort(peeled).alias("got")).collect()
    recovered = [r for r in found if r.got is not None]
    assert all(list(r.got) == list(r.true) for r in recovered) and len(recovered) >= 0.9 * len(found) and len(found) > 50
    print(len(recovered) / len(found))


def brute_patterns(model, text):
    """Patterns by looking back from each word, clause by clause, without machines or a search for entries."""
    found = collections.Counter()
    for words in toxicity.clauses(text or ""):
        kinds = [model.word_class(w) for w in words]
        for i, kind in enumerate(kinds):
            near, before = set(kinds[max(0, i - 3) : i]), set(kinds[:i])
            flags = {flag for flag, told in (("negated", "negation" in near), ("reported", "report" in before)) if told}
            if kind == "insult":
                found["+".join(["insult", *sorted(flags | ({"target"} if "target" in near else set()))])] += 1
            elif kind == "target" and "threat" in near:
                found["+".join(["threat", *sorted(flags)])] += 1
    return found


def test_toxicity_equals_brute_force(spark):
    """Patterns and scores of the composed machine, on the documents with a fitted model and on random clauses."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    fitted = toxicity.fit_model(docs, labels)
    made = toxicity.ToxicityModel(frozenset({"idiot", "scum"}), frozenset({"moro"}), {"insult": 2.0, "insult+negated": -1.0, "threat": 1.0})
    rng = random.Random(6)
    pool = ["idiot", "Scum", "morons", "moro", "idiots", "you", "they", "not", "never", "kill", "said", "wrote", "plain", "word", "isn't", "é", "7", "you.", "idiot,", "kill!", "said:", "\n", "scum-like"]
    texts = [" ".join(rng.choices(pool, k=rng.randrange(30))) for _ in range(600)] + [r.text for r in docs.select("text").collect()] + [None, "", "not " * 50 + "idiot", "x" * 600 + ". idiot"]
    for model in (made, fitted):
        expected = [brute_patterns(model, t) for t in texts]
        assert [model.patterns(t) for t in texts] == expected and sum(map(bool, expected)) > 10
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
        got = {r.doc_id: r.score for r in toxicity.score_documents(rows, model).collect()}
        for i, patterns in enumerate(expected):
            best = max((model.weights.get(p, toxicity._prior(p)) for p in patterns), default=None)
            odds = model.base if best is None else min(30.0, best + 0.1 * np.log(sum(patterns.values())))
            assert got[i] == pytest.approx(1 / (1 + np.exp(-odds)))
