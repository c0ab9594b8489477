"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer turns words into classes (insult, threat, target, negation, reported speech). A
chain of small transducers for target, threat, negation and report is composed with it into one machine
that runs over each clause and emits patterns such as insult+target or insult+negated. Patterns, not
single words, carry weights: an insult that is denied or quoted is another pattern than one that is
addressed, and a threat needs its target. The words of all five classes and the weights of patterns are
learned from labelled documents; short seed lists stand for what a small sample does not show.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeward.llm.common import labelled_sample, materialize, released, small_batches, table

#: At most about so many labelled rows are used to fit; they are chosen by a hash of the id.
FIT_ROWS = 20_000
#: An insult entry occurs outside of denials and quotes in at least so many toxic documents of the sample, at
#: least with this precision, and in so many surroundings of their own (near copies of one document share the
#: words before or those behind) that of all entries of the sample at most about CHANCE would do so by chance.
LEAST_DOCS, LEAST_PRECISION, CHANCE = 4, 0.95, 0.05
#: A cue word turns the verdict of clauses that hold an insult (or makes a threat): in at least so many
#: different clauses, of which at least this share has the label that the cue stands for.
CUE_CLAUSES, CUE_SHARE = 4, 0.8
STEMS = (4, 5, 6)
#: Seeds of the cue classes; `fit_model` adds what the labels show.
SEEDS = {
    "threat": frozenset("kill hurt destroy attack beat shoot stab murder burn töten schlagen umbringen tuer frapper matar golpear".split()),
    "target": frozenset("you your yours u he she they him her them du dich dir ihr euch sie tu toi te vous lui eux usted ustedes ti ellos ella él".split()),
    "negation": frozenset("not no never isn't aren't wasn't don't nicht kein keine nie pas jamais aucun ni nunca jamás".split()),
    "report": frozenset("said says wrote quoted called reported sagte schrieb zitierte disait écrit cité dijo escribió citó".split()),
}
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE_END = re.compile(r"[.!?;:\n]")
_REACH = 3  # words within which a target or a negation bears on an insult
_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

Flags = frozenset


@dataclass(frozen=True)
class Transducer:
    """Deterministic: step(state, symbol) gives the next state and the symbol that is passed on.

    A symbol is (class, flags), where the flags are what earlier transducers have found out.
    """

    start: object
    step: object  # Callable[[state, symbol], tuple[state, symbol]]

    def compose(self, other: "Transducer") -> "Transducer":
        """This machine's output is the other's input."""

        def step(state: tuple, symbol: tuple) -> tuple:
            first, passed = self.step(state[0], symbol)
            second, out = other.step(state[1], passed)
            return (first, second), out

        return Transducer((self.start, other.start), step)


def within(trigger: str, marked: tuple[str, ...], flag: str, reach: int | None) -> Transducer:
    """Adds `flag` to symbols of the marked classes up to `reach` words after a trigger (None: any)."""

    def step(left: int, symbol: tuple[str, Flags]) -> tuple[int, tuple[str, Flags]]:
        kind, flags = symbol
        if kind == trigger:
            return (reach if reach is not None else -1), symbol
        out = (kind, flags | {flag}) if left and kind in marked else symbol
        return (left if left < 0 else max(0, left - 1)), out

    return Transducer(0, step)


STEPS = {
    "target": within("target", ("insult",), "target", _REACH),
    "threat": within("threat", ("target",), "threat", _REACH),
    "negation": within("negation", ("insult", "threat", "target"), "negated", _REACH),
    "report": within("report", ("insult", "threat", "target"), "reported", None),
}


def grammar(without: str = "") -> Transducer:
    """The composition of all steps; an ablation leaves one out."""
    machine = Transducer(0, lambda state, symbol: (state, symbol))
    for name, step in STEPS.items():
        if name != without:
            machine = machine.compose(step)
    return machine


@dataclass
class ToxicityModel:
    """Insult entries (`words` whole, `stems` as beginnings), cue words and log-odds of patterns."""

    words: frozenset[str] = frozenset()
    stems: frozenset[str] = frozenset()
    weights: dict[str, float] = field(default_factory=dict)
    base: float = -3.0
    cues: dict[str, frozenset[str]] = field(default_factory=lambda: dict(SEEDS))
    without: str = ""  # a step of the grammar to leave out

    def __post_init__(self) -> None:
        heads = sorted({*self.words, *self.stems, *self.cues["threat"]}, key=len)
        self.search = re.compile(r"(?<![^\W\d_])(?:" + _trie(heads) + ")") if heads else None
        self.machine, self.table = grammar(self.without), {}

    def ablated(self, step: str) -> "ToxicityModel":
        return replace(self, without=step)

    def word_class(self, word: str) -> str:
        if word in self.words or any(word[:k] in self.stems for k in STEMS):
            return "insult"
        return next((kind for kind, listed in self.cues.items() if word in listed), "other")

    def clause_patterns(self, clause: str) -> list[str]:
        state, out = self.machine.start, []
        for word in _WORD.findall(clause):
            key = (state, self.word_class(word))
            if key not in self.table:
                self.table[key] = self.machine.step(state, (key[1], frozenset()))
            state, (kind, flags) = self.table[key]
            if kind == "insult":
                out.append("+".join(["insult", *sorted(flags)]))
            elif kind == "target" and "threat" in flags:
                out.append("+".join(["threat", *sorted(flags - {"threat"})]))
        return out

    def patterns(self, text: str | None) -> Counter:
        """Patterns of all clauses that hold an insult or a threat."""
        found: Counter = Counter()
        if not text or self.search is None:
            return found
        text, done = text.lower(), 0
        for hit in self.search.finditer(text):
            if hit.start() >= done:
                stop = _CLAUSE_END.search(text, hit.start())
                begin, done = _clause_start(text, hit.start()), stop.start() if stop else len(text)
                found.update(self.clause_patterns(text[begin:done]))
        return found

    def score(self, text: str | None) -> float:
        """Log-odds of the heaviest pattern, a little more for each further clause, as a probability."""
        found = self.patterns(text)
        if not found:
            return 1 / (1 + math.exp(-self.base))
        best = max(self.weights.get(p, _prior(p)) for p in found)
        return 1 / (1 + math.exp(-min(30.0, best + 0.1 * math.log(sum(found.values())))))


def _clause_start(text: str, at: int) -> int:
    low = at
    while low > 0:
        step = max(0, low - 256)
        ends = [m.end() for m in _CLAUSE_END.finditer(text, step, low)]
        if ends:
            return ends[-1]
        low = step
    return 0


def _prior(pattern: str) -> float:
    """Log-odds of a pattern that was not seen with labels."""
    weight = 1.5 if pattern.startswith("insult") else 1.2
    return weight + 0.5 * ("target" in pattern) - 2.0 * ("negated" in pattern) - 1.0 * ("reported" in pattern)


def _trie(words: list[str]) -> str:
    """One regular expression for the words, sharing their beginnings."""
    tree: dict = {}
    for word in words:
        node = tree
        for c in word:
            if "" in node:  # a shorter entry matches already
                break
            node = node.setdefault(c, {})
        else:
            node.clear()
            node[""] = {}

    def render(node: dict) -> str:
        branches = [re.escape(c) + render(x) for c, x in sorted(node.items()) if c]
        return "" if not branches else branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"

    return render(tree)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def _labelled(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    return labelled_sample(docs, labels.where(~held_out(F.col("doc_id"))), "toxic", rows, "toxicity").select("text", "toxic")


def clauses(text: str) -> Iterator[list[str]]:
    for clause in _CLAUSE_END.split(text.lower()):
        words = _WORD.findall(clause)
        if words:
            yield words


def plain_entries(words: list[str]) -> dict[str, int]:
    """The words of a clause (marked with =) and their beginnings, but for those that seeds deny or quote, with
    the place where each was seen last."""
    out: dict[str, int] = {}
    denied = -1
    for i, w in enumerate(words):
        if w in SEEDS["report"]:
            break
        if w in SEEDS["negation"]:
            denied = i + _REACH
        elif i > denied:
            out["=" + w] = i
            out.update((w[:k], i) for k in STEMS if len(w) >= k)
    return out


def _distinct_entries(worth: dict[str, int]) -> tuple[frozenset[str], frozenset[str]]:
    """Words and stems by falling worth, leaving out what begins like one that is chosen."""
    chosen: list[str] = []
    for e in sorted(worth, key=lambda e: (-worth[e], -len(e), e)):
        if not any(e.lstrip("=").startswith(c.lstrip("=")) or c.lstrip("=").startswith(e.lstrip("=")) for c in chosen):
            chosen.append(e)
    return frozenset(e[1:] for e in chosen if e[0] == "="), frozenset(e for e in chosen if e[0] != "=")


def _learned_entries(sample: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """Words and stems that mark toxic documents, in surroundings that differ."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
                counts[int(toxic.as_py() == 1)].update({e for words in clauses(text.as_py()) for e in plain_entries(words)})
            keys = list(counts[0].keys() | counts[1].keys())
            columns = [pa.array(keys, pa.string()), *(pa.array([counts[t][k] for k in keys], pa.int64()) for t in (1, 0))]
            yield pa.RecordBatch.from_arrays(columns, names=["entry", "toxic", "clean"])

    counted = materialize(sample.mapInArrow(released(count), "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    good = counted.where((F.col("toxic") >= LEAST_DOCS) & (F.col("toxic") >= LEAST_PRECISION * (F.col("toxic") + F.col("clean"))))
    clean = {r.entry: r.clean for r in good.select("entry", "clean").collect()}  # bounded by the sample

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[str, str, str]] = set()
            for text in batch.column(0):
                for words in clauses(text.as_py()):
                    entries = plain_entries(words)
                    found.update((e, " ".join(words[max(0, i - 2) : i]), " ".join(words[i + 1 : i + 3])) for e, i in entries.items() if e in clean)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in range(3)], names=["entry", "before", "after"])

    toxic = sample.where("toxic = 1").select("text")
    share = (toxic.count() + 1) / (sample.count() + 2)
    chance = math.log(max(1, counted.count()) / CHANCE)
    around = toxic.mapInArrow(released(spread), "entry string, before string, after string").distinct()
    sharing = lambda side: F.count("*").over(Window.partitionBy("entry", side))
    places = around.where("before != '' or after != ''").withColumn("shared", F.greatest(sharing("before"), sharing("after")))
    places = places.where("shared = 1").groupBy("entry").agg(F.count("*").alias("n"))
    found = {r.entry: r.n for r in places.where(F.col("n") >= LEAST_DOCS).collect()}
    return _distinct_entries({e: n - 5 * clean[e] for e, n in found.items() if _surprise(n, clean[e], share) >= chance})


def _surprise(toxic: int, clean: int, share: float) -> float:
    """Logarithm of how unlikely it is that so many of toxic + clean places are toxic, where a share of all is."""
    ways = math.lgamma(toxic + clean + 1) - math.lgamma(toxic + 1) - math.lgamma(clean + 1)
    return -toxic * math.log(share) - ways


def _learned_cues(sample: DataFrame, bare: ToxicityModel) -> dict[str, frozenset[str]]:
    """Cue words by what clauses with them are labelled: words before an insult that make it harmless (near:
    negation, anywhere: report); words before a denied or quoted insult that make it toxic all the same
    (target); without an insult, words before a target that make it toxic (threat)."""

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple] = set()
            for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
                label = int(toxic.as_py() == 1)
                cut = [(words, [bare.word_class(w) for w in words]) for words in clauses(text.as_py())]
                insulted = any("insult" in kinds for _, kinds in cut)
                for words, kinds in cut:
                    clause = " ".join(words)
                    for i, kind in enumerate(kinds):
                        near = range(max(0, i - _REACH), i)
                        if kind == "insult" and ("report" in kinds[:i] or "negation" in kinds[near.start : i]):
                            found.update(("denied", words[j], clause, label) for j in near if kinds[j] == "other")
                        elif kind == "insult":
                            found.update(("near", words[j], clause, label) for j in near if kinds[j] == "other")
                            found.update(("far", words[j], clause, label) for j in range(i - _REACH) if kinds[j] == "other")
                        elif kind == "target" and not insulted:
                            found.update(("threat", words[j], clause, label) for j in near if kinds[j] == "other")
            columns = [pa.array([x[k] for x in found], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x[3] for x in found], pa.int64())], names=["kind", "word", "clause", "toxic"])

    seen = sample.mapInArrow(released(observe), "kind string, word string, clause string, toxic long").withColumn("c", F.xxhash64("clause"))
    totals = seen.groupBy("kind", "word").agg(F.countDistinct("c").alias("n"), F.countDistinct(F.when(F.col("toxic") == 1, F.col("c"))).alias("yes"))
    yes, no = F.col("yes") / F.col("n"), 1 - F.col("yes") / F.col("n")
    told = totals.where((F.col("n") >= CUE_CLAUSES) & F.when(F.col("kind").isin("near", "far"), no >= CUE_SHARE).otherwise(yes >= LEAST_PRECISION)).collect()  # bounded by the sample
    words = {kind: frozenset(r.word for r in told if r.kind == kind) for kind in ("near", "far", "denied", "threat")}
    more = {"threat": words["threat"], "target": words["denied"], "negation": words["near"], "report": words["far"] - words["near"]}
    return {kind: SEEDS[kind] | more[kind] for kind in SEEDS}


def fit_model(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> ToxicityModel:
    """Entries, cues and weights from at most about `rows` labelled documents that are not held out.

    Without labels there is nothing to learn: the model then has the seeds and prior weights. Ties between
    entries go to the longer, then to the first in order of letters. A label without its document and a
    null text or label are left out; of several labels of one id the least counts, and rows alike in id and text
    count once.
    """
    sample = materialize(_labelled(docs, labels, rows))  # read four times
    words, stems = _learned_entries(sample)
    bare = ToxicityModel(words, stems, cues=_learned_cues(sample, ToxicityModel(words, stems)))

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
                found = bare.patterns(text.as_py())
                for p in found or ("none",):
                    counts[p, int(toxic.as_py() == 1)] += 1
            rows_of = list(counts.items())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k, _ in rows_of], pa.string()), pa.array([k[1] for k, _ in rows_of], pa.int64()), pa.array([v for _, v in rows_of], pa.int64())],
                names=["pattern", "toxic", "n"],
            )

    totals = sample.mapInArrow(released(patterns), "pattern string, toxic long, n long").groupBy("pattern").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("yes"), F.sum("n").alias("n")
    )
    weights = {}
    for r in totals.collect():  # a dozen patterns exist
        prior = 0.05 if r.pattern == "none" else 1 / (1 + math.exp(-_prior(r.pattern)))
        share = (r.yes + 2 * prior) / (r.n + 2)
        weights[r.pattern] = math.log(share / (1 - share))
    base = min(-0.5, weights.pop("none", -3.0))
    return ToxicityModel(words, stems, weights, base, bare.cues)


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Score of each row's whole text; a null or empty text has the score of a text without patterns.

    Repeated rows and null ids stay; other columns are not read; an empty table gives no rows. A very long
    text is lower-cased once, and only its clauses with an entry are read.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], schema=_SCORED)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(score), "doc_id long, score double")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic; null and empty texts stay.

    Each row is judged by its own text, so repeated rows and ids need no join, and other columns stay as
    they are. An empty table gives no rows.
    """
    small_batches(spark)
    model, at = fit_model(docs, table(spark, sf_dir, "labels")), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(t.as_py()) < 0.5 for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(released(keep), docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
