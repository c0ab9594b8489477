"""Quality rules: text statistics in built-in functions, and a learned decision list over them.

Sequential covering grows a conjunction of thresholds on two thirds of the labelled sample, prunes it
on the rest, keeps it if it is precise there, and goes on with the rows that it does not cover. The
rules become one ordered chain of `when`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward.llm.common import labelled_sample, table

SEPARATORS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: At most about so many labelled rows are used to fit the rules; they are chosen by a hash of the id.
FIT_ROWS = 20_000
FEATURES = ("n_words", "mean_word_chars", "symbol_share", "dup_line_share", "repeat_word_share")


def bind(value: Column, body) -> Column:
    """body(value) with `value` computed once for a row, however often `body` uses it."""
    return F.transform(F.array(value), body)[0]


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window whose words occur at least twice in the text."""

    def covered(positions: Column) -> Column:
        gaps = F.aggregate(F.sequence(F.lit(1), F.size(positions) - 1), F.lit(0), lambda n, j: n + F.least(F.lit(3), F.get(positions, j) - F.get(positions, j - 1)))
        return F.when(F.size(positions) == 0, 0).when(F.size(positions) == 1, 3).otherwise(gaps + 3)

    def twice(ordered: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(ordered, k)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(ordered, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

    def of_hashes(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(bind(ordered, lambda o: bind(twice(o), covered)))

    def of_words(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(2), F.size(w) - 1), lambda i: F.xxhash64(F.get(w, i - 2), F.get(w, i - 1), F.get(w, i)))
        return F.when(F.size(w) < 3, 0).otherwise(bind(hashes, of_hashes))

    return bind(words, of_words)


def text_statistics(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """`keep` and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (all long)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SEPARATORS, "") != "")
    words = bind(word_list(text), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r")))
    line_counts = bind(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    return docs.select(
        *keep,
        words.alias("_words"),
        line_counts.alias("_lines"),
        F.length(F.translate(text, SEPARATORS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    ).select(
        *keep,
        F.col("_words.n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("_lines.n").cast("long").alias("n_lines"),
        F.col("_lines.d").cast("long").alias("n_dup_lines"),
        F.col("_words.r").cast("long").alias("n_repeat_words"),
    )


def feature_columns() -> dict[str, Column]:
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word_chars": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_word_share": share("n_repeat_words", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # True: value > threshold, False: value <= threshold
    threshold: float

    def holds(self, row: dict) -> bool:
        return (row[self.feature] > self.threshold) == self.above

    def column(self, features: dict[str, Column]) -> Column:
        value = features[self.feature]
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Condition, ...]


def learn_rules(rows: list[dict], features: Sequence[str] = FEATURES, steps: int = 24, precision: float = 0.9, least: int = 5, most_rules: int = 16) -> list[Rule]:
    """Ordered rules for rows with `bad` true. `rows` have the features and `fold` (2: pruning)."""
    grow, prune = [r for r in rows if r["fold"] != 2], [r for r in rows if r["fold"] == 2]
    rules: list[Rule] = []
    while len(rules) < most_rules:
        if sum(r["bad"] for r in grow) < least:
            break
        rule = _pruned(_grown(grow, features, steps), prune)
        covered = [r for r in prune if all(c.holds(r) for c in rule)]
        hits = sum(r["bad"] for r in covered)
        if not rule or hits < least or hits < precision * len(covered):
            break
        rules.append(rule)
        grow, prune = ([r for r in part if not all(c.holds(r) for c in rule)] for part in (grow, prune))
    return rules


def _grown(rows: list[dict], features: Sequence[str], steps: int) -> Rule:
    """Add the condition of the highest information gain until no clean row is covered."""
    rule: list[Condition] = []
    while True:
        bad = [r for r in rows if r["bad"]]
        if not bad or len(bad) == len(rows) or len(rule) >= 4:
            return tuple(rule)
        base, best, chosen = math.log2(len(bad) / len(rows)), 0.0, None
        for name in features:
            ordered = sorted((r[name], r["bad"]) for r in rows)
            total_bad, seen_bad, cuts = len(bad), 0, {len(ordered) * k // steps for k in range(1, steps)}
            among_bad = sorted(r[name] for r in bad)
            values = {among_bad[len(among_bad) * k // steps] for k in range(steps)} | {among_bad[0], among_bad[-1]}
            for i, (value, is_bad) in enumerate(ordered):
                seen_bad += is_bad
                if i + 1 < len(ordered) and ordered[i + 1][0] != value and (i in cuts or value in values or ordered[i + 1][0] in values):
                    threshold = (value + ordered[i + 1][0]) / 2
                    for above, p, n in ((False, seen_bad, i + 1), (True, total_bad - seen_bad, len(ordered) - i - 1)):
                        if p and (gain := p * (math.log2(p / n) - base)) > best + 1e-9:
                            best, chosen = gain, Condition(name, above, threshold)
        if chosen is None:
            return tuple(rule)
        rule.append(chosen)
        rows = [r for r in rows if chosen.holds(r)]


def _pruned(rule: Rule, rows: list[dict]) -> Rule:
    """The beginning of the rule that is worth most on rows it was not grown on."""

    def worth(r: Rule) -> float:
        covered = [x for x in rows if all(c.holds(x) for c in r)]
        bad = sum(x["bad"] for x in covered)
        return (2 * bad - len(covered)) / len(covered) if covered else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=())


def rules_column(rules: Sequence[Rule]) -> Column:
    """Ordered conditional expression: false for the first rule that holds, else true."""
    features, chain = feature_columns(), F
    for rule in rules:
        met = F.lit(True)
        for condition in rule:
            met = met & condition.column(features)
        chain = chain.when(met, F.lit(False))
    return chain.otherwise(F.lit(True)) if rules else F.lit(True)


def fit_rules(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> list[Rule]:
    """Rules from at most about `rows` labelled documents (label quality 0 is bad) that pass the base test.

    Of several labels of one id the least counts, rows alike in id and text count once, and null ids, texts and
    labels are left out. Of conditions of equal gain the first by feature, then by threshold, then the one
    below it is taken.
    """
    labelled = labelled_sample(docs, labels, "quality", rows, "rules")
    part = F.crc32(F.concat(F.lit("rules"), F.col("doc_id").cast("string")))
    found = text_statistics(labelled, keep=("doc_id", "quality")).select(
        *[c.alias(name) for name, c in feature_columns().items()],
        (F.col("quality") == 0).alias("bad"),
        F.pmod(part, F.lit(3)).alias("fold"),
        base_failed().alias("failed"),
    )
    # Rows are left out here, not by a filter, which would be pushed below the join and so be worked out
    # for every document.
    return learn_rules([r.asDict() for r in found.collect() if not r.failed])


def base_failed() -> Column:
    """Too few words, or most of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge_documents(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Statistics and verdicts, one row per input row.

    A null or empty text has zero words and fails the base test. Repeated rows and ids stay; other
    columns are not read; an empty table gives no rows. The statistics of a text of any length are
    linear in it but for one sort.
    """
    judged = text_statistics(docs).withColumn("base_failed", base_failed())
    return judged.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(rules_column(rules)))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge_documents(docs, fit_rules(docs, table(spark, sf_dir, "labels"))).drop("n_lines")
