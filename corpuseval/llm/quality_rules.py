"""Quality rules: a decision list learned from labelled statistics and emitted as one ordered conditional expression.

The statistics of a text are DataFrame expressions over its words and lines. Sequential covering learns rules for bad
texts from a bounded sample of labelled rows: a rule grows by the threshold test with the best gain in information, is
pruned on rows held back, and takes its texts out before the next one grows. The rules become
``CASE WHEN test AND test THEN 1 WHEN ... END``; a text that meets none is kept.

Everything on rows is built-in functions. Only the sample's statistics (at most three times ``sample`` rows of numbers) come
to the driver, where the rules are learned.

Defined cases: a null, empty or wordless text has all statistics 0 and fails the base test; a null id and repeated rows are
judged like any others, one row each; without usable labels no rule is learned and the base test decides alone; several
labels of an id count as bad if one of them is; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuseval.functions.once import compute_once, let

BLANK = r"[\x20\x09-\x0D]+"
WINDOW = 5
FEATURES = [
    "n_words", "word_length", "symbols", "dup_lines", "repeated", "distinct", "adjacent", "capitals", "digits", "marks",
]


def _covered(words: Column) -> Column:
    """How many words stand in a window of five that occurs twice or more in the text."""
    spots = F.sequence(F.lit(0), F.size(words) - WINDOW)
    hashes = let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda each: F.transform(spots, lambda i: F.xxhash64(*[F.get(each, (i + k).cast("int")) for k in range(WINDOW)])),
    )

    def marked(hashed: Column) -> Column:
        order = F.sort_array(F.transform(hashed, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def found(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            twice = F.filter(s, lambda x, j: F.when(j > 0, same(x, j - 1)).otherwise(False) | same(x, j + 1))
            start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
            return F.aggregate(
                F.sort_array(F.transform(twice, lambda x: x["i"])),
                start,
                lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")),
                lambda a: a["n"],
            )

        return F.when(F.size(F.array_distinct(hashed)) < F.size(hashed), let(order, found)).otherwise(0)

    return F.when(F.size(words) >= WINDOW, let(hashes, marked)).otherwise(0)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the five base statistics (bigint) and the features of the rules (double)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"))
    rows = compute_once(rows, "words", F.filter(F.split("text", BLANK), lambda w: w != ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    line_counts = let(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("distinct")))
    words = F.col("words")
    pairs = F.filter(words, lambda w, i: F.coalesce(F.get(words, i + 1) == w, F.lit(False)))
    counted = rows.select(
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        line_counts.alias("lines"),
        _covered(words).cast("bigint").alias("n_repeat_words"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        F.size(pairs).alias("n_adjacent"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).alias("n_capitals"),
        F.regexp_count("text", F.lit(r"[0-9]")).alias("n_digits"),
        F.regexp_count("text", F.lit(r"[!?|]")).alias("n_marks"),
    )
    per = lambda n, of: F.coalesce(F.try_divide(F.col(n).cast("double"), F.col(of)), F.lit(0.0))
    return counted.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.col("lines.all") - F.col("lines.distinct")).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words",
        F.struct(
            F.col("n_words").cast("double").alias("n_words"),
            per("word_chars", "n_words").alias("word_length"),
            per("n_symbols", "n_words").alias("symbols"),
            F.coalesce(1 - F.try_divide(F.col("lines.distinct").cast("double"), F.col("lines.all")), F.lit(0.0)).alias("dup_lines"),
            per("n_repeat_words", "n_words").alias("repeated"),
            per("n_distinct", "n_words").alias("distinct"),
            per("n_adjacent", "n_words").alias("adjacent"),
            per("n_capitals", "word_chars").alias("capitals"),
            per("n_digits", "word_chars").alias("digits"),
            per("n_marks", "n_words").alias("marks"),
        ).alias("features"),
    )


@dataclass
class Rule:
    """A conjunction of tests (feature, is at least, threshold)."""

    tests: list[tuple[int, bool, float]]

    def meets(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for f, least, value in self.tests:
            out &= x[:, f] >= value if least else x[:, f] < value
        return out

    def expression(self) -> Column:
        test = F.lit(True)
        for f, least, value in self.tests:
            column = F.col(f"features.{FEATURES[f]}")
            test = test & (column >= value if least else column < value)
        return test


def _grow(x: np.ndarray, bad: np.ndarray, most: int = 4, cuts: int = 48) -> Rule:
    rule, inside = Rule([]), np.ones(len(x), dtype=bool)
    while len(rule.tests) < most and (inside & ~bad).any() and (inside & bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        best, best_gain = None, 0.0
        for f in range(x.shape[1]):
            values = np.unique(np.quantile(x[inside, f], np.linspace(0, 1, cuts)))
            values = np.unique(np.concatenate([values, np.quantile(x[inside & bad, f], np.linspace(0, 1, 12))]))
            for value in values[1:]:
                above = x[:, f] >= value
                for least in (True, False):
                    meets = inside & (above if least else ~above)
                    p, n = (meets & bad).sum(), (meets & ~bad).sum()
                    if p:
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if gain > best_gain:
                            best, best_gain, best_rows = (f, least, float(value)), gain, meets
        if best is None:
            break
        rule.tests.append(best)
        inside = best_rows
    return rule


def _worth(rule: Rule, x: np.ndarray, bad: np.ndarray) -> float:
    meets = rule.meets(x)
    p, n = (meets & bad).sum(), (meets & ~bad).sum()
    return (p - n) / (p + n) if p + n else -1.0


def learn_rules(x: np.ndarray, bad: np.ndarray, most: int = 12, precision: float = 0.8, least: int = 3) -> list[Rule]:
    """Rules for bad rows, in the order in which they are to be tried."""
    rules: list[Rule] = []
    held = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), dtype=bool)
    while len(rules) < most and (left & bad & ~held).sum() >= least:
        rule = _grow(x[left & ~held], bad[left & ~held])
        kept, kept_bad = x[left & held], bad[left & held]
        while len(rule.tests) > 1 and _worth(Rule(rule.tests[:-1]), kept, kept_bad) >= _worth(rule, kept, kept_bad):
            rule = Rule(rule.tests[:-1])
        meets = rule.meets(x) & left
        if not rule.tests or (meets & bad).sum() < max(least, precision * meets.sum()):
            break
        rules.append(rule)
        left &= ~meets
    return rules


def decision(rules: list[Rule]) -> Column:
    """Number of the first rule met, from 1; null if there is none."""
    out = F.lit(None).cast("int")
    for i in range(len(rules), 0, -1):
        out = F.when(rules[i - 1].expression(), F.lit(i)).otherwise(out)
    return out


def labelled_statistics(docs: DataFrame, labels: DataFrame, label: str, sample: int, **names: str) -> DataFrame:
    """Statistics of about ``sample`` labelled rows, chosen by the hash of their id, with the label's smallest value."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias("label"))
    share = max(1, labels.count() // sample)
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).limit(3 * sample)  # its share is below 2 x sample
    rows = docs.select(F.col(names["id_col"]).cast("bigint").alias("doc_id"), F.col(names["text_col"]).alias("text"))
    return statistics(rows.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")).join(F.broadcast(chosen), "doc_id")


def apply_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 9_000
) -> DataFrame:
    """doc_id, base statistics, base_failed, kept, and the number of the rule met (null: none)."""
    rows = labelled_statistics(docs, labels, "quality", sample, id_col=id_col, text_col=text_col).select(
        "doc_id", "label", "features.*"
    )
    learned = rows.orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).collect()
    x = np.array([[r[f] for f in FEATURES] for r in learned]).reshape(len(learned), len(FEATURES))
    rules = learn_rules(x, np.array([r.label == 0 for r in learned], dtype=bool))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = compute_once(statistics(docs, id_col, text_col), "rule", decision(rules))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("rule").isNull()).alias("kept"), "rule",
    )
