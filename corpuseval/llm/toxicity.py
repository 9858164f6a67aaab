"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become classes: insult, threat, target, negation, reported speech, other. Five small transducers read the classes of
a clause: one each for insults, threats and targets, one that marks an insult or threat shortly after a negation, one that
marks those after a word of reporting. Their composition is one state table; the state in which a clause ends says what
kind of clause it is, and a text's score is a logistic sum over its clauses' kinds. A word outside a clause pattern counts
for nothing.

The lexicon and the weights are learned. Insults are words, or word beginnings of 4 to 8 letters, found in labelled texts:
candidates need a minimal support and precision, then greedy covering keeps those that explain toxic texts not explained
yet, so words that merely share a text with an insult stay out; words that are well supported and all but always toxic
are added. Weights come from a logistic regression on clause kinds.
Both use a bounded sample of labelled training texts (``sample`` labels by the hash of their id). Threat, target, negation
and reporting words are fixed lists.

Defined cases: a null, empty or wordless text gets the score of a text without matched clauses; without any usable label
the score is 0; a null id is a training row but has no label; repeated rows are scored one by one; several labels of an id
count as toxic if one of them is; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuseval.llm.units import chunks, coded, frugal, split_units, spread, text_bytes
from corpuseval.session import ship_package

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
# Common words of English, German, French and Spanish.
WORDS = {
    THREAT: "kill hurt destroy beat burn punish tuer frapper töten schlagen vernichten matar golpear destruir",
    TARGET: "you your yours du dich dir dein deine euch tu vous ton votre vos tú usted ustedes vosotros",
    NEGATION: "not never no isn't aren't don't nicht kein keine nie pas jamais aucun nunca jamás ningún",
    REPORT: "said says say quoted called wrote claimed sagte sagt schrieb dit disait écrit dijo dice escribió",
}
PREFIXES = (4, 5, 6, 7, 8)
CLAUSE_END = r"[.!?;:…]['\")\]]*$"
KINDS = 7  # insult, targeted, negated, reported, threat at a target, threat alone, clauses of an insult beyond the first


def _machines() -> list[tuple[np.ndarray, str]]:
    """Transition tables (states x classes) with their names; state 0 starts."""
    seen = lambda c: np.array([[int(k == c) for k in range(6)], [1] * 6])
    negation = np.zeros((5, 6), dtype=np.int64)  # 0 none, 1 to 3 words since a negation, 4 negated
    for state in range(4):
        negation[state] = [state + 1 if 0 < state < 3 else 0] * 6
        negation[state, NEGATION] = 1
        if state:
            negation[state, [INSULT, THREAT]] = 4
    negation[4] = 4
    report = np.array([[0, 0, 0, 0, 0, 1], [1, 2, 2, 1, 1, 1], [2] * 6])
    return [(seen(INSULT), "insult"), (seen(THREAT), "threat"), (seen(TARGET), "target"), (negation, "negated"), (report, "reported")]


@dataclass
class Grammar:
    """The composed machine: next state by (state, class), and the kinds in which a state ends."""

    step: np.ndarray
    kinds: np.ndarray

    @classmethod
    def composed(cls) -> Grammar:
        machines = _machines()
        sizes = [len(table) for table, _ in machines]
        states = list(np.ndindex(*sizes))
        step = np.zeros((len(states), 6), dtype=np.int64)
        kinds = np.zeros((len(states), KINDS))
        for s, parts in enumerate(states):
            for c in range(6):
                step[s, c] = np.ravel_multi_index([t[p, c] for (t, _), p in zip(machines, parts, strict=True)], sizes)
            insult, threat, target, negated, reported = parts
            kinds[s, :6] = [insult, insult and target, insult and negated == 4, insult and reported == 2, threat and target, threat]
        return cls(step, kinds)

    def read(self, classes: np.ndarray) -> np.ndarray:
        state = 0
        for c in classes.tolist():
            state = self.step[state, c]
        return self.kinds[state]


def _core(units: pa.StringArray) -> pa.Array:
    """Lower-case word without the marks around it."""
    return pc.replace_substring_regex(pc.utf8_lower(units), r"^[^\pL\pN]+|[^\pL\pN]+$", "")


def classify(cores: pa.Array, insults: list[str]) -> np.ndarray:
    """Class of each word; an insult ending in * is a word beginning."""
    out = np.zeros(len(cores), dtype=np.int64)

    def mark(values: pa.Array, words: list[str], kind: int) -> None:
        if words:
            out[pc.is_in(values, value_set=pa.array(words)).to_numpy(zero_copy_only=False)] = kind

    for kind, words in WORDS.items():
        mark(cores, words.split(), kind)
    mark(cores, [w for w in insults if not w.endswith("*")], INSULT)
    for size in PREFIXES:
        mark(pc.utf8_slice_codeunits(cores, 0, size), [w[:-1] for w in insults if w.endswith("*") and len(w) == size + 1], INSULT)
    return out


def clause_kinds(column: pa.Array, insults: list[str], grammar: Grammar) -> np.ndarray:
    """How many clauses of each kind each text has."""
    units, of_text = split_units(*text_bytes(column))
    counts = np.zeros((len(column), KINDS))
    codes, names = coded(units)
    if not len(names):
        return counts
    classes = classify(_core(names), insults)[codes]
    ends = pc.match_substring_regex(names, CLAUSE_END).to_numpy(zero_copy_only=False)[codes]
    ends[of_text[1:][of_text[1:] > 0] - 1] = True
    last = np.flatnonzero(ends)
    hits = np.flatnonzero((classes == INSULT) | (classes == THREAT))
    texts = spread(of_text)
    for clause in np.unique(np.searchsorted(last, hits)):
        begin = last[clause - 1] + 1 if clause else 0
        counts[texts[begin]] += grammar.read(classes[begin : last[clause] + 1])
    counts[:, 6] = np.maximum(counts[:, 0] - 1, 0)
    return counts


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word or word beginning, toxic texts that have it, all texts that have it) of a chunk."""
    for part in chunks(batches, 0):
        toxic = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        units, of_text = split_units(*text_bytes(part.column(0)))
        codes, names = coded(units)
        rows, cores = spread(of_text), _core(names)
        for size in (0, *PREFIXES):
            own, words = coded(pc.utf8_slice_codeunits(cores, 0, size).cast(pa.string()) if size else cores)
            if not len(words):
                continue
            enough = pc.greater_equal(pc.utf8_length(words), max(size, 2)).to_numpy(zero_copy_only=False)
            pairs = np.unique(own[codes].astype(np.int64) * part.num_rows + rows)
            word, text = pairs // part.num_rows, pairs % part.num_rows
            every = np.bincount(word, minlength=len(words))
            bad = np.bincount(word, weights=toxic[text], minlength=len(words)).astype(np.int64)
            shown = pc.binary_join_element_wise(words, "*" if size else "", "")
            keep = pa.array(enough)
            yield pa.RecordBatch.from_arrays(
                [shown.filter(keep), pa.array(bad).filter(keep), pa.array(every).filter(keep)], names=["word", "bad", "n"]
            )


def _matches(candidates: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Which candidates each text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(candidates)
        for part in chunks(batches, 0):
            units, of_text = split_units(*text_bytes(part.column(0)))
            codes, names = coded(units)
            rows, cores, found = spread(of_text), _core(names), [np.zeros(0, dtype=np.int64)]
            for size in (0, *PREFIXES):
                words = pc.binary_join_element_wise(pc.utf8_slice_codeunits(cores, 0, size), "*", "") if size else cores
                at = pc.index_in(words, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)[codes]
                found.append(rows[at >= 0] * len(candidates) + at[at >= 0])
            pairs = np.unique(np.concatenate(found))
            of_row = pairs // max(len(candidates), 1)
            ends = np.searchsorted(of_row, np.arange(part.num_rows + 1))
            lists = pa.ListArray.from_arrays(ends.astype(np.int32), pa.array((pairs % max(len(candidates), 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(1), lists], names=["toxic", "has"])

    return run


def cover(toxic: list[list[int]], clean: list[list[int]], candidates: list[str], least: int = 2) -> list[str]:
    """Greedy covering of toxic texts; a candidate found in clean texts pays for them."""
    left = [set(x) for x in toxic]
    cost = np.bincount([c for x in clean for c in x], minlength=len(candidates)) * 3
    chosen: list[str] = []
    while True:
        gain = np.bincount([c for x in left for c in x], minlength=len(candidates)) - cost
        if not len(gain) or gain.max() < least:
            return chosen
        best = int(gain.argmax())
        chosen.append(candidates[best])
        left = [x for x in left if best not in x]


def certain(counted: list[tuple[str, float, int]], chosen: list[str], support: int = 8, precision: float = 0.99) -> list[str]:
    """Words and beginnings that are all but always toxic and well supported, though others explain their texts."""
    added: list[str] = []
    stems = tuple(w[:-1] for w in chosen if w.endswith("*"))
    for word, share, n in sorted(counted, key=lambda x: (len(x[0]), x[0])):
        if share >= precision and n >= support and word not in chosen and not (stems and word.startswith(stems)):
            added.append(word)
            if word.endswith("*"):
                stems += (word[:-1],)
    return added


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 40, ridge: float = 1.0) -> np.ndarray:
    """Weights (the last is the intercept) by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _clauses(insults: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar.composed()
        for part in chunks(batches, 0):
            kinds = clause_kinds(part.column(0), insults, grammar)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(kinds.ravel()), KINDS).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column(1), lists], names=["toxic", "kinds"])

    return run


@dataclass
class Model:
    insults: list[str]
    weights: np.ndarray | None


def learn(docs: DataFrame, labels: DataFrame, sample: int = 12_000, support: int = 3, precision: float = 0.7) -> Model:
    """Lexicon and weights from labelled rows (doc_id, text) x (doc_id, toxic)."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = max(1, labels.count() // sample)
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).limit(3 * sample)  # its share is below 2 x sample
    texts = docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    counted = [
        (r.word, r.bad / r.n, r.n)
        for r in texts.mapInArrow(frugal(_features), "word string, bad bigint, n bigint")
        .groupBy("word")
        .agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
        .where((F.col("bad") >= support) & (F.col("bad") >= precision * F.col("n")))
        .orderBy(F.desc("bad"), "word")
        .limit(2000)
        .collect()
    ]
    candidates = [word for word, _, _ in counted]
    found = texts.mapInArrow(frugal(_matches(candidates)), "toxic int, has array<int>").where("size(has) > 0").collect() if candidates else []
    insults = cover([r.has for r in found if r.toxic == 1], [r.has for r in found if r.toxic != 1], candidates)
    insults += certain(counted, insults)
    rows = (
        texts.mapInArrow(frugal(_clauses(insults)), "toxic int, kinds array<double>").groupBy("toxic", "kinds").count().collect()
    )  # few distinct rows
    if not rows:
        return Model(insults, None)
    x = np.array([r.kinds for r in rows])
    y, n = np.array([float(r.toxic == 1) for r in rows]), np.array([r["count"] for r in rows])
    return Model(insults, logistic(np.repeat(_scaled(x), n, axis=0), np.repeat(y, n)))


def _scaled(kinds: np.ndarray) -> np.ndarray:
    return np.minimum(kinds, 1)


def _scores(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar.composed()
        for part in chunks(batches, 1):
            score = np.zeros(part.num_rows)
            if model.weights is not None:
                x = _scaled(clause_kinds(part.column(1), model.insults, grammar))
                score = 1 / (1 + np.exp(-np.clip(x @ model.weights[:-1] + model.weights[-1], -30, 30)))
            arrays = [part.column(0), part.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), *part.columns[3:]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "score", "predicted", *part.schema.names[3:]])

    return run


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 5,
    held_out_fold: int = 0,
    sample: int = 12_000,
    row_col: str | None = None,
) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.5); with ``row_col``, a bigint that tells rows apart, also row_key."""
    ship_package(docs.sparkSession)
    key = F.col(id_col).cast("bigint")
    out = F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(folds)) == held_out_fold, F.lit(False))
    row = [F.col(row_col).cast("bigint").alias("row_key")] if row_col else []
    texts = docs.select(key.alias("doc_id"), F.col(text_col).alias("text"), out.alias("held_out"), *row)
    train = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) != held_out_fold
    usable = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "toxic").where(train)
    model = learn(texts.select("doc_id", "text"), usable, sample)
    return texts.mapInArrow(frugal(_scores(model)), "doc_id bigint, held_out boolean, score double, predicted int" + (", row_key bigint" if row_col else ""))
