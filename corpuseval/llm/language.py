"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram binds its letters' vectors, the first permuted twice and the
second once, by element-wise product; a text bundles its trigrams by addition; a language's prototype bundles all its
training texts. A text gets the language of the prototype with the largest cosine.

Bundling is linear, so a text's product with a prototype is the sum of its trigrams' products, which are tabled once per
process. A text's length is taken from its trigram counts, random vectors being nearly orthogonal; it is the same for
every language and so never changes the choice. Prototypes are partial sums by task, summed by (language, dimension):
what reaches the driver is one number for each of them, whatever the input.

Letters are the 26 of ASCII and 37 shared by all others (by a hash); anything else separates words.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is everything when no training text has a
language; a null id is a training text; repeated rows are kept and predicted one by one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuseval.llm.units import chunks, text_bytes
from corpuseval.session import ship_package

LETTERS, DIMENSIONS, SEED = 64, 2048, 2024
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letter_codes() -> np.ndarray:
    """0 for what is no letter; by code point below 0x10000."""
    codes = np.zeros(0x10000, dtype=np.int32)
    for point in range(0x10000):
        if 0xD800 <= point < 0xE000:
            continue
        letter = chr(point).lower()[:1]
        if letter.isalpha():
            codes[point] = ord(letter) - 96 if "a" <= letter <= "z" else 27 + ord(letter) * 2654435761 % 4294967296 % 37
    return codes


@lru_cache(maxsize=1)
def _letter_vectors() -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], dtype=np.int8), size=(LETTERS, DIMENSIONS))


def bound(trigrams: np.ndarray) -> np.ndarray:
    """Vectors of trigram codes."""
    v = _letter_vectors()
    first, second = np.roll(v, 2, axis=1), np.roll(v, 1, axis=1)
    return first[trigrams >> 12] * second[trigrams >> 6 & 63] * v[trigrams & 63]


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram codes, row of each, whether each row has a letter). Every letter ends one, as does each word."""
    data, bounds = text_bytes(column)
    n = len(column)
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(n, dtype=bool)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
    symbols = _letter_codes()[np.minimum(points, 0xFFFF)]
    for at in np.flatnonzero(points > 0xFFFF):
        symbols[at] = 27 + int(points[at]) * 2654435761 % 4294967296 % 37 if chr(points[at]).isalpha() else 0
    rows = np.repeat(np.arange(n), np.diff(before))
    keep = symbols > 0
    letters = np.bincount(rows[keep], minlength=n) > 0
    keep[1:] |= (symbols[:-1] > 0) & (rows[1:] == rows[:-1])
    symbols, rows = symbols[keep], rows[keep]
    codes = symbols.astype(np.int64)
    codes[1:] += np.where(rows[1:] == rows[:-1], symbols[:-1], 0) << 6
    codes[2:] += np.where(rows[2:] == rows[:-2], symbols[:-2], 0) << 12
    return codes, rows, letters


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sum for each language, one row per dimension."""
    counts: dict[str, np.ndarray] = {}
    for part in chunks(batches, 0):
        codes, rows, _ = trigrams(part.column(0))
        langs = part.column(1).dictionary_encode()
        of_row = langs.indices.to_numpy(zero_copy_only=False)
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            own = np.bincount(codes[of_row[rows] == k], minlength=LETTERS**3)
            counts[lang] = counts.get(lang, 0) + own
    for lang, n in counts.items():
        total, used = np.zeros(DIMENSIONS), np.flatnonzero(n)
        for at in range(0, len(used), 4096):
            some = used[at : at + 4096]
            total += n[some].astype(np.float64) @ bound(some).astype(np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * DIMENSIONS), pa.array(np.arange(DIMENSIONS)), pa.array(total)], names=["lang", "dimension", "value"]
        )


_TABLES: dict[bytes, np.ndarray] = {}


def products(prototypes: np.ndarray) -> np.ndarray:
    """Product of every trigram's vector with every prototype (of length 1); kept for the process."""
    key = prototypes.tobytes()
    if key not in _TABLES:
        v = _letter_vectors().astype(np.float32)
        first, second = np.roll(v, 2, axis=1), np.roll(v, 1, axis=1)
        table = np.zeros((LETTERS, LETTERS, LETTERS, len(prototypes)), dtype=np.float32)
        for k, p in enumerate(prototypes.astype(np.float32)):
            for a in range(LETTERS):
                table[a, :, :, k] = (second * (first[a] * p)) @ v.T
        _TABLES.clear()
        _TABLES[key] = table.reshape(-1, len(prototypes))
    return _TABLES[key]


def _predict(names: list[str], prototypes: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = products(prototypes) if names else None
        for part in chunks(batches, 1):
            codes, rows, letters = trigrams(part.column(1))
            n = part.num_rows
            langs, scores = np.array([UNKNOWN] * n, dtype=object), np.zeros(n)
            if names and len(codes):
                ends = np.searchsorted(rows, np.arange(n + 1))
                used = np.flatnonzero(np.diff(ends))
                dots = np.add.reduceat(table[codes], ends[used], axis=0, dtype=np.float64)
                pairs, times = np.unique(rows * LETTERS**3 + codes, return_counts=True)
                squares = np.bincount(pairs // LETTERS**3, weights=times.astype(np.float64) ** 2, minlength=n)[used]
                cosines = dots / np.sqrt(squares * DIMENSIONS)[:, None]
                best = cosines.argmax(axis=1)
                good = letters[used]
                langs[used[good]] = np.array(names, dtype=object)[best[good]]
                scores[used[good]] = np.clip(cosines[np.arange(len(best)), best], 0, 1)[good]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(langs, pa.string()), pa.array(scores)],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def predict_language(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    folds: int = 3,
    held_out_fold: int = 1,
) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the cosine, 0 to 1)."""
    ship_package(docs.sparkSession)
    key = F.col(id_col).cast("bigint")
    out = F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(folds)) == held_out_fold, F.lit(False))
    texts = docs.select(
        key.alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), out.alias("held_out")
    )
    learned = (
        texts.where(~F.col("held_out") & F.col("lang").isNotNull())
        .select("text", "lang")
        .mapInArrow(_bundles, "lang string, dimension bigint, value double")
        .groupBy("lang", "dimension")
        .agg(F.sum("value").alias("value"))
        .collect()  # one number for each language and dimension
    )
    found: dict[str, np.ndarray] = {}
    for row in learned:
        found.setdefault(row.lang, np.zeros(DIMENSIONS))[row.dimension] = row.value
    names = sorted(lang for lang, v in found.items() if v.any())
    prototypes = np.array([found[lang] / np.linalg.norm(found[lang]) for lang in names]).round(9)
    columns = texts.select("doc_id", "text", "held_out")
    return columns.mapInArrow(_predict(names, prototypes), "doc_id bigint, held_out boolean, lang_pred string, score double")
