"""Benchmark decontamination by the q-gram lemma: diagonal bands of shared character q-grams, then banded alignment.

Benchmark texts and documents are lower-cased with white space as single spaces. A benchmark text is searched as passages of
at most ``passage`` characters, every half passage, and as ones of ``short`` characters, every quarter; so a verbatim part of
``short * 5 / 4`` characters is found wherever it is cut. Edits are those of the best long passage found, or else of the best
short one. A passage of m
characters with at most k = floor(rate x m) edits shares at least m - q + 1 - k q of its q-grams with its copy, on diagonals
that lie within k + 1 of each other. Shared q-grams are counted by (document, passage, band); bands are 2 (k + 1) diagonals
wide and overlap by half, so every copy lies whole in one. Bands with enough q-grams are aligned: an edit-distance table of
the band's width, all bands of a chunk at a time.

The passages' q-gram index goes to every task. It is built from blocks of the benchmark of about ``block_chars`` characters,
each block scanned on its own, so what a task holds is bounded however long the benchmark is.

Defined cases: null and empty texts match nothing; benchmark texts of fewer than ``min_chars`` normalised characters are too
short to identify a text and are not searched; repeated benchmark rows and repeated documents each give their own rows;
null ids are kept as they are; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuseval.llm.units import chunks, frugal, gather, text_bytes
from corpuseval.session import ship_package

Q = 12
BASE = np.uint64(0x100000001B3)
MIX = np.uint64(0x9E3779B97F4A7C15)
SIEVE_BITS = 22
CHUNK = 2 << 20
FAR = 1 << 20


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """Lower case of code points below 0x10000 where it is one character; white space is a space."""
    out = np.arange(0x10000, dtype=np.uint32)
    for point in range(0x10000):
        if not 0xD800 <= point < 0xE000:
            c = chr(point)
            low = c.lower()
            out[point] = 32 if c.isspace() else ord(low) if len(low) == 1 and ord(low) < 0x10000 else point
    return out


def normal(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters of all texts, bounds of each, place of each character in its original text)."""
    data, bounds = text_bytes(column)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    ends = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
    folded = np.where(points < 0x10000, _folded()[np.minimum(points, 0xFFFF)], points)
    keep = folded != 32
    inner = np.ones(len(points), dtype=bool)
    inner[ends[:-1][ends[:-1] < ends[1:]]] = False
    keep[1:] |= (folded[:-1] != 32) & inner[1:]
    place = (np.arange(len(points)) - np.repeat(ends[:-1], np.diff(ends)))[keep]
    return folded[keep], np.concatenate([[0], np.cumsum(keep)])[ends], place


def _grams(text: np.ndarray) -> np.ndarray:
    n = len(text) - Q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(Q):
        h *= BASE
        h += text[k : k + n]
    h *= MIX
    return h ^ (h >> np.uint64(29))


class Index:
    """Passages of a block of benchmark texts and where their q-grams are."""

    def __init__(self, texts: list[str], rate: float, passage: int, short: int, min_chars: int) -> None:
        self.item, self.text, self.part = [], [], []
        for i, text in enumerate(texts):
            chars, bounds, _ = normal(pa.array([text]))
            chars = chars[: bounds[-1]]
            if len(chars) and chars[-1] == 32:
                chars = chars[:-1]
            if len(chars) < min_chars:
                continue
            for size, step, part in ((passage, passage // 2, 0), (short, short // 4, 1)):
                if part and len(chars) <= size:
                    continue  # already there as a whole
                last = max(len(chars) - size, 0)
                for at in sorted({*range(0, last, step), last}):
                    self.item.append(i)
                    self.text.append(chars[at : at + size])
                    self.part.append(part)
        lengths = np.array([len(t) for t in self.text], dtype=np.int64)
        self.edits = np.floor(rate * lengths).astype(np.int64)
        self.least = np.maximum(lengths - Q + 1 - self.edits * Q, 1)
        grams = [_grams(t) for t in self.text]
        h = np.concatenate([*grams, np.zeros(0, dtype=np.uint64)])
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams]).astype(np.int64)
        at = np.concatenate([np.arange(len(g)) for g in grams] or [np.zeros(0, dtype=np.int64)])
        order = np.argsort(h, kind="stable")
        self.grams, first = np.unique(h[order], return_index=True)
        self.ends = np.append(first, len(h))
        self.owner, self.at = owner[order], at[order]
        self.sieve = np.zeros(1 << SIEVE_BITS, dtype=bool)
        self.sieve[(self.grams >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)] = True


def candidates(index: Index, text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows (document, passage, first diagonal of the band) of bands with enough shared q-grams."""
    none = np.zeros((0, 3), dtype=np.int64)
    h = _grams(text)
    if not len(h) or not len(index.grams):
        return none
    spots = np.flatnonzero(index.sieve[(h >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)])
    at = np.minimum(np.searchsorted(index.grams, h[spots]), len(index.grams) - 1)
    real = index.grams[at] == h[spots]
    spots, at = spots[real], at[real]
    doc = np.searchsorted(bounds, spots, side="right") - 1
    whole = spots + Q <= bounds[doc + 1]
    spots, at, doc = spots[whole], at[whole], doc[whole]
    sizes = index.ends[at + 1] - index.ends[at]
    hits = gather(index.ends[at], sizes)
    passage = index.owner[hits]
    diagonal = np.repeat(spots, sizes) - index.at[hits]
    doc = np.repeat(doc, sizes)
    step = index.edits[passage] + 1
    band = np.floor_divide(diagonal, step)
    doc, passage = np.concatenate([doc, doc]), np.concatenate([passage, passage])
    band = np.concatenate([band, band - 1])
    order = np.lexsort((band, passage, doc))
    doc, passage, band = doc[order], passage[order], band[order]
    if not len(doc):
        return none
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (passage[1:] != passage[:-1]) | (band[1:] != band[:-1])
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(doc)))
    good = starts[counts >= index.least[passage[starts]]]
    return np.column_stack([doc[good], passage[good], band[good] * (index.edits[passage[good]] + 1)])


def align(index: Index, text: np.ndarray, bounds: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, first and last + 1 character) of the best alignment of each band's whole passage inside its document.

    A cell holds edits and, below them, the diagonal where the alignment began, so the smallest cell gives both.
    """
    edits, begin, end = (np.full(len(found), FAR, dtype=np.int64) for _ in range(3))
    lengths = np.array([len(t) for t in index.text], dtype=np.int64)
    groups = lengths[found[:, 1]] if len(found) else np.zeros(0, dtype=np.int64)
    for m in np.unique(groups):
        rows = np.flatnonzero(groups == m)
        for part in range(0, len(rows), 2048):
            some = rows[part : part + 2048]
            doc, passage, first = found[some].T
            width = int(2 * (index.edits[passage[0]] + 1))
            pattern = np.stack([index.text[p] for p in passage])
            column = np.arange(width)
            unit = np.int64(width)
            low, high = bounds[doc][:, None], bounds[doc + 1][:, None]
            cells = np.tile(column, (len(some), 1)).astype(np.int64)
            outside = first[:, None] + column
            cells[(outside < low) | (outside > high)] += FAR * unit
            for i in range(m):
                spot = first[:, None] + i + column
                inside = (spot >= low) & (spot < high)
                same = inside & (text[np.clip(spot, 0, len(text) - 1)] == pattern[:, i : i + 1])
                step = np.where(same, cells, cells + unit)
                step[~inside] += FAR * unit
                step[:, :-1] = np.minimum(step[:, :-1], cells[:, 1:] + unit)
                step = np.minimum.accumulate(step - column * unit, axis=1) + column * unit
                cells = step
            best = cells.argmin(axis=1)
            value = cells[np.arange(len(some)), best]
            edits[some], begin[some] = value // unit, first + value % unit
            end[some] = first + m + best
    return edits, begin, end


def _search(
    texts: list[str], rate: float, passage: int, short: int, min_chars: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(texts, rate, passage, short, min_chars)
        for chunk in chunks(batches, 1, CHUNK):
            text, bounds, place = normal(chunk.column(1))
            found = candidates(index, text, bounds)
            edits, begin, end = align(index, text, bounds, found)
            good = edits <= index.edits[found[:, 1]]
            best: dict[tuple[int, int], list[int]] = {}
            for (doc, p, _), e, b, z in zip(found[good].tolist(), edits[good].tolist(), begin[good].tolist(), end[good].tolist(), strict=True):
                z = min(z, int(bounds[doc + 1]))
                kind = (index.part[p], e)
                own = best.setdefault((doc, index.item[p]), (b, z, kind))
                best[doc, index.item[p]] = (min(own[0], b), max(own[1], z), min(own[2], kind))
            keys = list(best)
            spans = [best[k] for k in keys]
            arrays = [
                chunk.column(0).take(pa.array([k[0] for k in keys], pa.int64())),
                pa.array([k[1] for k in keys], pa.int64()),
                pa.array([int(place[s[0]]) for s in spans], pa.int64()),
                pa.array([int(place[s[1] - 1]) + 1 for s in spans], pa.int64()),
                pa.array([s[2][1] for s in spans], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "item", "start", "end", "edits"])

    return run


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rate: float = 0.06,
    passage: int = 160,
    min_chars: int = 24,
    block_chars: int = 1_000_000,
    short: int = 64,
) -> DataFrame:
    """doc_id, item_id, start, end (characters of the document), edits (of the best passage): one row per text and item."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text is not null")
    blocks = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    out = None
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        found = texts.mapInArrow(
            frugal(_search([r.text for r in block], rate, passage, short, min_chars)), "doc_id bigint, item bigint, start bigint, end bigint, edits bigint"
        )
        ids = F.array(*[F.lit(r.item_id).cast("bigint") for r in block]) if block else F.array().cast("array<bigint>")
        named = found.select("doc_id", F.get(ids, F.col("item").cast("int")).alias("item_id"), "start", "end", "edits")
        out = named if out is None else out.unionByName(named)
    return out
