"""Subword ids of many distinct units at once.

The merges of a public BPE vocabulary file are applied to all units of a batch together by numpy: in each round every
unit merges its best-ranked pair, leftmost first, which is the order of the published algorithm. That path takes units
of ASCII letters, digits and punctuation and Latin-1 letters; any other unit (apostrophes, other scripts, special
strings, very long units) goes to the ``tokenizers`` library itself, so ids are always the library's.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa

from corpuseval.llm.units import gather

NONE = np.iinfo(np.int32).max
LONGEST = 32  # symbols of a pre-token on the batched path
BLOCK = 8192  # pre-tokens merged at a time
LETTER, DIGIT, MARK, ODD, SPACE = 1, 2, 3, 4, 5


def _classes() -> np.ndarray:
    kind = np.full(256, ODD, dtype=np.uint8)
    for c in range(33, 127):
        kind[c] = LETTER if chr(c).isalpha() else DIGIT if chr(c).isdigit() else MARK
    kind[ord("'")] = ODD
    kind[32] = SPACE
    return kind


class UnitEncoder:
    """Ids for units by one vocabulary file: byte-level BPE, or BPE with word ends (lower case, spaces dropped)."""

    def __init__(self, file: str) -> None:
        from tokenizers import Tokenizer

        path = public_tokenizers.path(file)
        self.library = Tokenizer.from_file(str(path))
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], model["merges"]
        self.word_ends = bool(model.get("end_of_word_suffix"))
        suffix = model.get("end_of_word_suffix") or ""
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in printable} | {
            b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(printable))
        }
        self.inner = np.array([vocab[shown[b]] for b in range(256)], dtype=np.int32)
        self.last = np.array([vocab[shown[b] + suffix] for b in range(256)], dtype=np.int32)
        self.kinds = _classes()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([(vocab[a] << 17) | vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.bits = 19
        self.slots = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, NONE, dtype=np.int32)
        self.made = np.zeros(1 << self.bits, dtype=np.int32)
        left, ranks, at, self.probes = keys, np.arange(len(keys), dtype=np.int32), self._slot(keys), 0
        while len(left):
            self.probes += 1
            _, first = np.unique(at, return_index=True)
            free = first[self.slots[at[first]] == -1]
            self.slots[at[free]], self.ranks[at[free]], self.made[at[free]] = left[free], ranks[free], made[free]
            rest = np.ones(len(left), dtype=bool)
            rest[free] = False
            left, ranks, made, at = left[rest], ranks[rest], made[rest], (at[rest] + 1) % len(self.slots)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair of symbols (NONE where no merge exists) and the symbol it makes."""
        keys = (a.astype(np.int64) << 17) | b
        at = self._slot(keys)
        found = self.slots[at]
        rank = np.where(found == keys, self.ranks[at], NONE)
        left = np.flatnonzero((found != keys) & (found != -1))
        for _ in range(self.probes - 1):
            if not len(left):
                break
            at[left] = (at[left] + 1) % len(self.slots)
            found = self.slots[at[left]]
            hit = found == keys[left]
            rank[left[hit]] = self.ranks[at[left[hit]]]
            left = left[~hit & (found != -1)]
        return rank, self.made[at]

    def _merge(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol counts, ids one after another) of pre-tokens given as byte runs."""
        counts = lengths.astype(np.int64).copy()
        rows_of, cells_of = [], []
        order = np.argsort(lengths, kind="stable")
        edges = np.searchsorted(lengths[order], np.arange(1, LONGEST + 2))
        for width in range(1, LONGEST + 1):
            rows = order[edges[width - 1] : edges[width]]
            for part in range(0, len(rows), BLOCK):
                some = rows[part : part + BLOCK]
                cells, size = self._merge_block(data, starts[some], width)
                counts[some] = size
                rows_of.append(some)
                cells_of.append(cells)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        ids = np.zeros(offsets[-1], dtype=np.int64)
        for some, cells in zip(rows_of, cells_of, strict=True):
            size = counts[some]
            mask = np.arange(cells.shape[1]) < size[:, None]
            ids[gather(offsets[some], size)] = cells[mask]
        return counts, ids

    def _merge_block(self, data: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        column = np.arange(width)
        cells = self.inner[data[starts[:, None] + column]]
        cells[:, -1] = self.last[data[starts + width - 1]]
        size = np.full(len(starts), width, dtype=np.int64)
        if width == 1:
            return cells, size
        out = cells.copy()
        rank, made = self._pairs(cells[:, :-1].ravel(), cells[:, 1:].ravel())
        rank, made = rank.reshape(len(starts), -1), made.reshape(len(starts), -1)
        rows = np.arange(len(starts))
        while True:
            best = rank.argmin(axis=1)
            at = np.arange(len(rows))
            going = rank[at, best] != NONE
            if not going.all():
                done = rows[~going]
                out[done, : cells.shape[1]] = cells[~going]
                rows, cells, rank, made, best = rows[going], cells[going], rank[going], made[going], best[going]
                at = np.arange(len(rows))
            if not len(rows):
                return out, size
            merged = made[at, best]
            size[rows] -= 1
            # every row loses one symbol, so all rows keep one width
            keep = column[: cells.shape[1]] != best[:, None] + 1
            cells = cells[keep].reshape(len(rows), -1)
            cells[at, best] = merged
            if cells.shape[1] == 1:
                out[rows, :1] = cells
                return out, size
            keep = column[: rank.shape[1]] != best[:, None]
            rank, made = rank[keep].reshape(len(rows), -1), made[keep].reshape(len(rows), -1)
            left, right = np.flatnonzero(best > 0), np.flatnonzero(best < cells.shape[1] - 1)
            rank[left, best[left] - 1], made[left, best[left] - 1] = self._pairs(cells[left, best[left] - 1], merged[left])
            rank[right, best[right]], made[right, best[right]] = self._pairs(merged[right], cells[right, best[right] + 1])

    def encode(self, units: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the ids of unit i are ids[offsets[i]:offsets[i + 1]]."""
        n = len(units)
        if not n:
            return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64)
        _, buffer, raw = units.buffers()
        bounds = np.frombuffer(buffer, dtype=np.int32)[units.offset : units.offset + n + 1].astype(np.int64)
        data = np.frombuffer(raw, dtype=np.uint8)[bounds[0] : bounds[-1]].copy() if raw is not None else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0]
        kind = self.kinds[data]
        latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)) if len(data) else []
        kind[latin], kind[np.asarray(latin, dtype=np.int64) + 1] = LETTER, LETTER
        marks = (data[:-1] == ord("<")) & (data[1:] == ord("|")) if len(data) else np.zeros(0, dtype=bool)
        kind[np.flatnonzero(marks)] = ODD
        if self.word_ends:
            upper = (data >= 65) & (data <= 90)
            upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
            data[upper] += 32
        begin = np.ones(len(data), dtype=bool)
        begin[1:] = kind[1:] != kind[:-1]
        if self.word_ends:
            begin |= kind == DIGIT
        elif len(data):
            after = np.flatnonzero(kind[:-1] == SPACE) + 1
            begin[after] = False  # a leading space belongs to what follows it
        begin[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        starts = np.flatnonzero(begin)
        lengths = np.diff(np.concatenate([starts, [len(data)]]))
        owner = np.searchsorted(bounds, starts, side="right") - 1
        odd = np.zeros(n, dtype=bool)
        bad = np.flatnonzero(kind == ODD)
        odd[np.searchsorted(bounds, bad, side="right") - 1] = True
        odd[owner[lengths > LONGEST]] = True
        fine = ~odd[owner]
        counts, ids = self._merge(data, starts[fine], lengths[fine])
        sizes = np.bincount(owner[fine], weights=counts, minlength=n).astype(np.int64)
        rest = np.flatnonzero(odd)
        slow = []
        if len(rest):
            texts = units.take(pa.array(rest)).to_pylist()
            for at in range(0, len(texts), 20_000):
                slow += [x.ids for x in self.library.encode_batch(texts[at : at + 20_000], add_special_tokens=False)]
            sizes[rest] = [len(x) for x in slow]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        out = np.zeros(offsets[-1], dtype=np.int64)
        if len(rest):
            usual = np.flatnonzero(~odd)
            out[gather(offsets[usual], sizes[usual])] = ids
            out[gather(offsets[rest], sizes[rest])] = np.fromiter((i for x in slow for i in x), np.int64, int(sizes[rest].sum()))
        else:
            out = ids
        return offsets, out


@lru_cache(maxsize=4)
def encoder(file: str) -> UnitEncoder:
    """One encoder for each vocabulary and Python process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return UnitEncoder(file)
