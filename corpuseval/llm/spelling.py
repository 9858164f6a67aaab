"""Spelling variants: words one edit apart, each mapped to its more frequent form.

Words are the letter runs of all texts; Spark counts them, combining on the map side. A word's letter-count vector holds how
often each letter occurs in it. One replaced letter moves the vector by an L1 distance of two, one inserted or deleted letter
by one. So for each word a range search of radius two among words of its own length, and of radius one among words one letter
longer, holds every near word; candidates are then compared letter by letter.

The searches use k-d trees. For each length, an outer tree over a bounded sample of vectors (``sample``) cuts the space into
cells of about ``cell_words`` words. Every word lives in one cell and visits the cells whose boxes its search ball meets. Each
cell is a group with a tree of its own, where boxes beyond the radius are pruned. The sample only places the cuts: any cuts
give the same pairs. ``cells`` is bounded (``sample`` / 8), so beyond about sample / 8 * cell_words words of one length cells grow;
raise ``sample`` then. Counts above 255 of one letter are cut to 255, which can only shorten distances.

Forms are followed to the last one by doubling: a form is at least five times as frequent, so a chain has at most
log5 of the largest count steps.

Defined cases: a null text has no words; a null id counts as an empty string in the hash; rows that repeat count each time;
an empty table has no words; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuseval.session import materialize, ship_package

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OTHER = r"[^A-Za-zÀ-ÿ]+"
LETTERS = 26 + 64  # a to z and U+00C0 to U+00FF
SHORTEST, LEAST, LARGER, DROP_EVERY = 6, 5, 5, 199
RADIUS_SAME, RADIUS_LONGER = 2, 1
LEAF = 24  # vectors in a leaf of a cell's tree
GUESTS, BLOCK = 5_000, 200_000  # guests searched and candidate pairs compared at a time


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: words of at least six code points that occur five times or more."""
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("bigint").cast("string"), F.lit("")).alias("id"), F.explode(F.split(text_col, OTHER)).alias("run")
    ).where(F.length("run") >= SHORTEST)
    lowered = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h, size = F.crc32(F.concat_ws(":", "id", "run")), F.length("run")
    at = (h % size).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, size))
    words = lowered.select(F.when(h % DROP_EVERY == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)


def letter_matrix(words: list[str], length: int) -> np.ndarray:
    """Code points, a row per word of that length."""
    joined = "".join(words).encode("utf-32-le")
    return np.frombuffer(joined, dtype=np.uint32).reshape(len(words), length).astype(np.uint16)


def letter_counts(letters: np.ndarray) -> np.ndarray:
    """Letter-count vectors (uint8, at most 255) of a matrix of code points."""
    n = len(letters)
    kind = np.where(letters >= 0xC0, letters - 0xC0 + 26, letters - ord("a")).astype(np.int64)
    out = np.empty((n, LETTERS), dtype=np.uint8)
    for a in range(0, n, 20_000):
        part = kind[a : a + 20_000]
        cells = (np.arange(len(part))[:, None] * LETTERS + part).ravel()
        counted = np.bincount(cells, minlength=len(part) * LETTERS).reshape(len(part), LETTERS)
        out[a : a + 20_000] = np.minimum(counted, 255)
    return out


class KdTree:
    """A k-d tree over letter-count vectors. Node i has a box (low, high), children left and right or, as a leaf, a number.

    ``tight`` boxes enclose the points given; otherwise boxes are the regions of the cuts, for points still to come.
    """

    def __init__(self, points: np.ndarray, leaf: int, tight: bool) -> None:
        self.low, self.high, self.left, self.right, self.cut, self.leaf = [], [], [], [], [], []
        self.members: list[np.ndarray] = []
        dims = points.shape[1]
        whole = (np.zeros(dims, np.uint8), np.full(dims, 255, np.uint8))
        stack = [(np.arange(len(points)), *whole, -1, False)]
        while stack:
            rows, low, high, up, on_right = stack.pop()
            at, some = len(self.left), points[rows]
            if tight and len(rows):
                low, high = some.min(axis=0), some.max(axis=0)
            self.low.append(low)
            self.high.append(high)
            self.left.append(-1)
            self.right.append(-1)
            self.cut.append((0, 0))
            self.leaf.append(-1)
            if up >= 0:
                (self.right if on_right else self.left)[up] = at
            d = int(np.argmax(some.std(axis=0))) if len(rows) > leaf else 0
            values = some[:, d] if len(rows) > leaf else np.zeros(0, np.uint8)
            if len(values) and values.min() < values.max():
                value = int(np.median(values))
                if value >= values.max():
                    value = int(values.max()) - 1
                near = values <= value
                self.cut[at] = (d, value)
                high_near, low_far = high.copy(), low.copy()
                high_near[d], low_far[d] = value, value + 1
                stack.append((rows[~near], low_far, high, at, True))
                stack.append((rows[near], low, high_near, at, False))
            else:
                self.leaf[at] = len(self.members)
                self.members.append(rows)
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.left, self.right, self.leaf = np.array(self.left), np.array(self.right), np.array(self.leaf)

    def home(self, points: np.ndarray) -> np.ndarray:
        """The leaf whose region holds each point."""
        dims, values = np.array([c[0] for c in self.cut]), np.array([c[1] for c in self.cut])
        at = np.zeros(len(points), dtype=np.int64)
        while True:
            inner = np.flatnonzero(self.left[at] >= 0)
            if not len(inner):
                return self.leaf[at]
            node = at[inner]
            near = points[inner, dims[node]] <= values[node]
            at[inner] = np.where(near, self.left[node], self.right[node])

    def visit(self, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(point, leaf) of all leaves whose boxes lie within ``radius`` of a point; all other boxes are pruned."""
        which, node = np.arange(len(points)), np.zeros(len(points), dtype=np.int64)
        points_of, leaves_of = [], []
        while len(which):
            near = self._distance(points, which, node) <= radius
            which, node = which[near], node[near]
            done = self.left[node] < 0
            points_of.append(which[done])
            leaves_of.append(self.leaf[node[done]])
            which, node = which[~done], node[~done]
            which, node = np.concatenate([which, which]), np.concatenate([self.left[node], self.right[node]])
        return np.concatenate(points_of or [which]), np.concatenate(leaves_of or [which])

    def _distance(self, points: np.ndarray, which: np.ndarray, node: np.ndarray) -> np.ndarray:
        out = np.empty(len(which), dtype=np.int64)
        for a in range(0, len(which), 20_000):
            p, k = points[which[a : a + 20_000]].astype(np.int16), node[a : a + 20_000]
            gap = np.maximum(self.low[k] - p, 0) + np.maximum(p - self.high[k], 0)
            out[a : a + 20_000] = gap.sum(axis=1)
        return out


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For rows of code points: True where they differ by one replaced letter (same width) or one inserted letter."""
    if short.shape[1] == long.shape[1]:
        return (short != long).sum(axis=1) == 1
    ahead = np.ones((len(short), short.shape[1] + 1), dtype=bool)
    behind = ahead.copy()
    np.logical_and.accumulate(short == long[:, :-1], axis=1, out=ahead[:, 1:])
    behind[:, :-1] = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1)[:, ::-1]
    return (ahead & behind).any(axis=1)


def near_in_cell(homes: list[str], guests: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(guest, home) places of pairs one edit apart; guests have that length, homes the same or one more."""
    width = len(homes[0])
    home_letters, guest_letters = letter_matrix(homes, width), letter_matrix(guests, length)
    points, radius = letter_counts(home_letters), RADIUS_SAME if width == length else RADIUS_LONGER
    used = points.any(axis=0)  # letters that no home has are summed once for each guest
    tree = KdTree(points[:, used], LEAF, tight=True)
    sizes = np.array([len(m) for m in tree.members])
    offsets, order = np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(tree.members)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for a in range(0, len(guests), GUESTS):
        vectors = letter_counts(guest_letters[a : a + GUESTS])
        inside = np.flatnonzero(vectors[:, ~used].sum(axis=1, dtype=np.int64) <= radius)
        which, leaf = tree.visit(vectors[inside][:, used], radius)
        which = inside[which] + a
        bounds = np.cumsum(sizes[leaf])
        # a slice of (guest, leaf) visits at a time, so that memory does not follow the number of candidates
        steps = np.arange(BLOCK, bounds[-1] if len(bounds) else 0, BLOCK)
        edges = np.unique(np.concatenate([[0], np.searchsorted(bounds, steps), [len(leaf)]]))
        for b, c in zip(edges[:-1], edges[1:], strict=True):
            k = sizes[leaf[b:c]]
            guest = np.repeat(which[b:c], k)
            home = order[np.repeat(offsets[leaf[b:c]] - np.cumsum(k) + k, k) + np.arange(k.sum())]
            same = one_edit(guest_letters[guest], home_letters[home])
            found.append((guest[same], home[same]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([g for g, _ in found]), np.concatenate([h for _, h in found])


PAIR = "shorter string, shorter_n bigint, longer string, longer_n bigint"
PAIR_ARROW = pa.schema([("shorter", pa.string()), ("shorter_n", pa.int64()), ("longer", pa.string()), ("longer_n", pa.int64())])
SEEKER = "width int, cell int, word string, n bigint, home boolean"


def _seekers(batch: pa.RecordBatch, which: np.ndarray, width: int, cell: np.ndarray, home: bool) -> pa.RecordBatch:
    words = batch.take(pa.array(which))
    same = [pa.array(np.full(len(which), width, np.int32)), pa.array(cell.astype(np.int32))]
    columns = [*same, words["word"], words["n"], pa.array(np.full(len(which), home))]
    return pa.RecordBatch.from_arrays(columns, names=["width", "cell", "word", "n", "home"])


def near_pairs(words: DataFrame, cell_words: int = 20_000, sample: int = 40_000) -> DataFrame:
    """Unordered pairs of words one edit apart, each once: shorter (or first), its n, longer (or second), its n."""
    ship_package(words.sparkSession)
    sizes = {r.width: r.n for r in words.groupBy(F.length("word").alias("width")).agg(F.count("*").alias("n")).where("n > %d" % cell_words).collect()}
    total = sum(sizes.values())
    cuts: dict[int, KdTree] = {}
    if total:
        wide = words.where(F.length("word").isin(list(sizes)))
        modulus = max(1, -(-total // sample))
        some = wide.where(F.pmod(F.xxhash64("word"), F.lit(modulus)) == 0).orderBy(F.xxhash64("word")).limit(2 * sample).select("word")
        rows: dict[int, list[str]] = {}
        for r in some.collect():
            rows.setdefault(len(r.word), []).append(r.word)
        for width, found in rows.items():
            cells = max(1, min(-(-sizes[width] // cell_words), len(found) // 8))
            cuts[width] = KdTree(letter_counts(letter_matrix(found, width)), max(1, len(found) // cells), tight=False)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.utf8_length(batch["word"]).to_numpy(zero_copy_only=False)
            for length in map(int, np.unique(lengths)):
                some = batch.filter(pa.array(lengths == length))
                vectors = letter_counts(letter_matrix(some["word"].to_pylist(), length))
                everyone, first = np.arange(len(some)), np.zeros(len(some), np.int64)
                own = cuts.get(length)
                yield _seekers(some, everyone, length, own.home(vectors) if own else first, True)
                for width, radius in ((length, RADIUS_SAME), (length + 1, RADIUS_LONGER)):
                    tree = cuts.get(width)
                    which, leaf = tree.visit(vectors, radius) if tree else (everyone, first)
                    yield _seekers(some, which, width, leaf, False)

    def search(table: pa.Table) -> pa.Table:
        home = table["home"].to_numpy()
        homes, guests, out = table.filter(pa.array(home)), table.filter(pa.array(~home)), []
        width = table["width"][0].as_py()
        lengths = pc.utf8_length(guests["word"]).to_numpy()
        for length in map(int, np.unique(lengths) if len(homes) else ()):
            some = guests.filter(pa.array(lengths == length))
            g, h = near_in_cell(homes["word"].to_pylist(), some["word"].to_pylist(), length)
            one, two = some.take(pa.array(g)), homes.take(pa.array(h))
            pairs = pa.Table.from_arrays([one["word"], one["n"], two["word"], two["n"]], schema=PAIR_ARROW)
            out.append(pairs if length < width else pairs.filter(pc.less(pairs["shorter"], pairs["longer"])))
        return pa.concat_tables(out) if out else PAIR_ARROW.empty_table()

    return words.select("word", "n").mapInArrow(deal, SEEKER).groupBy("width", "cell").applyInArrow(search, PAIR)


def follow(forms: DataFrame) -> DataFrame:
    """word, root from (word, form): the last form reached. Forms do not run in circles, because counts grow along them."""
    rows = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        further = rows.select(F.col("word").alias("root"), F.col("root").alias("next"))
        rows = materialize(rows.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if rows.where("moved").isEmpty():
            return rows.select("word", "root")
        rows = rows.drop("moved")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cell_words: int = 20_000, sample: int = 40_000) -> DataFrame:
    """word, n, n_near, form, form_n, root: a row per word."""
    words = materialize(count_words(docs, id_col, text_col))
    pairs = near_pairs(words, cell_words, sample)
    both = pairs.select(F.col("shorter").alias("word"), F.col("longer").alias("near"), F.col("longer_n").alias("near_n")).unionByName(
        pairs.select(F.col("longer").alias("word"), F.col("shorter").alias("near"), F.col("shorter_n").alias("near_n"))
    )
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")
    )
    more = F.coalesce(-F.col("best.less") >= LARGER * F.col("n"), F.lit(False))
    known = materialize(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(more, F.col("best.form")).alias("form"), F.when(more, -F.col("best.less")).alias("form_n"),
    ))
    roots = follow(known.where("form is not null"))
    return known.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
