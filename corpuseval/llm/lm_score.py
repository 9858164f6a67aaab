"""Language-model scores of whole texts: a causal self-attention model over subword ids, trained in numpy.

Words (lower-cased A-Z) and one end per text are the tokens. Word counts of all training texts are gathered by a grouped
sum; they give the base score and, through the subwords of each distinct word, the share of every subword id within its
output class. How often each class follows each input symbol is counted over all whole training texts. The attention weights
learn from every window of every training text: they start from a fit on windows picked by the hash of text id and place,
about ``fit_windows`` of them and one in a thousand of all; then each task goes over all windows of its texts once, and the
tasks' weights are averaged by their windows. So weights depend a little on how texts are dealt out to tasks. Texts become
subwords once: their ids, two bytes each, are stored for the passes that learn and score. A text's subword stream, closed by
the end id, is scored in windows that overlap by ``OVERLAP`` positions: each subword is scored once, with at least that many
predecessors where the text has them, and all windows of a block share one batched masked attention, whose products of two
symbols are looked up in a table.

P(id | before) = P(cluster | before) P(class | cluster, before) P(id | class): a softmax of two levels, so that a subword
costs two small ones. The most frequent ids are a class each, the others share classes of about equal mass; shares are
smoothed over the whole vocabulary, so every text has a positive probability.

Counts of the ``hot`` most frequent words (a bounded list) go to every task. Other words leave as (word, ids of its
texts) and meet their counts in a join; a word's list is one entry per text and chunk, so frequent words, which the list
takes, cannot overload a partition.

Defined cases: a null text is empty and scores its end alone; a null id is a training text; rows that repeat an id are
one text whose tokens and scores are summed; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuseval.llm.subword import encoder
from corpuseval.llm.units import LOWER, chunks, coded, frugal, gather, grouped, most_frequent, split_units, spread, text_bytes
from corpuseval.session import materialize, ship_package

WINDOW, OVERLAP, WIDTH, HIDDEN = 32, 8, 16, 32
INPUTS, CLUSTERS, INSIDE = 512, 64, 16  # inputs besides the start and padding symbols; classes are clusters x inside
CLASSES = CLUSTERS * INSIDE
END = 50256
MASKED = -1e9
CHUNK = 8 << 20
STORED = np.dtype("<u2")  # ids are at most END
WEIGHTS = ["q", "k", "v", "r", "direct", "bias", "mix", "out", "inside"]  # what is learned by gradients
REFINE_RATE = 0.0015  # that of the last steps of a fit


@dataclass
class Attention:
    """Tables by input symbol: query, key, value, residual, direct cluster scores; position bias; dense layers; and, fixed
    from the pairs of neighbours in all training texts, direct scores of the classes in each cluster."""

    q: np.ndarray
    k: np.ndarray
    v: np.ndarray
    r: np.ndarray
    direct: np.ndarray
    bias: np.ndarray
    mix: np.ndarray
    out: np.ndarray
    inside: np.ndarray
    pairs: np.ndarray

    @classmethod
    def start(cls, pairs: np.ndarray, seed: int = 7) -> Attention:
        """``pairs``: how often each class follows each input symbol, smoothed."""
        rng = np.random.default_rng(seed)
        normal = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        symbols = INPUTS + 2
        groups = pairs.reshape(symbols, CLUSTERS, INSIDE).sum(axis=2)
        return cls(
            normal(symbols, WIDTH), normal(symbols, WIDTH), normal(symbols, WIDTH), normal(symbols, HIDDEN),
            np.log(groups / groups.sum(axis=1, keepdims=True)).astype(np.float32), np.zeros((WINDOW, WINDOW), np.float32),
            normal(WIDTH, HIDDEN), normal(HIDDEN, CLUSTERS) * np.float32(0.1),
            normal(CLUSTERS, HIDDEN, INSIDE) * np.float32(0.1),
            np.log(pairs / np.repeat(groups, INSIDE, axis=1)).astype(np.float32).reshape(symbols, CLUSTERS, INSIDE),
        )

    def weights(self) -> list[np.ndarray]:
        return [getattr(self, name) for name in WEIGHTS]

    def attend(self, x: np.ndarray, room: Room) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Attention weights and mixed values for the positions after the overlap, and the rows of q, k and v they come from;
        x: windows of input symbols."""
        n, scored = len(x), WINDOW - OVERLAP
        q = self.q.take(x[:, OVERLAP:], axis=0, mode="clip", out=room("q", n, scored, WIDTH))
        k = self.k.take(x, axis=0, mode="clip", out=room("k", n, WINDOW, WIDTH))
        v = self.v.take(x, axis=0, mode="clip", out=room("v", n, WINDOW, WIDTH))
        q *= np.float32(WIDTH**-0.5)
        scores = np.matmul(q, k.transpose(0, 2, 1), out=room("p", n, scored, WINDOW))
        scores += self.bias[OVERLAP:] + CAUSAL[OVERLAP:]
        padding = x == INPUTS + 1
        padded = np.flatnonzero(padding.any(axis=1))  # at the two ends of a text only
        scores[padded] += np.where(padding[padded], np.float32(MASKED), np.float32(0))[:, None, :]
        np.clip(scores, 4 * MASKED, 60, out=scores)
        np.exp(scores, out=scores)
        scores *= (1 / (scores @ ONES[:WINDOW] + np.float32(1e-20)))[:, :, None]
        return scores, np.matmul(scores, v, out=room("mixed", n, scored, WIDTH)), (q, k, v)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What an attention weight is a product of before it is made a share, by the symbols of both positions and by their
        places; and the values as the hidden units see them."""
        pairs = (self.q * np.float32(WIDTH**-0.5)) @ self.k.T
        pairs[:, INPUTS + 1] = MASKED
        places = self.bias[OVERLAP:] + CAUSAL[OVERLAP:]
        return np.exp(np.clip(pairs, MASKED, 40)), np.exp(np.clip(places, MASKED, 40)), self.v @ self.mix

    def classes(self, here: np.ndarray, mixed: np.ndarray, room: Room) -> tuple[np.ndarray, np.ndarray]:
        """Hidden units and cluster scores, a row for each position; ``here``: its own input symbol."""
        n = len(here)
        hidden = self.r.take(here, axis=0, mode="clip", out=room("hidden", n, HIDDEN))
        hidden += mixed
        np.clip(hidden, 0, np.inf, out=hidden)
        scores = np.matmul(hidden, self.out, out=room("scores", n, CLUSTERS))
        scores += self.direct.take(here, axis=0, mode="clip", out=room("direct", n, CLUSTERS))
        np.clip(scores, -60, 60, out=scores)  # exp stays within float32
        return hidden, scores

    def inner(
        self, here: np.ndarray, hidden: np.ndarray, clusters: np.ndarray, room: Room
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """Scores of the classes in each position's cluster, by cluster: (order of the positions, their hidden units, scores,
        slice of each cluster present)."""
        n = len(here)
        order = np.argsort(clusters.astype(np.int8), kind="stable")
        ends = [0, *np.cumsum(np.bincount(clusters, minlength=CLUSTERS)).tolist()]
        slices = [(c, ends[c], ends[c + 1]) for c in range(CLUSTERS) if ends[c] < ends[c + 1]]
        rows = hidden.take(order, axis=0, mode="clip", out=room("rows", n, HIDDEN))
        scores = room("inner", n, INSIDE)
        for c, at, end in slices:
            np.matmul(rows[at:end], self.inside[c], out=scores[at:end])
        at = (here * CLUSTERS + clusters).take(order)
        scores += self.pairs.reshape(-1, INSIDE).take(at, axis=0, mode="clip", out=room("pairs", n, INSIDE))
        np.clip(scores, -60, 60, out=scores)
        return order, rows, scores, slices


def looked_up(tables: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray, room: Room) -> np.ndarray:
    """Mixed values as the hidden units see them, for a model that stays as it is: no pair of symbols is multiplied twice."""
    pairs, places, values = tables
    n, scored = len(x), WINDOW - OVERLAP
    own = x[:, OVERLAP:] * (INPUTS + 2)
    cells = np.add(own[:, :, None], x[:, None, :], out=room("cells", n, scored, WINDOW, dtype=np.int64))
    p = pairs.reshape(-1).take(cells, mode="clip", out=room("p", n, scored, WINDOW))
    p *= places
    v = values.take(x, axis=0, mode="clip", out=room("v", n, WINDOW, HIDDEN))
    mixed = np.matmul(p, v, out=room("mixed", n, scored, HIDDEN))
    mixed *= (1 / (p @ ONES[:WINDOW] + np.float32(1e-20)))[:, :, None]
    return mixed.reshape(-1, HIDDEN)


class Room:
    """Arrays kept under a name from block to block, so that their memory is not asked for again."""

    def __init__(self) -> None:
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int, dtype: type = np.float32) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.held or len(self.held[name]) < size:
            self.held[name] = np.empty(size, dtype)
        return self.held[name][:size].reshape(shape)


ONES = np.ones(4096, dtype=np.float32)
CAUSAL = np.triu(np.full((WINDOW, WINDOW), MASKED, np.float32), 1)


@dataclass
class Vocabulary:
    """Input symbol, output class and log10 share of its class for every subword id."""

    symbol: np.ndarray
    klass: np.ndarray
    share: np.ndarray
    log_mass: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Vocabulary:
        smooth = counts + 0.01
        order = np.argsort(-smooth, kind="stable")

        def bands(single: int, total: int) -> np.ndarray:
            band = np.zeros(len(counts), dtype=np.int64)
            band[order[:single]] = np.arange(single)
            rest = smooth[order[single:]]
            middle = np.cumsum(rest) - rest / 2
            band[order[single:]] = single + np.minimum(middle / rest.sum() * (total - single), total - single - 1)
            return band

        klass = bands(CLASSES * 7 // 8, CLASSES)
        mass = np.bincount(klass, weights=smooth, minlength=CLASSES)
        share = np.log10(smooth / mass[klass]).astype(np.float32)
        return cls(bands(INPUTS * 7 // 8, INPUTS).astype(np.int32), klass.astype(np.int32), share, np.log(mass / mass.sum()))


def starts(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text of each window, place in it of the first id predicted)."""
    step = WINDOW - OVERLAP
    sizes = np.diff(bounds)
    count = -(-sizes // step)
    return np.repeat(np.arange(len(sizes)), count), gather(np.zeros(len(sizes), dtype=np.int64), count) * step


def windows(
    ids: np.ndarray, bounds: np.ndarray, vocabulary: Vocabulary, chosen: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(input symbols of each window, positions of the predicted ids or -1, text of each window), of all or of the chosen ones."""
    text, first = starts(bounds)
    if chosen is not None:
        text, first = text[chosen], first[chosen]
    place = places(bounds, text, first)
    return before(vocabulary, ids, bounds)[place], place[:, OVERLAP:], text


def places(bounds: np.ndarray, text: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions of the ids predicted in each window, and of those in its overlap; -1 outside the text."""
    at = np.arange(-OVERLAP, WINDOW - OVERLAP)
    begin, size = bounds[text], bounds[text + 1] - bounds[text]
    inside = (at >= -first[:, None]) & (at < (size - first)[:, None])
    return np.where(inside, (begin + first)[:, None] + at, -1)


def before(vocabulary: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The input symbol that each id follows, and at the end (-1) padding."""
    symbols = np.empty(len(ids) + 1, dtype=np.int64)
    symbols[1:] = vocabulary.symbol[ids]
    symbols[bounds[:-1]] = INPUTS  # where a text is empty, the next one starts
    symbols[-1] = INPUTS + 1
    return symbols


def score(model: Attention, vocabulary: Vocabulary, ids: np.ndarray, bounds: np.ndarray, block: int = 256) -> np.ndarray:
    """log10 probability of each run of ids."""
    x, place, text = windows(ids, bounds, vocabulary)
    total, room, tables = np.zeros(len(bounds) - 1), Room(), model.tables()
    for at in range(0, len(x), block):
        part, target = x[at : at + block], place[at : at + block].reshape(-1)
        here = part[:, OVERLAP:].reshape(-1)
        hidden, scores = model.classes(here, looked_up(tables, part, room), room)
        known = target >= 0
        wanted = ids[np.maximum(target, 0)]
        classes = vocabulary.klass[wanted].astype(np.int64)
        clusters = classes // INSIDE
        log = scores.reshape(-1).take(np.arange(len(target)) * CLUSTERS + clusters)
        np.exp(scores, out=scores)
        log -= np.log(scores @ ONES[:CLUSTERS])
        order, _, inner, _ = model.inner(here, hidden, clusters, room)
        own_class = inner.reshape(-1).take(np.arange(len(order)) * INSIDE + (classes % INSIDE).take(order))
        np.exp(inner, out=inner)
        log[order] += own_class - np.log(inner @ ONES[:INSIDE])
        log = log / np.float32(np.log(10)) + vocabulary.share[wanted]
        own = np.where(known, log, 0).reshape(len(part), -1).sum(axis=1)
        total += np.bincount(text[at : at + block], weights=own, minlength=len(total))
    return total


def wanted_classes(vocabulary: Vocabulary, ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    return np.where(place >= 0, vocabulary.klass[ids[np.maximum(place, 0)]], -1)


def pair_counts(vocabulary: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How often each class follows each input symbol, a flat table."""
    return np.bincount(before(vocabulary, ids, bounds)[:-1] * CLASSES + vocabulary.klass[ids], minlength=(INPUTS + 2) * CLASSES)


def fit(vocabulary: Vocabulary, ids: np.ndarray, bounds: np.ndarray, steps: int = 800, batch: int = 192) -> Attention:
    """A model of these texts alone."""
    x, place, _ = windows(ids, bounds, vocabulary)
    return fit_on(vocabulary, pair_counts(vocabulary, ids, bounds), x, wanted_classes(vocabulary, ids, place), steps, batch)


def fit_on(
    vocabulary: Vocabulary, counts: np.ndarray, x: np.ndarray, classes: np.ndarray, steps: int = 800, batch: int = 192
) -> Attention:
    """Weights by Adam on random batches of windows, with the gradients written out. ``classes``: those wanted, or -1."""
    model = Attention.start(counts.reshape(INPUTS + 2, CLASSES) + 20 * np.exp(vocabulary.log_mass))
    rng = np.random.default_rng(11)
    adam = Adam(model)
    for step in range(1, steps + 1 if len(x) else 1):
        rows = rng.integers(0, len(x), batch)
        adam.step(x[rows], classes[rows], 0.015 * min(1, step / 30) * (1 - 0.9 * step / steps))
    return model


class Adam:
    """Changes a model's weights in place, batch by batch."""

    def __init__(self, model: Attention) -> None:
        self.model, self.steps, self.room = model, 0, Room()
        held = model.weights()
        self.flat = np.concatenate([w.ravel() for w in held])
        self.grad, self.mean, self.square, self.change = (np.zeros_like(self.flat) for _ in range(4))
        ends = np.cumsum([w.size for w in held])
        parts = lambda flat: [v.reshape(w.shape) for v, w in zip(np.split(flat, ends[:-1]), held, strict=True)]
        for name, view in zip(WEIGHTS, parts(self.flat), strict=True):
            setattr(model, name, view)
        self.grads = parts(self.grad)

    def step(self, part: np.ndarray, classes: np.ndarray, rate: float) -> None:
        self._gradients(part, classes)
        self.steps += 1
        g, m, s, t = self.grad, self.mean, self.square, self.change
        np.subtract(g, m, out=t)
        t *= 0.1
        m += t
        np.multiply(g, g, out=t)
        t -= s
        t *= 0.02
        s += t
        np.multiply(s, 1 / (1 - 0.98**self.steps), out=t)
        np.sqrt(t, out=t)
        t += 1e-8
        np.divide(m, t, out=t)
        t *= rate / (1 - 0.9**self.steps)
        self.flat -= t

    def _gradients(self, part: np.ndarray, classes: np.ndarray) -> None:
        """Those of the mean over the batch's wanted classes."""
        model, room, n, scored = self.model, self.room, len(part), WINDOW - OVERLAP
        size, here = n * scored, part[:, OVERLAP:].reshape(-1)
        d_q, d_k, d_v, d_r, d_direct, d_bias, d_mix, d_out, d_inside = self.grads
        p, mixed, (q, k, v) = model.attend(part, room)
        flat = mixed.reshape(size, WIDTH)
        hidden, d = model.classes(here, np.matmul(flat, model.mix, out=room("units", size, HIDDEN)), room)
        target = classes.reshape(-1)
        weight = (target >= 0).astype(np.float32)
        weight /= max(weight.sum(), 1)
        wanted = np.maximum(target, 0).astype(np.int64)
        clusters, inside = wanted // INSIDE, wanted % INSIDE
        np.exp(d, out=d)
        d *= (weight / (d @ ONES[:CLUSTERS]))[:, None]
        d.reshape(-1)[np.arange(size) * CLUSTERS + clusters] -= weight
        order, rows, inner, slices = model.inner(here, hidden, clusters, room)
        np.exp(inner, out=inner)
        share = weight.take(order)
        inner *= (share / (inner @ ONES[:INSIDE]))[:, None]
        inner.reshape(-1)[np.arange(size) * INSIDE + inside.take(order)] -= share
        d_rows = room("d_rows", size, HIDDEN)
        d_inside[:] = 0
        for c, at, end in slices:
            np.matmul(inner[at:end], model.inside[c].T, out=d_rows[at:end])
            np.matmul(rows[at:end].T, inner[at:end], out=d_inside[c])
        place = np.empty_like(order)
        place[order] = np.arange(size)
        d_hidden = np.matmul(d, model.out.T, out=room("d_hidden", size, HIDDEN))
        d_hidden += d_rows.take(place, axis=0, mode="clip", out=room("rows", size, HIDDEN))
        d_hidden *= hidden > 0
        d_out[:] = (d.T @ hidden).T
        d_mix[:] = (d_hidden.T @ flat).T
        d_mixed = np.matmul(d_hidden, model.mix.T, out=room("d_mixed", size, WIDTH)).reshape(mixed.shape)
        d_z = np.matmul(d_mixed, v.transpose(0, 2, 1), out=room("d_z", *p.shape))
        mixed *= d_mixed
        d_z -= (mixed @ ONES[:WIDTH])[:, :, None]
        d_z *= p
        d_bias[OVERLAP:] = np.add.reduce(d_z, axis=0)
        keys = np.matmul(d_z.transpose(0, 2, 1), q, out=room("keys", n, WINDOW, WIDTH))  # q has its factor already
        values = np.matmul(p.transpose(0, 2, 1), d_mixed, out=room("v", n, WINDOW, WIDTH))
        queries = np.matmul(d_z, k, out=room("mixed", n, scored, WIDTH))
        queries *= np.float32(WIDTH**-0.5)
        d_q[:], d_r[:], d_direct[:] = _by_symbol(here, [queries.reshape(-1, WIDTH), d_hidden, d], room)
        d_k[:], d_v[:] = _by_symbol(part.reshape(-1), [keys.reshape(-1, WIDTH), values.reshape(-1, WIDTH)], room)


def _by_symbol(symbols: np.ndarray, tables: list[np.ndarray], room: Room) -> list[np.ndarray]:
    """Sums of the rows of each symbol; two columns are added at a time."""
    order = np.argsort(symbols.astype(np.int16), kind="stable")
    counts = np.bincount(symbols, minlength=INPUTS + 2)
    found = np.flatnonzero(counts)
    firsts, sums = (np.cumsum(counts) - counts)[found], []
    for table in tables:
        rows = table.take(order, axis=0, mode="clip", out=room("sorted", *table.shape))
        out = np.zeros((INPUTS + 2, table.shape[1]), np.float32)
        out[found] = np.add.reduceat(rows.view(np.complex64), firsts, axis=0).view(np.float32)
        sums.append(out)
    return sums


def _words(column: pa.Array) -> tuple[np.ndarray, pa.StringArray, np.ndarray]:
    data, bounds = text_bytes(column)
    units, of_text = split_units(LOWER[data], bounds)
    return *coded(units), of_text


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a chunk; the empty string stands for the end."""
    for part in chunks(batches, 0, CHUNK):
        codes, names, _ = _words(part.column(0))
        n = np.append(np.bincount(codes, minlength=len(names)), part.num_rows)
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([names, pa.array([""])]), pa.array(n)], names=["word", "c"])


def _spaced(words: pa.StringArray) -> pa.StringArray:
    return pc.binary_join_element_wise("", words, " ")


def _subword_counts(file: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(END + 1)
        for batch in batches:
            offsets, ids = encoder(file).encode(_spaced(batch.column(0)))
            n += np.bincount(ids, weights=np.repeat(batch.column(1).to_numpy(), np.diff(offsets)), minlength=len(n))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used].astype(np.int64))], names=["id", "n"])

    return run


def stream(file: str, codes: np.ndarray, names: pa.StringArray, of_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of all texts one after another, each closed by the end id, and their bounds."""
    offsets, ids = encoder(file).encode(_spaced(names))
    sizes = np.diff(offsets)[codes]
    before = np.concatenate([[0], np.cumsum(sizes)])[of_text]
    bounds = before + np.arange(len(of_text))
    out = np.full(bounds[-1], END, dtype=np.int64)
    inside = np.ones(len(out), dtype=bool)
    inside[bounds[1:] - 1] = False
    out[inside] = ids[gather(offsets[:-1][codes], sizes)]
    return out, bounds


def _stream(file: str, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same of a column of texts, or of their subword ids as ``_texts`` stores them."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return stream(file, *_words(column))
    data, bounds = text_bytes(column.cast(pa.binary()))
    return data.view(STORED).astype(np.int64), bounds // 2


def _inputs(texts: DataFrame) -> DataFrame:
    return texts.select("doc_id", "ids" if "ids" in texts.columns else "text")


TRAINING = "cell int, n bigint, rank bigint, x binary, classes binary"


def _ranks(ids: pa.Array, text: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each window's text id and place, from 0 to 2 ** 53."""
    h = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)[text]
    for more in (np.uint64(0x9E3779B97F4A7C15), first.astype(np.uint64)):
        h = (h + more) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return (h >> np.uint64(11)).astype(np.int64)


def _training(
    file: str, vocabulary: Vocabulary, share: float
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's pair counts (cell, n), and the windows that fall in the share to fit on."""

    def packed(table: np.ndarray) -> pa.Array:
        table = np.ascontiguousarray(table, dtype="<i2")
        kind = pa.binary(2 * table.shape[1])
        return pa.FixedSizeBinaryArray.from_buffers(kind, len(table), [None, pa.py_buffer(table.tobytes())]).cast(pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((INPUTS + 2) * CLASSES, dtype=np.int64)
        names = ["cell", "n", "rank", "x", "classes"]
        for part in chunks(batches, 1, CHUNK // 2):
            ids, bounds = _stream(file, part.column(1))
            total += pair_counts(vocabulary, ids, bounds)
            rank = _ranks(part.column(0), *starts(bounds))
            chosen = np.flatnonzero(rank < share * 2.0**53)
            x, place, _ = windows(ids, bounds, vocabulary, chosen)
            none = [pa.nulls(len(x), kind) for kind in (pa.int32(), pa.int64())]
            own = [pa.array(rank[chosen]), packed(x), packed(wanted_classes(vocabulary, ids, place))]
            yield pa.RecordBatch.from_arrays([*none, *own], names=names)
        cells = np.flatnonzero(total)
        none = [pa.nulls(len(cells), kind) for kind in (pa.int64(), pa.binary(), pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells]), *none], names=names)

    return frugal(run)


def _unpacked(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(bytearray(b"".join(column.to_pylist())), dtype="<i2").reshape(-1, width).astype(np.int64)


def train(
    training: DataFrame, vocabulary: Vocabulary, n_subwords: float, file: str, steps: int, fit_windows: int, batch: int = 192
) -> Attention:
    """A model of the texts (doc_id, and text or ids): pairs of neighbours and weights from all of them."""
    size = max(n_subwords / (WINDOW - OVERLAP), 1)
    share = min(1.0, fit_windows / size + 0.001)
    work = materialize(_inputs(training).mapInArrow(_training(file, vocabulary, share), TRAINING))
    cells = work.where("cell is not null").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # 526,336 rows at most
    counts = np.zeros((INPUTS + 2) * CLASSES, dtype=np.int64)
    counts[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    some = work.where("cell is null").select("rank", "x", "classes").toArrow()  # 0.1 KB a window
    x, classes = _unpacked(some["x"], WINDOW), _unpacked(some["classes"], WINDOW - OVERLAP)
    order = np.lexsort((*x.T, some["rank"].to_numpy()))  # the same windows in the same order however texts are dealt out
    more = 3 * max(0, len(x) - fit_windows) // batch  # so that each window beyond those of a small input is seen as often
    model = fit_on(vocabulary, counts, x[order], classes[order], steps + more, batch)
    return refine(model, training, vocabulary, file, batch)


REFINED = "cell int, change bigint"
UNIT = 2.0**20  # changes are summed as whole numbers, so that the order of the sum does not matter


def _refining(
    file: str, model: Attention, vocabulary: Vocabulary, batch: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's change of each weight times its windows (cell from 0), and its windows (cell -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = replace(model, **{f: w.copy() for f, w in zip(WEIGHTS, model.weights(), strict=True)})
        adam, n = Adam(own), 0
        for part in chunks(batches, 1, CHUNK // 2):
            ids, bounds = _stream(file, part.column(1))
            text, first = starts(bounds)
            symbols = before(vocabulary, ids, bounds)
            order = np.argsort(_ranks(part.column(0), text, first), kind="stable")
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                place = places(bounds, text[chosen], first[chosen])
                wanted = wanted_classes(vocabulary, ids, place[:, OVERLAP:])
                adam.step(symbols[place], wanted, REFINE_RATE * len(place) / batch)
            n += len(order)
        change = [(w.astype(np.float64) - v).ravel() for w, v in zip(own.weights(), model.weights(), strict=True)]
        sums = np.append(np.rint(np.concatenate(change) * (n * UNIT)).astype(np.int64), n)
        cells = np.append(np.arange(len(sums) - 1), -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(sums)], names=["cell", "change"])

    return frugal(run)


def refine(model: Attention, training: DataFrame, vocabulary: Vocabulary, file: str, batch: int = 192) -> Attention:
    """The model after one pass over all windows of all texts (doc_id, and text or ids), in their tasks, and averaged."""
    moved = _inputs(training).mapInArrow(_refining(file, model, vocabulary, batch), REFINED)
    sums = moved.groupBy("cell").agg(F.sum("change").alias("change")).orderBy("cell").toArrow()  # a row for each weight
    if not sums.num_rows or not sums["change"][0].as_py():
        return model
    change = sums["change"].to_numpy()
    change = change[1:] / (change[0] * UNIT)
    cuts = np.cumsum([w.size for w in model.weights()])[:-1]
    parts = zip(WEIGHTS, model.weights(), np.split(change, cuts), strict=True)
    return replace(model, **{f: (w + c.reshape(w.shape)).astype(np.float32) for f, w, c in parts})


NAMES = ["word", "docs", "doc_id", "held_out", "n_tokens", "n_known", "logs", "ids"]
SCHEMA = (
    "word string, docs array<bigint>, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, "
    "logs double, ids binary"
)


def _texts(file: str, hot: list[tuple[str, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What the base score takes from each text, its subword ids, and the texts of each word that is not hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array([w for w, _ in hot], pa.string())
        counts = np.array([c for _, c in hot], dtype=np.float64)
        for part in chunks(batches, 1, CHUNK):
            codes, names, of_text = _words(part.column(1))
            rows = spread(of_text)
            at = pc.index_in(names, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
            logs = np.where(at >= 0, np.log10(counts[at] + 1) if len(hot) else 0.0, 0.0)
            n = part.num_rows
            ids, bounds = stream(file, codes, names, of_text)
            kept = [pa.py_buffer((2 * bounds).astype(np.int32)), pa.py_buffer(ids.astype(STORED))]
            arrays = [
                pa.nulls(n, pa.string()),
                pa.nulls(n, pa.list_(pa.int64())),
                part.column(0),
                part.column(2),
                pa.array(np.diff(of_text) + 1),
                pa.array(np.bincount(rows, weights=at[codes] >= 0, minlength=n).astype(np.int64)),
                pa.array(np.bincount(rows, weights=logs[codes], minlength=n).astype(np.float64)),
                pa.Array.from_buffers(pa.binary(), n, [None, *kept]),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=NAMES)
            left = at[codes] < 0
            offsets, docs = grouped(codes[left], rows[left], len(names))
            used = np.flatnonzero(np.diff(offsets))
            lists = pa.ListArray.from_arrays(
                np.append(offsets[used], offsets[-1]).astype(np.int32),
                part.column(0).take(pa.array(docs)),
            )
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.binary()]
            none = [pa.nulls(len(used), kind) for kind in kinds]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(used)), lists, *none], names=NAMES)

    return frugal(run)


def _score(file: str, model: Attention, vocabulary: Vocabulary) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, 1, CHUNK // 2):
            found = score(model, vocabulary, *_stream(file, part.column(1)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], names=["doc_id", "score"])

    return frugal(run)


def score_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 7,
    held_out_fold: int = 2,
    file: str = "byte_bpe_50k.json",
    fit_windows: int = 50_000,
    steps: int = 800,
    hot: int = 50_000,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    ship_package(spark)
    key = F.col(id_col).cast("bigint")
    out = F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(folds)) == held_out_fold, F.lit(False))
    texts = docs.select(key.alias("doc_id"), F.col(text_col).alias("text"), out.alias("held_out"))

    counted = texts.where(~F.col("held_out")).select("text").mapInArrow(frugal(_word_counts), "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))
    vocab = materialize(counted)
    total = vocab.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n_train, n_words = total.n or 0, total.v
    words = vocab.where("word <> ''")
    subwords = np.zeros(END + 1)
    for row in words.mapInArrow(_subword_counts(file), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():
        subwords[row.id] = row.n  # one row for each id of the public vocabulary at most
    n_end = vocab.where("word = ''").agg(F.sum("c")).first()[0] or 0
    subwords[END] += n_end
    vocabulary = Vocabulary.of(subwords)
    common = [(r.word, r.c) for r in most_frequent(words, "c", hot).orderBy(F.desc("c"), "word").collect()]

    rows = materialize(texts.mapInArrow(_texts(file, common), SCHEMA))  # texts become subwords once
    own = rows.where("word is null")
    model = train(own.where(~F.col("held_out")), vocabulary, subwords.sum(), file, steps, fit_windows)
    scores = materialize(_inputs(own).mapInArrow(_score(file, model, vocabulary), "doc_id bigint, score double"))
    rare = (
        rows.where("word is not null")
        .select("word", "docs")
        .join(words, "word")
        .select(F.explode("docs").alias("doc_id"), F.log10(F.col("c") + 1).alias("logs"))
        .groupBy("doc_id")
        .agg(F.count("*").alias("n_known"), F.sum("logs").alias("logs"))
    )
    both = (
        own.select("doc_id", "held_out", "n_tokens", "n_known", "logs")
        .unionByName(rare, allowMissingColumns=True)
        .unionByName(scores, allowMissingColumns=True)
    )
    end_log, end_known = float(np.log10(n_end + 1)), F.lit(1 if n_end else 0)
    per_row = F.when(F.col("held_out").isNotNull(), 1).otherwise(0)
    summed = both.groupBy("doc_id").agg(
        F.max("held_out").alias("held_out"),
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.sum(per_row) * end_known).cast("bigint").alias("n_known"),
        (F.sum("logs") + F.sum(per_row) * F.lit(end_log)).alias("logs"),
        F.sum("score").alias("score"),
    )
    base = F.col("logs") - F.col("n_tokens") * F.lit(float(np.log10(n_train + n_words + 1)))
    return summed.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("bigint").alias("train_tokens"),
        base.alias("base_score"), "score",
    )
