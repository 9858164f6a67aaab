"""Array metrics on ``array<numeric>`` columns.

Masks are packed into 64-bit words first. A packed mask is 32 times smaller than float
values, so pair joins move words instead of samples, and overlap is a ``bit_count`` per word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from corpuseval.functions.once import let

# Full scale of an edge map, gradient level counted as an edge.
EDGE_FULL_SCALE = 255.0
EDGE_LEVEL = 80.0


def _pack(values: Column, is_set) -> Column:
    """Bits of 64 samples per word. ``values`` is bound once, however many words there are."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def words(v: Column) -> Column:
        def word(w: Column) -> Column:
            bits = F.transform(
                F.slice(v, w * 64 + 1, F.lit(64)),
                lambda x, i: F.when(is_set(x), F.call_function("shiftleft", one, i)).otherwise(zero),
            )
            return F.aggregate(bits, zero, lambda acc, b: acc.bitwiseOR(b))

        last = F.ceil(F.size(v) / F.lit(64)).cast("int") - 1
        return F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(0), last), word)).otherwise(
            F.array().cast("array<bigint>")
        )

    return let(values, words)


def pack_mask(values: Column) -> Column:
    """Samples above zero as bits of ``array<bigint>``; NULL stays NULL."""
    return F.when(values.isNotNull(), _pack(values, lambda x: x > 0))


def popcount(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda acc, w: acc + F.bit_count(w))


def and_count(a: Column, b: Column) -> Column:
    return popcount(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)))


def xor_count(a: Column, b: Column) -> Column:
    return popcount(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)))


def overlap_scores(intersection: Column, baseline: Column, candidate: Column) -> dict[str, Column]:
    """IoU, precision and recall of two sets; all 1.0 when both are empty."""
    union = baseline + candidate - intersection

    def score(denominator: Column) -> Column:
        return F.when(union == 0, F.lit(1.0)).otherwise(F.round(intersection / denominator, 6))

    one = F.lit(1)
    return {
        "iou": score(F.greatest(union, one)),
        "precision": score(F.greatest(candidate, one)),
        "recall": score(F.greatest(baseline, one)),
    }


def changed_count(a: Column, b: Column) -> Column:
    """Samples that differ; NULL when the shapes differ."""
    differing = F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda d: d)
    return F.when(F.size(a) == F.size(b), F.size(differing).cast("long"))


def mean_abs_diff(a: Column, b: Column) -> Column:
    """Mean absolute difference over all samples, 6 decimals; NULL when the shapes differ."""
    total = F.aggregate(
        F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))),
        F.lit(0.0),
        lambda acc, d: acc + d,
    )
    return F.when(
        (F.size(a) == F.size(b)) & (F.size(a) > 0), F.round(total / F.size(a), 6)
    )


def edge_words(values: Column, width: int, level: float = EDGE_LEVEL) -> Column:
    """Packed map of samples whose right plus lower neighbour difference exceeds ``level``.

    A gradient map, not a Canny map: it has no smoothing, thinning or hysteresis.
    """

    def edges(v: Column) -> Column:
        def gradient(x: Column, i: Column) -> Column:
            here, zero = x.cast("double"), F.lit(0.0)
            right = F.when(
                (i % width) < width - 1, F.abs(F.get(v, i + 1).cast("double") - here)
            ).otherwise(zero)
            below = F.when(
                i < F.size(v) - width, F.abs(F.get(v, i + width).cast("double") - here)
            ).otherwise(zero)
            return right + below

        return F.transform(v, gradient)

    return F.when(values.isNotNull(), _pack(let(values, edges), lambda g: g > F.lit(level)))


def edge_delta(a_words: Column, b_words: Column, samples: Column) -> Column:
    """Mean absolute difference of two 0/255 edge maps given as packed words."""
    return F.round(xor_count(a_words, b_words) * F.lit(EDGE_FULL_SCALE) / samples, 6)


def patch(values: Column, width: int, height: int, x1: int, y1: int, x2: int, y2: int) -> Column:
    """Samples of a sub-rectangle in row order."""
    rows = range(max(0, y1), min(height, y2))
    return F.concat(*[F.slice(values, y * width + x1 + 1, x2 - x1) for y in rows])


def fraction(values: Column, test) -> Column:
    return F.size(F.filter(values, test)) / F.size(values)


def _or(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def _smeared(word: Column, shift_by) -> Column:
    """Every bit on one side of a set bit is set as well; no arithmetic that could overflow."""

    def smear(value: Column, shift: int) -> Column:
        return let(value, lambda w: w.bitwiseOR(shift_by(w, shift)))

    return reduce(smear, (1, 2, 4, 8, 16, 32), word)


def first_bit(word: Column) -> Column:
    """Place of the lowest set bit of a nonzero word."""
    return 64 - F.bit_count(_smeared(word, F.shiftleft))


def last_bit(word: Column) -> Column:
    """Place of the highest set bit of a nonzero word."""
    return F.bit_count(_smeared(word, F.shiftrightunsigned)) - 1


def _row_words(words: Column, width: Column, row: Column) -> Column:
    """The bits of one row of a packed mask, from bit 0 of the first word on."""
    count = F.ceil(width / F.lit(64)).cast("int")

    def word(k: Column) -> Column:
        start = row.cast("long") * width + k * 64
        size = F.least(F.lit(64), width - k * 64)
        at, shift = F.floor(start / F.lit(64)).cast("int"), (start % 64).cast("int")
        here = F.call_function("shiftrightunsigned", F.coalesce(F.get(words, at), F.lit(0).cast("long")), shift)
        after = F.call_function("shiftleft", F.coalesce(F.get(words, at + 1), F.lit(0).cast("long")), F.lit(64) - shift)
        whole = F.when(shift == 0, here).otherwise(_or(here, after))
        kept = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), (F.lit(64) - size).cast("int"))
        return whole.bitwiseAND(kept)

    return F.transform(F.sequence(F.lit(0), count - 1), word)


def mask_extent(words: Column, width: Column, height: Column) -> Column:
    """Box (x1, y1, x2, y2) around the set samples of a packed mask in row order; NULL for an empty or missing mask.

    Rows come from the first and last set bit of all words. Columns come from the rows laid over each other, a word at a time.
    """
    zero = F.lit(0).cast("long")

    def ends(v: Column) -> Column:
        """First and last set bit of an array of words, NULL without one."""
        used = F.filter(F.transform(v, lambda w, i: F.struct(i.cast("long").alias("i"), w.alias("w"))), lambda x: x["w"] != 0)
        low, high = F.get(used, F.lit(0)), F.get(used, F.size(used) - 1)
        return F.when(
            F.size(used) > 0,
            F.struct((low["i"] * 64 + first_bit(low["w"])).alias("first"), (high["i"] * 64 + last_bit(high["w"])).alias("last")),
        )

    def inside(p: Column) -> Column:
        w, h = p["width"], p["height"]
        none = F.transform(F.sequence(F.lit(0), F.ceil(w / F.lit(64)).cast("int") - 1), lambda k: zero)

        def boxed(rows: Column) -> Column:
            top, bottom = F.floor(rows["first"] / w).cast("int"), F.floor(rows["last"] / w).cast("int")
            laid = F.aggregate(
                F.sequence(top, bottom), none, lambda acc, r: F.zip_with(acc, _row_words(p["words"], w, r), lambda a, b: a.bitwiseOR(b))
            )
            box = lambda columns: F.struct(
                columns["first"].cast("int").alias("x1"), top.alias("y1"), (columns["last"] + 1).cast("int").alias("x2"), (bottom + 1).alias("y2")
            )
            return let(let(laid, ends), box)

        return let(ends(p["words"]), lambda rows: F.when(rows.isNotNull(), boxed(rows)))

    usable = words.isNotNull() & (width > 0) & (height > 0)
    bound = F.struct(words.alias("words"), width.cast("long").alias("width"), height.cast("long").alias("height"))
    return F.when(usable, let(bound, inside))
