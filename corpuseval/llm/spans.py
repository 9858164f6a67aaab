"""Places of pattern matches inside a text, as column expressions whose work stays close to linear in the matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuseval.functions.once import let


def sums_before(sizes: Column) -> Column:
    """For an array of ints the sum of all elements before each one.

    Blocks of about sqrt(n) elements: block totals first, then the rest within a block, so n elements take n * sqrt(n) additions
    and no array is rebuilt for each element.
    """

    def inner(x: Column) -> Column:
        n = F.size(x["sizes"])
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
        add = lambda a, b: a + b
        total = lambda part: F.aggregate(part, F.lit(0), add)
        blocks = F.sequence(F.lit(0), F.greatest(F.lit(0), (n - 1).cast("int")), width)

        def offsets(width: Column) -> Column:
            sums = F.transform(blocks, lambda b: total(F.slice(x["sizes"], b + 1, width)))
            return let(sums, lambda s: F.transform(s, lambda _, i: total(F.slice(s, F.lit(1), i))))

        def places(p: Column) -> Column:
            block = lambda i: F.floor(i / p["width"]).cast("int")
            rest = lambda i: total(F.slice(x["sizes"], block(i) * p["width"] + 1, i % p["width"]))
            return F.transform(x["sizes"], lambda _, i: F.get(p["offsets"], block(i)) + rest(i))

        return let(F.struct(width.alias("width"), offsets(width).alias("offsets")), places)

    return let(F.struct(sizes.alias("sizes")), inner)


def placed_matches(text: Column, pattern: str, around: int) -> Column:
    """Array of (start, text, before, after) of all matches, in order; start in characters from 0, up to ``around`` characters
    of the text before and after a match as far as the neighbouring matches. Empty for an empty text."""

    def inner(p: Column) -> Column:
        sizes = F.transform(p["hits"], lambda hit, i: F.length(F.get(p["gaps"], i)) + F.length(hit))

        def one(starts: Column) -> Column:
            return F.transform(
                p["hits"],
                lambda hit, i: F.struct(
                    (F.get(starts, i) + F.length(F.get(p["gaps"], i))).alias("start"),
                    hit.alias("text"),
                    F.right(F.get(p["gaps"], i), F.lit(around)).alias("before"),
                    F.left(F.get(p["gaps"], i + 1), F.lit(around)).alias("after"),
                ),
            )

        return F.when(F.size(p["hits"]) > 0, let(sums_before(sizes), one))

    def parts(whole: Column) -> Column:
        return F.struct(
            F.regexp_extract_all(whole, F.lit(pattern), F.lit(0)).alias("hits"), F.split(whole, pattern, -1).alias("gaps")
        )

    none = F.array().cast("array<struct<start:int,text:string,before:string,after:string>>")
    return F.coalesce(let(parts(F.coalesce(text, F.lit(""))), inner), none)
