"""Mark text on recognised lines, documents and pages."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpuseval.functions.arrays import overlap_scores
from corpuseval.functions.boxes import box, clamp_box, is_valid, pad_box
from corpuseval.functions.classify import COVER
from corpuseval.functions.marktext import (
    DEFAULT_SCORE,
    DEFAULT_TOKENS,
    is_mark_text,
    may_hold_mark,
    polygon_bounds,
    polygon_center,
    squash,
    text_region,
)
from corpuseval.functions.once import compute_once
from corpuseval.operators.keyed import names
from corpuseval.session import materialize, ship_package

TOKEN_BLOCK = 50_000  # tokens in one automaton
HITS_PER_BATCH = 20_000


def flatten_lines(df: DataFrame, polys: str, texts: str, scores: str) -> DataFrame:
    """Parallel arrays to one row per line (``line_no``, ``polygon``, ``text``, ``score``).

    Like a zip, the shortest array decides the number of lines.
    """
    others = [c for c in df.columns if c not in (polys, texts, scores)]
    shortest = F.least(F.size(polys), F.size(texts), F.size(scores))
    zipped = F.slice(
        F.arrays_zip(F.col(polys).alias("polygon"), F.col(texts).alias("text"), F.col(scores).alias("score")),
        F.lit(1),
        F.greatest(shortest, F.lit(0)),
    )
    return df.select(*others, F.posexplode(zipped).alias("line_no", "_line")).select(
        *others, "line_no", "_line.polygon", "_line.text", "_line.score"
    )


def flatten_entries(df: DataFrame, entries: str) -> DataFrame:
    """The older nested form, ``array<struct<polygon, text, score>>``, to line rows."""
    others = [c for c in df.columns if c != entries]
    return df.select(*others, F.posexplode(entries).alias("line_no", "_line")).select(
        *others, "line_no", "_line.polygon", "_line.text", "_line.score"
    )


def accept_lines(
    lines: DataFrame,
    tokens: Sequence[str] = DEFAULT_TOKENS,
    threshold: float = DEFAULT_SCORE,
) -> DataFrame:
    """Lines that count as marks, with ``region`` and padded ``box``.

    Needs ``polygon array<struct<x,y>>``, ``text``, ``score``, ``width``, ``height`` and
    ``category``. A row-level projection and filter: no shuffle, and the cheap score test comes
    first so that Catalyst can push it to the source.
    """
    usable = lines.filter((F.coalesce("score", F.lit(0.0)) >= threshold) & (F.size("polygon") > 0))
    cx, cy = polygon_center(F.col("polygon"))
    x1, y1, x2, y2 = polygon_bounds(F.col("polygon"))
    outline = F.struct(cx.alias("cx"), cy.alias("cy"), box(x1, y1, x2, y2).alias("bounds"))
    outlined = compute_once(usable, "_o", outline)
    width, height, category = F.col("width"), F.col("height"), F.col("category")
    placed = outlined.withColumn("region", text_region(F.col("_o.cx"), F.col("_o.cy"), width, height, category))
    marked = placed.filter(
        F.col("region").isNotNull()
        & ((category == COVER) | is_mark_text(F.col("text"), F.col("region"), tokens))
    )
    padded = pad_box(clamp_box(F.col("_o.bounds"), width, height), width, height, F.col("region"))
    return marked.withColumn("box", padded).filter(is_valid(F.col("box"))).drop("_o")


def line_confidence(items: DataFrame, accepted: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Accepted lines and mean accepted score per item; 0 and 0.0 where none."""
    keys = names(key)
    per_item = accepted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_lines"), F.avg("score").alias("_mean")
    )
    return items.join(per_item, keys, "left").select(
        *items.columns,
        F.coalesce("_lines", F.lit(0)).alias("accepted_lines"),
        F.round(F.coalesce("_mean", F.lit(0.0)), 6).alias("confidence"),
    )


def residual_score(items: DataFrame, accepted: DataFrame, key: str | Sequence[str], scorer_ok: Column | None = None) -> DataFrame:
    """Hits, summed and greatest score of remaining marks; NULL where the scorer did not run."""
    keys = names(key)
    per_item = accepted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_hits"),
        F.round(F.sum(F.round("score", 4)), 6).alias("_sum"),
        F.round(F.max(F.round("score", 4)), 6).alias("_max"),
    )
    ok = F.lit(True) if scorer_ok is None else scorer_ok
    return items.join(per_item, keys, "left").select(
        *items.columns,
        F.when(ok, F.coalesce("_hits", F.lit(0))).alias("ocr_residual_hits"),
        F.when(ok, F.coalesce("_sum", F.lit(0.0))).alias("ocr_residual_score"),
        F.when(ok, F.coalesce("_max", F.lit(0.0))).alias("ocr_residual_max_score"),
    )


def cascade_rows(rows: DataFrame, key: str | Sequence[str], stage_names: Sequence[str], stage: str = "stage") -> DataFrame:
    """First stage per item with a nonempty mask; the first stage's row when all are empty.

    ``rows`` has the key, the stage number, ``mask_nonzero`` and payload columns. Adds ``strategy``
    and ``attempts`` (the stages tried up to the one taken). One aggregate, combined map-side.
    """
    keys = names(key)
    payload = [c for c in rows.columns if c not in (*keys, stage)]
    count = len(stage_names)
    # Empty stages rank after all others, the first of them before the rest.
    rank = F.when(F.col("mask_nonzero") > 0, F.col(stage)).otherwise(F.col(stage) + count)
    picked = rows.groupBy(*keys).agg(
        F.min_by(F.struct(F.col(stage).alias("_stage"), *payload), rank).alias("_row")
    )
    tried = F.when(F.col("_row.mask_nonzero") > 0, F.col("_row._stage") + 1).otherwise(count)
    all_names = F.array(*[F.lit(n) for n in stage_names])
    return picked.select(
        *keys,
        *[F.col(f"_row.{c}").alias(c) for c in payload],
        F.get(all_names, F.col("_row._stage")).alias("strategy"),
        F.slice(all_names, F.lit(1), tried).alias("attempts"),
    )


def cascade(stages: Sequence[tuple[str, DataFrame]], key: str | Sequence[str]) -> DataFrame:
    """``cascade_rows`` over one table per stage, all with the columns of the first."""
    columns = stages[0][1].columns
    tagged = [df.select(*columns).withColumn("_stage_no", F.lit(i)) for i, (_, df) in enumerate(stages)]
    return cascade_rows(
        reduce(DataFrame.unionByName, tagged), key, [name for name, _ in stages], "_stage_no"
    )


def document_lines(documents: DataFrame, text: str = "text") -> DataFrame:
    """One row per line of every whole text (``line_no`` from 0)."""
    others = [c for c in documents.columns if c != text]
    return documents.select(*others, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def page_runs(html: Column) -> Column:
    """Text between tags as an array, without scripts and styles, blank runs dropped."""
    visible = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>", "")
    return F.filter(
        F.split(visible, r"<[^>]*>"), lambda run: F.length(squash(run)) > 0
    )


def page_domain(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/:?#]+)", 1))


def mark_hits(lines: Column, region: str | None, tokens: Sequence[str] = DEFAULT_TOKENS) -> Column:
    """Number of mark lines in an ``array<string>``."""
    where = F.lit(region).cast("string")
    return F.size(F.filter(lines, lambda line: is_mark_text(line, where, tokens)))


def document_hits(text: Column, lines: Column, region: str | None, tokens: Sequence[str] = DEFAULT_TOKENS) -> Column:
    """``mark_hits`` behind a whole-text test, so texts without any of the words are never split."""
    return F.when(may_hold_mark(text, tokens, region is not None), mark_hits(lines, region, tokens)).otherwise(0)


def mark_audit(items: DataFrame, group_cols: str | Sequence[str], hits: str = "hits") -> DataFrame:
    """Items, items with marks, their share and mark lines per group; counts combine map-side."""
    return items.groupBy(*names(group_cols)).agg(
        F.count(F.lit(1)).alias("item_count"),
        F.count_if(F.col(hits) > 0).alias("marked_count"),
        F.sum(F.col(hits).cast("long")).alias("mark_lines"),
        F.round(F.avg(F.when(F.col(hits) > 0, 1.0).otherwise(0.0)), 6).alias("marked_share"),
    )


def predicate_quality(predictions: DataFrame, truth: DataFrame, key: str, predicted: str, actual: str) -> DataFrame:
    """Overlap scores of a predicate against ground truth on the labelled items."""
    joined = predictions.select(key, predicted).join(truth.select(key, actual), key)
    counts = joined.agg(
        F.count(F.lit(1)).alias("labelled_count"),
        F.count_if(F.col(predicted) & F.col(actual)).alias("shared_count"),
        F.count_if(F.col(actual)).alias("actual_count"),
        F.count_if(F.col(predicted)).alias("predicted_count"),
    )
    scores = overlap_scores(F.col("shared_count"), F.col("actual_count"), F.col("predicted_count"))
    return counts.select("*", *[c.alias(n) for n, c in scores.items()])


def token_hits(
    lines: DataFrame,
    tokens: DataFrame,
    text: str = "line",
    token: str = "token",
    block: int = TOKEN_BLOCK,
) -> DataFrame:
    """Every (line, token) where the squashed line contains the normalised token.

    Tokens are taken in blocks of about ``block``, dealt by hash. As many blocks as hold about ``TOKEN_BLOCK`` tokens, one at
    least, become one automaton, built once per task, that reads each line a single time whatever the number of tokens; lines
    stay in their task and are not shuffled. Further blocks are another pass over the lines, and the hits of each pass are
    stored before the next is built, so only one automaton is held at a time.
    """
    spark = lines.sparkSession
    distinct = materialize(tokens.select(squash(F.col(token)).alias("token")).filter("token <> ''").distinct())
    blocks = -(-distinct.count() // block)
    if not blocks:
        return lines.withColumn("token", F.lit("")).filter(F.lit(False))
    ship_package(spark)
    flat = lines.withColumn("_flat", squash(F.coalesce(F.col(text), F.lit(""))))
    schema = T.StructType([*lines.schema.fields, T.StructField("token", T.StringType())])
    found = None
    together = max(1, TOKEN_BLOCK // block)
    for first in range(0, blocks, together):
        dealt = distinct.filter(F.pmod(F.xxhash64("token"), F.lit(blocks)).between(first, first + together - 1))
        hits = flat.mapInArrow(partial(_scan_lines, [row.token for row in dealt.collect()]), schema)
        hits = hits if blocks <= together else materialize(hits)
        found = hits if found is None else found.unionByName(hits)
    return found


def _scan_lines(words: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of each batch, repeated for every word that its last column contains."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for word in words:
        machine.add_word(word, word)
    machine.make_automaton()

    def taken(batch: pa.RecordBatch, at: list[int], what: list[str]) -> pa.RecordBatch:
        columns = [c.take(pa.array(at, pa.int32())) for c in batch.columns[:-1]]
        return pa.RecordBatch.from_arrays([*columns, pa.array(what, pa.string())], names=[*batch.schema.names[:-1], "token"])

    for batch in batches if words else ():
        at: list[int] = []
        what: list[str] = []
        for i, line in enumerate(batch.columns[-1]):
            hits = sorted({word for _, word in machine.iter(line.as_py())})
            at += [i] * len(hits)
            what += hits
            if len(at) >= HITS_PER_BATCH:
                yield taken(batch, at, what)
                at, what = [], []
        yield taken(batch, at, what)
