"""Token counts of whole texts: pieces are counted once per distinct pre-token and joined to per-document frequencies.

A pre-token here is a unit of the byte-level pattern up to white space: a word with its leading space, or a run of white
space. Pattern matches never cross these borders, so counts add up. One pass splits the texts. Pre-tokens of a bounded
hot list are summed at once; the others leave as (pre-token, ids of its documents), are dealt out by pre-token, counted
there once, and summed by document. No list of ids is ever made for a text.

The hot list is only there for balance: it comes from a bounded sample of texts, holds at most ``hot_units`` pre-tokens,
and does not change any result. What is not hot is spread over many partitions by its hash.

Defined cases: a null or empty text has 0 bytes and 0 tokens; rows that repeat an id are one document whose texts are
counted one by one and summed; a null id is an id of its own; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuseval.llm.subword import encoder
from corpuseval.llm.units import chunks, coded, grouped, split_gaps, split_parts, spread, text_bytes
from corpuseval.session import ship_package

#: White space beyond ASCII, information separators and special strings: such texts go to the library whole.
UNUSUAL = (
    r"[\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|<\|"
)
CHUNK = 8 << 20


def _units(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All pre-tokens of a chunk and the row of each; and the rows that the library takes whole."""
    texts = batch.column(1).fill_null("")
    whole = pc.match_substring_regex(texts, UNUSUAL).to_numpy(zero_copy_only=False)
    data, bounds = text_bytes(texts)
    if not len(data):
        return pa.array([], pa.string()), np.zeros(0, dtype=np.int64), whole
    units, of_text, held, bare = split_parts(data, bounds, keep_space=True)
    gaps, gap_rows = split_gaps(data, bounds, held, bare)
    rows = np.concatenate([spread(of_text), gap_rows])
    units = pa.concat_arrays([units, gaps])
    if whole.any():
        usual = ~whole[rows]
        units, rows = units.filter(pa.array(usual)), rows[usual]
    return units, rows, whole


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, 1, CHUNK):
        codes, names = coded(_units(part)[0])
        yield pa.RecordBatch.from_arrays([names, pa.array(np.bincount(codes, minlength=len(names)))], ["unit", "n"])


def _split(file: str, hot: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of two kinds: (doc_id, n_bytes, n_tokens of hot pre-tokens), and (unit, docs) for each other pre-token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(file)
        known = pa.array(hot, pa.string())
        pieces = np.diff(tokens.encode(known)[0])
        for part in chunks(batches, 1, CHUNK):
            units, rows, whole = _units(part)
            ids = part.column(0)
            n = np.zeros(part.num_rows, dtype=np.int64)
            direct = np.flatnonzero(whole)
            if len(direct):
                texts = part.column(1).take(pa.array(direct)).to_pylist()
                for k, text in zip(direct, texts, strict=True):
                    n[k] = len(tokens.library.encode(text, add_special_tokens=False).ids)
            codes, names = coded(units)
            at = pc.index_in(names, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
            worth = np.where(at >= 0, pieces[np.maximum(at, 0)] if len(pieces) else 0, 0)
            n += np.bincount(rows, weights=worth[codes], minlength=part.num_rows).astype(np.int64)
            if ids.null_count:  # texts without an id cannot be named in a list
                rare = np.flatnonzero(at < 0)
                own = np.zeros(len(names), dtype=np.int64)
                own[rare] = np.diff(tokens.encode(names.take(pa.array(rare)))[0])
                nameless = ids.is_null().to_numpy(zero_copy_only=False)[rows]
                n += np.bincount(rows[nameless], weights=own[codes[nameless]], minlength=part.num_rows).astype(np.int64)
                codes, rows = codes[~nameless], rows[~nameless]
            _, bounds = text_bytes(part.column(1))
            empty = pa.nulls(part.num_rows, pa.string()), pa.nulls(part.num_rows, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*empty, ids, pa.array(np.diff(bounds)), pa.array(n)], names=NAMES)
            left = at[codes] < 0
            offsets, docs = grouped(codes[left], rows[left], len(names))
            used = np.flatnonzero(np.diff(offsets))
            values = ids.fill_null(0).to_numpy(zero_copy_only=False)[docs]
            lists = pa.ListArray.from_arrays(np.append(offsets[used], offsets[-1]).astype(np.int32), pa.array(values))
            none = [pa.nulls(len(used), pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([names.take(pa.array(used)), lists, *none], names=NAMES)

    return run


NAMES = ["unit", "docs", "doc_id", "n_bytes", "n_tokens"]
SCHEMA = "unit string, docs array<bigint>, doc_id bigint, n_bytes bigint, n_tokens bigint"


def _count(file: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pieces of each distinct pre-token, summed by document within the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(file)
        for batch in batches:
            docs = batch.filter(batch.column(0).is_null())
            yield docs.select(NAMES[2:])
            lists = batch.filter(batch.column(0).is_valid())
            if not lists.num_rows:
                continue
            codes, names = coded(lists.column(0))
            pieces = np.diff(tokens.encode(names)[0])[codes]
            lengths = lists.column(1).value_lengths().to_numpy(zero_copy_only=False)
            ids, where = np.unique(lists.column(1).flatten().to_numpy(zero_copy_only=False), return_inverse=True)
            n = np.bincount(where, weights=np.repeat(pieces, lengths)).astype(np.int64)
            zero = np.zeros(len(ids), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(zero), pa.array(n)], names=NAMES[2:])

    return run


def sampled(docs: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` rows, chosen by the hash of their id."""
    share = max(1, docs.count() // rows)
    return docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)


def count_tokens(
    docs: DataFrame,
    file: str = "byte_bpe_50k.json",
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 512,
    hot_sample: int = 2000,
    hot_units: int = 30_000,
) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens), for a byte-level vocabulary file."""
    ship_package(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    seen = sampled(texts, hot_sample).mapInArrow(_frequencies, "unit string, n bigint").groupBy("unit").agg(F.sum("n").alias("n"))
    hot = [r.unit for r in seen.orderBy(F.desc("n"), "unit").limit(hot_units).collect()]
    spread_key = F.when(F.col("unit").isNull(), F.xxhash64("doc_id", "n_bytes")).otherwise(F.xxhash64("unit"))
    parts = texts.mapInArrow(_split(file, hot), SCHEMA).repartition(spread_key).sortWithinPartitions("unit")
    sums = parts.mapInArrow(_count(file), "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return (
        sums.groupBy("doc_id")
        .agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
