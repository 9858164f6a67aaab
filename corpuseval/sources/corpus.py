"""Corpus listing, images and masks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpuseval.functions import pixels
from corpuseval.functions.classify import IMAGE_SUFFIXES, file_suffix
from corpuseval.operators.keyed import first_n
from corpuseval.session import ship_package

# Folder names left out of a recursive listing.
EXCLUDED_DIRS = [
    ".git",
    ".hg",
    ".svn",
    "__pycache__",
    ".pytest_cache",
    ".mypy_cache",
    ".venv",
    "venv",
    "env",
    "runtime",
    "docs",
    "src",
    "tests",
]


def relative_to(path: Column, root: str) -> Column:
    """Path below ``root``; both may carry a scheme such as ``file:`` or ``s3a:``."""
    bare = root.split(":", 1)[-1].lstrip("/").rstrip("/")
    return F.regexp_replace(path, "^(?:[A-Za-z0-9+.-]+:)?/*" + _quote(bare) + "/+", "")


def _quote(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_" else "\\" + c for c in text)


def list_corpus(
    spark: SparkSession,
    root: str,
    recursive: bool = True,
    excluded: Sequence[str] = (),
    limit: int | None = None,
) -> DataFrame:
    """Image files below ``root``: path, relative path, length, modification time.

    Only file metadata is read, never ``content``. Excluded folder names apply at any depth of a
    recursive listing. A limit takes the first paths in order, before anything is decoded.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(root).select(
        F.col("path").alias("source_path"),
        relative_to(F.col("path"), root).alias("relative_path"),
        "length",
        F.col("modificationTime").alias("modified"),
    )
    return select_images(files, recursive, excluded, limit)


def select_images(files: DataFrame, recursive: bool = True, excluded: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Suffix and folder rules of a listing on any table with ``relative_path``."""
    kept = files.filter(file_suffix(F.col("relative_path")).isin(IMAGE_SUFFIXES))
    if recursive:
        banned = F.array(*[F.lit(d) for d in [*EXCLUDED_DIRS, *excluded]])
        kept = kept.filter(~F.arrays_overlap(F.split("relative_path", "/"), banned))
    return kept if limit is None else first_n(kept, "relative_path", limit)


def read_images(spark: SparkSession, root: str, recursive: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(good, rejects)``: decoded images and files that could not be decoded.

    Paths are the files' metadata, so a filter on ``relative_path`` alone is applied while the scan is planned: files that it
    drops are not opened, let alone decoded.
    """
    reader = (
        spark.read.format("image")
        .option("dropInvalid", "false")
        .option("recursiveFileLookup", str(recursive).lower())
    )
    # The metadata path is escaped, the file listing's is not; a plus sign is literal here.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    rows = reader.load(root).select(
        path.alias("source_path"),
        relative_to(path, root).alias("relative_path"),
        F.col("image.height").alias("height"),
        F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("nChannels"),
        F.col("image.data").alias("data"),
    )
    good = rows.filter("width > 0")
    rejects = rows.filter("width <= 0").select(
        "source_path", "relative_path", F.lit("not decodable").alias("reject_reason")
    )
    return good, rejects


def read_masks(spark: SparkSession, root: str) -> DataFrame:
    """Mask files as packed words: ``mask_path, height, width, mask_nonzero, words``."""
    ship_package(spark)
    good, _ = read_images(spark, root)
    schema = "mask_path string, height int, width int, mask_nonzero long, words array<bigint>"

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, h, w, c, data in zip(
                *(batch[x] for x in ["source_path", "height", "width", "nChannels", "data"])
            ):
                mask = pixels.gray(pixels.decode(data, h, w, c)) > 0
                rows.append((path, h, w, int(mask.sum()), pixels.pack(mask)))
            yield pd.DataFrame(rows, columns=["mask_path", "height", "width", "mask_nonzero", "words"])

    return good.mapInPandas(pack, schema)
