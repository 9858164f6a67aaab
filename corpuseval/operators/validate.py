"""Row and header checks. Bad rows become a reject table instead of failing a task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from corpuseval.operators.keyed import lookup_join

REQUIRED_TEXT = ["source_path", "relative_path", "category"]
REQUIRED_INT = ["width", "height"]


def check_items(df: DataFrame) -> DataFrame:
    """Add ``reject_reason``: the first required field that is missing or empty, else NULL."""
    reason = F.coalesce(
        *[
            F.when(F.col(c).isNull() | (F.col(c) == ""), F.lit(f"{c} is missing or empty"))
            for c in REQUIRED_TEXT[:2]
        ],
        *[F.when(F.col(c).isNull(), F.lit(f"{c} is not an integer")) for c in REQUIRED_INT],
        F.when(
            F.col("category").isNull() | (F.col("category") == ""),
            F.lit("category is missing or empty"),
        ),
    )
    return df.withColumn("reject_reason", reason)


def validate_items(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = check_items(df)
    return (
        checked.filter("reject_reason is null").drop("reject_reason"),
        checked.filter("reject_reason is not null"),
    )


def check_version(header: DataFrame, column: str, expected: int) -> DataFrame:
    """Fail the job on a header whose version differs."""
    message = F.concat(
        F.lit(f"unsupported {column}: "),
        F.coalesce(F.col(column).cast("string"), F.lit("none")),
        F.lit(f", expected {expected}"),
    )
    passed = F.assert_true(F.coalesce(F.col(column) == expected, F.lit(False)), message)
    return header.filter(passed.isNull())


def count_mismatch(header: DataFrame, items: DataFrame, key: str, declared: str = "item_count") -> DataFrame:
    """Headers whose declared count differs from the loaded rows."""
    loaded = items.groupBy(key).agg(F.count(F.lit(1)).alias("loaded_count"))
    joined = header.select(key, declared).join(loaded, key, "left").withColumn(
        "loaded_count", F.coalesce("loaded_count", F.lit(0))
    )
    return joined.filter(~F.col(declared).eqNullSafe(F.col("loaded_count")))


def unknown_names(requests: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Requests that name something undefined."""
    return lookup_join(requests, known.select(column).distinct(), column, "left_anti")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Fail before expensive setup when there is nothing to do."""
    if df.isEmpty():
        raise ValueError(f"{what} has no items")
    return df


def require_names(requested: Sequence[str], known: Sequence[str], what: str) -> None:
    missing = [name for name in requested if name not in known]
    if missing:
        raise ValueError(f"unknown {what}: {', '.join(missing)}")
