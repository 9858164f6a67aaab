"""Keyed building blocks that stay balanced when one key holds a large share of the rows.

Rules used throughout the library:

* de-duplication and "latest" are aggregates (``max_by``/``min``), so every map task reduces a
  hot key to one row before the shuffle; no window is opened over an unbounded key;
* global or per-key numbering is done by range slices, see ``ordered_number``;
* joins against a unique table are left to Catalyst and AQE, which broadcast only below the
  configured byte limit; where the large side may be hot, ``lookup_join`` salts the hot keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuseval.session import materialize

HOT_BUCKETS, HOT_ROWS, HOT_SHARE = 4096, 1_000_000, 1000
GROUP_LIMIT_PUSHDOWN = 1000  # spark.sql.optimizer.windowGroupLimitThreshold
TOP_K_LIMIT = 10_000
TOP_SALTS = 16


def names(keys: str | Sequence) -> list:
    return [keys] if isinstance(keys, str) else list(keys)


def not_blank(column: Column) -> Column:
    return column.isNotNull() & (F.trim(column.cast("string")) != "")


def last_wins(df: DataFrame, key: str | Sequence[str], pos: str) -> DataFrame:
    """One row per key, the one with the greatest ``pos``; rows with a blank key are dropped."""
    keys = names(key)
    payload = [c for c in df.columns if c not in keys]
    kept = df.filter(reduce(and_, [not_blank(F.col(k)) for k in keys]))
    picked = kept.groupBy(*keys).agg(F.max_by(F.struct(*payload), pos).alias("_row"))
    return picked.select(*keys, "_row.*")


def ordered_distinct(df: DataFrame, value: str, pos: str, group: str | Sequence[str] = ()) -> DataFrame:
    """Distinct values with the position of their first occurrence (``first_pos``)."""
    return df.groupBy(*names(group), value).agg(F.min(pos).alias("first_pos"))


def latest_report(
    reports: DataFrame, keys: Sequence[str], run: str = "run_id", path: str = "report_path"
) -> DataFrame:
    """Per key the greatest run id and its report; equal run ids resolve to the smallest path."""
    per_run = reports.groupBy(*keys, run).agg(F.min(path).alias(path))
    return per_run.groupBy(*keys).agg(
        F.max(run).alias("latest_run_id"), F.max_by(path, run).alias("latest_report")
    )


def ordered_number(
    df: DataFrame,
    partition: str | Sequence[str],
    order: str | Sequence[str | Column],
    name: str = "seq",
    key: str | Sequence[str] | None = None,
) -> DataFrame:
    """Number rows 1..n in ``order`` within each ``partition`` without one task per partition.

    ``row_number`` would sort a hot partition in a single task. Here rows are range-partitioned
    on (partition, order), so a hot partition spans many slices; each slice numbers its own rows
    by physical position, and a prefix sum over slice sizes (one row per slice) supplies the
    offsets. The sliced rows are stored once so that both passes see the same slices, and the offsets, so that their size is
    known and the join moves no rows where they are few.
    ``order`` should be unique per partition for a deterministic result.

    ``key`` names columns that identify a row and are not null; ``order`` has to be names then. Only key, partition and order are
    sliced, sorted and stored; rows get their number by a join on the key, which is unique, so no key of it is hot. It pays for wide
    rows: rows of a few short columns are numbered as fast whole.
    """
    if key is not None:
        narrow = df.select(*dict.fromkeys([*names(key), *names(partition), *names(order)]))
        numbers = ordered_number(narrow, partition, order, name).select(*names(key), name)
        return df.join(numbers, names(key)).select(*df.columns, name)
    groups, keys = names(partition), [*names(partition), *names(order)]
    sliced = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    stored = materialize(sliced).withColumn("_slice", F.shiftright("_pos", 33))
    sizes = stored.groupBy(*groups, "_slice").agg(
        F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    earlier = (
        Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = materialize(
        sizes.select(
            *[F.col(g).alias(f"_o_{g}") for g in groups],
            F.col("_slice").alias("_o_slice"),
            "_first",
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        )
    )
    same = reduce(
        and_,
        [F.col(g).eqNullSafe(F.col(f"_o_{g}")) for g in groups],
        F.col("_slice") == F.col("_o_slice"),
    )
    numbered = stored.join(offsets, same).withColumn(
        name, F.col("_before") + F.col("_pos") - F.col("_first") + 1
    )
    return numbered.select(*df.columns, name)


def top_per_group(
    df: DataFrame, partition: str | Sequence[str], order: str | Sequence[str | Column], n: int
) -> DataFrame:
    """First ``n`` rows per group.

    Up to the group-limit threshold Spark keeps only ``n`` rows per group and task before the shuffle. Beyond it a group is
    first ranked in ``TOP_SALTS`` parts, dealt by a hash of the row, and the best ``n`` of each part then in the group; so a hot
    group is sorted by many tasks, the last of which sees at most ``TOP_SALTS`` times ``n`` rows. Ties go by the same hash.
    """
    keys = names(partition)
    if n <= GROUP_LIMIT_PUSHDOWN:
        ranked = Window.partitionBy(*keys).orderBy(*names(order))
        return df.withColumn("_rank", F.row_number().over(ranked)).filter(f"_rank <= {n}").drop("_rank")
    hashable = [F.col(c) for c in df.columns if not _is_map(df, c)]
    rows = df.withColumn("_tie", F.xxhash64(*hashable)).withColumn("_salt", F.pmod("_tie", F.lit(TOP_SALTS).cast("long")))
    for group in ([*keys, "_salt"], keys):
        ranked = Window.partitionBy(*group).orderBy(*names(order), "_tie")
        rows = rows.withColumn("_rank", F.row_number().over(ranked)).filter(f"_rank <= {n}").drop("_rank")
    return rows.drop("_tie", "_salt")


def first_n(df: DataFrame, order: str | Sequence[str | Column], n: int) -> DataFrame:
    """First ``n`` rows in order: a top-k when small, slice numbering when large."""
    if n <= TOP_K_LIMIT:
        return df.orderBy(*names(order)).limit(n)
    return ordered_number(df, [], order, "_rank").filter(f"_rank <= {n}").drop("_rank")


def key_membership(left: DataFrame, right: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Distinct keys of both sides with ``in_left`` and ``in_right``; one shuffle, combined map-side."""
    keys = names(key)
    tagged = left.select(*keys, F.lit(True).alias("_l"), F.lit(False).alias("_r")).unionByName(
        right.select(*keys, F.lit(False).alias("_l"), F.lit(True).alias("_r"))
    )
    return tagged.groupBy(*keys).agg(
        F.max("_l").alias("in_left"), F.max("_r").alias("in_right")
    )


def common_keys(left: DataFrame, right: DataFrame, key: str | Sequence[str]) -> DataFrame:
    return key_membership(left, right, key).filter("in_left and in_right").select(*names(key))


def left_only_keys(left: DataFrame, right: DataFrame, key: str | Sequence[str]) -> DataFrame:
    return key_membership(left, right, key).filter("in_left and not in_right").select(*names(key))


def frequent_keys(df: DataFrame, key: str | Sequence[str], support: float = 0.01) -> DataFrame:
    """Hashes of keys that may hold more than ``support`` of the rows.

    One pass with a bounded sketch: never more than ``1 / support`` rows, a superset of the
    frequent keys. It only steers the salting below, results do not depend on it.
    """
    hashed = df.select(F.xxhash64(*names(key)).alias("_key"))
    return (
        hashed.stat.freqItems(["_key"], support)
        .select(F.explode("_key_freqItems").alias("_key"))
        .distinct()
        .withColumn("_hot", F.lit(True))
    )


def hot_keys(df: DataFrame, key: str | Sequence[str]) -> list[int]:
    """Hashes (``xxhash64``) of the keys with more than ``HOT_ROWS`` rows and more than one in ``HOT_SHARE`` of all.

    Rows are counted by bucket of the hash, in ``HOT_BUCKETS`` primitive counts; only buckets that are large enough to hold such
    a key are then counted by hash. So at most ``HOT_SHARE`` hashes return, exactly those (keys that share a hash count as one).
    """
    hashed = df.select(F.xxhash64(*names(key)).alias("_key"))
    bucket = F.pmod("_key", F.lit(HOT_BUCKETS).cast("long")).alias("_bucket")
    counted = [(r["_bucket"], r["n"]) for r in hashed.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).collect()]
    least = max(HOT_ROWS, sum(n for _, n in counted) // HOT_SHARE)
    large = [b for b, n in counted if n > least]
    if not large:
        return []
    found = hashed.filter(bucket.isin(large)).groupBy("_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least)
    return [r["_key"] for r in found.collect()]


def key_filter(keys: DataFrame, key: str, bits_per_key: int = 64, most_bits: int = 2**27) -> Column | None:
    """A test on column ``key`` that every key of ``keys`` passes and hardly any other; None for no keys.

    The keys' hashes mark bits of a map of at most ``most_bits`` (16 MB), built in 4 KB pieces by the executors and held as a
    literal, so the test moves no rows: it can prune files by their metadata and thin wide rows before they are worked on. With
    more than most_bits / bits_per_key keys more others pass. An exact join on narrow rows has to follow.
    """
    n = keys.count()
    if not n:
        return None
    bits = min(most_bits, max(2**15, 1 << (n * bits_per_key - 1).bit_length()))

    def place(column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(bits).cast("long"))

    piece = keys.select(place(F.col(key)).alias("_at")).select(
        F.shiftright("_at", 15).alias("_piece"), F.col("_at").bitwiseAND(F.lit(2**15 - 1)).alias("_bit")
    )
    held = bytearray(bits // 8)
    for row in piece.groupBy("_piece").agg(F.bitmap_construct_agg("_bit").alias("_map")).toLocalIterator():
        held[row["_piece"] * 4096 : (row["_piece"] + 1) * 4096] = row["_map"]
    at = place(F.col(key))
    byte = F.conv(F.hex(F.substring(F.lit(bytes(held)), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, at.bitwiseAND(F.lit(7).cast("long")).cast("int")) == 1


def planned_bytes(df: DataFrame) -> float:
    """The optimizer's size estimate; infinite where the session does not expose it."""
    try:
        return float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:
        return float("inf")


def broadcast_limit(df: DataFrame) -> float:
    """``spark.sql.autoBroadcastJoinThreshold`` in bytes."""
    text = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760").lower().rstrip("b")
    units = {"k": 2**10, "m": 2**20, "g": 2**30}
    return float(text[:-1]) * units[text[-1]] if text[-1] in units else float(text)


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str | Sequence[str],
    how: str = "left",
    salts: int = 32,
    support: float = 0.01,
) -> DataFrame:
    """Join a possibly skewed ``left`` with a ``right`` that is unique per key.

    A right side whose planned size is below Spark's broadcast limit is joined plainly: Spark
    broadcasts it and nothing is shuffled, so skew does not matter. Otherwise rows of frequent
    keys are spread over ``salts`` sub-keys and the matching right rows are repeated once per
    sub-key, so no task receives a whole hot key; all other keys move as in a plain join. The salt
    is a hash of the row and its input partition, which a retried task recomputes to the same
    value.
    """
    if planned_bytes(right) <= broadcast_limit(right):
        return left.join(right, names(key), how)
    keys, zero = names(key), F.lit(0).cast("long")
    hot = F.broadcast(frequent_keys(left, keys, support))  # at most 1 / support rows
    hashed_key = F.xxhash64(*keys)
    hashable = [F.col(c) for c in left.columns if not _is_map(left, c)]
    spread = F.pmod(F.xxhash64(F.spark_partition_id(), *hashable), F.lit(salts))
    salted_left = (
        left.withColumn("_key", hashed_key)
        .withColumn("_spread", spread)
        .join(hot, "_key", "left")
        .withColumn("_salt", F.when(F.col("_hot"), F.col("_spread")).otherwise(zero))
        .drop("_key", "_hot", "_spread")
    )
    salted_right = (
        right.withColumn("_key", hashed_key)
        .join(hot, "_key", "left")
        .withColumn(
            "_salt",
            F.explode(
                F.when(F.col("_hot"), F.sequence(zero, F.lit(salts - 1).cast("long"))).otherwise(F.array(zero))
            ),
        )
        .drop("_key", "_hot")
    )
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")


def _is_map(df: DataFrame, column: str) -> bool:
    return "map<" in df.schema[column].dataType.simpleString()
