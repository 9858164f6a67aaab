"""Named profiles and keyword presets as tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from corpuseval.functions.marktext import DEFAULT_TOKENS, normalize_name, squash
from corpuseval.operators.keyed import lookup_join


def resolve_profiles(
    requests: DataFrame,
    profiles: DataFrame,
    defaults: Mapping[str, object],
    name: str = "profile",
) -> tuple[DataFrame, DataFrame]:
    """``(resolved, rejects)``: per field the explicit value, else the profile's, else the default.

    Names compare lower-cased with collapsed blanks. A request without a profile name uses only
    explicit values and defaults; one naming an unknown profile is rejected.
    """
    fields = list(defaults)
    known = profiles.select(
        normalize_name(F.col(name)).alias("_name"),
        *[F.col(f).alias(f"_p_{f}") for f in fields],
        F.lit(True).alias("_known"),
    )
    # The salted lookup needs a unique right side; the last definition by value order wins.
    known = known.groupBy("_name").agg(
        F.max(F.struct(*[c for c in known.columns if c != "_name"])).alias("_p")
    ).select("_name", "_p.*")
    named = requests.withColumn("_name", normalize_name(F.coalesce(F.col(name), F.lit(""))))
    joined = lookup_join(named, known, "_name", "left")
    unknown = (F.col("_name") != "") & F.col("_known").isNull()
    others = [c for c in requests.columns if c not in fields]
    resolved = joined.filter(~unknown).select(
        *others,
        *[
            F.coalesce(F.col(f), F.col(f"_p_{f}"), F.lit(default)).alias(f)
            for f, default in defaults.items()
        ],
    )
    return resolved, joined.filter(unknown).select(*requests.columns)


def keyword_tokens(
    presets: DataFrame,
    active: Sequence[str],
    extra: Sequence[str] = (),
    defaults: Sequence[str] = DEFAULT_TOKENS,
    order: Sequence[str] = ("pos",),
) -> DataFrame:
    """Normalised tokens in order of first use: defaults, active presets in order, extras.

    ``first_pos`` sorts them; it is a struct (source, rank, position).
    """
    spark = presets.sparkSession
    ranked = presets.withColumn("_preset", normalize_name(F.col("preset")))
    wanted = []
    for name in active:
        normal = " ".join(str(name).lower().split())
        if normal and normal not in wanted:
            wanted.append(normal)
    rank = F.array_position(F.array(*[F.lit(n) for n in wanted]), F.col("_preset")) if wanted else F.lit(0)
    position = F.struct(*[F.col(c).cast("long").alias(f"p{i}") for i, c in enumerate(order)])
    from_presets = ranked.filter(F.col("_preset").isin(wanted)).select(
        squash(F.col("token")).alias("token"),
        F.struct(F.lit(1).alias("source"), rank.cast("int").alias("rank"), position.alias("at")).alias("_pos"),
    )

    def literal(tokens: Sequence[str], source: int) -> DataFrame:
        rows = [(token, source, i) for i, token in enumerate(tokens)]
        at = F.struct(*[F.lit(0).cast("long").alias(f"p{i}") for i in range(len(order))])
        return spark.createDataFrame(rows, "token string, source int, rank int").select(
            squash(F.col("token")).alias("token"), F.struct("source", "rank", at.alias("at")).alias("_pos")
        )

    rows = from_presets.unionByName(literal(defaults, 0))
    if extra:
        rows = rows.unionByName(literal(extra, 2))
    return rows.filter("token <> ''").groupBy("token").agg(F.min("_pos").alias("first_pos"))


def unknown_presets(presets: DataFrame, active: Sequence[str]) -> list[str]:
    """Active preset names that have no row; the answer is at most as long as ``active``."""
    wanted = [" ".join(str(n).lower().split()) for n in active]
    found = (
        presets.select(normalize_name(F.col("preset")).alias("p")).filter(F.col("p").isin(wanted)).distinct()
    )
    have = {row.p for row in found.collect()}
    return [n for n in wanted if n and n not in have]
