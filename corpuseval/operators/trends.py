"""Trend of a candidate's latest report against aggregate references."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from corpuseval.functions.runs import assessment, delta
from corpuseval.metrics import CONFIDENCE, GROUP_KEYS, METRICS, headline_rank, preference
from corpuseval.operators.aggregate import pooled_mean, report_mean

Pair = tuple[str | None, str | None]


def group_profile(
    rollup: DataFrame,
    keys: Sequence[str] = GROUP_KEYS,
    metrics: Sequence[str] = METRICS,
    confidence: str = "confidence",
) -> DataFrame:
    """One row per group: counts and pooled means, ``latest_run_id`` and its report as ``latest``.

    Everything about a group comes from one chain of aggregates over the rollup, so neither the
    facts nor the rollup are read again for the latest report. Equal run ids resolve to the
    smallest path.
    """
    measured = [*metrics, confidence]
    report = F.struct(
        "report_path",
        F.col("item_count").alias("item_count"),
        *[report_mean(m).alias(m) for m in metrics],
        report_mean(confidence).alias(CONFIDENCE),
    )
    per_run = rollup.groupBy(*keys, "run_id").agg(
        F.count(F.lit(1)).alias("run_count"),
        F.sum("item_count").alias("item_count"),
        *[F.sum(f"{kind}_{m}").alias(f"{kind}_{m}") for m in measured for kind in ("sum", "n")],
        F.min_by(report, "report_path").alias("_report"),
    )
    return per_run.groupBy(*keys).agg(
        F.sum("run_count").alias("run_count"),
        F.sum("item_count").alias("item_count"),
        *[pooled_mean(m).alias(m) for m in metrics],
        pooled_mean(confidence).alias(CONFIDENCE),
        F.max("run_id").alias("latest_run_id"),
        F.max_by("_report", "run_id").alias("latest"),
    )


def metric_stack(metrics: Sequence[str], left: str, right: str) -> str:
    """``stack`` of metric pairs; preference and headline rank fold in as constants."""
    rows = []
    for m in metrics:
        wanted, rank = preference(m), headline_rank(m)
        rows.append(
            f"'{m}', {'cast(null as string)' if wanted is None else repr(wanted)}, "
            f"{'cast(null as int)' if rank is None else rank}, {left}{m}, {right}{m}"
        )
    return (
        f"stack({len(metrics)}, {', '.join(rows)}) "
        "as (metric_key, preference, headline_rank, baseline_value, candidate_value)"
    )


def assess_deltas(long: DataFrame) -> DataFrame:
    """Add ``delta`` and ``assessment`` to (preference, baseline_value, candidate_value) rows."""
    change = delta(F.round("baseline_value", 6), F.round("candidate_value", 6))
    return long.withColumn("delta", change).withColumn(
        "assessment", assessment(F.col("preference"), F.col("delta"))
    )


def headlines(assessed: DataFrame) -> DataFrame:
    """Headline metrics with a delta that is not flat; sort by ``headline_rank``."""
    return assessed.filter(
        "headline_rank is not null and delta is not null and assessment <> 'flat'"
    )


def is_pair(pair: Pair) -> Column:
    """Provider filter; a NULL provider matches any."""
    tests = [F.col(c) == v for c, v in zip(("mask_provider", "restore_provider"), pair) if v is not None]
    return reduce(and_, tests, F.lit(True))


def by_role(groups: DataFrame, roles: dict[str, Pair], payload: Sequence[str]) -> DataFrame:
    """One row per dataset with one struct per role, NULL where its group is missing.

    A role that matches several groups takes the first in provider order. A conditional
    aggregate instead of one join per role.
    """
    wanted = groups.filter(reduce(or_, [is_pair(pair) for pair in roles.values()]))

    def pick(pair: Pair) -> Column:
        test = is_pair(pair)
        place = F.struct("mask_provider", "restore_provider")
        return F.min_by(F.when(test, F.struct(*payload)), F.when(test, place))

    return wanted.groupBy("dataset_id").agg(*[pick(pair).alias(role) for role, pair in roles.items()])


def latest_pair(
    rollup: DataFrame, baseline: Pair, candidate: Pair, dataset: str | None = None, metrics: Sequence[str] = METRICS
) -> DataFrame:
    """Latest report of either role, a row per (dataset, role): run, path, item count and means."""
    if dataset is not None:
        rollup = rollup.filter(F.col("dataset_id") == dataset)
    roles = {"baseline": baseline, "candidate": candidate}
    wide = by_role(group_profile(rollup, metrics=metrics), roles, ["latest_run_id", "latest"])
    cells = F.array(*[F.struct(F.lit(role).alias("role"), F.col(role).alias("_ref")) for role in roles])
    rows = wide.select("dataset_id", F.inline(cells)).filter("_ref.latest is not null")
    return rows.select("dataset_id", "role", F.col("_ref.latest_run_id").alias("run_id"), "_ref.latest.*")


def trend_snapshot(
    rollup: DataFrame,
    baseline: Pair,
    candidate: Pair,
    aggregates: DataFrame | None = None,
    dataset: str | None = None,
    metrics: Sequence[str] = METRICS,
) -> DataFrame:
    """Candidate's latest report against the baseline's and its own aggregate, a row per metric.

    ``aggregates`` defaults to the groups of the rollup. A dataset without a baseline group or
    without a candidate report yields nothing; a missing candidate aggregate drops only that
    section. NULL for ``dataset`` or a provider matches any.
    """
    values = [*metrics, CONFIDENCE]
    payload = ["run_count", "item_count", *values]
    roles = {"baseline": baseline, "candidate": candidate}
    if dataset is not None:
        rollup = rollup.filter(F.col("dataset_id") == dataset)
    profile = group_profile(rollup, metrics=metrics)
    if aggregates is None:
        wide = by_role(profile, roles, [*payload, "latest_run_id", "latest"]).withColumns(
            {"_run": F.col("candidate.latest_run_id"), "_latest": F.col("candidate.latest")}
        )
        wide = wide.withColumns({role: F.col(role).dropFields("latest_run_id", "latest") for role in roles})
    else:
        newest = by_role(profile, {"candidate": candidate}, ["latest_run_id", "latest"]).select(
            "dataset_id", F.col("candidate.latest_run_id").alias("_run"), F.col("candidate.latest").alias("_latest")
        )
        wide = by_role(aggregates, roles, payload).join(newest, "dataset_id")
    sections = F.array(
        *[
            F.struct(F.lit(f"{role}_aggregate").alias("section"), F.col(role).alias("_ref"))
            for role in roles
        ]
    )
    rows = wide.filter("baseline is not null and _run is not null").select(
        "dataset_id", F.col("_run").alias("candidate_run_id"), "_latest", F.inline(sections)
    )
    stacked = rows.filter("_ref is not null").select(
        "dataset_id",
        "section",
        F.col("_ref.run_count").alias("reference_run_count"),
        F.col("_ref.item_count").alias("reference_item_count"),
        "candidate_run_id",
        F.expr(metric_stack(values, "_ref.", "_latest.")),
    )
    return assess_deltas(stacked)
