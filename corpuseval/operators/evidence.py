"""Release-evidence gate over the report rollup."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from corpuseval.functions.runs import assessment, delta
from corpuseval.metrics import CONFIDENCE, GROUP_KEYS, METRICS, headline_rank, preference
from corpuseval.operators.trends import Pair, by_role, group_profile, is_pair

# Section names, issue codes, states and the default number of runs.
REQUIRED_SECTION, OPTIONAL_SECTION = "release_blocking", "optional_stable"
MISSING_GROUP = "missing_aggregate_group"
FEW_RUNS = "run_count_below_threshold"
MISSING_REPORT = "missing_latest_report"
READY, ACTION_REQUIRED, SKIPPED, REQUIRED_READY = "ready", "action_required", "skipped", "release_blocking_ready"
MINIMUM_RUNS = 3


def pair_summary(rollup: DataFrame, keys: Sequence[str] = GROUP_KEYS) -> DataFrame:
    """Run count, item count, latest run and latest report of every provider pair."""
    per_run = rollup.groupBy(*keys, "run_id").agg(
        F.count(F.lit(1)).alias("run_count"),
        F.sum("item_count").alias("item_count"),
        F.min("report_path").alias("report_path"),
    )
    return per_run.groupBy(*keys).agg(
        F.sum("run_count").alias("run_count"),
        F.sum("item_count").alias("item_count"),
        F.max("run_id").alias("latest_run_id"),
        F.max_by("report_path", "run_id").alias("latest_report"),
    )


def evidence_gate(
    rollup: DataFrame,
    baseline: Pair,
    candidate: Pair,
    optional: Pair | None = None,
    minimum_runs: int = MINIMUM_RUNS,
    datasets: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(sections, issues)`` per dataset.

    ``sections`` has one row per dataset and section with its state and the overall state of the
    dataset; without an optional pair that section reads ``skipped``. ``issues`` lists what blocks
    a section. ``datasets`` (unique ``dataset_id``) names the datasets to judge, default all in
    the rollup. Facts are reduced to one row per dataset before anything is judged.
    """
    judged = _judge(rollup, baseline, candidate, optional, minimum_runs, datasets)
    required, extra = F.col("required_issues"), F.col("optional_issues")
    overall = (
        F.when(F.size(required) > 0, ACTION_REQUIRED)
        .when(F.size(extra) > 0, REQUIRED_READY)
        .otherwise(READY)
    )

    def section(name: str, issues: Column, role: str, skipped: bool) -> Column:
        state = F.lit(SKIPPED) if skipped else F.when(F.size(issues) == 0, READY).otherwise(ACTION_REQUIRED)
        return F.struct(
            F.lit(name).alias("section"),
            F.size(issues).cast("long").alias("issue_count"),
            F.col("baseline.run_count").alias("baseline_run_count"),
            F.col("baseline.latest_run_id").alias("baseline_latest_run_id"),
            F.col(f"{role}.run_count").alias("candidate_run_count"),
            F.col(f"{role}.latest_run_id").alias("candidate_latest_run_id"),
            state.alias("status"),
        )

    rows = F.array(
        section(REQUIRED_SECTION, required, "candidate", False),
        section(OPTIONAL_SECTION, extra, "optional", optional is None),
    )
    sections = judged.select("dataset_id", overall.alias("overall_status"), F.inline(rows))
    issues = judged.select("dataset_id", F.inline(F.concat(required, extra)))
    return sections, issues


def _judge(
    rollup: DataFrame,
    baseline: Pair,
    candidate: Pair,
    optional: Pair | None,
    minimum_runs: int,
    datasets: DataFrame | None,
) -> DataFrame:
    """One row per dataset: a struct per role and the issue list of either section."""
    roles = {"baseline": baseline, "candidate": candidate, "optional": optional or candidate}
    payload = F.struct("run_count", "latest_run_id", "latest_report")
    if datasets is not None:
        # Named datasets are joined back below, so the facts can be cut to the pairs at the scan.
        rollup = rollup.filter(reduce(or_, [is_pair(pair) for pair in roles.values()]))
    # Otherwise unfiltered: a dataset that has none of the pairs is judged as well.
    wide = pair_summary(rollup).groupBy("dataset_id").agg(
        *[F.max(F.when(is_pair(pair), payload)).alias(role) for role, pair in roles.items()]
    )
    if datasets is not None:
        wide = datasets.select("dataset_id").join(wide, "dataset_id", "left")
    if optional is None:
        wide = wide.withColumn("optional", F.when(F.lit(False), F.col("optional")))

    def issues(section: str, pair_role: str, role: str, pair: Pair) -> Column:
        name, cell = " + ".join(str(p) for p in pair), F.col(role)
        runs = cell["run_count"]

        def issue(test: Column, code: str, detail: Column) -> Column:
            return F.when(
                test,
                F.struct(
                    F.lit(section).alias("section"),
                    F.lit(pair_role).alias("pair_role"),
                    F.lit(code).alias("issue_code"),
                    detail.alias("detail"),
                ),
            )

        # A missing group hides the run-count rule, as there is nothing to count.
        return F.array(
            issue(runs.isNull(), MISSING_GROUP, F.lit(f"{name}: no aggregated runs")),
            issue(
                runs < minimum_runs,
                FEW_RUNS,
                F.concat(F.lit(f"{name}: "), runs.cast("string"), F.lit(f" of {minimum_runs} runs")),
            ),
            issue(cell["latest_report"].isNull(), MISSING_REPORT, F.lit(f"{name}: no report")),
        )

    required = F.concat(
        issues(REQUIRED_SECTION, "baseline", "baseline", baseline),
        issues(REQUIRED_SECTION, "candidate", "candidate", candidate),
    )
    judged = wide.withColumn("required_issues", F.array_compact(required))
    if optional is None:
        return judged.withColumn("optional_issues", F.slice("required_issues", F.lit(1), F.lit(0)))
    extra = F.concat(
        issues(OPTIONAL_SECTION, "baseline", "baseline", baseline),
        issues(OPTIONAL_SECTION, "candidate", "optional", optional),
    )
    return judged.withColumn("optional_issues", F.array_compact(extra))


def section_headlines(
    rollup: DataFrame, baseline: Pair, candidate: Pair, optional: Pair | None = None, metrics: Sequence[str] = METRICS
) -> DataFrame:
    """Headlines of every section, in their fixed order: the latest report of its candidate against the baseline's aggregate.

    A section without a baseline group or a candidate report has no row. All sections come from one profile of the groups.
    """
    roles = {"baseline": baseline, "candidate": candidate, "optional": optional or candidate}
    ranked = sorted((m for m in [*metrics, CONFIDENCE] if headline_rank(m)), key=headline_rank)
    wide = by_role(group_profile(rollup, metrics=metrics), roles, [*metrics, CONFIDENCE, "latest"])

    def section(name: str, role: str) -> Column:
        def line(m: str) -> Column:
            before, after = F.col(f"baseline.{m}"), F.col(f"{role}.latest.{m}")
            change = delta(F.round(before, 6), F.round(after, 6))
            return F.struct(
                F.lit(headline_rank(m)).alias("headline_rank"), F.lit(m).alias("metric_key"), before.alias("baseline_value"),
                after.alias("candidate_value"), change.alias("delta"), assessment(F.lit(preference(m)), change).alias("assessment"),
            )

        lines = F.filter(F.array(*[line(m) for m in ranked]), lambda x: x["delta"].isNotNull() & (x["assessment"] != "flat"))
        found = F.col("baseline").isNotNull() & F.col(f"{role}.latest").isNotNull()
        return F.struct(F.lit(name).alias("section"), F.when(found, lines).alias("headlines"))

    sections = [section(REQUIRED_SECTION, "candidate"), *([section(OPTIONAL_SECTION, "optional")] if optional else [])]
    return wide.select("dataset_id", F.inline(F.array(*sections))).filter("headlines is not null")


def with_headlines(sections: DataFrame, lines: DataFrame) -> DataFrame:
    """The sections of ``evidence_gate`` with their headlines, an empty list where there is none."""
    kind = lines.schema["headlines"].dataType
    dataset = F.col("s.dataset_id").eqNullSafe(F.col("h.dataset_id"))
    joined = sections.alias("s").join(lines.alias("h"), dataset & (F.col("s.section") == F.col("h.section")), "left")
    return joined.select("s.*", F.coalesce("h.headlines", F.array().cast(kind)).alias("headlines"))


def distinct_issues(issues: DataFrame) -> DataFrame:
    """Issues by (role, code, detail), across sections."""
    return issues.select("dataset_id", "pair_role", "issue_code", "detail").dropDuplicates()
