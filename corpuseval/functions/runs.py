"""Run ids, metric deltas and their assessment."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Run id format, shape rule and the width below which a delta is flat.
RUN_ID_FORMAT = "yyyyMMdd-HHmmss-SSSSSS"
RUN_ID_MIN_LENGTH = 16
FLAT_BELOW = 1e-9


def looks_like_run_id(value: Column) -> Column:
    """At least 16 characters, eight leading digits and a dash somewhere."""
    return (
        (F.length(value) >= RUN_ID_MIN_LENGTH)
        & F.substring(value, 1, 8).rlike("^[0-9]{8}$")
        & value.contains("-")
    )


def run_ts(run_id: Column) -> Column:
    """Timestamp of a run id, NULL when it has another shape."""
    return F.try_to_timestamp(run_id, F.lit(RUN_ID_FORMAT))


def delta(baseline: Column, candidate: Column) -> Column:
    return F.round(candidate - baseline, 6)


def assessment(preference: Column, change: Column) -> Column:
    improved = F.when(preference == "lower", change < 0).when(preference == "higher", change > 0)
    return (
        F.when(change.isNull(), "unavailable")
        .when(F.abs(change) < FLAT_BELOW, "flat")
        .when(improved.isNull(), "changed")
        .when(improved, "improved")
        .otherwise("regressed")
    )
