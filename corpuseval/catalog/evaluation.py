"""Aggregation, comparison, trend, evidence and review queries over evaluation results."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuseval.catalog.views import EVAL, POOLED, POS_DESC, eval_results, table
from corpuseval.functions.arrays import pack_mask
from corpuseval.functions.runs import assessment, delta, looks_like_run_id, run_ts
from corpuseval.metrics import BASE_METRICS, CONFIDENCE, METRICS, headline_rank, preference
from corpuseval.operators import aggregate, compare, evidence, keyed, review, trends
from corpuseval.plans import compare as compare_job
from corpuseval.sources.sinks import RUN_COLUMNS, RUN_COUNTS, flat_aggregate, flat_run

BASELINE, CANDIDATE, OPTIONAL = ("F", "p0"), ("O", "p1"), ("O", "p9")
HEADER_RUNS = 84
PAIR_KEY = ["dataset_id", "restore_provider", "item_id"]
LABELS = ["p0", "p1", "p2"]
REVIEW_KEY = ["dataset_id", "item_id"]


def aggregate_runs(spark, sf):
    return aggregate.aggregate_runs(eval_results(spark, sf))


def aggregate_filtered(spark, sf):
    return aggregate.aggregate_runs(aggregate.filter_runs(eval_results(spark, sf), "A", mask="F"))


def aggregate_run_range(spark, sf):
    rows = aggregate.filter_runs(eval_results(spark, sf), run_after="199607", run_before="199912")
    return aggregate.aggregate_runs(rows)


def group_runs(spark, sf):
    return aggregate.group_runs(eval_results(spark, sf))


def _report_headers(spark, sf):
    """Headers of all reports with results, and of reports without: one for each day of the orders, dataset and pair.

    Dataset A has none of the optional pair, R none at all.
    """
    k, status = F.col("o_orderkey") % 3, F.col("o_orderstatus")
    pair = F.when(k == 0, F.lit("F,p0")).when(k == 1, F.lit("O,p1")).otherwise("O,p9")
    day = table(spark, sf, "orders").filter((status == "O") | ((status == "F") & (k != 2))).select(
        F.when(status == "F", "A").otherwise("N").alias("dataset_id"),
        F.split_part(pair, F.lit(","), F.lit(1)).alias("mask_provider"),
        F.split_part(pair, F.lit(","), F.lit(2)).alias("restore_provider"),
        F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("e")).alias("run_id"),
    )
    path = F.concat_ws("/", "run_id", "dataset_id", F.concat_ws("__", "mask_provider", "restore_provider"))
    full = eval_results(spark, sf).select(*day.columns, "report_path")
    return full.unionByName(day.withColumn("report_path", path)).distinct()


def group_runs_headers(spark, sf):
    return aggregate.group_runs(eval_results(spark, sf), headers=_report_headers(spark, sf))


def evidence_headers(spark, sf):
    """The gate over reports with and without results."""
    rollup = aggregate.report_rollup(eval_results(spark, sf), headers=_report_headers(spark, sf))
    sections, _ = evidence.evidence_gate(rollup, BASELINE, CANDIDATE, OPTIONAL, minimum_runs=HEADER_RUNS)
    return sections


def status_counts(spark, sf):
    return aggregate.status_counts(eval_results(spark, sf))


def status_map_report(spark, sf):
    rows = eval_results(spark, sf)
    counted = rows.groupBy("dataset_id", "mask_provider", "restore_provider", "status").agg(F.count(F.lit(1)).alias("n"))
    keys = ["dataset_id", "mask_provider", "restore_provider"]
    maps = aggregate.counts_to_map(counted, keys, "status", alias="status_counts")
    flat = flat_aggregate(aggregate.aggregate_runs(rows), maps)
    return flat.select(*keys, "run_count", "item_count", "status_counts")


def dataset_counts(spark, sf):
    return aggregate.dataset_counts(eval_results(spark, sf))


def merge_status_maps(spark, sf):
    events = table(spark, sf, "events")
    headers = events.select(
        F.to_date("ts").cast("string").alias("run_id"),
        F.create_map(
            F.col("event_type"), (F.col("user_id") % 5 + 1), F.lit("restored"), (F.col("event_id") % 3)
        ).alias("status_counts"),
    )
    return aggregate.merge_status_maps(headers, ["run_id"])


def report_summary(spark, sf):
    rows = eval_results(spark, sf)
    measured = rows.select(
        "dataset_id", "mask_provider", "restore_provider",
        F.map_from_arrays(F.array(*[F.lit(m) for m in METRICS]), F.array(*METRICS)).alias("metrics"),
    )
    return aggregate.report_summary(measured, ["dataset_id", "mask_provider", "restore_provider"])


def side_summary(spark, sf):
    return compare.summarize_side(eval_results(spark, sf)).withColumn("status_counts", F.to_json("status_counts"))


def side_summaries(spark, sf):
    """Both sides of a comparison in one pass, per dataset."""
    rows = eval_results(spark, sf).filter("mask_provider in ('F', 'O')")
    sides = compare.summarize_sides(rows, ["dataset_id", "mask_provider"])
    return sides.withColumn("status_counts", F.to_json("status_counts"))


def report_overview(spark, sf):
    """All reports; some headers have counts of their own, others an empty map.

    A report of a small table has so few rows that its mean is often an exact tie, which the order of addition decides.
    """
    keys = ["dataset_id", "mask_provider", "restore_provider", "run_id", "report_path"]
    last = F.right("run_id", F.lit(1))
    own = F.when(last == "e", F.create_map(F.lit("no_mask"), F.lit(1))).when(last == "5", F.create_map(F.lit("restored"), F.lit(99)))
    headers = _report_headers(spark, sf).withColumn("status_counts", F.coalesce(own, F.create_map().cast("map<string,int>")))
    facts = eval_results(spark, sf, spread=False)
    return aggregate.report_overview(facts, headers, keys).withColumn("status_counts", F.to_json("status_counts"))


def _pairs(spark, sf, payload=(*compare.PAYLOAD, *METRICS)):
    return compare.pair_rows(
        eval_results(spark, sf), F.col("mask_provider") == "F", F.col("mask_provider") == "O", PAIR_KEY, payload=payload
    )


def compare_items(spark, sf):
    return compare.compare_items(_pairs(spark, sf), PAIR_KEY)


def compare_coverage(spark, sf):
    rows = eval_results(spark, sf)
    keys = ["dataset_id", "run_id", "item_id"]
    return compare.coverage(rows.filter("mask_provider = 'F'"), rows.filter("mask_provider = 'O'"), keys)


def delta_summary(spark, sf):
    return compare.delta_summary(compare.compare_items(_pairs(spark, sf, METRICS), PAIR_KEY, payload=()))


def compare_masks(spark, sf):
    """Comparison rows with mask overlap: many rows share a mask, some masks are missing."""
    rows = eval_results(spark, sf).withColumn(
        "mask_path", F.concat(F.lit("m/"), ((F.col("item_id").cast("int") * 7 + F.length("dataset_id") + F.ascii("mask_provider")) % 600).cast("string"))
    )
    masks = table(spark, sf, "embeddings").select(
        F.concat(F.lit("m/"), F.col("vec_id").cast("string")).alias("mask_path"), pack_mask(F.col("embedding")).alias("words")
    )
    parts = compare_job.compare_reports(
        rows.filter("mask_provider = 'F'"), rows.filter("mask_provider = 'O'"), masks, PAIR_KEY, store=False
    )
    return parts["items"].select(*PAIR_KEY, "baseline_status", "candidate_status", "mask_iou", "mask_precision", "mask_recall")


def status_pairs(spark, sf):
    return compare.status_pairs(compare.compare_items(_pairs(spark, sf, ["status"]), PAIR_KEY, (), payload=["status"]))


def set_common(spark, sf):
    rows = eval_results(spark, sf)
    keys = ["run_id", "item_id"]
    return keyed.common_keys(rows.filter("mask_provider = 'F'"), rows.filter("mask_provider = 'O'"), keys)


def set_baseline_only(spark, sf):
    rows = eval_results(spark, sf)
    keys = ["run_id", "item_id"]
    return keyed.left_only_keys(rows.filter("mask_provider = 'F'"), rows.filter("mask_provider = 'O'"), keys)


def union_datasets(spark, sf):
    rows = eval_results(spark, sf)
    parts = [rows.filter(F.col("dataset_id") == d) for d in ("A", "N", "R")]
    united = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return united.groupBy("status", "mask_provider").agg(F.count(F.lit(1)).alias("n"))


def _rollup(spark, sf):
    return aggregate.report_rollup(eval_results(spark, sf))


def latest_report(spark, sf):
    rows = eval_results(spark, sf)
    return keyed.latest_report(rows, ["dataset_id", "mask_provider", "restore_provider"])


def trend(spark, sf):
    return trends.trend_snapshot(_rollup(spark, sf), BASELINE, CANDIDATE)


def trend_latest(spark, sf):
    return trends.latest_pair(_rollup(spark, sf), BASELINE, CANDIDATE)


def headlines(spark, sf):
    snapshot = trends.trend_snapshot(_rollup(spark, sf), BASELINE, CANDIDATE)
    return trends.headlines(snapshot).select(
        "dataset_id", "section", "headline_rank", "metric_key", "delta", "assessment"
    )


def assess_delta(spark, sf):
    lines = table(spark, sf, "lineitem")
    wanted = F.when(F.col("l_linenumber") % 3 == 0, "lower").when(F.col("l_linenumber") % 3 == 1, "higher")
    change = delta(
        F.when(F.col("l_quantity") > 3, F.abs("l_tax")), F.when(F.col("l_quantity") < 48, F.abs("l_discount"))
    )
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", wanted.alias("preference"), change.alias("delta"),
        assessment(wanted, change).alias("assessment"),
    )


def evidence_gate(spark, sf):
    sections, _ = evidence.evidence_gate(_rollup(spark, sf), BASELINE, CANDIDATE, OPTIONAL, minimum_runs=80)
    return sections


def evidence_headlines(spark, sf):
    rollup = _rollup(spark, sf)
    sections, _ = evidence.evidence_gate(rollup, BASELINE, CANDIDATE, OPTIONAL, minimum_runs=80)
    both = evidence.with_headlines(sections, evidence.section_headlines(rollup, BASELINE, CANDIDATE, OPTIONAL))
    text = F.array_join(F.transform("headlines", lambda h: F.concat_ws(":", h["metric_key"], h["assessment"])), ",")
    return both.select("dataset_id", "section", "status", F.size("headlines").cast("bigint").alias("headline_count"), text.alias("headlines"))


def evidence_issues(spark, sf):
    _, issues = evidence.evidence_gate(_rollup(spark, sf), BASELINE, CANDIDATE, OPTIONAL, minimum_runs=1000)
    return issues


def distinct_issues(spark, sf):
    return evidence.distinct_issues(evidence_issues(spark, sf))


def _labelled(spark, sf):
    return eval_results(spark, sf).withColumn("label", F.col("restore_provider"))


def review_common(spark, sf):
    wide = review.review_wide(_labelled(spark, sf), LABELS, REVIEW_KEY)
    return wide.select(*REVIEW_KEY, F.col("review_order.l_orderkey").alias("first_orderkey"))


def review_table(spark, sf):
    return review.review_table(
        _labelled(spark, sf), LABELS, REVIEW_KEY, fields=["status", "note", "confidence", "mean_abs_diff", "restore_latency_ms"]
    )


def review_queue(spark, sf):
    rows = eval_results(spark, sf).withColumn("order_key", F.col("pos.l_orderkey"))
    queued = review.review_queue(
        rows, min_confidence=0.75, per_dataset=500,
        order=["confidence", "item_id", "order_key", "run_id", "restore_provider", "mask_provider"],
    )
    return queued.select("dataset_id", "item_id", "order_key", "status", "confidence", "reason", "action")


def review_queue_all(spark, sf):
    queued = review.review_queue(eval_results(spark, sf), min_confidence=0.75)
    return queued.groupBy("dataset_id", "reason", "action", "status").agg(F.count(F.lit(1)).alias("n"))


def dedupe_labels(spark, sf):
    rows = eval_results(spark, sf)
    reports = rows.groupBy("report_path", "mask_provider", "dataset_id", "run_id", "restore_provider").agg(
        F.count(F.lit(1)).alias("item_count")
    )
    blank = F.when(F.col("run_id").endswith("12"), "").otherwise(F.col("run_id"))
    named = reports.select("report_path", "item_count", blank.alias("run_id"), review.provider_label(
        F.col("mask_provider"), F.when(F.col("dataset_id") == "N", "").otherwise(F.col("restore_provider"))
    ).alias("label"))
    return review.dedupe_labels(named, "label", ["report_path"])


TEXT_COLUMNS = [
    "item_id", "dataset_id", "relative_path", "status", "mask_provider", "restore_provider", "note",
]


def flat_run_report(spark, sf):
    return flat_run(eval_results(spark, sf))


def run_id_shape(spark, sf):
    lines = table(spark, sf, "lineitem")
    made = (
        F.when(F.col("l_linenumber") == 1, F.date_format("l_shipdate", "yyyyMMdd-HHmmss-SSSSSS"))
        .when(F.col("l_linenumber") == 2, F.date_format("l_shipdate", "yyyyMMddHHmmssSSSSSS"))
        .when(F.col("l_linenumber") == 3, F.date_format("l_shipdate", "yyyy-MM-dd-HH-mm-ss"))
        .otherwise(F.date_format("l_shipdate", "yyyyMMdd-HH"))
    )
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", made.alias("run_id")).withColumn(
        "is_run_id", looks_like_run_id(F.col("run_id"))
    ).withColumn("run_day", F.date_format(run_ts(F.col("run_id")), "yyyy-MM-dd"))


QUERIES = {
    f.__name__: f
    for f in (
        aggregate_runs, aggregate_filtered, aggregate_run_range, group_runs, status_counts,
        status_map_report, dataset_counts, merge_status_maps, report_summary, side_summary, side_summaries, report_overview, trend_latest, evidence_headlines,
        compare_items, compare_masks, compare_coverage, delta_summary, status_pairs, set_common,
        set_baseline_only, union_datasets, latest_report, trend, headlines, assess_delta,
        evidence_gate, evidence_issues, distinct_issues, review_common, review_table,
        group_runs_headers, evidence_headers, review_queue, review_queue_all, dedupe_labels, flat_run_report, run_id_shape,
    )
}

# --- SQL -----------------------------------------------------------------------------------

_GROUP = "dataset_id, mask_provider, restore_provider"


def _aggregate(where: str = "") -> str:
    return f"""WITH {EVAL}
SELECT {_GROUP}, count(DISTINCT report_path) AS run_count, count(*) AS item_count, {POOLED},
       round(avg(confidence), 6) AS mean_confidence
FROM eval_results {where} GROUP BY {_GROUP}"""


_PAIRED = f"""WITH {EVAL},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY mask_provider, dataset_id, restore_provider, item_id ORDER BY {POS_DESC}) AS rn
  FROM eval_results),
items AS (
  SELECT b.dataset_id, b.restore_provider, b.item_id, b.relative_path, b.status AS baseline_status, c.status AS candidate_status,
         round(b.confidence, 6) AS baseline_confidence, round(c.confidence, 6) AS candidate_confidence,
         {", ".join(f"b.{m} AS baseline_{m}, c.{m} AS candidate_{m}, round(c.{m} - b.{m}, 6) AS delta_{m}" for m in METRICS)}
  FROM ranked b JOIN ranked c USING (dataset_id, restore_provider, item_id)
  WHERE b.rn = 1 AND c.rn = 1 AND b.mask_provider = 'F' AND c.mask_provider = 'O')"""

_SIDES = f"""WITH {EVAL},
b AS (SELECT DISTINCT run_id, item_id FROM eval_results WHERE mask_provider = 'F'),
c AS (SELECT DISTINCT run_id, item_id FROM eval_results WHERE mask_provider = 'O')"""

_ASSESS = """CASE WHEN delta IS NULL THEN 'unavailable' WHEN abs(delta) < 1e-9 THEN 'flat'
  WHEN preference = 'lower' THEN CASE WHEN delta < 0 THEN 'improved' ELSE 'regressed' END
  WHEN preference = 'higher' THEN CASE WHEN delta > 0 THEN 'improved' ELSE 'regressed' END
  ELSE 'changed' END"""


def _metric_rows() -> str:
    rows = []
    for m in [*METRICS, CONFIDENCE]:
        wanted, rank = preference(m), headline_rank(m)
        rows.append(
            f"SELECT dataset_id, section, reference_run_count, reference_item_count, candidate_run_id, '{m}' AS metric_key, "
            f"{'NULL' if wanted is None else repr(wanted)}::VARCHAR AS preference, {'NULL' if rank is None else rank}::INT AS headline_rank, "
            f"r_{m} AS baseline_value, c_{m} AS candidate_value FROM joined"
        )
    return " UNION ALL ".join(rows)


_MEASURED = [*METRICS, CONFIDENCE]
_TREND = f"""WITH {EVAL},
measured AS (SELECT *, confidence AS {CONFIDENCE} FROM eval_results),
groups AS (SELECT {_GROUP}, count(DISTINCT report_path) AS run_count, count(*) AS item_count,
           {", ".join(f"round(avg({m}), 6) AS {m}" for m in _MEASURED)} FROM measured GROUP BY {_GROUP}),
newest AS (SELECT dataset_id, max(run_id) AS run_id FROM measured WHERE mask_provider = 'O' AND restore_provider = 'p1' GROUP BY dataset_id),
latest AS (SELECT m.dataset_id, m.run_id, {", ".join(f"round(avg(m.{m}), 6) AS {m}" for m in _MEASURED)}
           FROM measured m JOIN newest n ON m.dataset_id = n.dataset_id AND m.run_id = n.run_id
           WHERE m.mask_provider = 'O' AND m.restore_provider = 'p1' GROUP BY m.dataset_id, m.run_id),
joined AS (
  SELECT g.dataset_id, CASE WHEN g.mask_provider = 'F' THEN 'baseline_aggregate' ELSE 'candidate_aggregate' END AS section,
         g.run_count AS reference_run_count, CAST(g.item_count AS BIGINT) AS reference_item_count, l.run_id AS candidate_run_id,
         {", ".join(f"g.{m} AS r_{m}, l.{m} AS c_{m}" for m in _MEASURED)}
  FROM groups g JOIN latest l USING (dataset_id)
  WHERE (g.mask_provider = 'F' AND g.restore_provider = 'p0') OR (g.mask_provider = 'O' AND g.restore_provider = 'p1')),
long AS (SELECT *, round(round(candidate_value, 6) - round(baseline_value, 6), 6) AS delta FROM ({_metric_rows()})),
trend AS (SELECT *, {_ASSESS} AS assessment FROM long)"""


def _flat_run_cell(name: str) -> str:
    if name in METRICS:
        missing = "'0'" if name in RUN_COUNTS else "'0.000000'"
        value = f"CAST(CAST(round({name}) AS BIGINT) AS VARCHAR)" if name in RUN_COUNTS else f"printf('%.6f', round({name}, 6))"
        return f"""coalesce({value}, {missing if name in BASE_METRICS else "''"}) AS {name}"""
    return name if name in TEXT_COLUMNS else f"'' AS {name}"


#: Rows (status, n) as a JSON object.
_STATUS_JSON = """'{' || string_agg('"' || status || '":' || n, ',' ORDER BY status) || '}'"""
_LINES = """SELECT dataset_id, count(*) AS n, string_agg(metric_key || ':' || assessment, ',' ORDER BY headline_rank) AS lines
  FROM trend WHERE section = 'baseline_aggregate' AND headline_rank IS NOT NULL AND delta IS NOT NULL AND assessment <> 'flat' GROUP BY dataset_id"""

_EMPTY_REPORTS = """,
days AS (SELECT DISTINCT CASE o_orderstatus WHEN 'F' THEN 'A' ELSE 'N' END AS dataset_id, CASE o_orderkey % 3 WHEN 0 THEN 'F' ELSE 'O' END AS mask_provider,
           CASE o_orderkey % 3 WHEN 0 THEN 'p0' WHEN 1 THEN 'p1' ELSE 'p9' END AS restore_provider, strftime(o_orderdate, '%Y%m%d') || 'e' AS run_id
         FROM orders WHERE o_orderstatus = 'O' OR (o_orderstatus = 'F' AND o_orderkey % 3 <> 2)),
reports AS (SELECT dataset_id, mask_provider, restore_provider, run_id, report_path, 1 AS w FROM eval_results
  UNION ALL SELECT dataset_id, mask_provider, restore_provider, run_id, run_id || '/' || dataset_id || '/' || mask_provider || '__' || restore_provider, 0 FROM days)"""


def _issues(minimum: int, reports: str = "eval_results", more: str = "") -> str:
    return f"""WITH {EVAL}{more},
pairs AS (SELECT {_GROUP}, count(DISTINCT report_path) AS run_count, max(run_id) AS latest_run_id FROM {reports} GROUP BY {_GROUP}),
expected AS (
  SELECT DISTINCT dataset_id, section, pair_role, m, r FROM {reports},
  (VALUES ('release_blocking', 'baseline', 'F', 'p0'), ('release_blocking', 'candidate', 'O', 'p1'),
          ('optional_stable', 'baseline', 'F', 'p0'), ('optional_stable', 'candidate', 'O', 'p9')) v(section, pair_role, m, r)),
judged AS (
  SELECT e.*, p.run_count, p.latest_run_id FROM expected e LEFT JOIN pairs p
  ON p.dataset_id = e.dataset_id AND p.mask_provider = e.m AND p.restore_provider = e.r),
issues AS (
  SELECT dataset_id, section, pair_role, 'missing_aggregate_group' AS issue_code, m || ' + ' || r || ': no aggregated runs' AS detail
  FROM judged WHERE run_count IS NULL
  UNION ALL
  SELECT dataset_id, section, pair_role, 'run_count_below_threshold', m || ' + ' || r || ': ' || run_count || ' of {minimum} runs'
  FROM judged WHERE run_count < {minimum}
  UNION ALL
  SELECT dataset_id, section, pair_role, 'missing_latest_report', m || ' + ' || r || ': no report'
  FROM judged WHERE latest_run_id IS NULL)"""


_SECTIONS = """,
counted AS (SELECT dataset_id, section, count(*) AS issue_count FROM issues GROUP BY dataset_id, section),
sections AS (
  SELECT j.dataset_id, j.section, CAST(coalesce(max(c.issue_count), 0) AS BIGINT) AS issue_count,
         max(CASE WHEN pair_role = 'baseline' THEN run_count END) AS baseline_run_count,
         max(CASE WHEN pair_role = 'baseline' THEN latest_run_id END) AS baseline_latest_run_id,
         max(CASE WHEN pair_role = 'candidate' THEN run_count END) AS candidate_run_count,
         max(CASE WHEN pair_role = 'candidate' THEN latest_run_id END) AS candidate_latest_run_id
  FROM judged j LEFT JOIN counted c USING (dataset_id, section) GROUP BY j.dataset_id, j.section),
overall AS (
  SELECT dataset_id, CASE WHEN max(CASE WHEN section = 'release_blocking' THEN issue_count END) > 0 THEN 'action_required'
    WHEN max(CASE WHEN section = 'optional_stable' THEN issue_count END) > 0 THEN 'release_blocking_ready' ELSE 'ready' END AS overall_status
  FROM sections GROUP BY dataset_id)
SELECT s.*, CASE WHEN issue_count = 0 THEN 'ready' ELSE 'action_required' END AS status, overall_status
FROM sections s JOIN overall USING (dataset_id)"""
_GATE = _issues(80) + _SECTIONS

_REVIEW = f"""WITH {EVAL},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY restore_provider, dataset_id, item_id ORDER BY {POS_DESC}) AS rn,
         row_number() OVER (PARTITION BY restore_provider, dataset_id, item_id ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey) AS first_rn
  FROM eval_results),
common AS (SELECT dataset_id, item_id FROM ranked WHERE rn = 1 GROUP BY dataset_id, item_id HAVING count(*) = 3)"""

_QUEUE = f"""WITH {EVAL},
queued AS (
  SELECT *, status IN ('no_mask', 'mask_provider_unavailable', 'mask_provider_error', 'restore_provider_unavailable', 'restore_provider_error') AS failed
  FROM eval_results),
q AS (
  SELECT *, CASE WHEN failed THEN 'failed' ELSE 'low_confidence' END AS reason,
         CASE WHEN status = 'no_mask' THEN 'reject' WHEN failed THEN 'retry' ELSE 'approve' END AS action
  FROM queued WHERE failed OR confidence < 0.75)"""

ORACLES = {
    "aggregate_runs": _aggregate(),
    "aggregate_filtered": _aggregate("WHERE dataset_id = 'A' AND mask_provider = 'F'"),
    "aggregate_run_range": _aggregate("WHERE run_id >= '199607' AND run_id <= '199912'"),
    "group_runs": f"WITH {EVAL} SELECT {_GROUP}, run_id, report_path, count(*) AS item_count FROM eval_results GROUP BY ALL",
    "status_counts": f"""WITH {EVAL}
SELECT CASE WHEN grouping(dataset_id) = 1 THEN 'all' ELSE dataset_id END AS dataset_id, status, count(*) AS n
FROM eval_results GROUP BY GROUPING SETS ((dataset_id, status), (status))""",
    "status_map_report": f"""WITH {EVAL},
counted AS (SELECT {_GROUP}, status, count(*) AS n FROM eval_results GROUP BY ALL),
runs AS (SELECT {_GROUP}, count(DISTINCT report_path) AS run_count FROM eval_results GROUP BY ALL)
SELECT {_GROUP}, CAST(max(run_count) AS VARCHAR) AS run_count, CAST(CAST(sum(n) AS BIGINT) AS VARCHAR) AS item_count, '{{' || string_agg('"' || status || '":' || n, ',' ORDER BY status) || '}}' AS status_counts
FROM counted JOIN runs USING ({_GROUP}) GROUP BY {_GROUP}""",
    "dataset_counts": f"WITH {EVAL} SELECT dataset_id, count(*) AS item_count FROM eval_results GROUP BY dataset_id",
    "merge_status_maps": """
WITH entries AS (
  SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, event_type AS status, user_id % 5 + 1 AS n FROM events
  UNION ALL SELECT CAST(CAST(ts AS DATE) AS VARCHAR), 'restored', event_id % 3 FROM events)
SELECT run_id, status, CAST(sum(n) AS BIGINT) AS n FROM entries GROUP BY run_id, status""",
    "report_summary": f"WITH {EVAL} "
    + " UNION ALL ".join(
        f"SELECT {_GROUP}, '{m}' AS metric_key, count({m}) AS sample_count, round(avg({m}), 6) AS mean_value FROM eval_results GROUP BY {_GROUP}"
        for m in METRICS
    ),
    "side_summary": f"""WITH {EVAL}, counted AS (SELECT coalesce(status, '') AS status, count(*) AS n FROM eval_results GROUP BY 1)
SELECT count(*) AS item_count, {POOLED}, round(avg(round(confidence, 6)), 6) AS mean_confidence,
       (SELECT {_STATUS_JSON} FROM counted) AS status_counts FROM eval_results""",
    "side_summaries": f"""WITH {EVAL},
counted AS (SELECT dataset_id, mask_provider, coalesce(status, '') AS status, count(*) AS n FROM eval_results GROUP BY ALL),
maps AS (SELECT dataset_id, mask_provider, {_STATUS_JSON} AS status_counts FROM counted GROUP BY ALL)
SELECT dataset_id, mask_provider, count(*) AS item_count, {POOLED}, round(avg(round(confidence, 6)), 6) AS mean_confidence,
       any_value(status_counts) AS status_counts
FROM eval_results JOIN maps USING (dataset_id, mask_provider) WHERE mask_provider IN ('F', 'O') GROUP BY dataset_id, mask_provider""",
    "report_overview": f"""WITH {EVAL}{_EMPTY_REPORTS},
every AS (SELECT {_GROUP}, run_id, report_path, CAST(sum(w) AS BIGINT) AS item_count FROM reports GROUP BY ALL),
counted AS (SELECT {_GROUP}, run_id, report_path, coalesce(status, 'unknown') AS status, count(*) AS n FROM eval_results GROUP BY ALL),
maps AS (SELECT {_GROUP}, run_id, report_path, {_STATUS_JSON} AS status_counts FROM counted GROUP BY ALL),
means AS (SELECT {_GROUP}, run_id, report_path, round(avg(confidence), 6) AS mean_confidence FROM eval_results GROUP BY ALL)
SELECT {_GROUP}, run_id, report_path, item_count, mean_confidence,
       CASE right(run_id, 1) WHEN 'e' THEN '{{"no_mask":1}}' WHEN '5' THEN '{{"restored":99}}' ELSE status_counts END AS status_counts
FROM every LEFT JOIN maps USING ({_GROUP}, run_id, report_path) LEFT JOIN means USING ({_GROUP}, run_id, report_path)""",
    "trend_latest": f"""WITH {EVAL},
roles AS (SELECT *, CASE WHEN mask_provider = 'F' AND restore_provider = 'p0' THEN 'baseline'
                         WHEN mask_provider = 'O' AND restore_provider = 'p1' THEN 'candidate' END AS role FROM eval_results)
SELECT dataset_id, role, run_id, report_path, count(*) AS item_count, {POOLED}, round(avg(confidence), 6) AS {CONFIDENCE}
FROM roles WHERE role IS NOT NULL GROUP BY dataset_id, role, run_id, report_path
QUALIFY row_number() OVER (PARTITION BY dataset_id, role ORDER BY run_id DESC, report_path) = 1""",
    "evidence_headlines": f"""SELECT g.dataset_id, g.section, g.status, coalesce(h.n, 0) AS headline_count, coalesce(h.lines, '') AS headlines
FROM ({_GATE}) g LEFT JOIN (
  SELECT 'release_blocking' AS section, * FROM ({_TREND} {_LINES}) UNION ALL
  SELECT 'optional_stable', * FROM ({_TREND.replace("'p1'", "'p9'")} {_LINES})) h ON h.dataset_id = g.dataset_id AND h.section = g.section""",
    "compare_items": f"{_PAIRED} SELECT * FROM items",
    "compare_masks": f"""{_PAIRED},
n AS (SELECT *, CAST(item_id AS INT) * 7 + 1 + ascii('F') AS fb, CAST(item_id AS INT) * 7 + 1 + ascii('O') AS fc FROM items),
v AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS bits FROM embeddings),
p AS (SELECT DISTINCT fb % 600 AS b, fc % 600 AS c FROM n),
u AS (SELECT b, c, unnest(x.bits) AS s, unnest(y.bits) AS t FROM p JOIN v x ON x.vec_id = b JOIN v y ON y.vec_id = c),
o AS (SELECT b, c, count(*) FILTER (s AND t) AS i, count(*) FILTER (s OR t) AS un, count(*) FILTER (s) AS nb, count(*) FILTER (t) AS nc FROM u GROUP BY b, c)
SELECT dataset_id, restore_provider, item_id, baseline_status, candidate_status,
       CASE WHEN un = 0 THEN 1.0 ELSE round(i / un, 6) END AS mask_iou, CASE WHEN un = 0 THEN 1.0 ELSE round(i / greatest(1, nc), 6) END AS mask_precision,
       CASE WHEN un = 0 THEN 1.0 ELSE round(i / greatest(1, nb), 6) END AS mask_recall
FROM n LEFT JOIN o ON o.b = fb % 600 AND o.c = fc % 600""",
    "compare_coverage": f"""WITH {EVAL},
b AS (SELECT DISTINCT dataset_id, run_id, item_id, 1 AS hit FROM eval_results WHERE mask_provider = 'F'),
c AS (SELECT DISTINCT dataset_id, run_id, item_id, 1 AS hit FROM eval_results WHERE mask_provider = 'O')
SELECT count(*) FILTER (b.hit = 1 AND c.hit = 1) AS common_item_count,
       count(*) FILTER (b.hit = 1 AND c.hit IS NULL) AS baseline_only_count,
       count(*) FILTER (b.hit IS NULL AND c.hit = 1) AS candidate_only_count
FROM b FULL OUTER JOIN c USING (dataset_id, run_id, item_id)""",
    "delta_summary": f"{_PAIRED} "
    + " UNION ALL ".join(
        f"SELECT '{m}' AS metric_key, round(avg(delta_{m}), 6) AS mean_delta, round(min(delta_{m}), 6) AS min_delta, "
        f"round(max(delta_{m}), 6) AS max_delta FROM items"
        for m in METRICS
    ),
    "status_pairs": f"{_PAIRED} SELECT baseline_status || '__' || candidate_status AS status_pair, count(*) AS n FROM items GROUP BY 1",
    "set_common": f"{_SIDES} SELECT * FROM b INTERSECT SELECT * FROM c",
    "set_baseline_only": f"{_SIDES} SELECT * FROM b EXCEPT SELECT * FROM c",
    "union_datasets": f"WITH {EVAL} SELECT status, mask_provider, count(*) AS n FROM eval_results GROUP BY ALL",
    "latest_report": f"""WITH {EVAL}
SELECT {_GROUP}, run_id AS latest_run_id, report_path AS latest_report FROM (
  SELECT DISTINCT {_GROUP}, run_id, report_path FROM eval_results)
QUALIFY row_number() OVER (PARTITION BY {_GROUP} ORDER BY run_id DESC, report_path) = 1""",
    "trend": f"{_TREND} SELECT * FROM trend",
    "headlines": f"""{_TREND} SELECT dataset_id, section, headline_rank, metric_key, delta, assessment FROM trend
WHERE headline_rank IS NOT NULL AND delta IS NOT NULL AND assessment <> 'flat'""",
    "assess_delta": f"""WITH d AS (
  SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 3 WHEN 0 THEN 'lower' WHEN 1 THEN 'higher' END AS preference,
         round(CASE WHEN l_quantity < 48 THEN abs(l_discount) END - CASE WHEN l_quantity > 3 THEN abs(l_tax) END, 6) AS delta
  FROM lineitem)
SELECT *, {_ASSESS} AS assessment FROM d""",
    "evidence_gate": _GATE,
    "evidence_headers": _issues(HEADER_RUNS, "reports", _EMPTY_REPORTS) + _SECTIONS,
    "group_runs_headers": f"WITH {EVAL}{_EMPTY_REPORTS} SELECT {_GROUP}, run_id, report_path, CAST(sum(w) AS BIGINT) AS item_count FROM reports GROUP BY ALL",
    "evidence_issues": f"{_issues(1000)} SELECT * FROM issues",
    "distinct_issues": f"{_issues(1000)} SELECT DISTINCT dataset_id, pair_role, issue_code, detail FROM issues",
    "review_common": f"""{_REVIEW}
SELECT dataset_id, item_id, l_orderkey AS first_orderkey FROM ranked JOIN common USING (dataset_id, item_id)
WHERE restore_provider = 'p0' AND first_rn = 1""",
    "review_table": f"""{_REVIEW}
SELECT dataset_id, item_id, relative_path, restore_provider AS label, status, note, confidence, mean_abs_diff, restore_latency_ms
FROM ranked JOIN common USING (dataset_id, item_id) WHERE rn = 1""",
    "review_queue": f"""{_QUEUE}
SELECT dataset_id, item_id, l_orderkey AS order_key, status, confidence, reason, action FROM q
QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY confidence NULLS FIRST, item_id, l_orderkey, run_id, restore_provider, mask_provider) <= 500""",
    "review_queue_all": f"{_QUEUE} SELECT dataset_id, reason, action, status, count(*) AS n FROM q GROUP BY ALL",
    "dedupe_labels": f"""WITH {EVAL},
reports AS (
  SELECT report_path, count(*) AS item_count, CASE WHEN run_id LIKE '%12' THEN '' ELSE run_id END AS run_id,
         CASE WHEN dataset_id = 'N' THEN mask_provider ELSE restore_provider END AS label
  FROM eval_results GROUP BY report_path, run_id, dataset_id, mask_provider, restore_provider),
numbered AS (
  SELECT *, count(*) OVER (PARTITION BY label) AS total, row_number() OVER (PARTITION BY label ORDER BY report_path) AS ordinal FROM reports)
SELECT report_path, item_count, run_id, label,
       CASE WHEN total = 1 THEN label WHEN run_id <> '' THEN label || '@' || run_id ELSE label || '@' || ordinal END AS unique_label
FROM numbered""",
    "flat_run_report": f"""WITH {EVAL}
SELECT {", ".join(_flat_run_cell(c) for c in RUN_COLUMNS)} FROM eval_results""",
    "run_id_shape": """WITH made AS (
  SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber WHEN 1 THEN strftime(l_shipdate, '%Y%m%d-%H%M%S-%f')
    WHEN 2 THEN strftime(l_shipdate, '%Y%m%d%H%M%S%f') WHEN 3 THEN strftime(l_shipdate, '%Y-%m-%d-%H-%M-%S')
    ELSE strftime(l_shipdate, '%Y%m%d-%H') END AS run_id FROM lineitem)
SELECT *, length(run_id) >= 16 AND regexp_full_match(substr(run_id, 1, 8), '[0-9]{8}') AND contains(run_id, '-') AS is_run_id,
       strftime(try_strptime(run_id, '%Y%m%d-%H%M%S-%f'), '%Y-%m-%d') AS run_day FROM made""",
}
