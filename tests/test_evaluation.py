import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from corpuseval.metrics import METRICS
from corpuseval.operators import aggregate, compare, evidence, review, trends
from corpuseval.plans import compare as comparison
from corpuseval.sources import reports, sinks


def result(item_id, status="restored", confidence=0.9, **metrics):
    return {
        "item": {"item_id": item_id, "relative_path": f"{item_id}.png"},
        "status": status,
        "metrics": {m: metrics.get(m) for m in METRICS},
        "mask_result": {"confidence": confidence},
    }


def write_report(root, run_id, results, mask="seed", restore="fill", dataset="d", name=None, **extra):
    doc = {
        "run_id": run_id,
        "dataset_id": dataset,
        "mask_provider": mask,
        "restore_provider": restore,
        "status_counts": {"restored": len(results)},
        "results": results,
        **extra,
    }
    folder = root / (run_id or "20260101-000000-000001") / "reports"
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / (name or f"{dataset}_{mask}__{restore}.json")
    path.write_text(json.dumps({k: v for k, v in doc.items() if v is not None}))
    return path


FIRST, SECOND = "20260101-000000-000001", "20260102-000000-000001"


@pytest.fixture()
def tree(tmp_path):
    write_report(tmp_path, FIRST, [result("i1", mean_abs_diff=1.0)])
    write_report(tmp_path, SECOND, [result("i1", mean_abs_diff=2.0), result("i2", mean_abs_diff=6.0)])
    write_report(tmp_path, SECOND, [result("i1", mean_abs_diff=0.0)], restore="noop")
    (tmp_path / FIRST / "reports" / "summary.json").write_text("{}")
    return tmp_path


def test_aggregate_pools_items_not_run_means(spark, tree):
    headers, results, rejects = reports.read_reports(spark, str(tree))
    assert headers.count() == 3 and rejects.count() == 0
    groups = aggregate.aggregate_runs(results, headers=headers)
    assert rows(groups, "restore_provider", "run_count", "item_count", "mean_abs_diff") == [
        ("fill", 2, 3, 3.0),
        ("noop", 1, 1, 0.0),
    ]
    ranged = aggregate.filter_runs(results, run_after=SECOND, run_before=SECOND, restore="fill")
    assert rows(aggregate.aggregate_runs(ranged), "run_count", "mean_abs_diff") == [(1, 4.0)]
    assert rows(aggregate.merge_status_maps(headers, ["restore_provider"])) == [("fill", "restored", 3), ("noop", "restored", 1)]


def test_reader_fallbacks_and_rejects(spark, tmp_path):
    with_provider = {**result("i1"), "mask_provider": "seed", "restore_provider": "first"}
    write_report(tmp_path, None, [with_provider], mask=None, restore=None, name="a.json")
    write_report(tmp_path, SECOND, [], name="empty.json")
    (tmp_path / "bad.json").write_text("{ not json")
    (tmp_path / "other.json").write_text(json.dumps({"dataset_id": "d"}))
    headers, results, rejects = reports.read_reports(spark, str(tmp_path))
    assert rows(headers, "run_id", "mask_provider", "restore_provider", "item_count") == [
        ("20260101-000000-000001", "seed", "first", 1),
        (SECOND, "seed", "fill", 0),
    ]
    assert rows(rejects, "reject_reason") == [("no results",), ("not parsable",)]
    groups = aggregate.aggregate_runs(results, headers=headers)
    assert rows(groups, "restore_provider", "run_count", "item_count", "mean_abs_diff") == [
        ("fill", 1, 0, None),
        ("first", 1, 1, None),
    ]


def test_compare_with_itself_and_last_wins(spark, tree):
    _, results, _ = reports.read_reports(spark, str(tree))
    one = results.filter((F.col("run_id") == SECOND) & (F.col("restore_provider") == "fill"))
    items = compare.compare_runs(one, one)
    assert rows(items, "item_id", "delta_mean_abs_diff") == [("i1", 0.0), ("i2", 0.0)]
    assert rows(compare.status_pairs(items)) == [("restored__restored", 2)]
    assert rows(compare.coverage(one, one)) == [(2, 0, 0)]
    doubled = one.unionByName(one.withColumn("pos", F.col("pos") + 10).withColumn("mean_abs_diff", F.lit(9.0)))
    assert rows(compare.compare_runs(one, doubled), "item_id", "delta_mean_abs_diff") == [("i1", 7.0), ("i2", 3.0)]
    summary = {r.metric_key: r for r in compare.delta_summary(compare.compare_runs(one, doubled)).collect()}
    assert (summary["mean_abs_diff"].mean_delta, summary["mean_abs_diff"].max_delta) == (5.0, 7.0)
    assert summary["edge_delta"].mean_delta is None


def test_one_sided_items(spark, tree):
    _, results, _ = reports.read_reports(spark, str(tree))
    base = results.filter("restore_provider = 'fill'")
    cand = results.filter("restore_provider = 'noop'")
    assert rows(compare.coverage(base, cand)) == [(1, 1, 0)]
    assert compare.compare_runs(base, cand).count() == 1


def test_trend_takes_the_latest_candidate(spark, tree):
    _, results, _ = reports.read_reports(spark, str(tree))
    rollup = aggregate.report_rollup(results)
    trend = trends.trend_snapshot(rollup, ("seed", "fill"), ("seed", "noop"))
    row = trend.filter("section = 'baseline_aggregate' and metric_key = 'mean_abs_diff'").first()
    assert (row.reference_run_count, row.candidate_run_id, row.delta, row.assessment) == (2, SECOND, -3.0, "improved")
    own = trend.filter("section = 'candidate_aggregate'")
    assert own.count() == 12 and trends.headlines(own).count() == 0
    without = aggregate.aggregate_runs(results).filter("restore_provider = 'fill'")
    only = trends.trend_snapshot(rollup, ("seed", "fill"), ("seed", "noop"), aggregates=without)
    assert rows(only.select("section").distinct()) == [("baseline_aggregate",)]
    assert trends.trend_snapshot(rollup, ("seed", "none"), ("seed", "noop")).count() == 0
    assert trends.trend_snapshot(rollup, (None, "fill"), (None, "noop"), dataset="d").count() == 24


def evidence_rollup(spark, runs):
    data = [("d", m, r, run, f"{run}/{m}/{r}", "i1", "restored", 0.5, 1.0) for run in runs for m, r in
            (("seed", "fill"), ("ocr", "fill"), ("seed", "other"))]
    facts = spark.createDataFrame(
        data, "dataset_id string, mask_provider string, restore_provider string, run_id string, report_path string, "
        "item_id string, status string, confidence double, mean_abs_diff double"
    )
    facts = facts.select("*", *[F.lit(1.0).alias(m) for m in METRICS if m != "mean_abs_diff"])
    return aggregate.report_rollup(facts)


BASE, CAND, OPTIONAL = ("seed", "fill"), ("ocr", "fill"), ("seed", "other")


def test_evidence_ready(spark):
    sections, issues = evidence.evidence_gate(evidence_rollup(spark, [FIRST, SECOND]), BASE, CAND, OPTIONAL, minimum_runs=2)
    assert rows(sections, "section", "status", "overall_status") == [
        ("optional_stable", "ready", "ready"), ("release_blocking", "ready", "ready"),
    ]
    assert issues.count() == 0


def test_evidence_below_threshold_and_skipped(spark):
    sections, issues = evidence.evidence_gate(evidence_rollup(spark, [FIRST]), BASE, CAND, None, minimum_runs=2)
    assert rows(sections, "section", "status", "overall_status") == [
        ("optional_stable", "skipped", "action_required"), ("release_blocking", "action_required", "action_required"),
    ]
    assert rows(issues, "pair_role", "issue_code") == [
        ("baseline", "run_count_below_threshold"), ("candidate", "run_count_below_threshold"),
    ]


def test_evidence_missing_pair_and_dataset(spark):
    rollup = evidence_rollup(spark, [FIRST, SECOND])
    wanted = spark.createDataFrame([("d",), ("absent",)], "dataset_id string")
    sections, issues = evidence.evidence_gate(rollup, BASE, CAND, ("seed", "none"), 2, wanted)
    assert rows(sections.select("dataset_id", "overall_status").distinct()) == [
        ("absent", "action_required"), ("d", "release_blocking_ready"),
    ]
    assert rows(issues.filter("dataset_id = 'd'"), "section", "pair_role", "issue_code") == [
        ("optional_stable", "candidate", "missing_aggregate_group"),
        ("optional_stable", "candidate", "missing_latest_report"),
    ]
    assert evidence.distinct_issues(issues.filter("dataset_id = 'absent'")).count() == 6


def test_review_labels_and_common_items(spark):
    labels = spark.createDataFrame(
        [("patch", "run-base", 1), ("patch", "run-tuned", 2), ("fill", "r", 3), ("x", "", 4), ("x", None, 5)],
        "label string, run_id string, pos int",
    )
    assert rows(review.dedupe_labels(labels, "label", "pos"), "pos", "unique_label") == [
        (1, "patch@run-base"), (2, "patch@run-tuned"), (3, "fill"), (4, "x@1"), (5, "x@2"),
    ]
    facts = spark.createDataFrame(
        [("a", "i1", "s1", 0.41, 1), ("b", "i1", "s2", 0.5, 2), ("a", "i2", "s3", 0.5, 3), ("b", "i1", "s4", 0.7, 4)],
        "label string, item_id string, status string, confidence double, pos int",
    ).withColumn("note", F.lit("")).withColumn("relative_path", F.col("item_id"))
    table = review.review_table(facts, ["a", "b"])
    assert rows(table, "item_id", "label", "status", "confidence") == [("i1", "a", "s1", 0.41), ("i1", "b", "s4", 0.7)]
    with pytest.raises(ValueError):
        review.require_common(review.review_table(facts, ["a", "c"]))
    with pytest.raises(ValueError):
        review.review_wide(facts, ["a"])


def test_report_summary_reads_whatever_metrics_occur(spark):
    df = spark.createDataFrame(
        [("r", {"mean_abs_diff": 0.4, "own": 1.0}), ("r", {"mean_abs_diff": 0.42, "own": None})],
        "report_path string, metrics map<string,double>",
    )
    assert rows(aggregate.report_summary(df), "metric_key", "sample_count", "mean_value") == [
        ("mean_abs_diff", 2, 0.41), ("own", 1, 1.0),
    ]


def test_report_status_counts_prefers_the_header(spark):
    headers = spark.createDataFrame([("a", {"restored": 5}), ("b", {})], "report_path string, status_counts map<string,long>")
    facts = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y")], "report_path string, status string")
    assert rows(aggregate.report_status_counts(facts, headers)) == [("a", "restored", 5), ("b", "x", 1), ("b", "y", 1)]


def test_review_queue_decisions(spark):
    facts = spark.createDataFrame(
        [("d", "i1", "no_mask", 0.9), ("d", "i2", "restored", 0.1), ("d", "i3", "restored", 0.9)],
        "dataset_id string, item_id string, status string, confidence double",
    )
    queue = review.review_queue(facts)
    assert rows(queue, "item_id", "reason", "action") == [("i1", "failed", "reject"), ("i2", "low_confidence", "approve")]
    decided = review.apply_decisions(
        queue, spark.createDataFrame([("i2", "rejected", 1), ("i2", "approved", 2)], "item_id string, decision string, pos int")
    )
    assert rows(decided, "item_id", "review_state") == [("i1", "pending"), ("i2", "approved")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("i1", {"a": 1}, 0.5, None)], "item_id string, status_counts map<string,int>, x double, y string")
    sinks.write_csv(df, str(tmp_path / "csv"), ["item_id", "status_counts", "x", "y", "absent"])
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.columns == ["item_id", "status_counts", "x", "y", "absent"]
    assert rows(back) == [("i1", '{"a":1}', "0.5", None, None)]
    root = str(tmp_path / "snap")
    sinks.write_snapshot(df.select("item_id"), root, "20260101-a")
    sinks.write_snapshot(df.select("item_id").union(df.select("item_id")), root, "20260102-a")
    sinks.write_snapshot(df.select("item_id"), root, "20260102-a")
    assert sinks.read_snapshot(spark, root).count() == 1
    assert rows(sinks.read_snapshot(spark, root, "20260101-a")) == [("i1", "20260101-a")]


def test_result_table_prunes_partitions(spark, tree, tmp_path):
    _, results, _ = reports.read_reports(spark, str(tree))
    path = str(tmp_path / "facts")
    sinks.write_results(results.drop("metrics"), path)
    stored = aggregate.filter_runs(spark.read.parquet(path), "d", restore="fill")
    assert rows(aggregate.aggregate_runs(stored), "run_count", "mean_abs_diff") == [(2, 3.0)]
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset_id" in plan


def test_latest_artifact(spark):
    docs = spark.createDataFrame([("a", 1, "d1"), ("b", 3, "d1"), ("c", 5, "d2")], "path string, modified int, dataset_id string")
    assert rows(reports.latest_matching(docs, *reports.matches(dataset_id="d1", mask=None)), "path") == [("b",)]
    assert reports.latest_matching(docs, F.col("dataset_id") == "none").count() == 0


def test_whole_comparison_with_masks(spark, tree):
    _, results, _ = reports.read_reports(spark, str(tree))
    one = results.filter((F.col("run_id") == SECOND) & (F.col("restore_provider") == "fill")).withColumn(
        "mask_path", F.when(F.col("item_id") == "i1", "m1").otherwise("gone")
    )
    masks = spark.createDataFrame([("m1", [3])], "mask_path string, words array<long>")
    parts = comparison.compare_reports(one, one, masks)
    assert rows(parts["items"], "item_id", "mask_iou", "delta_mean_abs_diff") == [("i1", 1.0, 0.0), ("i2", None, 0.0)]
    assert rows(parts["overlap_summary"]) == [(1, 1.0, 1.0, 1.0)]
    assert rows(parts["coverage"]) == [(2, 0, 0)] and rows(parts["status_pairs"]) == [("restored__restored", 2)]
    assert rows(parts["side_summaries"], "side", "item_count", "mean_abs_diff", "status_counts") == [
        ("baseline", 2, 4.0, {"restored": 2}), ("candidate", 2, 4.0, {"restored": 2}),
    ]
    flat = sinks.flat_report(parts["items"], sinks.COMPARE_COLUMNS)
    assert flat.columns == sinks.COMPARE_COLUMNS and flat.count() == 2


def test_reports_without_results_in_the_rollup(spark):
    from corpuseval.operators import aggregate, evidence

    metric = ["mean_abs_diff"]
    facts = spark.createDataFrame(
        [("d", "m", "r", "1", "a", 2.0, 0.5), ("d", "m", "r", "1", "a", 4.0, None), (None, "m", "r", "2", "b", 1.0, 1.0)],
        "dataset_id string, mask_provider string, restore_provider string, run_id string, report_path string, mean_abs_diff double, confidence double",
    )
    headers = spark.createDataFrame(
        [("d", "m", "r", "1", "a"), ("d", "m", "r", "3", "c"), ("d", "m", "r", "3", "c"), ("e", "m", "r", "1", "x")],
        "dataset_id string, mask_provider string, restore_provider string, run_id string, report_path string",
    )
    runs = aggregate.group_runs(facts, headers=headers)
    assert rows(runs, "dataset_id", "run_id", "item_count") == [("d", "1", 2), ("d", "3", 0), ("e", "1", 0), (None, "2", 1)]
    groups = aggregate.aggregate_runs(facts, metrics=metric, headers=headers)
    assert rows(groups, "dataset_id", "run_count", "item_count", "mean_abs_diff") == [("d", 2, 2, 3.0), ("e", 1, 0, None), (None, 1, 1, 1.0)]
    rollup = aggregate.report_rollup(facts, metrics=metric, headers=headers)
    assert rows(evidence.pair_summary(rollup), "dataset_id", "run_count", "latest_run_id", "latest_report") == [
        ("d", 2, "3", "c"), ("e", 1, "1", "x"), (None, 1, "2", "b"),
    ]
    _, issues = evidence.evidence_gate(rollup.filter("dataset_id = 'd'"), ("m", "r"), ("m", "r"), minimum_runs=2)
    assert issues.count() == 0


def test_side_summaries_and_coverage_of_pairs(spark):
    facts = spark.createDataFrame(
        [("b", "i1", "x", 0.5, 1.0, 1), ("b", "i1", None, None, 3.0, 2), ("b", "", "x", 0.7, None, 3), ("c", "i2", "", 0.1, 2.0, 4), ("c", "i1", "y", 0.3, 2.0, 5)],
        "_side string, item_id string, status string, confidence double, mean_abs_diff double, pos int",
    ).withColumn("relative_path", F.col("item_id"))
    metric = ["mean_abs_diff"]
    found = rows(compare.summarize_sides(facts, metrics=metric), "_side", "item_count", "status_counts", "mean_abs_diff", "mean_confidence")
    assert found == [("b", 3, {"": 1, "x": 2}, 2.0, 0.6), ("c", 2, {"": 1, "y": 1}, 2.0, 0.2)]
    none = compare.summarize_side(facts.filter("false"), metric).first()
    assert none.item_count == 0 and none.status_counts == {} and none.mean_abs_diff is None
    b, c = F.col("_side") == "b", F.col("_side") == "c"
    pairs = compare.pair_rows(facts, b, c, payload=[*compare.PAYLOAD, *metric])
    assert rows(compare.coverage_of_pairs(pairs)) == rows(compare.coverage(facts.filter(b), facts.filter(c))) == [(1, 0, 1)]


def test_pairs_are_sorted_after_the_shuffle(spark, monkeypatch):
    """Cold rows are not sorted by key in map tasks; rows of a hot key are reduced there."""
    from corpuseval.operators import keyed

    facts = spark.range(4000).selectExpr(
        "case when id % 4 < 2 then 'hot' else cast(id div 8 as string) end as item_id", "if(id % 2 = 0, 'b', 'c') as _side",
        "(id * 7919) % 4001 as pos", "'p' as relative_path", "cast(id as string) as status", "0.5D as confidence",
    )
    b, c = F.col("_side") == "b", F.col("_side") == "c"
    cold = compare.pair_rows(facts, b, c, payload=["status"])
    monkeypatch.setattr(keyed, "HOT_ROWS", 500)
    hot = compare.pair_rows(facts, b, c, payload=["status"])
    assert rows(cold) == rows(hot) and cold.count() == 501
    last = {s: max((r.pos, r.status) for r in facts.collect() if (r.item_id, r._side) == ("hot", s))[1] for s in "bc"}
    assert [(r.b.status, r.c.status) for r in hot.filter("item_id = 'hot'").collect()] == [(last["b"], last["c"])]
    plans = [df._jdf.queryExecution().executedPlan().toString().split("Initial Plan ==")[-1] for df in (cold, hot)]
    below = [p[p.index("Exchange") :] for p in plans]
    assert "max_by" not in below[0] and plans[1].count("Exchange") == 2 and "relative_path" not in plans[0]


def test_summaries_of_pairs_move_what_they_need(spark, monkeypatch):
    from corpuseval.catalog import evaluation

    moved = []
    whole = compare.pair_rows
    monkeypatch.setattr(compare, "pair_rows", lambda *a, payload, **k: moved.append(list(payload)) or whole(*a, payload=payload, **k))
    assert evaluation.status_pairs(spark, "/root/testdata/sf0.001").columns == ["status_pair", "n"]
    assert evaluation.delta_summary(spark, "/root/testdata/sf0.001").count() == len(moved[1])
    assert moved == [["status"], list(evaluation.METRICS)]


def test_report_overview(spark):
    facts = spark.createDataFrame(
        [("a", "x", 0.5), ("a", "x", None), ("b", None, None), ("b", "y", 1.0), (None, "y", 0.25)],
        "report_path string, status string, confidence double",
    )
    headers = spark.createDataFrame(
        [("a", {"restored": 5}), ("b", {}), ("e", {"no_mask": 2}), ("f", None)], "report_path string, status_counts map<string,long>"
    )
    columns = ["report_path", "item_count", "mean_confidence", "status_counts"]
    assert rows(aggregate.report_overview(facts, headers), *columns) == [
        ("a", 2, 0.5, {"restored": 5}), ("b", 2, 1.0, {"unknown": 1, "y": 1}), ("e", 0, None, {"no_mask": 2}), ("f", 0, None, {}),
        (None, 1, 0.25, {"y": 1}),
    ]
    assert rows(aggregate.report_overview(facts), "report_path", "item_count") == [("a", 2), ("b", 2), (None, 1)]


def test_report_overview_adds_confidences_in_row_order(spark):
    """The mean is a tie at the sixth decimal; sums per status would turn it."""
    values = [0.0435, 0.7034, 0.9832, 0.5932, 0.3936, 0.1703, 0.5022, 0.9821]
    facts = spark.createDataFrame([("a", "xy"[i % 2], v) for i, v in enumerate(values)], "report_path string, status string, confidence double")
    found = aggregate.report_overview(facts.coalesce(1)).first()
    assert found.mean_confidence == 0.546438 and found.item_count == 8 and found.status_counts == {"x": 4, "y": 4}


def test_trend_report_and_section_headlines(spark):
    from corpuseval.operators import evidence
    from corpuseval.plans import trend

    metric = ["mean_abs_diff"]
    facts = spark.createDataFrame(
        [
            ("d", "s", "base", "1", "p1", 4.0, 0.5), ("d", "s", "base", "2", "p2", 6.0, 0.5), ("d", "o", "cand", "1", "p3", 9.0, 0.5),
            ("d", "o", "cand", "3", "p4", 2.0, 0.5), ("e", "o", "cand", "1", "p5", 2.0, 0.5),
        ],
        "dataset_id string, mask_provider string, restore_provider string, run_id string, report_path string, mean_abs_diff double, confidence double",
    )
    rollup = aggregate.report_rollup(facts, metrics=metric)
    base, cand = ("s", "base"), ("o", "cand")
    status = spark.createDataFrame([("x__y", 1)], "status_pair string, n long")
    parts = trend.trend_report(rollup, {"status_pairs": status, "items": facts}, base, cand, metrics=metric)
    assert set(parts) == {"comparison_status_pairs", "latest", "sections", "headlines"}
    assert rows(parts["latest"], "dataset_id", "role", "run_id", "report_path", "item_count", "mean_abs_diff") == [
        ("d", "baseline", "2", "p2", 1, 6.0), ("d", "candidate", "3", "p4", 1, 2.0), ("e", "candidate", "1", "p5", 1, 2.0),
    ]
    assert rows(parts["headlines"].filter("section = 'baseline_aggregate'"), "metric_key", "delta", "assessment") == [("mean_abs_diff", -3.0, "improved")]
    lines = evidence.section_headlines(rollup, base, cand, metrics=metric)
    sections, _ = evidence.evidence_gate(rollup, base, cand, minimum_runs=1)
    found = {(r.dataset_id, r.section): [(h.metric_key, h.delta) for h in r.headlines] for r in evidence.with_headlines(sections, lines).collect()}
    assert found == {
        ("d", "release_blocking"): [("mean_abs_diff", -3.0)], ("d", "optional_stable"): [],
        ("e", "release_blocking"): [], ("e", "optional_stable"): [],
    }


def test_flat_run_and_dataset_reports(spark, tmp_path):
    facts = spark.createDataFrame(
        [("i1", "restored", 12.0, 0.5, 1.25, None, {"a": 1}), ("i2", None, None, None, None, 3.0, None)],
        "item_id string, status string, mask_nonzero double, mask_ratio double, mask_latency_ms double, ocr_residual_hits double, note map<string,int>",
    )
    flat = sinks.flat_run(facts)
    assert flat.columns == sinks.RUN_COLUMNS
    columns = ["item_id", "status", "mask_nonzero", "mask_ratio", "edge_delta", "mask_latency_ms", "ocr_residual_hits", "ocr_residual_score", "note"]
    assert rows(flat, *columns) == [
        ("i1", "restored", "12", "0.500000", "0.000000", "1.250000", "", "", '{"a":1}'), ("i2", "", "0", "0.000000", "0.000000", "", "3", "", ""),
    ]
    items = spark.createDataFrame(
        [("i1", "a.png", 'say "hi", now', 5, 0.25, "old"), ("i2", None, "", None, None, "old")],
        "item_id string, relative_path string, prompt string, seed_mask_nonzero int, seed_confidence double, comment string",
    )
    sinks.write_dataset_reports(items, str(tmp_path / "out"))
    read = spark.read.option("header", True).option("escape", '"')
    notes = read.csv(str(tmp_path / "out" / "notes"))
    assert notes.columns == sinks.NOTES_COLUMNS and read.csv(str(tmp_path / "out" / "manifest")).columns == sinks.DATASET_COLUMNS
    assert rows(notes, "item_id", "relative_path", "prompt", "seed_mask_nonzero", "seed_confidence", "comment") == [
        ("i1", "a.png", 'say "hi", now', "5", "0.250000", None), ("i2", None, None, "0", "0.000000", None),
    ]
