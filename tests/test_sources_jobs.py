import json
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from conftest import rows, write_png
from corpuseval.functions import pixels
from corpuseval import schemas
from corpuseval.catalog import runs as runs_catalog
from corpuseval.operators import images as image_ops, masks as mask_ops, review, runs, text, validate
from corpuseval.plans import batch, evaluate as ev, evidence, scan
from corpuseval.sources import corpus, reports, sinks

# Python workers cannot import this file, so its providers travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture()
def folder(tmp_path):
    rng = np.random.default_rng(0)
    root = tmp_path / "in"
    write_png(root / "regular.png", np.full((180, 120, 3), 90))
    write_png(root / "landscape.PNG", rng.integers(0, 255, (120, 220, 3)))
    write_png(root / "nested" / "0001-cover.png", np.full((180, 120, 3), 90))
    write_png(root / "docs" / "ignored.png", np.full((20, 20, 3), 90))
    write_png(root / "nested" / "skip me" / "x.png", np.full((20, 20), 90))
    (root / "broken.png").write_bytes(b"not an image")
    (root / "notes.txt").write_text("x")
    return root


def test_listing(spark, folder):
    listed = corpus.list_corpus(spark, str(folder), excluded=["skip me"])
    assert rows(listed, "relative_path") == [("broken.png",), ("landscape.PNG",), ("nested/0001-cover.png",), ("regular.png",)]
    flat = corpus.list_corpus(spark, str(folder), recursive=False)
    assert rows(flat, "relative_path") == [("broken.png",), ("landscape.PNG",), ("regular.png",)]
    first = corpus.list_corpus(spark, str(folder), limit=2)
    assert rows(first, "relative_path") == [("broken.png",), ("landscape.PNG",)]
    assert "content" not in corpus.list_corpus(spark, str(folder))._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]


@pytest.mark.parametrize("limit, expected", [(None, 3), (3, 2)])
def test_scan(spark, folder, limit, expected):
    items, rejects = scan.scan_corpus(spark, str(folder), excluded=["skip me"], limit=limit)
    got = rows(items, "relative_path", "width", "height", "category")
    assert len(got) == expected and rows(rejects, "relative_path") == [("broken.png",)]
    assert ("landscape.PNG", 220, 120, "landscape_regular") in got
    if limit is None:
        assert ("nested/0001-cover.png", 120, 180, "cover_heavy") in got
        assert ("regular.png", 120, 180, "portrait_regular") in got
        prepared = scan.prepare_dataset(items)
        assert rows(prepared, "item_id", "relative_path") == [
            ("cover-0001", "nested/0001-cover.png"), ("regular-0001", "landscape.PNG"), ("regular-0002", "regular.png"),
        ]
        assert rows(scan.scan_summary(items)) == [("all", 3), ("cover_heavy", 1), ("landscape_regular", 1), ("portrait_regular", 1)]


def test_cover_look(spark, tmp_path):
    image = np.full((200, 100), 120)
    patch = image[144:, :18]
    patch[:] = 10
    patch[::3, ::2] = 250
    write_png(tmp_path / "tall.png", image)
    items, _ = scan.scan_corpus(spark, str(tmp_path))
    assert rows(items, "category") == [("cover_heavy",)]


def test_masks_and_overlap(spark, tmp_path):
    a, b = np.zeros((10, 9)), np.zeros((10, 9))
    a[2:6, 1:5], b[4:8, 1:5] = 255, 255
    write_png(tmp_path / "a.png", a)
    write_png(tmp_path / "b.png", b)
    masks = corpus.read_masks(spark, str(tmp_path))
    paths = {r.mask_path.rsplit("/", 1)[1]: r.mask_path for r in masks.collect()}
    pairs = spark.createDataFrame([(1, paths["a.png"], paths["b.png"]), (2, paths["a.png"], None), (3, "gone", paths["b.png"])], "i int, p string, q string")
    joined = mask_ops.attach_masks(mask_ops.attach_masks(pairs, masks, "p", "baseline_words"), masks, "q", "candidate_words")
    assert rows(mask_ops.mask_overlap(joined), "i", "mask_iou", "mask_precision") == [
        (1, round(8 / 24, 6), 0.5), (2, None, None), (3, None, None),
    ]


def test_corner_profile(spark, tmp_path):
    image = np.full((200, 100, 3), 60)
    image[195:198, 10:20] = 240
    write_png(tmp_path / "x.png", image)
    good, _ = corpus.read_images(spark, str(tmp_path))
    profile = image_ops.corner_profile(good.withColumn("category", F.lit("portrait_regular")))
    assert rows(profile, "region", "bright_pixels", "x1", "y1", "x2", "y2", "is_fallback") == [
        ("bottom_left", 30, 10, 195, 20, 198, False), ("bottom_right", 0, 77, 184, 100, 200, True),
    ]


class Fussy:
    def detect(self, item, image):
        if item["item_id"] == "a":
            raise ev.ProviderUnavailable("no model")
        if item["item_id"] == "b":
            raise RuntimeError("broken")
        mask = np.zeros(image.shape[:2], np.uint8)
        if item["item_id"] != "c":
            mask[:2, :2] = 1
        return ev.MaskOutput(mask, 0.5)


class Fill:
    def restore(self, item, image, mask):
        if item["item_id"] == "d":
            raise ev.ProviderUnavailable("no weights")
        if item["item_id"] == "e":
            raise RuntimeError("broken")
        restored = image.copy()
        restored[mask > 0] = 0
        return ev.TransformOutput(restored[:-1] if item["item_id"] == "g" else restored, "cropped" if item["item_id"] == "g" else "")


def eval_images(spark, ids, category="portrait_regular"):
    df = spark.createDataFrame([(i, [200] * 16) for i in ids], "item_id string, px array<int>")
    base = df.select(
        "item_id", F.lit("d").alias("dataset_id"), F.concat("item_id", F.lit(".png")).alias("relative_path"),
        F.lit(category).alias("source_category"), "px",
    )
    return ev.gray_images(base, F.col("px"), 4, 4).drop("px")


@pytest.fixture()
def providers(monkeypatch):
    monkeypatch.setitem(ev.MASK_PROVIDERS, "fussy", Fussy)
    monkeypatch.setitem(ev.TRANSFORM_PROVIDERS, "fill", Fill)


def test_evaluate_statuses_and_metrics(spark, providers):
    results = ev.evaluate(eval_images(spark, "abcdefg"), "fussy", "fill", scorer=lambda item, image: [0.5, 0.25])
    got = {r.item_id: r for r in results.collect()}
    assert {k: r.status for k, r in got.items()} == {
        "a": "mask_provider_unavailable", "b": "mask_provider_error", "c": "no_mask",
        "d": "restore_provider_unavailable", "e": "restore_provider_error", "f": "restored", "g": "cropped",
    }
    assert got["b"].note == "broken" and got["b"].confidence is None
    f = got["f"]
    assert (f.mask_nonzero, f.mask_ratio, f.changed_nonzero, f.mean_abs_diff) == (4.0, 0.25, 4.0, 50.0)
    assert (f.ocr_residual_hits, f.ocr_residual_score, f.ocr_residual_max_score) == (2.0, 0.75, 0.5)
    assert f.mask_words == [int(x) for x in pixels.pack(np.pad(np.ones((2, 2)), (0, 2)))]
    assert got["c"].changed_nonzero == 0.0 and got["c"].ocr_residual_hits is None
    assert got["g"].changed_nonzero is None  # another shape
    assert got["f"].restore_latency_ms >= 0


def test_residual_scorer_failures_are_told(spark, providers):
    def scorer(item, image):
        if item["item_id"] == "f":
            raise ev.ProviderUnavailable("no reader")
        if item["item_id"] == "h":
            raise RuntimeError("reader broke")
        return ["bad"] if item["item_id"] == "i" else []

    got = {r.item_id: r for r in ev.evaluate(eval_images(spark, "cfhij"), "fussy", "fill", scorer=scorer).collect()}
    assert got["c"].residual_meta is None and got["j"].residual_meta == {"status": "ok", "note": ""}
    assert got["f"].residual_meta == {"status": "unavailable", "note": "no reader"}
    assert got["h"].residual_meta == {"status": "error", "note": "reader broke"} and got["i"].residual_meta["status"] == "error"
    assert [got[k].ocr_residual_hits for k in "fhij"] == [None, None, None, 0.0] and got["f"].status == "restored"
    plain = ev.evaluate(eval_images(spark, "f"), "fussy", "fill").first()
    assert plain.residual_meta is None


def test_evaluate_guards(spark, providers):
    with pytest.raises(ValueError, match="unknown provider"):
        ev.evaluate(eval_images(spark, "f"), "none", "fill")
    with pytest.raises(ValueError, match="no items"):
        ev.evaluate(eval_images(spark, "f").filter("item_id = 'x'"), "fussy", "fill")


def test_seed_masks(spark):
    mask = np.zeros((4, 4), np.uint8)
    mask[0, 0] = 1
    masks = spark.createDataFrame([("m", [int(x) for x in pixels.pack(mask)])], "mask_path string, words array<long>")
    items = eval_images(spark, "fg").withColumn("seed_mask_path", F.when(F.col("item_id") == "f", "m"))
    got = ev.evaluate(ev.with_seed_masks(items, masks), "seed_manifest", "noop")
    assert rows(got, "item_id", "status", "confidence", "mask_nonzero", "changed_nonzero") == [
        ("f", "masked_only", 1.0, 1.0, 0.0), ("g", "no_mask", 0.0, 0.0, 0.0),
    ]


@pytest.mark.parametrize(("height", "width", "set_bits"), [(8, 16, 128), (2, 8, 16), (4, 5, 20)])
def test_seed_mask_of_another_shape_is_an_error(spark, height, width, set_bits):
    mask = np.zeros(height * width, np.uint8)
    mask[:set_bits] = 1
    words = [int(x) for x in pixels.pack(mask)]
    plain = spark.createDataFrame([("m", words)], "mask_path string, words array<long>")
    items = eval_images(spark, "f").withColumn("seed_mask_path", F.lit("m"))
    shaped = plain.withColumn("height", F.lit(height)).withColumn("width", F.lit(width))
    for masks in (shaped, plain) if set_bits > 16 else (shaped,):
        got = ev.evaluate(ev.with_seed_masks(items, masks), "seed_manifest", "noop")
        assert rows(got, "status") == [("mask_provider_error",)]


def test_odd_pixels_and_outputs_are_rows(spark, providers):
    made = {"none": None, "flat": np.zeros(16)}
    for name, mask in made.items():
        ev.MASK_PROVIDERS[name] = lambda mask=mask: type("Odd", (), {"detect": lambda s, i, im: ev.MaskOutput(mask, 1.0)})()
        assert rows(ev.evaluate(eval_images(spark, "f"), name, "fill"), "status", "mask_nonzero") == [("mask_provider_error", 0.0)]
    blank = eval_images(spark, "f").withColumn("data", F.lit(None).cast("binary"))
    assert rows(ev.evaluate(blank, "fussy", "fill"), "item_id", "status", "mask_nonzero") == [("f", "decode_provider_error", None)]


def test_repeated_evidence(spark, providers):
    made = evidence.repeated_evidence(eval_images(spark, "fh"), ("fussy", "fill"), ("fussy", "noop"), repetitions=2)
    assert rows(made["sections"], "section", "status", "overall_status", "baseline_run_count") == [
        ("optional_stable", "skipped", "ready", 2), ("release_blocking", "ready", "ready", 2),
    ]
    assert made["results"].count() == 8 and made["issues"].count() == 0
    row = made["trend"].filter("section = 'baseline_aggregate' and metric_key = 'mean_abs_diff'").first()
    assert (row.baseline_value, row.candidate_value, row.assessment) == (50.0, 0.0, "improved")


def test_batch_resume(spark, providers):
    items = eval_images(spark, "bf")
    first, failures = batch.run_batch(items, "fussy", "fill", "run-1")
    assert rows(first, "item_id", "status") == [("f", "restored")]
    assert [(r.item_id, r.run_id, "_provider_" in r.status, bool(r.note)) for r in failures.collect()] == [("b", "run-1", True, True)]
    progress = runs.run_progress(spark.createDataFrame([("run-1", 2)], "run_id string, image_count long"), first)
    assert rows(progress) == [("run-1", 2, 1, 1)]
    ev.MASK_PROVIDERS["steady"] = lambda: type("Steady", (), {"detect": lambda s, i, im: ev.MaskOutput(np.ones((4, 4)), 1.0)})()
    manifest = items.select("relative_path")
    second, failures = batch.resume_batch(manifest, first, items, "steady", "fill", "run-1")
    assert rows(second, "item_id", "status") == [("b", "restored")] and failures.count() == 0
    both = first.unionByName(second)
    assert batch.resume_batch(manifest, both, items, "steady", "fill", "run-1")[0].count() == 0
    assert rows(runs.resume_counts(manifest, first, both, "relative_path")) == [(2, 1, 1, 1, 0, 1)]
    cover, _ = batch.run_batch(eval_images(spark, "f", "cover_heavy"), "fussy", "fill", "r")
    assert rows(cover, "status") == [("skipped_cover",)]
    assert rows(batch.run_batch(items, "fussy", "fill", "r", scan_only=True)[0], "status") == [("scanned",), ("scanned",)]


def test_plan(spark, tmp_path):
    items = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "relative_path string, category string")
    root = str(tmp_path / "plans")
    batch.write_plan(items, root, "20260101-a", {"mask_provider": "m"})
    batch.write_plan(items.filter("relative_path = 'a'"), root, "20260102-a", {"mask_provider": "m"})
    header, stored = batch.read_plan(spark, root, "20260101-a")
    assert rows(header, "plan_id", "mask_provider", "item_count") == [("20260101-a", "m", 3)]
    assert header.first().category_counts == {"x": 2, "y": 1}
    assert rows(stored, "relative_path") == [("a",), ("b",), ("c",)]
    assert batch.apply_plan(header, stored)[1].count() == 0
    assert batch.apply_plan(header, stored.limit(2))[1].count() == 1
    assert batch.read_plan(spark, root)[0].first().plan_id == "20260102-a"
    with pytest.raises(ValueError):
        batch.read_plan(spark, root, "none")


def test_manifest_reader(spark, tmp_path):
    item = {"source_path": "/x", "relative_path": "x", "width": 1, "height": 2, "category": "c"}
    good = tmp_path / "good.json"
    good.write_text(json.dumps({"scan_version": 1, "item_count": 1, "items": [item]}, indent=1))
    header, items = reports.read_manifest(spark, str(good))
    assert header.count() == 1 and rows(items, "pos", "relative_path", "width") == [(0, "x", 1)]
    for name, doc in {"version": {"scan_version": 2, "item_count": 1, "items": [item]}, "count": {"scan_version": 1, "item_count": 2, "items": [item]}, "items": {"scan_version": 1, "item_count": 0}}.items():
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(doc))
        with pytest.raises(Exception):
            reports.read_manifest(spark, str(path))[0].collect()


def test_results_jsonl(spark, tmp_path):
    path = tmp_path / "results.jsonl"
    path.write_text(json.dumps({"item": {"relative_path": "a"}, "status": "restored"}) + "\n\n" + json.dumps({"item": {"relative_path": "b"}, "status": "x"}) + "\n")
    assert rows(reports.read_results_jsonl(spark, str(path)), "item.relative_path", "status") == [("a", "restored"), ("b", "x")]
    path.write_text('{"status": "ok"}\n{bad\n')
    with pytest.raises(Exception):
        reports.read_results_jsonl(spark, str(path)).collect()
    good, bad = reports.read_results_jsonl(spark, str(path), mode="PERMISSIVE")
    assert rows(good, "status", "line_no") == [("ok", 1)] and rows(bad, "line", "line_no") == [("{bad", 2)]


def test_line_numbers_of_a_folder(spark, tmp_path):
    for folder, name, count in (("x", "a", 3), ("x", "b", 0), ("x", "c", 2), ("y", "a", 1)):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text("".join(f"{folder}{name}{i}\n" for i in range(count)))
    got = rows(reports.number_lines(spark, f"{tmp_path}/*/*", by_folder=True), "line_no", "value")
    assert got == [(1, "xa0"), (1, "ya0"), (2, "xa1"), (3, "xa2"), (4, "xc0"), (5, "xc1")]


def test_no_task_sorts_a_whole_flag(spark, monkeypatch):
    """One flag holds all lines; they are written by several tasks and numbered as one text."""
    data = spark.range(2000).selectExpr(
        "id as l_orderkey", "id % 7 as l_partkey", "1L as l_suppkey", "1 as l_linenumber", "'A' as l_returnflag", "'O' as l_linestatus"
    )
    monkeypatch.setattr(runs_catalog, "table", lambda *_: data)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = runs_catalog.numbered_results(spark, "")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({f for f in got.inputFiles() if "flag=A" in f}) >= 3
    found = {r.line_no: r.relative_path for r in got.collect() if r.relative_path}
    assert found == {i + 1: f"{i}-1-{i % 7}" for i in range(2000) if i % 50}


def test_line_numbers_across_splits(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    wanted = []
    for name, count in (("a.jsonl", 4000), ("b.jsonl", 7), ("c.jsonl", 2500)):
        texts = ["" if i % 11 == 3 else "{bad" if i % 97 == 5 else "[2]" if i % 97 == 6 else json.dumps({"status": f"s{i}", "pad": "x" * (i % 40)}) for i in range(count)]
        (folder / name).write_text("\n".join(texts) + "\n")
        wanted += [(name, i + 1, t) for i, t in enumerate(texts) if t]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1000")
        numbered = reports.number_lines(spark, str(folder))
        assert numbered.rdd.getNumPartitions() > 5
        good, bad = reports.read_results_jsonl(spark, str(folder), mode="PERMISSIVE")
        name = F.regexp_extract("source_file", "[^/]+$", 0)
        got = [(r[0], r[1], r[2]) for r in bad.select(name, "line_no", "line").collect()]
        assert sorted(got) == sorted(w for w in wanted if not w[2].startswith('{"'))
        places = {(r[0], r[1]): r[2] for r in good.select(name, "line_no", "status").collect()}
        assert places == {(n, i): json.loads(t)["status"] for n, i, t in wanted if t.startswith('{"')}
        with pytest.raises(Exception, match=r"bad result line \d+ of .*\.jsonl"):
            reports.read_results_jsonl(spark, str(folder)).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_validation(spark):
    df = spark.createDataFrame(
        [("/a", "a", 1, 1, "c"), ("", "a", 1, 1, "c"), ("/a", None, 1, 1, "c"), ("/a", "a", None, 1, "c"), ("/a", "a", 1, 1, "")],
        "source_path string, relative_path string, width int, height int, category string",
    )
    good, bad = validate.validate_items(df)
    assert good.count() == 1 and bad.count() == 4
    assert rows(validate.unknown_names(df.select("category"), spark.createDataFrame([("c",)], "category string"), "category")) == [("",)]
    with pytest.raises(ValueError):
        validate.require_names(["x"], ["y"], "dataset")
    with pytest.raises(ValueError):
        scan.select_items(df.withColumn("dataset_id", F.lit("d")), "other")


def test_run_lookup(spark):
    df = spark.createDataFrame([("r1", 1), ("r3", 3), ("r2", 2)], "run_id string, n int")
    assert rows(runs.run_lookup(df)) == [("r3", 3)]
    assert rows(runs.run_lookup(df, "r2")) == [("r2", 2)]
    with pytest.raises(ValueError):
        runs.run_lookup(df, "r2", latest=True)


def test_result_key_and_reconcile(spark):
    df = spark.createDataFrame([("a", "/a"), ("", "/b"), ("", ""), (None, None)], "r string, s string")
    assert rows(df.select(runs.result_key(F.col("r"), F.col("s")).alias("k"))) == [("/b",), ("a",), (None,), (None,)]
    summary = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1)], "run_id string, v int")
    lines = spark.createDataFrame([("x", 10), ("y", 11), ("z", 12)], "run_id string, v int")
    assert rows(runs.reconcile_results(summary, lines)) == [("x", 1), ("x", 2), ("y", 11), ("z", 12)]


def test_flat_batch_report(spark, tmp_path):
    path = tmp_path / "results.jsonl"
    full = {
        "item": {"source_path": "/a", "relative_path": "a", "category": "c", "width": 1, "height": 1},
        "status": "restored", "note": "", "mask_provider": "m", "restore_provider": "r", "mask_path": "/m",
        "detection": {"category": "c", "mask_nonzero": 7, "confidence": 0.12345, "boxes": []},
        "restore_meta": {"session_mode": "shared"}, "mask_latency_ms": 1.5,
    }
    path.write_text(json.dumps(full) + "\n" + json.dumps({"item": {"relative_path": "b"}, "status": "scanned"}))
    flat = sinks.flat_batch(reports.read_results_jsonl(spark, str(path)))
    assert flat.columns == sinks.BATCH_COLUMNS
    got = rows(flat, "relative_path", "mask_nonzero", "confidence", "mask_latency_ms", "restore_latency_ms", "restore_session_mode")
    assert got == [("a", "7", "0.1235", "1.500", "", "shared"), ("b", "0", "0.0000", "", "", "")]


def test_stored_artifacts(spark, tmp_path):
    for name, dataset in (("one", "d1"), ("two", "d1"), ("latest", "d9")):
        (tmp_path / f"{name}.json").write_text(json.dumps({"dataset_id": dataset}, indent=1))
    found = reports.read_artifacts(spark, str(tmp_path), schemas.struct(dataset_id=schemas.STRING))
    assert rows(found, "dataset_id") == [("d1",), ("d1",)]
    newest = reports.latest_matching(found, *reports.matches(dataset_id="d1")).first()
    assert newest.path.endswith(("one.json", "two.json"))


def test_nested_recogniser_entries(spark):
    df = spark.createDataFrame(
        [(1, [([(1, 2)], "t", 0.5), ([(3, 4)], "u", 0.6)])],
        "i int, entries array<struct<polygon:array<struct<x:int,y:int>>,text:string,score:double>>",
    )
    assert rows(text.flatten_entries(df, "entries"), "line_no", "text", "score") == [(0, "t", 0.5), (1, "u", 0.6)]


def test_review_key(spark):
    df = spark.createDataFrame([(" a ", "p"), ("", " p "), (None, None)], "i string, r string")
    assert rows(df.select(review.review_key(F.col("i"), F.col("r")).alias("k"))) == [("a",), ("p",), (None,)]


def test_run_summaries_fall_back_and_reconcile(spark, tmp_path):
    def entry(path, status="restored"):
        return {"item": {"relative_path": path}, "status": status}

    def put(run, name, text):
        target = tmp_path / run / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)

    whole = {"run_id": "r1", "run_status": "interrupted", "image_count": 3, "resume_count": 1, "results": [entry("a")]}
    put("r1", "summary.json", json.dumps(whole, indent=1))
    put("r1", "reports/report.json", json.dumps({**whole, "run_status": "other"}))
    put("r2", "summary.json", '{"run_id": "r2", "results": [')
    put("r2", "reports/report.json", json.dumps({"results": [entry("a"), entry("b")]}))
    put("r1", "results.jsonl", json.dumps(entry("a")) + "\n" + json.dumps(entry("b")) + "\n")
    put("r2", "results.jsonl", json.dumps(entry("a")) + "\n")
    headers, results = reports.read_run_summaries(spark, str(tmp_path))
    assert rows(headers, "run_id", "run_status", "resume_count", "image_count", "completed_item_count", "pending_item_count") == [
        ("r1", "interrupted", 1, 3, 1, 2), ("r2", "completed", 0, 2, 2, 0),
    ]
    key = results.select("run_id", "item.relative_path")
    lines = None
    for run in ("r1", "r2"):
        part = reports.read_results_jsonl(spark, str(tmp_path / run / "results.jsonl")).select(F.lit(run).alias("run_id"), "item.relative_path")
        lines = part if lines is None else lines.unionByName(part)
    assert rows(runs.reconcile_results(key, lines)) == [("r1", "a"), ("r1", "b"), ("r2", "a"), ("r2", "b")]
