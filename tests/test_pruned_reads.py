"""Limits and resumed runs open only the files they need."""

from __future__ import annotations

import sys

import numpy as np
import pytest
from conftest import rows, write_png
from pyspark import cloudpickle
from pyspark.sql import functions as F

from corpuseval.operators.keyed import key_filter
from corpuseval.plans import batch, scan
from corpuseval.plans import evaluate as ev
from corpuseval.sources import corpus

cloudpickle.register_pickle_by_value(sys.modules[__name__])
NAMES = ["a.png", "b c.png", "d+e.png", "p%20q.png", "sub/ü.png", "sub/x.png", "y.png", "z#1.png"]


@pytest.fixture()
def folder(tmp_path):
    for name in NAMES:
        write_png(tmp_path / "in" / name, np.full((6, 5, 3), 90))
    (tmp_path / "in" / "notes.txt").write_text("x")
    write_png(tmp_path / "in" / "docs" / "left_out.png", np.zeros((3, 3)))
    return str(tmp_path / "in")


def opened(df):
    """Files that the scans of an executed plan opened."""
    total = 0

    def walk(node):
        nonlocal total
        if node.metrics().contains("numFiles"):
            total += node.metrics().apply("numFiles").value()
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    walk(plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan)
    return total


def test_paths_of_images_are_those_of_the_listing(spark, folder):
    good, bad = corpus.read_images(spark, folder)
    listed = corpus.list_corpus(spark, folder)
    assert rows(corpus.select_images(good), "relative_path") == rows(listed, "relative_path") == sorted((n,) for n in NAMES)
    for name in NAMES:
        one = good.filter(F.col("relative_path") == name).select("relative_path", "data")
        assert rows(one, "relative_path") == [(name,)] and opened(one) == 1


@pytest.mark.parametrize("limit", [0, 1, 3, 5, 8, 50])
def test_scan_decodes_no_more_than_the_limit(spark, folder, limit):
    items, rejects = scan.scan_corpus(spark, folder, limit=limit)
    assert rows(items, "relative_path") == sorted((n,) for n in NAMES)[:limit] and rejects.count() == 0
    assert opened(items) == min(limit, len(NAMES))


def test_scan_opens_images_only(spark, folder):
    items, _ = scan.scan_corpus(spark, folder)
    assert opened(items) == len(NAMES)


def test_limit_beyond_top_k(spark, folder, monkeypatch):
    from corpuseval.operators import keyed

    monkeypatch.setattr(keyed, "TOP_K_LIMIT", 2)
    items, _ = scan.scan_corpus(spark, folder, limit=4)
    assert opened(items) == 4 and items.count() == 4


class Whole:
    def detect(self, item, image):
        return ev.MaskOutput(np.ones(image.shape[:2], np.uint8), 1.0)


def test_resume_opens_pending_files_only(spark, folder, monkeypatch):
    monkeypatch.setitem(ev.MASK_PROVIDERS, "whole", Whole)
    good, _ = corpus.read_images(spark, folder)
    name = F.col("relative_path")
    images = good.select("*", name.alias("item_id"), F.lit("d").alias("dataset_id"), F.lit("portrait_regular").alias("source_category"))
    manifest = corpus.list_corpus(spark, folder).select("relative_path")
    done = spark.createDataFrame([(n,) for n in NAMES if n not in ("b c.png", "sub/ü.png", "p%20q.png")], "relative_path string")
    seen = []
    evaluate = batch.evaluate
    monkeypatch.setattr(batch, "evaluate", lambda images, *a, **k: seen.append(images) or evaluate(images, *a, **k))
    results, failures = batch.resume_batch(manifest, done, images, "whole", "noop", "run-2")
    assert rows(results, "relative_path", "status") == [("b c.png", "masked_only"), ("p%20q.png", "masked_only"), ("sub/ü.png", "masked_only")]
    assert failures.count() == 0
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert opened(seen[0].select("item_id", "data")) == 3 and "Exchange" not in plan and "Join" not in plan
    all_done = manifest.select("relative_path")
    assert batch.resume_batch(manifest, all_done, images, "whole", "noop", "run-3")[0].count() == 0


@pytest.mark.parametrize("bits", [2**15, 2**27])
def test_key_filter_keeps_every_key(spark, bits):
    table = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("k"))
    keys = table.filter("hash(k) % 10 = 0")
    passed = table.filter(key_filter(keys, "k", most_bits=bits))
    missing = keys.join(passed, "k", "left_anti").count()
    assert missing == 0 and passed.count() < keys.count() * (1.2 if bits > 2**15 else 1.7)
    assert key_filter(table.limit(0), "k") is None
