import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from corpuseval.operators import keyed


def test_last_wins_drops_blank_keys(spark):
    df = spark.createDataFrame(
        [("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("", 9, "q"), (None, 9, "q"), ("b", 0, "w")], "k string, pos int, v string"
    )
    assert rows(keyed.last_wins(df, "k", "pos"), "k", "v") == [("a", "z"), ("b", "w")]


@pytest.mark.parametrize("partition", [["g"], []])
def test_ordered_number_with_a_hot_partition(spark, partition):
    rng = random.Random(5)
    data = [("hot" if i % 3 else f"g{i % 17}", rng.random(), i) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, v double, i long").repartition(7)
    got = {(r.g, r.i): r.seq for r in keyed.ordered_number(df, partition, ["v", "i"]).collect()}
    counters, want = {}, {}
    for g, v, i in sorted(data, key=lambda r: (r[0] if partition else "", r[1], r[2])):
        group = g if partition else ""
        counters[group] = counters.get(group, 0) + 1
        want[(g, i)] = counters[group]
    assert got == want


def test_ordered_number_moves_no_numbered_rows_for_few_offsets(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"), F.sha2(F.col("id").cast("string"), 512).alias("payload"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        plan = keyed.ordered_number(df, "g", "v")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_hot_keys(spark, monkeypatch):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), (F.col("id") % 2).alias("j"))
    assert keyed.hot_keys(df, "k") == [] == keyed.hot_keys(df.limit(0), "k")
    monkeypatch.setattr(keyed, "HOT_ROWS", 600)
    want = df.select(F.xxhash64(F.lit("hot"))).first()[0]
    assert keyed.hot_keys(df, "k") == [want] and keyed.hot_keys(df, ["k", "j"]) == []
    monkeypatch.setattr(keyed, "HOT_BUCKETS", 1)
    assert keyed.hot_keys(df, "k") == [want]


def test_ordered_number_keeps_null_partitions(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 5)], "g string, v int")
    assert rows(keyed.ordered_number(df, "g", "v"), "g", "v", "seq") == [("a", 5, 1), (None, 1, 1), (None, 2, 2)]


@pytest.mark.parametrize("n", [5, 1500])
def test_top_per_group_small_and_large(spark, n):
    df = spark.range(6000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    top = keyed.top_per_group(df, "g", [F.col("v").desc()], n)
    kept = top.groupBy("g").agg(F.count(F.lit(1)), F.min("v"), F.max("v"))
    assert rows(kept) == [(0, n, 5998 - 2 * (n - 1), 5998), (1, n, 5999 - 2 * (n - 1), 5999)]


def test_first_n_beyond_top_k(spark, monkeypatch):
    monkeypatch.setattr(keyed, "TOP_K_LIMIT", 10)
    df = spark.range(200).select(F.col("id").alias("v"))
    assert [r[0] for r in rows(keyed.first_n(df, "v", 25).orderBy("v"))] == sorted(range(25), key=str)


@pytest.mark.parametrize("how", ["left", "inner", "left_anti", "left_semi"])
def test_salted_lookup_equals_plain_join(spark, no_broadcast, how):
    left = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))).alias("k"),
        "id",
    )
    right = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(0, 500, 2)]], "k string, v int")
    for chosen in (right, right.filter("k <> 'hot'")):
        got = keyed.lookup_join(left, chosen, "k", how)
        want = left.join(chosen, "k", how)
        assert got.columns == want.columns
        assert rows(got) == rows(want)


def test_salt_spreads_a_hot_key(spark, no_broadcast):
    left = spark.range(4000).select(F.lit("hot").alias("k"), "id")
    hot = keyed.frequent_keys(left, "k")
    assert hot.count() == 1
    plan = keyed.lookup_join(left, spark.createDataFrame([("hot", 1)], "k string, v int"), "k")._jdf.queryExecution().toString()
    assert "_salt" in plan


def test_key_sets(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "k string")
    b = spark.createDataFrame([("y",), ("z",)], "k string")
    assert rows(keyed.common_keys(a, b, "k")) == [("y",)]
    assert rows(keyed.left_only_keys(a, b, "k")) == [("x",)]


def test_latest_report_ties_go_to_the_smallest_path(spark):
    df = spark.createDataFrame([("d", "r2", "b"), ("d", "r2", "a"), ("d", "r1", "0")], "dataset_id string, run_id string, report_path string")
    assert rows(keyed.latest_report(df, ["dataset_id"])) == [("d", "r2", "a")]


def test_group_limit_is_pushed_below_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    plan = keyed.top_per_group(df, "g", ["v"], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_top_of_a_hot_group_beyond_the_pushdown(spark):
    df = spark.range(6000).select(F.when(F.col("id") % 10 < 7, "hot").otherwise("cold").alias("g"), (F.col("id") * 7919 % 6007).alias("v"), "id")
    top = keyed.top_per_group(df, "g", [F.col("v").desc()], 1500)
    data = df.collect()
    want = {(g, r.v) for g in ("hot", "cold") for r in sorted((r for r in data if r.g == g), key=lambda r: -r.v)[:1500]}
    assert {(r.g, r.v) for r in top.collect()} == want
    tied = keyed.top_per_group(df.select("g", (F.col("v") % 3).alias("v"), "id"), "g", "v", 1001)
    counts = {r.g: (r.n, r.least) for r in tied.groupBy("g").agg(F.count("*").alias("n"), F.max("v").alias("least")).collect()}
    assert counts == {"hot": (1001, 0), "cold": (1001, 1)}
    assert tied.columns == ["g", "v", "id"] and sorted(tied.collect()) == sorted(tied.repartition(7).collect())


def test_ordered_number_by_key_stores_keys_only(spark):
    data = [(i, "a" if i % 3 else "b", (i * 37) % 101, "x" * 50) for i in range(300)]
    df = spark.createDataFrame(data, "i long, g string, v long, payload string")
    wide = keyed.ordered_number(df, "g", ["v", "i"])
    narrow = keyed.ordered_number(df, "g", ["v", "i"], key="i")
    assert narrow.columns == wide.columns
    assert rows(narrow, "i") == rows(wide, "i")
    stored = [s for s in narrow._jdf.queryExecution().analyzed().toString().splitlines() if "parquet" in s]
    assert stored and all("payload" not in s for s in stored)


def test_ordered_number_by_key_of_no_rows(spark):
    df = spark.createDataFrame([], "i long, g string, p string")
    assert keyed.ordered_number(df, "g", "i", key="i").collect() == []
