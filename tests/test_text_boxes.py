import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from corpuseval.functions import arrays as fa, boxes as fb, marktext as fm, pixels, sql
from corpuseval.operators import geometry, profiles, text


def judge(spark, value, region, tokens):
    df = spark.createDataFrame([(value, region)], "t string, r string")
    return df.select(fm.is_mark_text(F.col("t"), F.col("r"), tokens)).first()[0]


@pytest.mark.parametrize(
    "value, region, tokens, want",
    [
        ("Acme Studio", "bottom_left", ["acmestudio"], True),
        ("Acme Studio", "bottom_left", [], False),
        ("Some Site.Com", "bottom_left", [], True),
        ("Some Site.Com", None, [], False),
        ("com", "bottom_right", [], False),
        ("COPY  RIGHT", "cover_text", [], True),
        ("copy right　x", None, ["copyrightx"], True),
        (None, "bottom_left", ["x"], False),
    ],
)
def test_mark_text(spark, value, region, tokens, want):
    assert judge(spark, value, region, tokens) is want


def test_whitespace_matches_python_split(spark):
    value = "".join(f"a{c}" for c in fm.WHITESPACE) + "b"
    df = spark.createDataFrame([(value,)], "t string")
    assert df.select(fm.squash(F.col("t"))).first()[0] == "".join(value.lower().split())
    assert df.select(fm.normalize_name(F.col("t"))).first()[0] == " ".join(value.lower().split())


def test_sql_functions(spark):
    sql.register_sql(spark, ["acmestudio"])
    assert spark.sql("select is_mark_text('Acme\tStudio', null), is_mark_text('a.com', 'bottom_left'), is_mark_text('a.com', null), mask_iou(0, 0, 0), mask_iou(1, 2, 2)").first()[:] == (True, True, False, 1.0, 0.333333)
    flat = spark.sql(
        "select * from flatten_lines(array(array(named_struct('x', 1, 'y', 2))), array('t', 'u'), array(0.5D, 0.6D))"
    )
    assert rows(flat, "text", "score") == [("t", 0.5)]


def lines_df(spark, lines, category="portrait_regular", width=80, height=120):
    data = [("i", [{"x": x, "y": y} for x, y in polygon], t, s) for polygon, t, s in lines]
    df = spark.createDataFrame(data, "item_id string, polygon array<struct<x:int,y:int>>, text string, score double")
    return df.select("*", F.lit(width).alias("width"), F.lit(height).alias("height"), F.lit(category).alias("category"))


CORNER = [(60, 106), (78, 106), (78, 111), (60, 111)]


def test_accept_lines(spark):
    rows_in = [(CORNER, "site.com", 0.62), (CORNER, "site.com", 0.4), ([], "site.com", 0.9), ([(40, 10)], "site.com", 0.9), (CORNER, "hello", 0.9)]
    got = text.accept_lines(lines_df(spark, rows_in))
    assert rows(got, "region", "box.x1", "box.y1", "box.x2", "box.y2") == [("bottom_right", 48, 98, 80, 119)]
    cover = text.accept_lines(lines_df(spark, [(CORNER, "hello", 0.9)], category="cover_heavy"))
    assert rows(cover, "region") == [("cover_text",)]
    items = spark.createDataFrame([("i",), ("none",)], "item_id string")
    assert rows(text.line_confidence(items, got, "item_id")) == [("i", 1, 0.62), ("none", 0, 0.0)]
    scored = text.residual_score(items, got, "item_id")
    assert rows(scored) == [("i", 1, 0.62, 0.62), ("none", 0, 0.0, 0.0)]


def test_cascade(spark):
    def stage(*cells):
        return spark.createDataFrame(list(cells), "item_id string, mask_nonzero long, source string")

    first = stage(("a", 5, "p"), ("b", 0, "p"), ("c", 0, "p"), ("d", 0, "p"))
    second = stage(("a", 9, "s"), ("b", 7, "s"), ("c", 0, "s"), ("d", 0, "s"))
    third = stage(("a", 9, "t"), ("b", 9, "t"), ("c", 3, "t"), ("d", 0, "t"))
    got = text.cascade([("primary", first), ("retry", second), ("boxes", third)], "item_id")
    assert rows(got, "item_id", "mask_nonzero", "source", "strategy", "attempts") == [
        ("a", 5, "p", "primary", ["primary"]),
        ("b", 7, "s", "retry", ["primary", "retry"]),
        ("c", 3, "t", "boxes", ["primary", "retry", "boxes"]),
        ("d", 0, "p", "primary", ["primary", "retry", "boxes"]),
    ]
    assert fm.retry_score(0.45) == 0.35 and fm.retry_score(0.3) == 0.3 and fm.retry_score(0.1) == 0.25


def test_token_join_equals_brute_force(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcé.") for _ in range(rng.randint(1, 6))) for _ in range(60)] + ["", " "]
    lines = ["".join(rng.choice("abcé. \n\t") for _ in range(rng.randint(0, 60))) for _ in range(80)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "id int, line string")
    tokens = spark.createDataFrame([(w,) for w in words], "token string")
    want = sorted(
        (i, w)
        for i, t in enumerate(lines)
        for w in {"".join(x.split()) for x in words}
        if w and w in "".join(t.split())
    )
    for block in (500, 5):
        got = text.token_hits(df, tokens, block=block)
        assert sorted((r.id, r.token) for r in got.collect()) == want
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert text.token_hits(df, tokens.filter("token = 'none'")).count() == 0
    assert text.token_hits(df.limit(0), tokens).count() == 0


def test_token_blocks_share_a_pass(spark, monkeypatch):
    """Blocks that fit in one automaton read the lines once; more take several passes with the same hits."""
    df = spark.createDataFrame([(1, "a b c d"), (2, "d e f"), (3, None)], "id int, line string")
    tokens = spark.createDataFrame([(c,) for c in "abcdefghij"], "token string")
    want = sorted((1, c) for c in "abcd") + sorted((2, c) for c in "def")
    passes = []
    scan = text.materialize
    monkeypatch.setattr(text, "materialize", lambda d: passes.append(d) or scan(d))
    for most, stored in ((100, 1), (4, 4)):
        monkeypatch.setattr(text, "TOKEN_BLOCK", most)
        passes.clear()
        assert sorted((r.id, r.token) for r in text.token_hits(df, tokens, block=2).collect()) == want
        assert len(passes) == stored


def test_long_line_and_many_tokens(spark):
    rng = random.Random(4)
    line = "".join(rng.choice("abcdefgh ") for _ in range(100_000))
    squashed = line.replace(" ", "")
    words = {squashed[i : i + 9] for i in range(0, 60_000, 100)} | {f"absent{i}" for i in range(3000)}
    df = spark.createDataFrame([(1, line, {"k": 1}), (2, None, None)], "id int, line string, extra map<string,int>")
    start = time.time()
    got = text.token_hits(df, spark.createDataFrame([(w,) for w in words], "token string")).collect()
    assert {r.token for r in got} == {w for w in words if w in squashed} and time.time() - start < 20
    assert got[0].line == line and got[0].extra == {"k": 1}


def test_mask_extent_of_any_width(spark):
    rng = np.random.default_rng(5)
    rows, want = [], []
    for i, (h, w) in enumerate([(1, 1), (3, 5), (4, 64), (5, 65), (7, 63), (9, 130), (2, 200), (200, 3), (6, 128)] * 4):
        mask = rng.random((h, w)) < (0.02 if i % 4 else 0.5)
        if i % 9 == 4:
            mask[:] = False
            mask[h - 1, w - 1] = True
        ys, xs = np.nonzero(mask)
        rows.append((i, [float(v) for v in mask.ravel()], w, h))
        want.append((int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1) if len(xs) else None)
    df = spark.createDataFrame(rows, "id int, samples array<double>, w int, h int")
    got = df.select("id", fa.mask_extent(fa.pack_mask(F.col("samples")), F.col("w"), F.col("h")).alias("b")).orderBy("id").collect()
    assert [tuple(r.b) if r.b else None for r in got] == want
    none = spark.sql("select cast(null as array<bigint>) a, array(0L) z").select(
        fa.mask_extent(F.col("a"), F.lit(3), F.lit(3)).alias("x"), fa.mask_extent(F.col("z"), F.lit(3), F.lit(3)).alias("y")
    )
    assert tuple(none.first()) == (None, None)


def test_source_box(spark):
    frame = "width int, height int"
    items = spark.createDataFrame([(k, 10, 8) for k in "abcde"], f"k string, {frame}")
    boxes = spark.createDataFrame(
        [("a", 10, 8, (2, 2, 4, 5)), ("a", 10, 8, (3, 1, 9, 2)), ("b", 10, 8, (5, 5, 5, 6))], f"k string, {frame}, box struct<x1:int,y1:int,x2:int,y2:int>"
    )
    bit = lambda *at: [sum(1 << (y * 10 + x) for x, y in at if y * 10 + x < 64), sum(1 << (y * 10 + x - 64) for x, y in at if y * 10 + x >= 64)]
    masks = spark.createDataFrame(
        [("a", 10, 8, bit((0, 0))), ("b", 10, 8, bit((3, 2), (1, 3))), ("b", 10, 8, bit((9, 7))), ("c", 10, 8, bit()), ("d", 10, 8, None)],
        f"k string, {frame}, words array<bigint>",
    )
    got = geometry.source_box(items, boxes, masks, "k", padding=1)
    assert rows(got) == [
        ("a", 1, 0, 10, 6, "boxes"), ("b", 0, 1, 10, 8, "mask"), ("c", None, None, None, None, "empty_mask"),
        ("d", None, None, None, None, "no_mask"), ("e", None, None, None, None, "no_mask"),
    ]


def test_compact_boxes(spark):
    df = spark.createDataFrame(
        [("i", 80, 120, "portrait_regular", "bottom_left", (0, 114, 54, 120)), ("i", 80, 120, "portrait_regular", "bottom_right", (61, 110, 80, 120)),
         ("j", 80, 120, "portrait_regular", "bottom_left", (1, 114, 54, 120)), ("k", 80, 120, "cover_heavy", "bottom_left", (1, 2, 3, 4))],
        "item_id string, width int, height int, category string, region string, box struct<x1:int,y1:int,x2:int,y2:int>",
    )
    made, regions = geometry.compact_boxes(df, "item_id")
    assert rows(made, "item_id", "box.x1", "box.y1", "box.x2", "box.y2") == [
        ("i", 0, 115, 47, 119), ("i", 49, 113, 79, 118), ("j", 1, 114, 54, 120), ("k", 1, 2, 3, 4),
    ]
    assert rows(regions) == [("i", "bottom_left"), ("i", "bottom_right")]


def impact(spark, box, width, height, **options):
    df = spark.createDataFrame([(box,)], "b struct<x1:int,y1:int,x2:int,y2:int>")
    return df.select(fb.edge_impact(F.col("b"), F.lit(width), F.lit(height), **options).alias("i")).first().i


def test_edge_impact(spark):
    got = impact(spark, (0, 90, 60, 120), 220, 120, tolerance=24)
    assert (got.edge, got.kept_height, got.kept_width) == ("bottom", 90, 220)
    assert got.removed_ratio == 0.25
    assert impact(spark, (100, 50, 110, 60), 220, 120).edge == "top"  # none near: the nearest edge
    assert impact(spark, (0, 0, 220, 120), 220, 120) is None
    assert impact(spark, (0, 90, 60, 120), 220, 120, tolerance=24, min_height=100).edge == "left"


def test_union_and_covered_pixels_equal_a_painted_mask(spark, no_broadcast):
    rng = np.random.default_rng(7)
    data, masks = [], {}
    for item in range(12):
        mask = np.zeros((60, 80), bool)
        for _ in range(60 if item == 0 else 5):
            x1, y1 = int(rng.integers(0, 70)), int(rng.integers(0, 50))
            x2, y2 = x1 + int(rng.integers(-2, 12)), y1 + int(rng.integers(-2, 12))
            x2, y2 = min(x2, 80), min(y2, 60)
            data.append((item, 80, 60, (x1, y1, x2, y2)))
            if x2 > x1 and y2 > y1:
                mask[y1:y2, x1:x2] = True
        masks[item] = mask
    df = spark.createDataFrame(data, "item_id int, width int, height int, box struct<x1:int,y1:int,x2:int,y2:int>")
    got = dict((r.item_id, r.mask_nonzero) for r in geometry.covered_pixels(df, "item_id").collect())
    assert got == {i: int(m.sum()) for i, m in masks.items() if m.any()}
    for r in geometry.bbox_union(df, "item_id").collect():
        ys, xs = np.nonzero(masks[r.item_id])
        assert (r.x1, r.y1, r.x2, r.y2) == (xs.min(), ys.min(), xs.max() + 1, ys.max() + 1)


def test_packed_arrays_equal_numpy(spark):
    rng = np.random.default_rng(2)
    data = []
    for i, size in enumerate([0, 1, 63, 64, 65, 200]):
        data.append((i, [int(v) for v in rng.integers(0, 3, size)], [int(v) for v in rng.integers(0, 255, size)], size))
    df = spark.createDataFrame(data, "i int, m array<int>, p array<int>, n int")
    got = df.select("i", fa.pack_mask(F.col("m")).alias("w"), fa.popcount(fa.pack_mask(F.col("m"))).alias("c"),
                    fa.edge_words(F.col("p"), 5).alias("e")).collect()
    for r in got:
        _, mask, values, size = data[r.i]
        assert r.w == [int(x) for x in pixels.pack(np.array(mask, dtype=np.uint8))]
        assert r.c == sum(v > 0 for v in mask)
        if size and size % 5 == 0:
            assert r.e == [int(x) for x in pixels.pack(pixels.edges(np.array(values, np.uint8).reshape(-1, 5)))]


def test_overlap_of_empty_and_missing_masks(spark):
    from corpuseval.operators import masks

    df = spark.createDataFrame(
        [(1, [0], [0]), (2, [3], [1]), (3, None, [1]), (4, [1], [1, 0]), (5, [3], [3])],
        "i int, baseline_words array<long>, candidate_words array<long>",
    )
    got = masks.mask_overlap(df)
    assert rows(got, "i", "mask_iou", "mask_precision", "mask_recall", "mask_shape_differs") == [
        (1, 1.0, 1.0, 1.0, False), (2, 0.5, 1.0, 0.5, False), (3, None, None, None, None), (4, None, None, None, True), (5, 1.0, 1.0, 1.0, False),
    ]


def test_keyword_tokens(spark):
    presets = spark.createDataFrame(
        [("Brand", 0, "Acme Studio"), ("brand", 1, ".COM"), ("Other  Name", 0, "z")], "preset string, pos int, token string"
    )
    tokens = profiles.keyword_tokens(presets, ["other name", "brand"], ["Extra", "z"])
    ordered = [r.token for r in tokens.orderBy("first_pos").collect()]
    assert ordered == [*fm.DEFAULT_TOKENS, "z", "acmestudio", "extra"]
    assert profiles.unknown_presets(presets, ["brand", "none"]) == ["none"]


def test_profiles(spark):
    known = spark.createDataFrame([("Fast  Run", "m1", None)], "profile string, mask string, restore string")
    asked = spark.createDataFrame(
        [(1, "fast run", None, None), (2, "fast run", "x", None), (3, None, None, "y"), (4, "nope", None, None)],
        "id int, profile string, mask string, restore string",
    )
    good, bad = profiles.resolve_profiles(asked, known, {"mask": "dm", "restore": "dr"})
    assert rows(good, "id", "mask", "restore") == [(1, "m1", "dr"), (2, "x", "dr"), (3, "dm", "y")]
    assert rows(bad, "id") == [(4,)]


def test_areas_beyond_the_int_range(spark):
    from pyspark.sql import functions as F

    from corpuseval.functions import boxes

    frame = spark.createDataFrame([(9_000_000, 60_000, 60_000)], "n bigint, w int, h int")
    row = frame.select(boxes.mask_ratio(F.col("n"), F.col("w"), F.col("h")).alias("r")).first()
    assert row.r == 0.0025
