"""Array and mask metrics on 8 x 8 vectors, and provider evaluation over them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from corpuseval.catalog.views import VECTORS, vectors
from corpuseval.functions import arrays as fa, boxes as fb
from corpuseval.operators import compare, geometry, masks
from corpuseval.plans import evaluate as ev

EDGE_LEVEL = 60.0


def mask_nonzero(spark, sf):
    rows = vectors(spark, sf)
    return rows.select("vec_id", fa.popcount(fa.pack_mask(F.col("embedding"))).alias("mask_nonzero"))


MARK_LEVEL = 0.25


def _marks(spark, sf):
    """Sparse 8 x 8 masks, some empty."""
    level = F.transform("embedding", lambda v: v.cast("double") - MARK_LEVEL)
    return vectors(spark, sf).select("vec_id", fa.pack_mask(level).alias("words"), F.lit(8).alias("width"), F.lit(8).alias("height"))


def mask_extent(spark, sf):
    box = fa.mask_extent(F.col("words"), F.col("width"), F.col("height"))
    return _marks(spark, sf).select("vec_id", box.alias("box")).select("vec_id", "box.*")


def source_box(spark, sf):
    """Boxes of every third vector, some invalid; masks of all but every seventh stand in for the rest."""
    marks, v = _marks(spark, sf), F.col("vec_id")
    x, y = (v % 8).cast("int"), (v % 5).cast("int")
    boxes = marks.filter(v % 3 == 0).select(
        "vec_id", "width", "height", fb.box(x, y, (x + v % 4 - 1).cast("int"), y + 2).alias("box")
    )
    return geometry.source_box(marks, boxes, marks.filter(v % 7 != 0), "vec_id", padding=1)


def mask_ratios(spark, sf):
    rows = mask_nonzero(spark, sf)
    nonzero, w, h = F.col("mask_nonzero"), F.lit(8), F.lit(8)
    return rows.select(
        "vec_id", fb.mask_ratio(nonzero, w, h).alias("mask_ratio"),
        F.round(fb.mask_confidence(nonzero, w, h * 10), 6).alias("confidence"),
    )


def changed_nonzero(spark, sf):
    pairs = masks.consecutive_pairs(vectors(spark, sf), "vec_id", "pixels")
    return pairs.select("vec_id", fa.changed_count(F.col("a_pixels"), F.col("b_pixels")).alias("changed_nonzero"))


def mean_abs_diff(spark, sf):
    pairs = masks.consecutive_pairs(vectors(spark, sf), "vec_id", "pixels")
    return pairs.select("vec_id", fa.mean_abs_diff(F.col("a_pixels"), F.col("b_pixels")).alias("mean_abs_diff"))


def edge_delta(spark, sf):
    rows = vectors(spark, sf).select(
        "vec_id", fa.edge_words(F.col("pixels"), 8, EDGE_LEVEL).alias("edges"), F.size("pixels").alias("samples")
    )
    pairs = masks.consecutive_pairs(rows, "vec_id", ["edges", "samples"])
    return pairs.select("vec_id", fa.edge_delta(F.col("a_edges"), F.col("b_edges"), F.col("a_samples")).alias("edge_delta"))


def _overlaps(spark, sf):
    rows = vectors(spark, sf).select(
        "vec_id", F.when(F.col("vec_id") % 50 != 7, fa.pack_mask(F.col("embedding"))).alias("words")
    )
    return masks.mask_overlap(masks.consecutive_pairs(rows, "vec_id", "words"), "a_words", "b_words")


def mask_overlap(spark, sf):
    return _overlaps(spark, sf).select("vec_id", "mask_iou", "mask_precision", "mask_recall")


def mask_shape_guard(spark, sf):
    """Masks of 8 x 8 next to masks of 7 x 8, which take one word as well."""
    low = F.col("vec_id") % 3 == 0
    rows = vectors(spark, sf).select(
        "vec_id", fa.pack_mask(F.when(low, F.slice("embedding", 1, 56)).otherwise(F.col("embedding"))).alias("words"),
        F.when(low, 7).otherwise(8).alias("words_height"), F.lit(8).alias("words_width"),
    )
    pairs = masks.consecutive_pairs(rows, "vec_id", ["words", "words_height", "words_width"])
    return masks.mask_overlap(pairs, "a_words", "b_words").select("vec_id", "mask_shape_differs", "mask_iou")


def overlap_summary(spark, sf):
    return compare.overlap_summary(_overlaps(spark, sf))


def tone_fractions(spark, sf):
    corner = fa.patch(F.col("pixels"), 8, 8, 0, 5, 3, 8)
    return vectors(spark, sf).select("vec_id", corner.alias("corner")).select(
        "vec_id",
        F.round(fa.fraction(F.col("corner"), lambda p: p < 110), 6).alias("dark_fraction"),
        F.round(fa.fraction(F.col("corner"), lambda p: p > 150), 6).alias("bright_fraction"),
    )


class BrightMask:
    """Pixels above a level; fails on some items the way a real engine may."""

    def detect(self, item, image):
        if item["vec_id"] % 50 == 8:
            raise ev.ProviderUnavailable("no engine")
        if item["vec_id"] % 50 == 9:
            raise ValueError("bad frame")
        mask = (image[:, :, 0] > 200).astype(np.uint8)
        return ev.MaskOutput(mask, float(mask.sum()) / 100)


class MidFill:
    def restore(self, item, image, mask):
        if item["vec_id"] % 50 == 11:
            raise ValueError("fill failed")
        restored = image.copy()
        restored[mask > 0] = 128
        return ev.TransformOutput(restored)


ev.MASK_PROVIDERS.setdefault("bright", BrightMask)
ev.TRANSFORM_PROVIDERS.setdefault("mid_fill", MidFill)


def _evaluated(spark, sf):
    rows = vectors(spark, sf).select(
        F.col("vec_id").cast("string").alias("item_id"), "vec_id", "pixels",
        F.lit("vectors").alias("dataset_id"),
        F.concat(F.lit("v/"), F.col("vec_id").cast("string")).alias("relative_path"),
        F.when(F.col("label") == 0, "cover_heavy").otherwise("portrait_regular").alias("source_category"),
    )
    images = ev.gray_images(rows, F.col("pixels"), 8, 8).drop("pixels")
    return ev.evaluate(images, "bright", "mid_fill", check_rows=False)


def evaluate(spark, sf):
    return _evaluated(spark, sf).select(
        "item_id", "status", "confidence", "mask_nonzero", "mask_ratio", "changed_nonzero", "mean_abs_diff"
    )


def evaluate_statuses(spark, sf):
    return _evaluated(spark, sf).groupBy("dataset_id", "status").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        mask_nonzero, mask_extent, source_box, mask_ratios, changed_nonzero, mean_abs_diff, edge_delta, mask_overlap,
        mask_shape_guard, overlap_summary, tone_fractions, evaluate, evaluate_statuses,
    )
}

# --- SQL -----------------------------------------------------------------------------------

_PAIRS = f"""WITH {VECTORS},
pairs AS (SELECT a.vec_id, a.pixels AS ap, b.pixels AS bp, a.embedding AS ae, b.embedding AS be
          FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1)"""
_CELLS = f"""{_PAIRS},
cells AS (SELECT vec_id, unnest(ap) AS x, unnest(bp) AS y FROM pairs)"""
_NONZERO = f"""WITH {VECTORS},
m AS (SELECT vec_id, CAST(len(list_filter(embedding, lambda v: v > 0)) AS BIGINT) AS mask_nonzero FROM vectors)"""
_OVERLAP = f"""{_PAIRS},
c AS (SELECT vec_id, unnest(ae) > 0 AS p, unnest(be) > 0 AS q FROM pairs),
n AS (SELECT vec_id, count(*) FILTER (p AND q) AS i, count(*) FILTER (p OR q) AS u, count(*) FILTER (p) AS np, count(*) FILTER (q) AS nq
      FROM c GROUP BY vec_id),
overlap AS (
  SELECT vec_id, CASE WHEN gone THEN NULL WHEN u = 0 THEN 1.0 ELSE round(i / u, 6) END AS mask_iou,
         CASE WHEN gone THEN NULL WHEN u = 0 THEN 1.0 ELSE round(i / greatest(1, nq), 6) END AS mask_precision,
         CASE WHEN gone THEN NULL WHEN u = 0 THEN 1.0 ELSE round(i / greatest(1, np), 6) END AS mask_recall
  FROM (SELECT *, vec_id % 50 = 7 OR (vec_id + 1) % 50 = 7 AS gone FROM n))"""
_EVALUATED = f"""WITH {VECTORS},
s AS (SELECT CAST(vec_id AS VARCHAR) AS item_id, vec_id, label, len(list_filter(pixels, lambda p: p > 200)) AS nz,
             list_sum(list_transform(pixels, lambda p: CASE WHEN p > 200 THEN abs(p - 128) ELSE 0 END)) AS total FROM vectors),
t AS (SELECT *, CASE WHEN vec_id % 50 = 8 THEN 'mask_provider_unavailable'
             WHEN vec_id % 50 = 9 THEN 'mask_provider_error' WHEN nz = 0 THEN 'no_mask' WHEN vec_id % 50 = 11 THEN 'restore_provider_error'
             ELSE 'restored' END AS status FROM s)"""

_EXTENTS = f"""WITH {VECTORS},
cells AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding) AS v FROM vectors),
extents AS (SELECT vec_id, CAST(min(i % 8) AS INT) AS x1, CAST(min(i // 8) AS INT) AS y1, CAST(max(i % 8) + 1 AS INT) AS x2,
                   CAST(max(i // 8) + 1 AS INT) AS y2 FROM cells WHERE CAST(v AS DOUBLE) - {MARK_LEVEL} > 0 GROUP BY vec_id)"""

ORACLES = {
    "mask_extent": f"{_EXTENTS} SELECT vec_id, x1, y1, x2, y2 FROM vectors LEFT JOIN extents USING (vec_id)",
    "source_box": f"""{_EXTENTS},
b AS (SELECT vec_id, CAST(vec_id % 8 AS INT) AS l, CAST(vec_id % 5 AS INT) AS t, CAST(vec_id % 8 + vec_id % 4 - 1 AS INT) AS r FROM vectors
      WHERE vec_id % 3 = 0 AND vec_id % 4 > 1),
c AS (SELECT vec_id, l, t, r, t + 2 AS d, 'boxes' AS box_status FROM b
      UNION ALL SELECT v.vec_id, x1, y1, x2, y2, CASE WHEN v.vec_id % 7 = 0 THEN 'no_mask' WHEN x1 IS NULL THEN 'empty_mask' ELSE 'mask' END
      FROM vectors v LEFT JOIN (SELECT * FROM extents WHERE vec_id % 7 <> 0) e USING (vec_id) WHERE v.vec_id NOT IN (SELECT vec_id FROM b))
SELECT vec_id, CASE WHEN l IS NOT NULL THEN greatest(0, l - 1) END AS x1, CASE WHEN l IS NOT NULL THEN greatest(0, t - 1) END AS y1,
       CASE WHEN l IS NOT NULL THEN least(8, r + 1) END AS x2, CASE WHEN l IS NOT NULL THEN least(8, d + 1) END AS y2, box_status FROM c""",
    "mask_nonzero": f"{_NONZERO} SELECT * FROM m",
    "mask_ratios": f"""{_NONZERO} SELECT vec_id, round(mask_nonzero / 64, 6) AS mask_ratio,
       round(least(1.0::DOUBLE, mask_nonzero / (640 * 0.08::DOUBLE)), 6) AS confidence FROM m""",
    "changed_nonzero": f"{_CELLS} SELECT vec_id, count(*) FILTER (x <> y) AS changed_nonzero FROM cells GROUP BY vec_id",
    "mean_abs_diff": f"{_CELLS} SELECT vec_id, round(avg(abs(x - y)), 6) AS mean_abs_diff FROM cells GROUP BY vec_id",
    "edge_delta": f"""{_PAIRS},
g AS (SELECT vec_id, ap, bp, unnest(range(64)) AS i FROM pairs),
e AS (SELECT vec_id,
  (CASE WHEN i % 8 < 7 THEN abs(ap[i + 2] - ap[i + 1]) ELSE 0 END + CASE WHEN i < 56 THEN abs(ap[i + 9] - ap[i + 1]) ELSE 0 END) > 60 AS x,
  (CASE WHEN i % 8 < 7 THEN abs(bp[i + 2] - bp[i + 1]) ELSE 0 END + CASE WHEN i < 56 THEN abs(bp[i + 9] - bp[i + 1]) ELSE 0 END) > 60 AS y FROM g)
SELECT vec_id, round(count(*) FILTER (x <> y) * 255.0::DOUBLE / 64, 6) AS edge_delta FROM e GROUP BY vec_id""",
    "mask_overlap": f"{_OVERLAP} SELECT * FROM overlap",
    "mask_shape_guard": f"""{_OVERLAP},
full_pairs AS (SELECT vec_id, CASE WHEN u = 0 THEN 1.0 ELSE round(i / u, 6) END AS iou FROM n)
SELECT vec_id, (vec_id % 3 = 0) <> ((vec_id + 1) % 3 = 0) AS mask_shape_differs,
       CASE WHEN (vec_id % 3 = 0) = ((vec_id + 1) % 3 = 0) THEN iou END AS mask_iou FROM full_pairs""",
    "overlap_summary": f"""{_OVERLAP} SELECT count(mask_iou) AS paired_count, round(avg(mask_iou), 6) AS mean_iou,
       round(avg(mask_precision), 6) AS mean_precision, round(avg(mask_recall), 6) AS mean_recall FROM overlap""",
    "tone_fractions": f"""WITH {VECTORS},
g AS (SELECT vec_id, unnest([pixels[41], pixels[42], pixels[43], pixels[49], pixels[50], pixels[51], pixels[57], pixels[58], pixels[59]]) AS p FROM vectors)
SELECT vec_id, round(avg(CASE WHEN p < 110 THEN 1.0 ELSE 0.0 END), 6) AS dark_fraction,
       round(avg(CASE WHEN p > 150 THEN 1.0 ELSE 0.0 END), 6) AS bright_fraction FROM g GROUP BY vec_id""",
    "evaluate": f"""{_EVALUATED}
SELECT item_id, status,
       CASE WHEN status IN ('no_mask', 'restore_provider_error', 'restored') THEN nz / 100 END AS confidence,
       CASE WHEN status LIKE 'mask_provider%' THEN 0.0 ELSE CAST(nz AS DOUBLE) END AS mask_nonzero,
       CASE WHEN status LIKE 'mask_provider%' THEN 0.0 ELSE round(nz / 64, 6) END AS mask_ratio,
       CASE WHEN status = 'restored' THEN CAST(nz AS DOUBLE) ELSE 0.0 END AS changed_nonzero,
       CASE WHEN status = 'restored' THEN round(total / 64, 6) ELSE 0.0 END AS mean_abs_diff
FROM t""",
    "evaluate_statuses": f"{_EVALUATED} SELECT 'vectors' AS dataset_id, status, count(*) AS n FROM t GROUP BY status",
}
