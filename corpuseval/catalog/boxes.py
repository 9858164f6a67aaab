"""Box geometry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuseval.catalog.views import BOXES, line_boxes, table
from corpuseval.functions import boxes as fb
from corpuseval.functions.marktext import text_region
from corpuseval.operators import geometry


def _xy(column: str, prefix: str = ""):
    return [F.col(f"{column}.{c}").alias(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")]


def box_region(spark, sf):
    category = F.when(F.col("l_returnflag") == "A", "landscape_regular").when(
        F.col("l_returnflag") == "N", "portrait_regular"
    ).otherwise("cover_heavy")
    cx, cy = F.col("l_partkey") % 1000, F.col("l_suppkey") * 8
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber",
        text_region(cx, cy, F.lit(1000), F.lit(800), category).alias("region"),
    )


def pad_boxes(spark, sf):
    rows = line_boxes(spark, sf)
    padded = fb.pad_box(F.col("box"), F.col("width"), F.col("height"), F.col("region"))
    roi = fb.pad_box(F.col("box"), F.col("width"), F.col("height"), F.col("region"), kind="roi")
    return rows.withColumn("t", padded).withColumn("r", roi).select(
        "item_id", "region", F.col("pos.l_partkey").alias("part"), F.col("pos.l_linenumber").alias("line"),
        *_xy("t"), *_xy("r", "roi_"),
    )


def roi_boxes(spark, sf):
    items = table(spark, sf, "part").select(
        F.col("p_partkey").alias("item_id"),
        (F.col("p_partkey") % 700 + 80).cast("int").alias("width"),
        (F.col("p_size") * 20 + 60).alias("height"),
    ).withColumn(
        "category", F.when(F.col("width") > F.col("height"), "landscape_regular").otherwise("portrait_regular")
    )
    return geometry.roi_boxes(items).select(
        "item_id", "region", *_xy("search_box"), *_xy("fallback_box", "f"), *_xy("compact_box", "c")
    )


def _fallback_candidates(spark, sf):
    """Every line gets its region's fallback box, moved by one pixel on even lines."""
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber",
        (F.col("l_partkey") % 700 + 80).cast("int").alias("width"),
        (F.col("l_suppkey") * 5 + 60).cast("int").alias("height"),
    ).withColumn("category", F.when(F.col("width") > F.col("height"), "landscape_regular").otherwise("portrait_regular"))
    boxed = geometry.roi_boxes(rows)
    moved = F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(0)
    return boxed.select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber").alias("item_id"), "width", "height", "category", "region",
        fb.box(
            F.col("fallback_box.x1") + moved, F.col("fallback_box.y1"), F.col("fallback_box.x2"), F.col("fallback_box.y2")
        ).alias("box"),
    )


def compact_boxes(spark, sf):
    made, _ = geometry.compact_boxes(_fallback_candidates(spark, sf), "item_id")
    return made.select("item_id", "region", *_xy("box"), "compacted")


def compacted_regions(spark, sf):
    _, regions = geometry.compact_boxes(_fallback_candidates(spark, sf), "item_id")
    return regions.groupBy("region").agg(F.count(F.lit(1)).alias("n"))


def rescale_boxes(spark, sf):
    scale = F.lit(0.4)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber",
        fb.rescale(F.col("l_partkey").cast("double"), scale).alias("x"),
        fb.rescale(F.col("l_suppkey").cast("double"), scale, F.lit(98)).alias("y"),
    )


def bbox_union(spark, sf):
    return geometry.bbox_union(line_boxes(spark, sf), "item_id", padding=3)


def box_regions(spark, sf):
    regions = geometry.box_regions(line_boxes(spark, sf), "item_id", "pos")
    return regions.select("item_id", F.array_join("regions", ",").alias("regions"))


def covered_pixels(spark, sf):
    rows = line_boxes(spark, sf)
    clamped = rows.withColumn("box", fb.clamp_box(F.col("box"), F.col("width"), F.col("height")))
    return geometry.covered_pixels(clamped, "item_id")


def _impact(spark, sf, **options):
    rows = geometry.bbox_union(line_boxes(spark, sf), "item_id")
    b = F.struct("x1", "y1", "x2", "y2")
    impact = fb.edge_impact(b, F.lit(220), F.lit(120), **options)
    return rows.withColumn("impact", impact).select(
        "item_id", *[F.col(f"impact.{c}").alias(c) for c in ("edge", "removed", "kept_width", "kept_height", "removed_ratio")]
    )


def edge_impact(spark, sf):
    return _impact(spark, sf)


def edge_impact_limits(spark, sf):
    return _impact(spark, sf, tolerance=24, min_width=60, min_height=50)


QUERIES = {
    f.__name__: f
    for f in (
        box_region, pad_boxes, roi_boxes, compact_boxes, compacted_regions, rescale_boxes,
        bbox_union, box_regions, covered_pixels, edge_impact, edge_impact_limits,
    )
}

# --- SQL -----------------------------------------------------------------------------------

_SPECS = """specs(category, region, s1, s2, s3, s4, f1, f2, f3, f4, c1, c2, c3, c4) AS (VALUES
  ('portrait_regular', 'bottom_left', 0.00::DOUBLE, 0.94::DOUBLE, 0.70::DOUBLE, 1.00::DOUBLE, 0.00::DOUBLE, 0.952::DOUBLE, 0.68::DOUBLE, 1.00::DOUBLE, 0.00::DOUBLE, 0.965::DOUBLE, 0.595::DOUBLE, 0.999::DOUBLE),
  ('portrait_regular', 'bottom_right', 0.77, 0.90, 1.00, 1.00, 0.77, 0.92, 1.00, 1.00, 0.617, 0.944, 0.991, 0.99),
  ('landscape_regular', 'bottom_left', 0.00, 0.905, 0.58, 1.00, 0.00, 0.915, 0.52, 1.00, 0.00, 0.932, 0.56, 0.995),
  ('landscape_regular', 'bottom_right', 0.76, 0.88, 1.00, 1.00, 0.76, 0.89, 1.00, 1.00, 0.617, 0.883, 0.991, 0.973))"""


def _px(prefix: str) -> list[str]:
    return [f"CAST(trunc({'width' if i % 2 else 'height'} * {prefix}{i}) AS INT)" for i in (1, 2, 3, 4)]


_FALLBACK = f"""WITH {_SPECS},
sized AS (SELECT l_orderkey || '-' || l_partkey || '-' || l_linenumber AS item_id, l_linenumber,
                 CAST(l_partkey % 700 + 80 AS INT) AS width, CAST(l_suppkey * 5 + 60 AS INT) AS height FROM lineitem),
placed AS (SELECT s.item_id, s.l_linenumber, p.region, {", ".join(f"{e} AS f{i}x" for i, e in enumerate(_px("f")))},
                  {", ".join(f"{e} AS c{i}x" for i, e in enumerate(_px("c")))}
           FROM sized s JOIN specs p ON p.category = CASE WHEN width > height THEN 'landscape_regular' ELSE 'portrait_regular' END)"""


def _edge(tolerance: str, min_w: int, min_h: int) -> str:
    return f"""WITH {BOXES},
u AS (SELECT item_id, greatest(0, min(x1)) AS x1, greatest(0, min(y1)) AS y1, least(220, max(x2)) AS x2, least(120, max(y2)) AS y2
      FROM line_boxes WHERE x2 > x1 AND y2 > y1 GROUP BY item_id),
e AS (SELECT item_id, 'left' AS edge, 0 AS ord, x1 AS d, 220 - x2 AS kw, 120 AS kh FROM u
      UNION ALL SELECT item_id, 'right', 1, greatest(0, 220 - x2), x1, 120 FROM u
      UNION ALL SELECT item_id, 'top', 2, y1, 220, 120 - y2 FROM u
      UNION ALL SELECT item_id, 'bottom', 3, greatest(0, 120 - y2), 220, y1 FROM u),
near AS (SELECT *, min(d) OVER (PARTITION BY item_id) AS least_d, row_number() OVER (PARTITION BY item_id ORDER BY d, ord) AS nearest FROM e),
best AS (
  SELECT * FROM near WHERE (d <= {tolerance} OR (least_d > {tolerance} AND nearest = 1)) AND kw >= {min_w} AND kh >= {min_h}
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY 220 * 120 - kw * kh, ord) = 1)
SELECT u.item_id, edge, CAST(220 * 120 - kw * kh AS BIGINT) AS removed, kw AS kept_width, kh AS kept_height,
       round((220 * 120 - kw * kh) / (220 * 120), 6) AS removed_ratio
FROM u LEFT JOIN best USING (item_id)"""


ORACLES = {
    "box_region": """SELECT l_orderkey, l_partkey, l_linenumber,
  CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'cover_text'
       WHEN l_returnflag = 'A' THEN CASE WHEN cy >= 656 AND cx <= 620 THEN 'bottom_left' WHEN cy >= 640 AND cx >= 740 THEN 'bottom_right' END
       ELSE CASE WHEN cy >= 704 AND cx <= 720 THEN 'bottom_left' WHEN cy >= 672 AND cx >= 740 THEN 'bottom_right' END END AS region
FROM (SELECT *, l_partkey % 1000 AS cx, l_suppkey * 8 AS cy FROM lineitem)""",
    "pad_boxes": f"""WITH {BOXES},
p AS (SELECT *, CASE region WHEN 'bottom_left' THEN 16 WHEN 'bottom_right' THEN 12 ELSE 10 END AS px,
             CASE WHEN region IN ('bottom_left', 'bottom_right') THEN 8 ELSE 6 END AS py,
             CASE region WHEN 'bottom_left' THEN 12 ELSE 8 END AS rx FROM line_boxes)
SELECT item_id, region, l_partkey AS part, l_linenumber AS line,
       greatest(0, x1 - px) AS x1, greatest(0, y1 - py) AS y1, least(width, x2 + px) AS x2, least(height, y2 + py) AS y2,
       greatest(0, x1 - rx) AS roi_x1, greatest(0, y1 - 6) AS roi_y1, least(width, x2 + rx) AS roi_x2, least(height, y2 + 6) AS roi_y2
FROM p""",
    "roi_boxes": f"""WITH {_SPECS},
sized AS (SELECT p_partkey AS item_id, CAST(p_partkey % 700 + 80 AS INT) AS width, p_size * 20 + 60 AS height FROM part)
SELECT item_id, region, {", ".join(f"{e} AS {n}" for e, n in zip(_px("s"), ("x1", "y1", "x2", "y2")))},
       {", ".join(f"{e} AS f{n}" for e, n in zip(_px("f"), ("x1", "y1", "x2", "y2")))},
       {", ".join(f"{e} AS c{n}" for e, n in zip(_px("c"), ("x1", "y1", "x2", "y2")))}
FROM sized JOIN specs ON category = CASE WHEN width > height THEN 'landscape_regular' ELSE 'portrait_regular' END""",
    "compact_boxes": f"""{_FALLBACK}
SELECT item_id, region, {", ".join(f"CASE WHEN l_linenumber % 2 = 1 THEN c{i}x ELSE f{i}x{' + 1' if i == 0 else ''} END AS {n}" for i, n in enumerate(("x1", "y1", "x2", "y2")))},
       l_linenumber % 2 = 1 AS compacted FROM placed""",
    "compacted_regions": f"""{_FALLBACK}
SELECT region, count(*) AS n FROM (SELECT DISTINCT item_id, region FROM placed WHERE l_linenumber % 2 = 1) GROUP BY region""",
    "rescale_boxes": """SELECT l_orderkey, l_partkey, l_linenumber, CAST(round_even(l_partkey * 0.4::DOUBLE, 0) AS INT) AS x,
       CAST(round_even(l_suppkey * 0.4::DOUBLE, 0) AS INT) + 98 AS y FROM lineitem""",
    "bbox_union": f"""WITH {BOXES}
SELECT item_id, greatest(0, min(x1) - 3) AS x1, greatest(0, min(y1) - 3) AS y1, least(220, max(x2) + 3) AS x2,
       least(120, max(y2) + 3) AS y2, count(*) AS box_count
FROM line_boxes WHERE x2 > x1 AND y2 > y1 GROUP BY item_id""",
    "box_regions": f"""WITH {BOXES},
f AS (SELECT item_id, region, row_number() OVER (PARTITION BY item_id, region ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS rn,
             l_linenumber, l_partkey, l_suppkey, l_quantity FROM line_boxes WHERE x2 > x1 AND y2 > y1 AND region <> '')
SELECT item_id, string_agg(region, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS regions FROM f WHERE rn = 1 GROUP BY item_id""",
    "covered_pixels": f"""WITH {BOXES},
c AS (SELECT item_id, x1, y1, least(220, x2) AS x2, least(120, y2) AS y2 FROM line_boxes),
v AS (SELECT DISTINCT * FROM c WHERE x2 > x1 AND y2 > y1),
r AS (SELECT item_id, x1, x2, unnest(range(y1, y2)) AS y FROM v),
p AS (SELECT DISTINCT item_id, y, unnest(range(x1, x2)) AS x FROM r)
SELECT item_id, count(*) AS mask_nonzero FROM p GROUP BY item_id""",
    "edge_impact": _edge("10", 1, 1),
    "edge_impact_limits": _edge("24", 60, 50),
}
