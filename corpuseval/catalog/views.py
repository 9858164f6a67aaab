"""Driver tables seen as evaluation inputs, in Spark and in SQL.

Both sides of each view state the same mapping. ``lineitem`` rows stand for evaluation results,
scan items and boxes; ``events`` for recognised lines and appended results; ``embeddings`` for
8 x 8 pixel arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpuseval.functions.boxes import box
from corpuseval.functions.classify import layout_category, file_stem
from corpuseval.functions.once import compute_once
from corpuseval.metrics import METRICS
from corpuseval.sources.tables import spread_small

POS_COLUMNS = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey"]
POS_DESC = ", ".join(f"{c} DESC" for c in POS_COLUMNS)


SCHEMAS = {
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "benchmark": "item_id long, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = True) -> DataFrame:
    """A driver table by its known schema, so planning a query starts no inference job."""
    rows = spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")
    return spread_small(rows) if spread else rows


def eval_results(spark: SparkSession, sf_dir: str, spread: bool = True) -> DataFrame:
    """Fact rows; only the columns a query uses are read from the file. Without ``spread`` they stay in the file's order."""
    q, price = F.col("l_quantity"), F.col("l_extendedprice")
    discount, tax = F.abs("l_discount"), F.abs("l_tax")
    status = (
        F.when(q <= 4, "no_mask")
        .when(q <= 7, "mask_provider_error")
        .when(q <= 10, "restore_provider_unavailable")
        .when(q <= 20, "masked_only")
        .otherwise("restored")
    )
    has_mask, done, scored = (q <= 4) | (q > 7), q > 10, q > 20
    restore = F.concat(F.lit("p"), (F.col("l_linenumber") % 3).cast("string"))
    run = F.date_format("l_shipdate", "yyyyMM")
    return table(spark, sf_dir, "lineitem", spread).select(
        F.col("l_returnflag").alias("dataset_id"),
        F.col("l_linestatus").alias("mask_provider"),
        restore.alias("restore_provider"),
        run.alias("run_id"),
        F.concat(run, F.lit("/"), "l_returnflag", F.lit("/"), "l_linestatus", F.lit("__"), restore).alias("report_path"),
        F.col("l_partkey").cast("string").alias("item_id"),
        F.concat(F.lit("img/"), F.col("l_partkey").cast("string"), F.lit(".png")).alias("relative_path"),
        status.alias("status"),
        F.when(status == "mask_provider_error", "no engine").otherwise("").alias("note"),
        F.when(has_mask, F.round(1 - discount * 5, 4)).alias("confidence"),
        (q * 8).alias("mask_nonzero"),
        F.round(q / 50, 6).alias("mask_ratio"),
        F.when(done, (F.col("l_orderkey") % 97).cast("double")).otherwise(0.0).alias("changed_nonzero"),
        F.when(done, F.round(discount * 100, 6)).otherwise(0.0).alias("mean_abs_diff"),
        F.when(done, F.round(tax * 100, 6)).otherwise(0.0).alias("edge_delta"),
        F.when(has_mask, F.round(price * q / 10, 6)).alias("mask_latency_ms"),
        F.when(done, F.round(price * 2, 6)).alias("restore_latency_ms"),
        F.when(scored, price).alias("ocr_residual_latency_ms"),
        F.when(scored, F.col("l_linenumber").cast("double")).alias("ocr_residual_hits"),
        F.when(scored, F.round(discount * F.col("l_linenumber"), 6)).alias("ocr_residual_score"),
        F.when(scored, discount).alias("ocr_residual_max_score"),
        F.struct(*POS_COLUMNS).alias("pos"),
    )


EVAL = """
eval_results AS (
  SELECT l_returnflag AS dataset_id, l_linestatus AS mask_provider,
         'p' || (l_linenumber % 3) AS restore_provider,
         strftime(l_shipdate, '%Y%m') AS run_id,
         strftime(l_shipdate, '%Y%m') || '/' || l_returnflag || '/' || l_linestatus || '__p' || (l_linenumber % 3) AS report_path,
         CAST(l_partkey AS VARCHAR) AS item_id, 'img/' || l_partkey || '.png' AS relative_path,
         CASE WHEN l_quantity <= 4 THEN 'no_mask' WHEN l_quantity <= 7 THEN 'mask_provider_error'
              WHEN l_quantity <= 10 THEN 'restore_provider_unavailable'
              WHEN l_quantity <= 20 THEN 'masked_only' ELSE 'restored' END AS status,
         CASE WHEN l_quantity > 4 AND l_quantity <= 7 THEN 'no engine' ELSE '' END AS note,
         CASE WHEN l_quantity <= 4 OR l_quantity > 7 THEN round(1 - abs(l_discount) * 5, 4) END AS confidence,
         l_quantity * 8 AS mask_nonzero, round(l_quantity / 50, 6) AS mask_ratio,
         CASE WHEN l_quantity > 10 THEN CAST(l_orderkey % 97 AS DOUBLE) ELSE 0.0 END AS changed_nonzero,
         CASE WHEN l_quantity > 10 THEN round(abs(l_discount) * 100, 6) ELSE 0.0 END AS mean_abs_diff,
         CASE WHEN l_quantity > 10 THEN round(abs(l_tax) * 100, 6) ELSE 0.0 END AS edge_delta,
         CASE WHEN l_quantity <= 4 OR l_quantity > 7 THEN round(l_extendedprice * l_quantity / 10, 6) END AS mask_latency_ms,
         CASE WHEN l_quantity > 10 THEN round(l_extendedprice * 2, 6) END AS restore_latency_ms,
         CASE WHEN l_quantity > 20 THEN l_extendedprice END AS ocr_residual_latency_ms,
         CASE WHEN l_quantity > 20 THEN CAST(l_linenumber AS DOUBLE) END AS ocr_residual_hits,
         CASE WHEN l_quantity > 20 THEN round(abs(l_discount) * l_linenumber, 6) END AS ocr_residual_score,
         CASE WHEN l_quantity > 20 THEN abs(l_discount) END AS ocr_residual_max_score,
         l_shipdate, l_orderkey, l_linenumber, l_suppkey
  FROM lineitem)"""

POOLED = ", ".join(f"round(avg({m}), 6) AS {m}" for m in METRICS)


def sized_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path and size of one scan item per line: path parts carry every value its size and name depend on."""
    text = {c: F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")}
    stem = (
        F.when(F.col("l_linenumber") == 7, F.concat(text["l_orderkey"], F.lit("-0")))
        .when(F.col("l_linenumber") == 6, F.concat(text["l_orderkey"], F.lit("_Cover")))
        .otherwise(F.concat(text["l_orderkey"], F.lit("x")))
    )
    path = F.concat(
        F.lit("s"), text["l_suppkey"], F.lit("/p"), text["l_partkey"], F.lit("/l"), text["l_linenumber"],
        F.lit("-"), stem, F.lit(".png"),
    )
    return table(spark, sf_dir, "lineitem").select(
        path.alias("relative_path"),
        (F.col("l_partkey") % 400 + 100).cast("int").alias("width"),
        (F.col("l_suppkey") % 400 + 300).cast("int").alias("height"),
    )


def classified_items(sized: DataFrame) -> DataFrame:
    return sized.select(
        F.concat(F.lit("/corpus/"), "relative_path").alias("source_path"), "relative_path", "width", "height",
        layout_category(F.col("width"), F.col("height"), file_stem(F.col("relative_path"))).alias("category"),
    )


def scan_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified_items(sized_items(spark, sf_dir))


SCAN = """
sized AS (
  SELECT 's' || l_suppkey || '/p' || l_partkey || '/l' || l_linenumber || '-' ||
         CASE WHEN l_linenumber = 7 THEN l_orderkey || '-0' WHEN l_linenumber = 6 THEN l_orderkey || '_Cover'
              ELSE l_orderkey || 'x' END || '.png' AS relative_path,
         CAST(l_partkey % 400 + 100 AS INT) AS width, CAST(l_suppkey % 400 + 300 AS INT) AS height,
         l_linenumber
  FROM lineitem),
scan_items AS (
  SELECT '/corpus/' || relative_path AS source_path, relative_path, width, height,
         CASE WHEN width > height THEN 'landscape_regular' WHEN l_linenumber IN (6, 7) THEN 'cover_heavy'
              ELSE 'portrait_regular' END AS category
  FROM sized)"""


def line_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in a 220 x 120 frame, some invalid or reaching over the frame; key is the order."""
    x1 = (F.col("l_partkey") % 180).cast("int")
    y1 = (F.col("l_suppkey") % 100).cast("int")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("item_id"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("pos"),
        F.lit(220).alias("width"),
        F.lit(120).alias("height"),
        F.when(F.col("l_linenumber") % 4 == 0, "bottom_left")
        .when(F.col("l_linenumber") % 4 == 1, "bottom_right")
        .when(F.col("l_linenumber") % 4 == 2, "cover_text")
        .otherwise("")
        .alias("region"),
        box(x1, y1, x1 + F.col("l_quantity").cast("int") - 5, y1 + F.col("l_linenumber") * 4).alias("box"),
    )


BOXES = """
line_boxes AS (
  SELECT l_orderkey AS item_id, 220 AS width, 120 AS height,
         CASE l_linenumber % 4 WHEN 0 THEN 'bottom_left' WHEN 1 THEN 'bottom_right' WHEN 2 THEN 'cover_text' ELSE '' END AS region,
         CAST(l_partkey % 180 AS INT) AS x1, CAST(l_suppkey % 100 AS INT) AS y1,
         CAST(l_partkey % 180 + CAST(l_quantity AS INT) - 5 AS INT) AS x2,
         CAST(l_suppkey % 100 + l_linenumber * 4 AS INT) AS y2,
         l_linenumber, l_partkey, l_suppkey, l_quantity
  FROM lineitem)"""


def event_k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised text lines in 1000 x 800 frames; key is the user."""
    k = F.col("k")
    x = (F.col("event_id") * 37 % 900).cast("int")
    y = (F.col("event_id") * 53 % 290 + 500).cast("int")
    right, low = x + 20 + k, y + 10 + k % 20

    def point(px: Column, py: Column) -> Column:
        return F.struct(px.cast("int").alias("x"), py.cast("int").alias("y"))

    return compute_once(table(spark, sf_dir, "events"), "k", event_k()).select(
        F.col("user_id").alias("item_id"),
        "event_id",
        F.lit(1000).alias("width"),
        F.lit(800).alias("height"),
        F.when(F.col("user_id") % 3 == 0, "landscape_regular")
        .when(F.col("user_id") % 3 == 1, "portrait_regular")
        .otherwise("cover_heavy")
        .alias("category"),
        F.when(k % 4 == 0, "Visit Example .COM")
        .when(k % 4 == 1, F.col("event_type"))
        .when(k % 4 == 2, F.concat(F.lit("Copy Right "), "event_type"))
        .otherwise(F.concat("event_type", F.lit(".net")))
        .alias("text"),
        (k / F.lit(100.0)).alias("score"),
        F.array(point(x, y), point(right, y), point(right, low), point(x, low)).alias("polygon"),
    )


LINES = """
raw_lines AS (
  SELECT user_id AS item_id, event_id, 1000 AS width, 800 AS height,
         CASE user_id % 3 WHEN 0 THEN 'landscape_regular' WHEN 1 THEN 'portrait_regular' ELSE 'cover_heavy' END AS category,
         CASE k % 4 WHEN 0 THEN 'Visit Example .COM' WHEN 1 THEN event_type WHEN 2 THEN 'Copy Right ' || event_type
              ELSE event_type || '.net' END AS text,
         k / 100.0 AS score, event_id * 37 % 900 AS bx, event_id * 53 % 290 + 500 AS ty,
         event_id * 37 % 900 + 20 + k AS bx2, event_id * 53 % 290 + 500 + 10 + k % 20 AS ty2
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)),
placed AS (
  SELECT *, (bx + bx2) / 2.0 AS cx, (ty + ty2) / 2.0 AS cy, lower(replace(text, ' ', '')) AS flat FROM raw_lines),
regioned AS (
  SELECT *, CASE WHEN category = 'cover_heavy' THEN 'cover_text'
     WHEN category = 'landscape_regular' THEN
       CASE WHEN cy >= height * 0.82::DOUBLE AND cx <= width * 0.62::DOUBLE THEN 'bottom_left'
            WHEN cy >= height * 0.80::DOUBLE AND cx >= width * 0.74::DOUBLE THEN 'bottom_right' END
     ELSE CASE WHEN cy >= height * 0.88::DOUBLE AND cx <= width * 0.72::DOUBLE THEN 'bottom_left'
            WHEN cy >= height * 0.84::DOUBLE AND cx >= width * 0.74::DOUBLE THEN 'bottom_right' END END AS region
  FROM placed),
marked AS (
  SELECT *, CASE region WHEN 'bottom_left' THEN 16 WHEN 'bottom_right' THEN 12 ELSE 10 END AS px,
            CASE WHEN region IN ('bottom_left', 'bottom_right') THEN 8 ELSE 6 END AS py
  FROM regioned
  WHERE region IS NOT NULL AND (category = 'cover_heavy' OR
        regexp_matches(flat, 'copyright|allrights|reserved|watermark|\\.com|\\.net|\\.org|\\.cn') OR
        (length(flat) >= 4 AND regexp_matches(flat, 'com|net|org|cn|eu|copyright|issuedby')))),
lines_at AS (
  SELECT *, CAST(greatest(0, greatest(0, bx) - px) AS INT) AS x1, CAST(greatest(0, greatest(0, ty) - py) AS INT) AS y1,
            CAST(least(width, least(width, bx2) + px) AS INT) AS x2, CAST(least(height, least(height, ty2) + py) AS INT) AS y2
  FROM marked),
accepted AS (SELECT * FROM lines_at WHERE score >= 0.45 AND x2 > x1 AND y2 > y1)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 gray pixels 0..255 next to the raw values."""
    pixel = F.transform(
        "embedding",
        lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((v.cast("double") + 0.5) * 255).cast("int"))),
    )
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", pixel.alias("pixels"))


VECTORS = """
vectors AS (
  SELECT vec_id, label, embedding,
         list_transform(embedding, lambda v: greatest(0, least(255, CAST(floor((CAST(v AS DOUBLE) + 0.5) * 255) AS INT)))) AS pixels
  FROM embeddings)"""
