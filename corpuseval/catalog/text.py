"""Mark-text queries over recognised lines, documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuseval.catalog.views import LINES, event_lines, table
from corpuseval.functions.marktext import is_mark_text, retry_score
from corpuseval.functions.sql import register_sql
from corpuseval.operators import geometry, text

CORNER = "bottom_left"


def mark_text(spark, sf):
    """Mark lines of every document, judged as corner text."""
    lines = text.document_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return lines.filter(is_mark_text(F.col("line"), F.lit(CORNER))).select("doc_id", "line_no", "line")


def mark_text_any_region(spark, sf):
    """Mark lines by configured tokens only (no region)."""
    lines = text.document_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return lines.filter(is_mark_text(F.col("line"), F.lit(None).cast("string"))).select("doc_id", "line_no", "line")


def mark_text_sql(spark, sf):
    """``mark_text`` through the registered SQL function."""
    register_sql(spark)
    lines = text.document_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return lines.filter(f"is_mark_text(line, '{CORNER}')").select("doc_id", "line_no", "line")


def flatten_lines_sql(spark, sf):
    """Lines of a recogniser's parallel arrays through the table function."""
    register_sql(spark)
    event_lines(spark, sf).groupBy("event_id").agg(
        F.array(F.max("polygon")).alias("polys"), F.array(F.max("text"), F.lit("cut")).alias("texts"),
        F.array(F.max("score")).alias("scores"),
    ).createOrReplaceTempView("recognised_events")
    return spark.sql(
        "SELECT event_id, l.text, l.score, l.polygon[0].x AS x FROM recognised_events, LATERAL flatten_lines(polys, texts, scores) AS l"
    )


def accept_lines(spark, sf):
    rows = text.accept_lines(event_lines(spark, sf))
    return rows.select(
        "item_id", "event_id", "region", "text", "score",
        *[F.col(f"box.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")],
    )


def _line_items(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("item_id")).distinct()


def line_confidence(spark, sf):
    return text.line_confidence(_line_items(spark, sf), text.accept_lines(event_lines(spark, sf)), "item_id")


def residual_score(spark, sf):
    return text.residual_score(
        _line_items(spark, sf), text.accept_lines(event_lines(spark, sf)), "item_id", F.col("item_id") % 7 != 0
    )


def cascade(spark, sf):
    """Strict lines, then lines by the retry score, then the corner boxes.

    Lines are judged once by the lower score; a strict line serves both stages.
    """
    items = _line_items(spark, sf)
    strict = 0.98
    accepted = text.accept_lines(event_lines(spark, sf), threshold=retry_score(strict))
    stages = F.when(F.col("score") >= strict, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    line_boxes = accepted.select("item_id", F.explode(stages).alias("stage"), "box")
    sized = items.select(
        "item_id", F.lit(1000).alias("width"), F.lit(800).alias("height"),
        F.when(F.col("item_id") % 3 == 0, "landscape_regular").when(F.col("item_id") % 3 == 1, "portrait_regular").otherwise("cover_heavy").alias("category"),
    )
    corners = geometry.roi_boxes(sized).select("item_id", F.lit(2).alias("stage"), F.col("compact_box").alias("box"))
    painted = geometry.covered_pixels(line_boxes.unionByName(corners), ["item_id", "stage"])
    none = items.select("item_id", F.lit(0).alias("stage"), F.lit(0).cast("long").alias("mask_nonzero"))
    rows = painted.unionByName(none).withColumn("source", F.when(F.col("stage") == 2, "boxes").otherwise("lines"))
    picked = text.cascade_rows(rows, "item_id", ["primary", "retry", "fallback"])
    return picked.withColumn("attempts", F.array_join("attempts", ","))


def flatten_lines(spark, sf):
    docs = table(spark, sf, "documents").withColumn("texts", F.split("text", "\n"))
    shaped = docs.select(
        "doc_id",
        F.transform(
            "texts", lambda t, i: F.array(F.struct(i.alias("x"), F.length(t).alias("y")))
        ).alias("polys"),
        "texts",
        F.transform("texts", lambda t: (F.length(t) % 100) / F.lit(100.0)).alias("scores"),
    )
    flat = text.flatten_lines(shaped, "polys", "texts", "scores")
    return flat.select("doc_id", "line_no", "text", "score", F.get("polygon", F.lit(0))["y"].alias("y"))


def _tokens(spark, sf):
    words = F.split("text", " ")
    return table(spark, sf, "benchmark").select(F.get(words, F.lit(0)).alias("token"))


def token_hits(spark, sf):
    lines = text.document_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return text.token_hits(lines, _tokens(spark, sf)).select("doc_id", "line_no", "token")


def token_hits_join(spark, sf):
    """The same with the tokens in several blocks, as for long token tables."""
    lines = text.document_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return text.token_hits(lines, _tokens(spark, sf), block=5).select("doc_id", "line_no", "token")


def _document_hits(spark, sf):
    docs = table(spark, sf, "documents")
    hits = text.document_hits(F.col("text"), F.split("text", "\n"), CORNER)
    return docs.select("doc_id", "source", "lang", hits.alias("hits"))


def mark_audit_docs(spark, sf):
    return text.mark_audit(_document_hits(spark, sf), ["source", "lang"])


def mark_audit_pages(spark, sf):
    pages = table(spark, sf, "pages").select(
        text.page_domain(F.col("url")).alias("domain"),
        text.document_hits(F.col("html"), text.page_runs(F.col("html")), CORNER).alias("hits"),
    )
    return text.mark_audit(pages, "domain")


def text_precision_recall(spark, sf):
    predicted = _document_hits(spark, sf).select("doc_id", (F.col("hits") > 0).alias("is_marked"))
    truth = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 0).alias("is_bad"))
    return text.predicate_quality(predicted, truth, "doc_id", "is_marked", "is_bad")


QUERIES = {
    f.__name__: f
    for f in (
        mark_text, mark_text_any_region, mark_text_sql, flatten_lines_sql, accept_lines, line_confidence, residual_score, cascade,
        flatten_lines, token_hits, token_hits_join, mark_audit_docs, mark_audit_pages,
        text_precision_recall,
    )
}

# --- SQL -----------------------------------------------------------------------------------

_SPACE = r"'[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'"
_TOKENS = r"'copyright|allrights|reserved|watermark|\.com|\.net|\.org|\.cn'"
_WORDS = r"'com|net|org|cn|eu|copyright|issuedby'"


def _flat(column: str) -> str:
    return f"regexp_replace(lower({column}), {_SPACE}, '', 'g')"


_DOC_LINES = f"""split AS (SELECT doc_id, source, lang, string_split(text, chr(10)) AS parts FROM documents),
doc_lines AS (SELECT doc_id, source, lang, CAST(unnest(range(len(parts))) AS INT) AS line_no, unnest(parts) AS line FROM split),
flat_lines AS (SELECT *, {_flat("line")} AS flat FROM doc_lines),
judged AS (SELECT *, regexp_matches(flat, {_TOKENS}) AS by_token,
                  regexp_matches(flat, {_TOKENS}) OR (length(flat) >= 4 AND regexp_matches(flat, {_WORDS})) AS by_corner FROM flat_lines)"""

_AUDIT = """count(*) AS item_count, count(*) FILTER (hits > 0) AS marked_count, CAST(sum(hits) AS BIGINT) AS mark_lines,
       round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 6) AS marked_share"""

_PIXELS = """per_row AS (SELECT DISTINCT item_id, stage, unnest(range(y1, y2)) AS y, x1, x2 FROM stage_boxes),
painted AS (SELECT DISTINCT item_id, stage, y, unnest(range(x1, x2)) AS x FROM per_row),
nonzero AS (SELECT item_id, stage, count(*) AS mask_nonzero FROM painted GROUP BY item_id, stage)"""

_TOKEN_HITS = f"""WITH {_DOC_LINES},
tokens AS (SELECT DISTINCT {_flat("string_split(text, ' ')[1]")} AS token FROM benchmark)
SELECT doc_id, line_no, token FROM flat_lines JOIN tokens ON contains(flat, token) WHERE token <> ''"""

ORACLES = {
    "mark_text": f"WITH {_DOC_LINES} SELECT doc_id, line_no, line FROM judged WHERE by_corner",
    "mark_text_any_region": f"WITH {_DOC_LINES} SELECT doc_id, line_no, line FROM judged WHERE by_token",
    "mark_text_sql": f"WITH {_DOC_LINES} SELECT doc_id, line_no, line FROM judged WHERE by_corner",
    "flatten_lines_sql": f"WITH {LINES} SELECT event_id, text, score, CAST(bx AS INT) AS x FROM raw_lines",
    "accept_lines": f"WITH {LINES} SELECT item_id, event_id, region, text, score, x1, y1, x2, y2 FROM accepted",
    "line_confidence": f"""WITH {LINES},
a AS (SELECT item_id, count(*) AS n, avg(score) AS m FROM accepted GROUP BY item_id)
SELECT item_id, coalesce(n, 0) AS accepted_lines, round(coalesce(m, 0.0), 6) AS confidence
FROM (SELECT DISTINCT user_id AS item_id FROM events) LEFT JOIN a USING (item_id)""",
    "residual_score": f"""WITH {LINES},
a AS (SELECT item_id, count(*) AS n, round(sum(round(score, 4)), 6) AS s, round(max(round(score, 4)), 6) AS m FROM accepted GROUP BY item_id)
SELECT item_id, CASE WHEN item_id % 7 <> 0 THEN coalesce(n, 0) END AS ocr_residual_hits,
       CASE WHEN item_id % 7 <> 0 THEN coalesce(s, 0.0) END AS ocr_residual_score,
       CASE WHEN item_id % 7 <> 0 THEN coalesce(m, 0.0) END AS ocr_residual_max_score
FROM (SELECT DISTINCT user_id AS item_id FROM events) LEFT JOIN a USING (item_id)""",
    "cascade": f"""WITH {LINES},
items AS (SELECT DISTINCT user_id AS item_id FROM events),
corners(kind, x1, y1, x2, y2) AS (VALUES (0, 0, 745, 560, 796), (0, 617, 706, 991, 778), (1, 0, 772, 595, 799), (1, 617, 755, 991, 792)),
stage_boxes AS (
  SELECT item_id, 0 AS stage, x1, y1, x2, y2 FROM lines_at WHERE score >= 0.98 AND x2 > x1 AND y2 > y1
  UNION ALL SELECT item_id, 1, x1, y1, x2, y2 FROM lines_at WHERE score >= 0.35 AND x2 > x1 AND y2 > y1
  UNION ALL SELECT item_id, 2, x1, y1, x2, y2 FROM items JOIN corners ON kind = item_id % 3),
{_PIXELS},
best AS (SELECT item_id, min(stage) AS stage FROM nonzero GROUP BY item_id)
SELECT i.item_id, coalesce(n.mask_nonzero, 0) AS mask_nonzero,
       CASE WHEN b.stage = 2 THEN 'boxes' ELSE 'lines' END AS source,
       CASE coalesce(b.stage, 0) WHEN 0 THEN 'primary' WHEN 1 THEN 'retry' ELSE 'fallback' END AS strategy,
       CASE b.stage WHEN 0 THEN 'primary' WHEN 1 THEN 'primary,retry' ELSE 'primary,retry,fallback' END AS attempts
FROM items i LEFT JOIN best b USING (item_id) LEFT JOIN nonzero n ON n.item_id = i.item_id AND n.stage = b.stage""",
    "flatten_lines": """WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
u AS (SELECT doc_id, CAST(unnest(range(len(parts))) AS INT) AS line_no, unnest(parts) AS text FROM s)
SELECT doc_id, line_no, text, (length(text) % 100) / 100.0::DOUBLE AS score, CAST(length(text) AS INT) AS y FROM u""",
    "token_hits": _TOKEN_HITS,
    "token_hits_join": _TOKEN_HITS,
    "mark_audit_docs": f"""WITH {_DOC_LINES},
d AS (SELECT doc_id, source, lang, count(*) FILTER (by_corner) AS hits FROM judged GROUP BY doc_id, source, lang)
SELECT source, lang, {_AUDIT} FROM d GROUP BY source, lang""",
    "mark_audit_pages": f"""WITH v AS (
  SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)) AS domain,
         string_split_regex(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>', '', 'g'), '<[^>]*>') AS runs FROM pages),
u AS (SELECT page_id, unnest(runs) AS run FROM v),
h AS (SELECT page_id, count(*) FILTER (regexp_matches(flat, {_TOKENS}) OR (length(flat) >= 4 AND regexp_matches(flat, {_WORDS}))) AS hits
      FROM (SELECT page_id, {_flat("run")} AS flat FROM u) GROUP BY page_id),
d AS (SELECT domain, coalesce(hits, 0) AS hits FROM v LEFT JOIN h USING (page_id))
SELECT domain, {_AUDIT} FROM d GROUP BY domain""",
    "text_precision_recall": f"""WITH {_DOC_LINES},
d AS (SELECT doc_id, bool_or(by_corner) AS p FROM judged GROUP BY doc_id),
c AS (SELECT count(*) AS labelled_count, count(*) FILTER (p AND quality = 0) AS shared_count,
             count(*) FILTER (quality = 0) AS actual_count, count(*) FILTER (p) AS predicted_count FROM d JOIN labels USING (doc_id))
SELECT *, round(shared_count / greatest(1, actual_count + predicted_count - shared_count), 6) AS iou,
       round(shared_count / greatest(1, predicted_count), 6) AS precision, round(shared_count / greatest(1, actual_count), 6) AS recall FROM c""",
}
