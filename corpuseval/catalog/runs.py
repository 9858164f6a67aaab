"""Scan, dataset, plan, batch and bookkeeping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuseval.catalog.views import EVAL, SCAN, classified_items, eval_results, event_k, scan_items, sized_items, table
from corpuseval.functions.classify import file_stem, name_hint
from corpuseval.operators import keyed, profiles, runs, validate
from corpuseval.operators.aggregate import category_counts as count_categories
from corpuseval.plans import batch, scan
from corpuseval.session import scratch_dir
from corpuseval.sources import reports
from corpuseval.sources.corpus import select_images

PROMPTS = {"cover_heavy": "dense cover text", "landscape_regular": "corner text", "portrait_regular": "corner text"}


def layout_category(spark, sf):
    return scan_items(spark, sf).select("relative_path", "width", "height", "category")


def page_name_hint(spark, sf):
    path = F.regexp_replace("url", r"[?#].*$", "")
    stem = file_stem(path)
    return table(spark, sf, "pages").select("page_id", stem.alias("stem"), name_hint(stem).alias("hinted"))


def corpus_rules(spark, sf):
    """Listing rules over page paths: suffix and excluded folders."""
    suffix = F.element_at(F.array(*[F.lit(s) for s in (".JPG", ".png", ".txt", ".webp", ".docx")]), (F.col("page_id") % 5 + 1).cast("int"))
    folder = F.element_at(F.array(*[F.lit(s) for s in ("a", "docs", "b/.git", "c/d")]), (F.col("page_id") % 4 + 1).cast("int"))
    files = table(spark, sf, "pages").select(
        F.concat_ws("/", folder, F.concat(F.col("page_id").cast("string"), suffix)).alias("relative_path")
    )
    return select_images(files)


def numbered_results(spark, sf):
    """Result lines written out by return flag, every 50th spoilt in one of three ways, read back with their places.

    A flag's lines lie in one file for each range of keys, so that no task sorts a whole flag.
    """
    flag, key = F.col("l_returnflag"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")
    k = F.col("l_orderkey") % 150
    good = F.to_json(F.struct(F.struct(key.alias("relative_path")).alias("item"), F.col("l_linestatus").alias("status")))
    line = F.when(k == 0, F.concat(F.lit("{bad "), key)).when(k == 50, F.lit("[1]")).when(k == 100, F.lit(" ")).otherwise(good)
    root = f"{scratch_dir(spark)}/lines"
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, sf, "lineitem").select(flag.alias("flag"), line.alias("value"), *order)
    rows.repartitionByRange("flag", *order).sortWithinPartitions("flag", *order).select("flag", "value").write.partitionBy("flag").text(root)
    found, bad = reports.read_results_jsonl(spark, f"{root}/*/*", mode="PERMISSIVE", by_folder=True)
    flag_of = F.regexp_extract("source_file", "flag=([A-Z])", 1)
    both = found.select("source_file", "line_no", F.col("item.relative_path").alias("relative_path"), F.lit(None).cast("string").alias("line"))
    both = both.unionByName(bad.select("source_file", "line_no", F.lit(None).cast("string").alias("relative_path"), "line"))
    return both.select(flag_of.alias("flag"), "line_no", "relative_path", "line")


def category_counts(spark, sf):
    return count_categories(scan_items(spark, sf))


def scan_summary(spark, sf):
    return scan.scan_summary(scan_items(spark, sf))


def scan_limit(spark, sf):
    """The first 20000 paths: beyond the top-k size, so numbered by slices."""
    return keyed.first_n(scan_items(spark, sf), ["relative_path", "width"], 20_000).select("relative_path", "category")


def sequence_ids(spark, sf):
    routed = scan.route_items(scan_items(spark, sf)).select("dataset_id", "relative_path")
    return scan.sequence_ids(routed).select("dataset_id", "item_id", "relative_path")


def prepare_dataset(spark, sf):
    """What is derived from path and size is added to the distinct rows, which lie dealt by path, as do the seeds."""
    sized = sized_items(spark, sf).repartition("relative_path").distinct()
    seeds = sized.select(
        "relative_path",
        (F.col("width") * 3).cast("long").alias("seed_mask_nonzero"),
        (F.col("height") / F.lit(1000.0)).alias("seed_confidence"),
    )
    return scan.prepare_dataset(classified_items(sized), seeds, PROMPTS)


def eval_items_selected(spark, sf):
    items = scan.route_items(scan_items(spark, sf))
    return scan.select_items(items, "all", 300, "relative_path").select("dataset_id", "relative_path")


def eval_items_large(spark, sf):
    """A per-dataset limit beyond the group-limit pushdown, numbered by slices."""
    items = scan.route_items(scan_items(spark, sf))
    return scan.select_items(items, "all", 5000, "relative_path").select("dataset_id", "relative_path")


def derive_status(spark, sf):
    n = F.col("l_linenumber")
    lines = table(spark, sf, "lineitem")
    nonzero = F.when(F.col("l_quantity") > 5, F.col("l_quantity").cast("int")).otherwise(0)
    category = F.when(F.col("l_returnflag") == "A", "cover_heavy").otherwise("portrait_regular")
    custom = F.when(F.col("l_linestatus") == "O", "cropped").otherwise("")
    mask_failure = F.when(n == 1, "unavailable").when(n == 2, "error")
    restore_failure = F.when(n == 3, "unavailable").when(n == 4, "error")
    restorer = F.when(n == 5, "noop").otherwise("fill")
    return lines.select(
        "l_orderkey", "l_partkey", "l_linenumber",
        runs.batch_status(n == 7, category, nonzero, custom).alias("batch_status"),
        runs.eval_status(mask_failure, nonzero, restore_failure, restorer, custom).alias("eval_status"),
    )


def pending_items(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("item_key"), "o_orderstatus")
    done = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item_key"))
    return runs.pending_items(orders, done, "item_key")


def _run_tables(spark, sf):
    """Runs are order customers; a declared count per run, and finished lines as results."""
    orders = table(spark, sf, "orders")
    totals = orders.groupBy(F.col("o_custkey").alias("run_id")).agg((F.count(F.lit(1)) * 4).alias("image_count"))
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", F.when(F.col("l_quantity") > 10, "restored").otherwise("no_mask").alias("status")
    )
    results = orders.select("o_orderkey", F.col("o_custkey").alias("run_id")).join(
        lines, F.col("o_orderkey") == F.col("l_orderkey")
    )
    return totals, results.select("run_id", "status")


def run_progress(spark, sf):
    return runs.run_progress(*_run_tables(spark, sf))


def run_summary(spark, sf):
    return runs.run_summary(*_run_tables(spark, sf))


def resume_counts(spark, sf):
    key = F.col("l_orderkey").alias("item_key")
    lines = table(spark, sf, "lineitem")
    manifest = table(spark, sf, "orders").select(F.col("o_orderkey").alias("item_key"))
    return runs.resume_counts(
        manifest, lines.filter("l_returnflag = 'A'").select(key), lines.select(key), "item_key"
    )


def run_lookup(spark, sf):
    rows = eval_results(spark, sf)
    per_run = rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("item_count"), F.count_if(F.col("status") == "restored").alias("restored_count")
    )
    return runs.run_lookup(per_run, latest=True)


def reconcile(spark, sf):
    events = table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), "event_id", F.col("event_type").alias("status")
    )
    return runs.reconcile_results(events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1"))


def last_wins(spark, sf):
    events = table(spark, sf, "events").select(
        F.concat(F.lit("u"), (F.col("user_id")).cast("string")).alias("item_id"),
        F.col("event_type").alias("status"), F.round("value", 2).alias("value"), "event_id",
    )
    return keyed.last_wins(events, "item_id", "event_id")


def ordered_distinct(spark, sf):
    words = table(spark, sf, "conversations").select(
        "role", F.posexplode(F.split("text", " ")).alias("at", "word"),
        (F.col("conv_id") * 1_000_000_000 + F.col("turn") * 1_000_000).alias("base"),
    )
    placed = words.select("role", "word", (F.col("base") + F.col("at")).alias("pos"))
    return keyed.ordered_distinct(placed, "word", "pos", "role")


def json_props(spark, sf):
    return table(spark, sf, "events").groupBy(event_k().alias("k")).agg(F.count(F.lit(1)).alias("n"))


def _raw_items(spark, sf):
    k = event_k()
    return table(spark, sf, "events").select(
        "event_id",
        F.when(k % 10 != 1, F.concat(F.lit("/in/"), F.col("event_id").cast("string"))).alias("source_path"),
        F.when(k % 10 == 2, "").otherwise(F.col("event_id").cast("string")).alias("relative_path"),
        F.expr("try_cast(case when event_id % 11 = 3 then 'wide' else cast(user_id as string) end as int)").alias("width"),
        F.when(k % 7 != 4, F.col("user_id").cast("int")).alias("height"),
        F.when(k % 13 == 5, "").otherwise(F.col("event_type")).alias("category"),
    )


def validate_items(spark, sf):
    return validate.check_items(_raw_items(spark, sf)).select("event_id", "reject_reason")


def count_mismatch(spark, sf):
    declared = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("manifest_key"), (F.col("o_custkey") % 8).alias("item_count")
    )
    loaded = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("manifest_key"))
    return validate.count_mismatch(declared, loaded, "manifest_key")


def unknown_names(spark, sf):
    requests = table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("NATION_"), (F.col("user_id") % 30).cast("string")).alias("n_name")
    )
    return validate.unknown_names(requests, table(spark, sf, "nation"), "n_name")


def plan_counts(spark, sf):
    """A plan's header: settings, item count and category counts."""
    header, _ = batch.plan(scan_items(spark, sf), "plan-1", {"mask_provider": "rule_based_roi", "restore_provider": "noop"})
    return header.withColumn("category_counts", F.to_json("category_counts"))


def plan_count_check(spark, sf):
    """Plans whose stored items differ in number from the header: one plan per supplier group."""
    items = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 50).alias("plan_id"), "l_quantity")
    headers = items.groupBy("plan_id").agg(F.count_if(F.col("l_quantity") < 51).alias("item_count")).withColumn(
        "item_count", F.when(F.col("plan_id") % 5 == 0, F.col("item_count") + 1).otherwise(F.col("item_count"))
    )
    _, warnings = batch.apply_plan(headers, items)
    return warnings


def _profile_inputs(spark, sf):
    events = table(spark, sf, "events")
    u = F.col("user_id") % 30
    name = (
        F.when(F.col("event_id") % 9 == 0, F.lit(None).cast("string"))
        .when(F.col("event_id") % 3 == 0, F.concat(F.lit("  nation_"), u.cast("string"), F.lit(" ")))
        .otherwise(F.concat(F.lit("NATION_"), u.cast("string")))
    )
    requests = events.select(
        "event_id", name.alias("profile"),
        F.when(F.col("event_id") % 4 == 0, F.col("event_type")).alias("mask_provider"),
        F.lit(None).cast("string").alias("restore_provider"),
    )
    known = table(spark, sf, "nation").select(
        F.col("n_name").alias("profile"),
        F.concat(F.lit("mask"), F.col("n_regionkey").cast("string")).alias("mask_provider"),
        F.when(F.col("n_nationkey") % 3 != 0, F.concat(F.lit("fill"), F.col("n_nationkey").cast("string"))).alias("restore_provider"),
    )
    return requests, known


PROFILE_DEFAULTS = {"mask_provider": "rule_based_roi", "restore_provider": "noop"}


def resolve_profile(spark, sf):
    resolved, _ = profiles.resolve_profiles(*_profile_inputs(spark, sf), PROFILE_DEFAULTS)
    return resolved.select("event_id", "mask_provider", "restore_provider")


def profile_rejects(spark, sf):
    _, rejects = profiles.resolve_profiles(*_profile_inputs(spark, sf), PROFILE_DEFAULTS)
    return rejects.select("event_id", "profile")


def keyword_tokens(spark, sf):
    words = table(spark, sf, "conversations").select(
        F.col("role").alias("preset"), "conv_id", "turn", F.posexplode(F.split("text", r"\.")).alias("at", "token")
    )
    tokens = profiles.keyword_tokens(words, ["User", " assistant "], ["Acme Studio"], order=["conv_id", "turn", "at"])
    return tokens.select(
        "token", F.col("first_pos.source").alias("source"),
        F.col("first_pos.at.p0").alias("conv_id"), F.col("first_pos.at.p1").alias("turn"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        layout_category, page_name_hint, corpus_rules, numbered_results, category_counts, scan_summary, scan_limit,
        sequence_ids, prepare_dataset, eval_items_selected, eval_items_large, derive_status,
        pending_items, run_progress, run_summary, resume_counts, run_lookup, reconcile, last_wins,
        ordered_distinct, json_props, validate_items, count_mismatch, unknown_names, plan_counts, plan_count_check,
        resolve_profile, profile_rejects, keyword_tokens,
    )
}

# --- SQL -----------------------------------------------------------------------------------

_ROUTED = f"""WITH {SCAN},
routed AS (SELECT *, CASE WHEN category = 'cover_heavy' THEN 'cover_heavy' ELSE 'regular_corner_text' END AS dataset_id FROM scan_items)"""
_PREFIX = "CASE WHEN dataset_id = 'cover_heavy' THEN 'cover' ELSE 'regular' END"
_NUMBERED = f"{_PREFIX} || '-' || CASE WHEN rn < 10000 THEN lpad(CAST(rn AS VARCHAR), 4, '0') ELSE CAST(rn AS VARCHAR) END"

_RUNS = """WITH totals AS (SELECT o_custkey AS run_id, count(*) * 4 AS image_count FROM orders GROUP BY 1),
results AS (SELECT o_custkey AS run_id, CASE WHEN l_quantity > 10 THEN 'restored' ELSE 'no_mask' END AS status
            FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
done AS (SELECT run_id, count(*) AS n FROM results GROUP BY 1),
progress AS (SELECT run_id, image_count, coalesce(n, 0) AS completed_item_count,
                    greatest(0, image_count - coalesce(n, 0)) AS pending_item_count
             FROM totals LEFT JOIN done USING (run_id))"""

_PROFILES = """WITH requests AS (
  SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 3 = 0 THEN '  nation_' || (user_id % 30) || ' '
         ELSE 'NATION_' || (user_id % 30) END AS profile,
         CASE WHEN event_id % 4 = 0 THEN event_type END AS mask_provider FROM events),
known AS (SELECT lower(n_name) AS name, 'mask' || n_regionkey AS pm, CASE WHEN n_nationkey % 3 <> 0 THEN 'fill' || n_nationkey END AS pr FROM nation),
joined AS (SELECT r.*, k.name, pm, pr FROM requests r LEFT JOIN known k ON trim(lower(r.profile)) = k.name)"""

_SPACES = r"'[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'"

ORACLES = {
    "layout_category": f"WITH {SCAN} SELECT relative_path, width, height, category FROM scan_items",
    "page_name_hint": r"""WITH s AS (
  SELECT page_id, regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]*$'), '^(.+)\.[^.]+$', '\1') AS stem FROM pages)
SELECT page_id, stem, regexp_matches(stem, '(?i)(?:^|[-_])(0|cover|封面)$') AS hinted FROM s""",
    "corpus_rules": """WITH f AS (
  SELECT ['a', 'docs', 'b/.git', 'c/d'][page_id % 4 + 1] || '/' || page_id || ['.JPG', '.png', '.txt', '.webp', '.docx'][page_id % 5 + 1] AS relative_path,
         page_id FROM pages)
SELECT relative_path FROM f WHERE page_id % 4 NOT IN (1, 2) AND page_id % 5 IN (0, 1, 3)""",
    "category_counts": f"WITH {SCAN} SELECT category, count(*) AS n FROM scan_items GROUP BY category",
    "scan_summary": f"WITH {SCAN} SELECT coalesce(category, 'all') AS category, count(*) AS n FROM scan_items GROUP BY ROLLUP (category)",
    "numbered_results": """WITH n AS (
  SELECT l_returnflag AS flag, l_orderkey % 150 AS k, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS id,
         row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS line_no FROM lineitem)
SELECT flag, line_no, CASE WHEN k NOT IN (0, 50) THEN id END AS relative_path,
       CASE k WHEN 0 THEN '{bad ' || id WHEN 50 THEN '[1]' END AS line FROM n WHERE k <> 100""",
    "scan_limit": f"WITH {SCAN} SELECT relative_path, category FROM scan_items ORDER BY relative_path LIMIT 20000",
    "sequence_ids": f"""{_ROUTED},
numbered AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY relative_path) AS rn FROM routed)
SELECT dataset_id, {_NUMBERED} AS item_id, relative_path FROM numbered""",
    "prepare_dataset": f"""{_ROUTED},
numbered AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY relative_path) AS rn FROM (SELECT DISTINCT * FROM routed))
SELECT {_NUMBERED} AS item_id, dataset_id, source_path, relative_path, width, height, category AS source_category,
       dataset_id AS benchmark_category, CASE WHEN category = 'cover_heavy' THEN 'dense cover text' ELSE 'corner text' END AS prompt,
       CAST(CASE WHEN dataset_id = 'regular_corner_text' THEN width * 3 ELSE 0 END AS BIGINT) AS seed_mask_nonzero,
       round(CASE WHEN dataset_id = 'regular_corner_text' THEN CAST(height AS DOUBLE) / 1000 ELSE 0.0 END, 4) AS seed_confidence
FROM numbered""",
    "eval_items_selected": f"""{_ROUTED} SELECT dataset_id, relative_path FROM routed
QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY relative_path) <= 300""",
    "eval_items_large": f"""{_ROUTED} SELECT dataset_id, relative_path FROM routed
QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY relative_path) <= 5000""",
    "derive_status": """SELECT l_orderkey, l_partkey, l_linenumber,
  CASE WHEN l_linenumber = 7 THEN 'scanned' WHEN l_returnflag = 'A' THEN 'skipped_cover' WHEN l_quantity <= 5 THEN 'no_mask'
       WHEN l_linestatus = 'O' THEN 'cropped' ELSE 'restored' END AS batch_status,
  CASE WHEN l_linenumber = 1 THEN 'mask_provider_unavailable' WHEN l_linenumber = 2 THEN 'mask_provider_error'
       WHEN l_quantity <= 5 THEN 'no_mask' WHEN l_linenumber = 3 THEN 'restore_provider_unavailable'
       WHEN l_linenumber = 4 THEN 'restore_provider_error' WHEN l_linestatus = 'O' THEN 'cropped'
       WHEN l_linenumber = 5 THEN 'masked_only' ELSE 'restored' END AS eval_status
FROM lineitem""",
    "pending_items": """SELECT o_orderkey AS item_key, o_orderstatus FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""",
    "run_progress": f"{_RUNS} SELECT * FROM progress",
    "run_summary": f"""{_RUNS},
counted AS (SELECT run_id, status, count(*) AS n FROM results GROUP BY ALL)
SELECT p.*, CASE WHEN completed_item_count >= image_count THEN 'completed' ELSE 'interrupted' END AS run_status, status, n
FROM progress p LEFT JOIN counted USING (run_id)""",
    "resume_counts": """WITH m AS (
  SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') AS b,
         o_orderkey IN (SELECT l_orderkey FROM lineitem) AS a FROM orders)
SELECT count(*) AS image_count, count(*) FILTER (b) AS completed_before, count(*) FILTER (NOT b) AS pending_before,
       count(*) FILTER (NOT b AND a) AS resumed_item_count, count(*) FILTER (NOT b AND NOT a) AS pending_after,
       CAST(count(*) FILTER (NOT b) > 0 AS INT) AS resume_count FROM m""",
    "run_lookup": f"""WITH {EVAL} SELECT run_id, count(*) AS item_count, count(*) FILTER (status = 'restored') AS restored_count
FROM eval_results GROUP BY run_id ORDER BY run_id DESC LIMIT 1""",
    "reconcile": """WITH n AS (
  SELECT user_id, count(*) FILTER (event_id % 2 = 1) >= count(*) FILTER (event_id % 2 = 0) AS use_jsonl FROM events GROUP BY user_id)
SELECT user_id AS run_id, event_id, event_type AS status FROM events JOIN n USING (user_id) WHERE (event_id % 2 = 1) = use_jsonl""",
    "last_wins": """SELECT 'u' || user_id AS item_id, event_type AS status, round(value, 2) AS value, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""",
    "ordered_distinct": """WITH w AS (
  SELECT role, string_split(text, ' ') AS parts, conv_id * 1000000000 + turn * 1000000 AS base FROM conversations),
u AS (SELECT role, unnest(parts) AS word, base + unnest(range(len(parts))) AS pos FROM w)
SELECT role, word, CAST(min(pos) AS BIGINT) AS first_pos FROM u GROUP BY role, word""",
    "json_props": "SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY 1",
    "validate_items": """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
SELECT event_id, CASE WHEN k % 10 = 1 THEN 'source_path is missing or empty' WHEN k % 10 = 2 THEN 'relative_path is missing or empty'
  WHEN event_id % 11 = 3 THEN 'width is not an integer' WHEN k % 7 = 4 THEN 'height is not an integer'
  WHEN k % 13 = 5 THEN 'category is missing or empty' END AS reject_reason FROM e""",
    "count_mismatch": """WITH loaded AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey AS manifest_key, o_custkey % 8 AS item_count, coalesce(n, 0) AS loaded_count
FROM orders LEFT JOIN loaded ON l_orderkey = o_orderkey WHERE o_custkey % 8 <> coalesce(n, 0)""",
    "unknown_names": """SELECT event_id, 'NATION_' || (user_id % 30) AS n_name FROM events
WHERE 'NATION_' || (user_id % 30) NOT IN (SELECT n_name FROM nation)""",
    "plan_counts": f"""WITH {SCAN},
c AS (SELECT category, count(*) AS n FROM scan_items GROUP BY category)
SELECT 'plan-1' AS plan_id, 1 AS plan_version, 'rule_based_roi' AS mask_provider, 'noop' AS restore_provider,
       CAST(sum(n) AS BIGINT) AS item_count, '{{' || string_agg('"' || category || '":' || n, ',' ORDER BY category) || '}}' AS category_counts FROM c""",
    "plan_count_check": """WITH n AS (SELECT l_suppkey % 50 AS plan_id, count(*) AS loaded_count FROM lineitem GROUP BY 1)
SELECT plan_id, loaded_count + 1 AS item_count, loaded_count FROM n WHERE plan_id % 5 = 0""",
    "resolve_profile": f"""{_PROFILES}
SELECT event_id, coalesce(mask_provider, pm, 'rule_based_roi') AS mask_provider, coalesce(pr, 'noop') AS restore_provider
FROM joined WHERE profile IS NULL OR name IS NOT NULL""",
    "profile_rejects": f"{_PROFILES} SELECT event_id, profile FROM joined WHERE profile IS NOT NULL AND name IS NULL",
    "keyword_tokens": f"""WITH w AS (
  SELECT CASE role WHEN 'user' THEN 0 ELSE 1 END AS rank, conv_id, turn, string_split(text, '.') AS parts
  FROM conversations WHERE role IN ('user', 'assistant')),
u AS (SELECT 1 AS source, rank, conv_id, turn, unnest(range(len(parts))) AS place, unnest(parts) AS raw FROM w
      UNION ALL SELECT 0, unnest(range(8)), 0, 0, 0, unnest(['copyright', 'allrights', 'reserved', 'watermark', '.com', '.net', '.org', '.cn'])
      UNION ALL SELECT 2, 0, 0, 0, 0, 'Acme Studio'),
t AS (SELECT *, regexp_replace(lower(raw), {_SPACES}, '', 'g') AS token FROM u)
SELECT token, source, conv_id, turn FROM t WHERE token <> ''
QUALIFY row_number() OVER (PARTITION BY token ORDER BY source, rank, conv_id, turn, place) = 1""",
}
