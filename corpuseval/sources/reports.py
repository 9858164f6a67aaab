"""Evaluation report documents, result lines and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from corpuseval.functions.runs import looks_like_run_id
from corpuseval.metrics import METRICS
from corpuseval.operators.validate import check_version
from corpuseval.session import materialize
from corpuseval.schemas import BATCH_RESULT, MANIFEST, REPORT, RUN_SUMMARY


def _path_run_id(path: Column) -> Column:
    """Nearest parent folder that looks like a run id, else an empty string."""
    parents = F.reverse(F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1))
    return F.coalesce(F.get(F.filter(parents, looks_like_run_id), F.lit(0)), F.lit(""))


def read_reports(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(headers, results, rejects)`` of all ``*.json`` below ``root`` except ``summary.json``.

    Documents without ``results`` or not parsable are rejects. A missing provider is taken from
    the first result, a missing run id from the path. Headers keep reports without results.
    """
    schema = T.StructType([*REPORT.fields, T.StructField("_corrupt_record", T.StringType())])
    docs = (
        spark.read.schema(schema)
        .option("multiLine", "true")
        .option("mode", "PERMISSIVE")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json")
        .json(root)
        .select("*", F.col("_metadata.file_path").alias("report_path"), F.col("_metadata.file_name").alias("_name"))
        .filter("_name <> 'summary.json'")
    )
    usable = F.col("results").isNotNull() & F.col("_corrupt_record").isNull()
    rejects = docs.filter(~usable).select(
        "report_path",
        F.when(F.col("_corrupt_record").isNotNull(), "not parsable").otherwise("no results").alias("reject_reason"),
    )

    def provider(name: str) -> Column:
        first = F.get(F.col("results"), F.lit(0))[name]
        return F.coalesce(F.nullif(F.col(name), F.lit("")), first, F.lit("")).alias(name)

    named = docs.filter(usable).select(
        "report_path",
        F.coalesce(F.nullif("run_id", F.lit("")), _path_run_id(F.col("report_path"))).alias("run_id"),
        F.coalesce("dataset_id", F.lit("")).alias("dataset_id"),
        provider("mask_provider"),
        provider("restore_provider"),
        "status_counts",
        "results",
    )
    headers = named.withColumn("item_count", F.size("results").cast("long")).drop("results")
    return headers, flatten_results(named), rejects


def flatten_results(reports: DataFrame) -> DataFrame:
    """Report documents to flat fact rows; ``pos`` is the place inside the document."""
    rows = reports.select(
        "report_path", "run_id", "dataset_id", "mask_provider", "restore_provider",
        F.posexplode("results").alias("pos", "r"),
    )
    return rows.select(
        "report_path",
        "run_id",
        "dataset_id",
        "mask_provider",
        "restore_provider",
        "pos",
        F.col("r.item.item_id").alias("item_id"),
        F.col("r.item.relative_path").alias("relative_path"),
        F.col("r.item.source_category").alias("source_category"),
        F.col("r.item.prompt").alias("prompt"),
        F.col("r.status").alias("status"),
        F.coalesce("r.note", F.lit("")).alias("note"),
        F.col("r.mask_result.confidence").alias("confidence"),
        F.col("r.mask_path").alias("mask_path"),
        F.col("r.restored_path").alias("restored_path"),
        F.col("r.metrics").alias("metrics"),
        *[F.element_at("r.metrics", F.lit(m)).alias(m) for m in METRICS],
    )


def number_lines(spark: SparkSession, path: str, by_folder: bool = False) -> DataFrame:
    """Lines of text files with their file and number (from 1): source_file, line_no, value.

    With ``by_folder`` the files of a folder, in the order of their names, are numbered on as one text.
    Files are read in splits. A split's lines are numbered by their place in its task, and a sum over the few counts per split
    gives the lines before it, so a long file is numbered by many tasks and no text is shuffled.
    """
    rows = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    counts = rows.groupBy("source_file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    text = F.regexp_replace("source_file", "/[^/]*$", "") if by_folder else F.col("source_file")
    earlier = Window.partitionBy(text).orderBy("source_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n"))
    joined = rows.join(offsets, ["source_file", "_block"])
    # both passes must have dealt the splits to the same tasks; Spark plans the same scan twice, and this makes sure
    same = F.assert_true(F.shiftright("_id", 33) == F.shiftright("_first", 33), F.lit("files changed while their lines were numbered"))
    number = F.col("_before") + F.col("_id") - F.col("_first") + 1
    return joined.select("source_file", F.when(same.isNull(), number).alias("line_no"), "value")


def read_results_jsonl(
    spark: SparkSession, path: str, mode: str = "FAILFAST", schema: T.StructType = BATCH_RESULT, by_folder: bool = False
):
    """Appended results, one object per line; blank lines are skipped but count in the numbering.

    FAILFAST raises on a bad line, naming its file and number, and returns rows; PERMISSIVE returns ``(rows, rejects)``, both with
    ``source_file`` and ``line_no``. A line that is no JSON object is bad. ``by_folder`` as in ``number_lines``.
    """
    lines = number_lines(spark, path, by_folder).filter(F.trim("value") != "")
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = lines.withColumn(
        "r", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    )
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull() | ~F.ltrim("value").startswith("{")
    values = [F.col(f"r.{f.name}") for f in schema.fields]
    if mode.upper() == "FAILFAST":
        place = F.concat(F.lit("bad result line "), "line_no", F.lit(" of "), "source_file")
        return parsed.filter(F.assert_true(~bad, place).isNull()).select(*values)
    good = parsed.filter(~bad).select("source_file", "line_no", *values)
    return good, parsed.filter(bad).select("source_file", "line_no", F.col("value").alias("line"))


def read_run_summaries(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """``(headers, results)`` of the runs below ``root``.

    A run folder's ``summary.json`` is used when it can be parsed, else its ``reports/report.json``.
    Only the paths are compared across files; the chosen documents are then read in place. Missing
    header fields get their defaults: a completed run, no resumes, counts from the results.
    """
    schema = T.StructType([*RUN_SUMMARY.fields, T.StructField("_corrupt_record", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    docs = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "{summary,report}.json")
        .text(root, wholetext=True)
        .select(F.from_json("value", schema, options).alias("d"), F.col("_metadata.file_path").alias("summary_path"))
        .select("d.*", "summary_path")
        .withColumn("run_dir", F.regexp_replace("summary_path", "(/reports)?/[^/]+$", ""))
    )
    is_summary = F.col("summary_path").endswith("/summary.json")
    in_place = is_summary | F.col("summary_path").endswith("/reports/report.json")
    usable = docs.filter(F.col("_corrupt_record").isNull() & in_place)
    chosen = usable.groupBy("run_dir").agg(
        F.min_by("summary_path", F.when(is_summary, 0).otherwise(1)).alias("summary_path")
    )
    picked = usable.drop("_corrupt_record").join(chosen.select("summary_path"), "summary_path", "left_semi")
    run_id = F.coalesce(F.nullif("run_id", F.lit("")), F.substring_index("run_dir", "/", -1))
    loaded = F.coalesce(F.size("results"), F.lit(0)).cast("long")
    total = F.coalesce("image_count", loaded)
    headers = picked.select(
        run_id.alias("run_id"),
        "run_dir",
        "summary_path",
        F.coalesce("run_status", F.lit("completed")).alias("run_status"),
        F.coalesce("resume_count", F.lit(0)).alias("resume_count"),
        total.alias("image_count"),
        F.coalesce("completed_item_count", loaded).alias("completed_item_count"),
        F.coalesce("pending_item_count", F.greatest(F.lit(0).cast("long"), total - loaded)).alias("pending_item_count"),
        "status_counts",
    )
    results = picked.select(run_id.alias("run_id"), F.inline("results"))
    return headers, results


def read_manifest(spark: SparkSession, path: str, version: int = 1, kind: str = "scan") -> tuple[DataFrame, DataFrame]:
    """``(header, items)`` of scan manifests, plans or run manifests (``kind`` names the version field).

    A wrong version, a missing item list or a declared count that differs from the loaded one
    fails the job that reads the result.
    """
    column = f"{kind}_version"
    docs = spark.read.schema(MANIFEST).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    docs = check_version(docs.withColumn("manifest_path", F.col("_metadata.file_path")), column, version)
    listed = F.assert_true(F.col("items").isNotNull(), F.lit("the item list is missing"))
    counted = F.assert_true(
        F.coalesce(F.col("item_count") == F.size("items"), F.lit(False)),
        F.concat(
            F.lit("item_count says "),
            F.coalesce(F.col("item_count").cast("string"), F.lit("none")),
            F.lit(", found "),
            F.coalesce(F.size("items"), F.lit(0)).cast("string"),
        ),
    )
    checked = docs.filter(listed.isNull()).filter(counted.isNull())
    items = checked.select("manifest_path", F.posexplode("items").alias("pos", "i")).select(
        "manifest_path", "pos", "i.*"
    )
    return checked.drop("items"), items


def latest_matching(documents: DataFrame, *filters: Column, modified: str = "modified", path: str = "path") -> DataFrame:
    """Most recently modified document that passes all filters; ties go to the greatest path."""
    kept = documents
    for test in filters:
        kept = kept.filter(test)
    payload = F.struct(*kept.columns)
    return kept.agg(F.max_by(payload, F.struct(modified, path)).alias("_row")).select("_row.*").filter(
        F.col(path).isNotNull()
    )


def read_artifacts(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """JSON documents directly below ``root`` with path and modification time, without ``latest.json``."""
    return (
        spark.read.schema(schema)
        .option("multiLine", "true")
        .option("pathGlobFilter", "*.json")
        .json(root)
        .select(
            "*",
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_name").alias("_name"),
            F.col("_metadata.file_modification_time").alias("modified"),
        )
        .filter("_name <> 'latest.json'")
        .drop("_name")
    )


def matches(**wanted: str | None) -> list[Column]:
    """Equality filters where NULL means any value."""
    return [F.col(name) == value for name, value in wanted.items() if value is not None]
