"""A training corpus from raw documents: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuseval.llm import secrets
from corpuseval.llm.decontaminate import find_leaks
from corpuseval.llm.jaccard_join import join_texts
from corpuseval.llm.packing import pack_documents
from corpuseval.llm.toxicity import score_toxicity
from corpuseval.session import materialize

BROADCAST_ROWS = 1_000_000


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of id and text in a column of a free name: equal for repeated rows, different where only one agrees."""
    name = "row_key"
    while name in docs.columns:
        name += "_"
    known = F.col("doc_id").isNotNull(), F.col("text").isNotNull()
    return docs.withColumn(name, F.xxhash64(*known, F.col("doc_id"), F.col("text"))), name


def _without(rows: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """``rows`` without the keys of the one column of ``dropped``, which are broadcast up to a checked number."""
    gone = materialize(dropped.toDF(key).where(F.col(key).isNotNull()).distinct())
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return rows.join(gone, key, "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar does not reject."""
    rows, key = _keyed(docs)
    scores = score_toxicity(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), row_col=key)
    return _without(rows, key, scores.where("predicted = 1").select("row_key")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, the one with the smallest id (ids before null), and of repeated rows one."""
    rows, key = _keyed(docs)
    found = join_texts(rows, id_col=key).select(F.col("doc_id").alias(key), F.col("component_id").alias("component"))
    ids = materialize(rows.groupBy(key).agg(F.first("doc_id").alias("id"), F.count("*").alias("times")))
    placed = materialize(found.join(ids, key).select(key, "component", F.struct(F.col("id").isNull(), "id", key).alias("rank")))
    best = placed.groupBy("component").agg(F.min("rank").alias("best"))
    kept = best.select(F.col(f"best.{key}").alias(key))
    left = _without(rows, key, placed.select(key).join(kept, key, "left_anti"))
    repeated = materialize(ids.where("times > 1").select(key))
    if not repeated.isEmpty():
        one = left.join(repeated, key, "left_semi").dropDuplicates([key])
        left = _without(left, key, repeated).unionByName(one)
    return left.select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    rows, key = _keyed(docs)
    leaks = find_leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key)
    return _without(rows, key, leaks.select("doc_id")).select(docs.columns)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with confirmed secrets in their texts replaced."""
    forest = secrets.train_on(secrets.labelled_findings(docs))
    return secrets.redact(docs, forest).withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and their places in sequences."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_redaction", secret_redaction),
    ("packing", packing),
]

#: No SQL for a learned filter or a vocabulary file; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
