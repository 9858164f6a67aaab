"""The pipeline stage by stage, and what each stage leaves out."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline
from corpuseval.llm import secrets
from corpuseval.llm.decontaminate import find_leaks
from corpuseval.llm.jaccard_join import join_texts
from corpuseval.llm.toxicity import score_toxicity
from corpuseval.session import materialize

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near_duplicates", "decontamination", "secret_redaction", "packing",
    ]
    drops = [
        lambda d: ids(score_toxicity(d, labels).where("predicted = 1")),
        lambda d: ids(join_texts(d).where("doc_id <> component_id")),
        lambda d: ids(find_leaks(d, bench)),
        lambda d: set(),
    ]
    for (_, stage), drop in zip(corpus_pipeline.STAGES, drops, strict=False):
        after = materialize(stage(spark, docs, SF))
        assert after.columns == docs.columns and ids(after) == ids(docs) - drop(docs)
        docs = after
    forest = secrets.train_on(secrets.labelled_findings(docs))
    assert secrets.scan_secrets(docs, forest).where("is_secret and start >= 0 and text not like '%SECRET%'").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert ids(packed) == ids(docs)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF))
    assert docs.count() == 0
