"""The pipeline's stages row for row, on null, repeated and shared ids, against plain Python."""

from __future__ import annotations

import collections
import os
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline
from corpuseval.session import materialize

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row_key string, dropped_id int, found int"
COPY = " ".join(f"alpha{i} beta{i}" for i in range(40))
NEAR = COPY.replace("beta7", "other7")
FAR = " ".join(f"gamma{i} delta{i}" for i in range(40))
ITEM = "The committee shall review every proposal within thirty days, and publish its reasons in full, so that all members can reply."
ROWS = [
    (1, COPY), (1, COPY), (None, COPY), (2, NEAR), (3, FAR), (3, COPY + " end"), (None, "lonely words without an id"),
    (None, "lonely words without an id"), (4, None), (4, None), (5, ""), (6, f"Before it. {ITEM} After it."), (None, f"Again. {ITEM} Done."),
    (6, "a clean text that shares the id of a leaked one"), (7, 'token = "9f8e7d6c5b4a39281706f5e4d3c2b1a09f8e7d6c" here'), (8, "one"), (9, "one"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "r", 1, 2) for i, t in rows], SCHEMA)


def pairs(df):
    return collections.Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def without_copies(rows):
    """One row of each group of linked texts, smallest id first, null last; repeated rows count once."""
    texts = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for _, t in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    group = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    return collections.Counter(t for k, t in enumerate(texts) if group[k] == k)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(7, ITEM), (8, None)], "item_id bigint, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{root}/labels.parquet")
    return root


def test_near_duplicates_keep_one_row_of_a_group(spark, tables):
    docs = frame(spark, ROWS)
    got = corpus_pipeline.near_duplicates(spark, docs, tables)
    assert got.columns == docs.columns and pairs(got) == without_copies(ROWS)
    assert pairs(got)[1, COPY] == 1 and pairs(got)[3, FAR] == 1 and (None, COPY) not in pairs(got)


def test_decontamination_drops_rows_not_ids(spark, tables):
    docs = frame(spark, ROWS)
    got = corpus_pipeline.decontamination(spark, docs, tables)
    assert got.columns == docs.columns and pairs(got) == collections.Counter(r for r in ROWS if ITEM not in (r[1] or ""))


def test_toxicity_drops_rows_not_ids(spark, tables):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    toxic = given.join(labels.where("toxic = 1").select("doc_id"), "doc_id").first()
    calm = "and then they went home to read a book about the sea"
    rows = [(r.doc_id, r.text) for r in given.collect()] + [(None, toxic.text), (toxic.doc_id, calm), (toxic.doc_id, toxic.text)]
    docs = frame(spark, rows)
    left = pairs(corpus_pipeline.toxicity(spark, docs, tables))
    assert (toxic.doc_id, toxic.text) not in left and (None, toxic.text) not in left and left[toxic.doc_id, calm] == 1


def test_redaction_and_packing_keep_every_row(spark, tables):
    docs = frame(spark, ROWS)
    cleaned = corpus_pipeline.secret_redaction(spark, docs, tables)
    assert cleaned.columns == docs.columns and cleaned.count() == len(ROWS)
    packed = corpus_pipeline.packing(spark, docs, tables)
    assert collections.Counter(r.doc_id for r in packed.where("piece = 0").collect()) == collections.Counter(i for i, _ in ROWS)
    filled = collections.defaultdict(list)
    for r in packed.collect():
        filled[r.sequence_id].append((r.offset, r.length))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096


def test_all_stages_on_awkward_rows(spark, tables):
    docs = frame(spark, ROWS)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, tables))
    assert docs.count() > 0
