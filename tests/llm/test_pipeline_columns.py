"""Stages keep the columns of their documents, whatever their names and types."""

import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import frame, prose

import corpus_pipeline

NAMES = ["th", "kept", "n_removed", "gone_id", "gone_th", "_kept", "_d", "row", "hash", "of", "d", "r", "s", "k", "best", "n", "root", "a.b", "a`c"]


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    rng = random.Random(31)
    # stages are judged one by one: each meets copies, repeats and contamination
    texts = [prose(rng, 60) for _ in range(12)]
    item = prose(rng, 14)
    texts += [texts[0], texts[0].replace("e", "E"), f"{texts[1]}\n{texts[2]}", f"{item} {texts[3]}", "", None]
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, texts[5], None, None, None)]
    docs = frame(spark, rows).withColumns({n: F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for n in NAMES})
    docs = docs.withColumn("a map", F.create_map(F.lit("id"), F.col("doc_id").cast("string"))).withColumn("list", F.array("lang"))
    folder = str(tmp_path_factory.mktemp("wide"))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_columns_stay_as_they_are(spark, wide, stage):
    docs = spark.read.parquet(f"{wide}/documents.parquet")
    got = dict(corpus_pipeline.STAGES)[stage](spark, docs, wide)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    rows = got.collect()
    assert 0 < len(rows) <= docs.count()
    for r in rows:
        i = "-" if r.doc_id is None else str(r.doc_id)
        assert all(r[n] == f"{n} of {i}" for n in NAMES)
        assert r["a map"] == {"id": None if r.doc_id is None else i} and r["list"] == [r["lang"]]
    if stage == "near duplicates":
        ids = [r.doc_id for r in rows]
        assert ids.count(4) == 1 and 12 not in ids and 13 not in ids and None not in ids
    if stage == "substring dedup":
        assert next(r.text for r in rows if r.doc_id == 14) == "" and sum(r.text == "" for r in rows if r.doc_id == 4) == 0
    if stage == "decontamination":
        assert 15 not in {r.doc_id for r in rows}


def test_last_stage(spark, wide):
    docs = spark.read.parquet(f"{wide}/documents.parquet")
    assert corpus_pipeline.STAGES[-1][1](spark, docs, wide).select("doc_id").distinct().count() == 19
