import random
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import DOCS, documents, frame, link_classes, shingle_set

from dovetail.llm import cross_polytope


def test_rotation_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(20, 48))
    assert np.allclose(np.linalg.norm(cross_polytope.rotate(x, 2), axis=1), np.linalg.norm(x, axis=1))


def test_search(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 32)).astype(np.float32)
    x[300:360] = x[0]  # one vector many times: ties go to smaller ids
    rows = [(i, [float(v) for v in x[i]]) for i in range(600)]
    odd = [(600, None), (620, [0.0] * 32), (640, [float("nan")] * 32), (660, [None] * 32), (None, [1.0] * 32), (680, [1.0, 2.0]), rows[5]]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("dim", F.lit(0)).withColumn("ids", F.lit("x"))
    monkeypatch.setattr(cross_polytope, "BLOCK_ROWS", 16)
    got: dict[int, list] = {}
    for r in cross_polytope.search(df, F.col("vec_id") % 20 == 0, k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    d = x.astype(np.float64)
    found = total = 0
    for q in range(0, 600, 20):
        scores = d @ d[q]
        best = [i for i in np.lexsort((np.arange(600), -np.round(scores, 9))) if i != q][:10]
        assert len(got[q]) == 10 and all(abs(s - scores[i]) < 1e-9 for i, s in got[q])
        assert [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True) and q not in [i for i, _ in got[q]]
        found += len({i for i, _ in got[q]} & set(best))
        total += 10
    assert found / total >= 0.9
    assert [i for i, _ in got[0]] == list(range(300, 310))
    assert set(got) == set(range(0, 600, 20))
    few = cross_polytope.search(spark.createDataFrame(rows[:7], "vec_id long, embedding array<float>"), F.col("vec_id") == 0, k=10, tables=1, probes=1)
    assert few.count() == 6
    assert cross_polytope.search(df.limit(0), F.lit(True)).count() == 0


def test_ties_of_distinct_vectors_go_to_smaller_ids(spark):
    rng = np.random.default_rng(3)
    x = np.unique(rng.choice([-0.125, 0.125], (1500, 12)), axis=0)
    x = np.hstack([np.full((len(x), 1), 4.0), x])  # near each other, so that they share a bucket
    x = x[rng.permutation(len(x))]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict[int, list] = {}
    # all axes are probed, so that every vector is a candidate
    for r in cross_polytope.search(df, F.col("vec_id") % 100 == 0, k=20, tables=1, probes=1 << 30).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q in range(0, len(x), 100):
        scores = x @ x[q]
        assert got[q] == [i for i in np.lexsort((np.arange(len(x)), -scores)).tolist() if i != q][:20]


def test_stages(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(3)
    rows = documents()
    docs = frame(spark, rows)
    columns = [f.name for f in docs.schema]
    near = p.near_duplicates(spark, docs, "")
    assert near.columns == columns
    label = link_classes([r[1] for r in rows])
    full = {k for r, k in zip(rows, label) if shingle_set(r[1])}
    empty = sum(not shingle_set(r[1]) for r in rows)
    assert near.count() == len(full) + empty
    kept = p.passages(spark, near, "")
    assert kept.columns == columns and kept.count() == near.count()
    bench = [(1, rows[12][1])]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = p.decontaminate(spark, docs, str(tmp_path))
    assert clean.columns == columns and 0 < docs.count() - clean.count() < 4
    packed = p.packed(spark, clean, "")
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in clean.select("doc_id").collect()}
    assert rng and DOCS


def test_language_stage_keeps_clean(spark):
    import corpus_pipeline as p

    rows = [(i, "the other and the thing with that", "en", "s", 0) for i in range(20)] + [(90, "12 34", "en", "s", 0), (91, None, "en", "s", 0)]
    got = p.language(spark, frame(spark, rows), "")
    assert {r.doc_id for r in got.collect()} == set(range(20))
