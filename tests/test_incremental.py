"""Imports against runs over everything."""

import pytest
from pyspark.sql import functions as F

from dovetail.operators import duplicates, linkage
from dovetail.plans import incremental
from dovetail.plans.stages import near_clusters
from dovetail.sources.instances import instances

SF = "/root/testdata/sf0.001"


def _set(df):
    return {tuple(r) for r in df.select("id", "cluster_id", "cluster_kind", "weak").collect()}


@pytest.fixture(scope="module")
def media(spark, tmp_path_factory):
    inv = instances(spark, SF).where("kind in ('image', 'video')").select(*incremental.MEDIA)
    # copies of some files, in a source that sorts last, and of one that sorts first
    copies = inv.where("id % 9 = 0").withColumn("id", F.col("id") + 100_000).withColumn("source", F.lit("X"))
    near = inv.where("id % 7 = 1").withColumn("id", F.col("id") + 200_000).withColumn("sha256", F.concat(F.lit("n"), "sha256")).withColumn("phash", F.concat(F.substring("phash", 1, 15), F.lit("0")))
    path = str(tmp_path_factory.mktemp("media"))
    every = inv.unionByName(copies).unionByName(near)
    signs = duplicates.representatives(every).select("sha256", *incremental.SIGNS)  # of equal contents they are equal
    every.drop(*incremental.SIGNS).join(signs, "sha256").select(*incremental.MEDIA).write.parquet(f"{path}/m")
    return spark.read.parquet(f"{path}/m")


def _edits(media, new):
    ids = new.select("id")
    all_ = linkage.edited_pairs(media)
    return all_.join(ids.withColumnRenamed("id", "edited_id"), "edited_id", "left_semi").unionByName(all_.join(ids.withColumnRenamed("id", "original_id"), "original_id", "left_semi")).distinct()


def test_imports_equal_a_run_over_everything(spark, media, tmp_path):
    catalog = incremental.indexes(spark, str(tmp_path / "c"), rows_per_file=40)
    # smaller ids come last, so labels change
    step = F.when(F.col("id") % 10 < 6, 0).when(F.col("id") > 150, 1).otherwise(2)
    parts = [media.where(step == k) for k in range(3)]
    incremental.build(catalog, parts[0])
    have = parts[0]
    assert _set(incremental.clusters(catalog)) == _set(near_clusters(have))
    for part in parts[1:]:
        have = have.unionByName(part)
        touched = _set(incremental.import_files(catalog, part, _edits(have, part)))
        want = _set(near_clusters(have))
        assert _set(incremental.clusters(catalog)) == want
        ids = {r.id for r in part.select("id").collect()}
        assert touched == {r for r in want if r[1] in {x[1] for x in want if x[0] in ids}}


def test_a_copy_joins_its_cluster_and_few_files_are_read(spark, media, tmp_path):
    catalog = incremental.indexes(spark, str(tmp_path / "c"), rows_per_file=20)
    incremental.build(catalog, media)
    one = media.where("id = 4").withColumn("id", F.lit(999_999).cast("long")).withColumn("source", F.lit("Z"))
    before = {n: set(catalog.files(n)) for n in incremental.KEYS}
    assert all(len(catalog.hit(n, one)) <= 2 < len(before[n]) for n in ("contents",))
    got = _set(incremental.import_files(catalog, one, spark.createDataFrame([], "edited_id long, original_id long")))
    assert {r[0] for r in got} >= {4, 999_999} and got <= _set(near_clusters(media.unionByName(one)))
    assert all(before[n] <= set(catalog.files(n)) for n in ("bands", "members", "contents"))  # nothing is written again


def test_what_the_indexes_cannot_tell(spark, media, tmp_path):
    catalog = incremental.indexes(spark, str(tmp_path / "c"))
    incremental.build(catalog, media)
    first = media.where("id = 4").withColumn("id", F.lit(999_999).cast("long")).withColumn("source", F.lit("A"))
    with pytest.raises(incremental.NeedsAll):
        incremental.import_files(catalog, first, spark.createDataFrame([(999_999, 5)], "edited_id long, original_id long"))
    none = spark.createDataFrame([], "edited_id long, original_id long")
    with pytest.raises(incremental.NeedsAll):
        incremental.import_files(catalog, first.withColumn("width", F.lit(1)), none)
    with pytest.raises(incremental.NeedsAll):
        incremental.import_files(catalog, first, spark.createDataFrame([(5, 6)], "edited_id long, original_id long"))
