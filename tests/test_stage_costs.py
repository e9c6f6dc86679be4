"""What the duplicate stage stores and compiles: one inventory for two runs, narrow rows, no clusters where members are asked for."""

import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from dovetail.functions import dates
from dovetail.operators import duplicates, linkage, tiles
from dovetail.queries import QUERIES
from dovetail.sources import instances, shared

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture
def stored(monkeypatch):
    seen, real = [], shared.stash

    def stash(df, name):
        seen.append((name, df.columns))
        return real(df, name)

    monkeypatch.setattr(shared, "stash", stash)
    return seen


def test_file_name_dates_compile(spark):
    names = spark.createDataFrame([("x/IMG_20070408_010203_x7.jpg",), ("x/scan_x199001.jpg",)], "p string")
    before = spark.conf.get("spark.sql.codegen.fallback")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        found = names.select(dates.filename_candidate(F.col("p"), serial=r"_x\d+(?=\.[^.]*$|$)").alias("f")).select("f.date", "f.precision").collect()
    finally:
        spark.conf.set("spark.sql.codegen.fallback", before)
    assert [tuple(r) for r in found] == [("2007-04-08T01:02:03", "second"), (None, None)]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["pending_clusters", "quarantine_index"])
def test_stage_stores_what_is_read(spark, stored, name):
    QUERIES[name](spark, str(DATA))
    count = Counter(n for n, _ in stored)
    assert count["resolved"] == count["ranked"] == 1
    assert count["pool"] == count["people"] == count["clusters"] == 0
    assert not {"phash", "folder", "gps_lat"} & set(dict(stored)["ranked"])


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_facts_are_merged_once(spark, stored):
    QUERIES["dedup_facts"](spark, str(DATA))
    count = Counter(n for n, _ in stored)
    assert count["pool"] == count["people"] == count["clusters"] == 0
    assert {"gps_lat", "side_lat", "description"} <= set(dict(stored)["ranked"])


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_a_second_run_reads_the_first_ones_dates(spark, stored):
    QUERIES["replaced_clusters"](spark, str(DATA))
    assert Counter(n for n, _ in stored)["resolved"] == 1


def test_stars_are_done_as_they_are(spark, stored):
    edges = spark.createDataFrame([(1, k) for k in range(2, 30)] + [(40, 41)], "a long, b long")
    got = {r.node: r.component for r in duplicates.components(edges).collect()}
    assert got == {**{k: 1 for k in range(1, 30)}, 40: 40, 41: 40}
    assert [n for n, _ in stored] == ["edges"]


def test_small_tiles_without_links_are_not_taken_up():
    import numpy as np

    linked = tiles._links(6, 4, 8)
    ids = np.arange(5)
    x = {"id": ids, "orig": ids * 0 - 1, "old": ids * 0, "n": ids * 0 + 16, "ratio": np.ones(5), "p": np.array([0, 1 << 20, 0xFFFFFF << 20, 0, 3], np.uint64), "d": np.array([0, 0, 0, 0xFFFF, 0], np.uint64)}
    x |= {"b0": np.array([7, 7, 7, 8, 9]), "b1": ids, "b2": ids}
    at = lambda *k: np.array(k)
    # tiles of images 0 and 1 (near), 0 and 2 by themselves, and 4 against 0; the same in the next band, where 0 and 1 have met
    left, right = (at(0, 2, 4, 0), at(2, 4, 5, 2)), (at(0, 2, 0, 0), at(2, 4, 1, 2))
    found = tiles._screen(linked)(x, at(0, 0, 0, 1), left, right, at(False, False, True, False).astype(bool))
    assert found.tolist() == [True, False, True, False]
    assert tiles._screen(linked, most=3)(x, at(0, 0, 0, 1), left, right, at(False, False, True, False).astype(bool)).tolist() == [True] * 4


def test_dates_merge_without_meeting_their_members_again(spark):
    columns = "cluster_id long, kind string, trust string, rel_path string, resolved_date string, resolved_precision string, resolved_source string"
    rows = spark.createDataFrame([(1, "image", "curated", "a", "2001-02-03", "day", "exif"), (1, "image", "curated", "b", "2002-02-03", "day", "filename")], columns)
    found = duplicates.merged_dates(rows)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.date, r.flags, r.disagrees) for r in found.collect()] == [("2001-02-03", ["date_disagreement"], True)]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["quarantine_index", "space_needed"])
def test_placements_make_what_they_read(spark, monkeypatch, name):
    seen = []
    for module, f in ((duplicates, "guardrails"), (linkage, "edited_pairs")):
        monkeypatch.setattr(module, f, lambda *a, f=f, real=getattr(module, f): (seen.append(f), real(*a))[1])
    QUERIES[name](spark, str(DATA))
    assert seen == ["edited_pairs"]


def test_a_group_of_a_date_is_taken_once(spark):
    names = spark.createDataFrame([("x/IMG_20070408_010203.jpg",), ("2001-02-03 trip/scan.jpg",)], "p string")
    found = names.select(dates.filename_candidate(F.col("p")).alias("f"), dates.folder_candidate(F.col("p")).alias("d"))
    named = sum(g in dates._PARTS for p in dates.FILENAME_PATTERNS + dates.FOLDER_PATTERNS for g in re.compile(p).groupindex)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") <= named
    assert [(r.f and r.f.date, r.d and r.d.date) for r in found.collect()] == [("2007-04-08T01:02:03", None), (None, "2001-02-03")]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_days_are_written_out_for_documents_only(spark):
    plan = instances.instances(spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
    read = [line for line in plan.splitlines() if "date_format" in line]
    assert read and not any("o_orderkey" in line for line in read)
