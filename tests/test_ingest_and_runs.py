import hashlib
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from dovetail.operators import placement, review
from dovetail.plans.stages import Settings
from dovetail.sources import files, runs, store


def test_settings_file(tmp_path):
    path = tmp_path / "settings.toml"
    path.write_text("[duplicates]\ncolour = 4\n")
    with pytest.raises(ValueError, match="unknown settings: colour"):
        Settings.load(str(path))
    path.write_text("[duplicates]\nphash_most = 4\n[dates]\ncamera_years = {Pixel = 2016}\n")
    assert Settings.load(str(path)) == Settings(phash_most=4, camera_years=(("Pixel", 2016),))
    path.write_text("[other]\n")
    with pytest.raises(ValueError, match="unknown sections: other"):
        Settings.load(str(path))


def test_files_below_a_folder_with_an_odd_name(spark, tmp_path):
    root = tmp_path / "it's 100% a+b"
    (root / "Photos from 2001").mkdir(parents=True)
    (root / "Photos from 2001" / "a+b #1.json").write_text("{}")
    name = "Photos from 2001/a+b #1.json"
    assert [r.rel_path for r in files.json_bodies(spark, str(root)).collect()] == [name]
    assert [(r.rel_path, r.size_bytes) for r in files.walk(spark, str(root)).collect()] == [(name, 2)]
    assert [r.sha256 for r in files.digests(spark, str(root)).collect()] == [hashlib.sha256(b"{}").hexdigest()]


def test_members_of_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/1.jpg", b"one")
        z.writestr("x/empty", b"")
        z.mkdir("x/folder")
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "none.zip", "w"):
        pass
    got = {(r.rel_path, r.member, r.size_bytes, r.sha256) for r in files.archive_members(spark, str(tmp_path)).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {("a.zip", "x/1.jpg", 3, sha(b"one")), ("a.zip", "x/empty", 0, sha(b"")), ("broken.zip", None, None, None)}


def test_runs(spark, tmp_path):
    log = store.Table(spark, f"{tmp_path}/runs")
    with runs.recorded(log, "scan", {"b": 1, "a": 2}) as first:
        assert [r.status for r in runs.states(log.read()).collect()] == ["running"]
    with pytest.raises(KeyError), runs.recorded(log, "scan"):
        raise KeyError("x")
    found = {r.run_id: r for r in runs.states(log.read()).collect()}
    assert (found[first].status, found[first].args) == ("ok", '{"a": 2, "b": 1}')
    (last,) = runs.latest(log.read()).collect()
    assert last.status == "failed" and last.run_id != first and last.finished >= last.started


def test_purge_needs_a_report_that_passed(spark, tmp_path):
    ledger = spark.createDataFrame([(1, "quarantine", "q/1", 5), (2, "archive", "a/2", 6), (3, "quarantine", None, 7)], "id long, disposition string, dest_rel_path string, size_bytes long")
    path = tmp_path / "report.json"
    for passed in (False, True):
        path.write_text(json.dumps({"passed": passed, "counts": [{"disposition": "archive", "n": 1, "bytes": 6}], "discrepancies": []}, indent=1))
        report = files.verify_report(spark, str(path))
        if passed:
            assert [r.id for r in placement.purge_plan(ledger, report).collect()] == [1]
            assert report.first().counts[0].bytes == 6
        else:
            with pytest.raises(ValueError, match="passed"):
                placement.purge_plan(ledger, report)


def test_camera_window_against_all_pairs(spark):
    draw = random.Random(5)
    rows = [(i, draw.choice(["a", "b", None]), draw.choice([0, 7, 7, 7, 60, 90, draw.randrange(600)])) for i in range(160)]
    df = spark.createDataFrame(rows, "id long, camera_model string, s long").select("id", "camera_model", F.date_format(F.timestamp_seconds("s"), "yyyy-MM-dd'T'HH:mm:ss").alias("exif_dto"))
    for seconds, most in ((30, 3), (100, 10)):
        want = set()
        for i, c, s in rows:
            near = sorted((abs(s - t), j) for j, k, t in rows if j != i and c is not None and k == c and abs(s - t) <= seconds)
            want |= {(i, j, g) for g, j in near[:most]}
        assert {(r.id, r.other_id, r.gap) for r in review.camera_window(df, seconds, most).collect()} == want


def test_flags_and_creation_dates_reach_the_date_stage(spark):
    from dovetail.functions.dates import SCANNED_TYPES
    from dovetail.plans import ingest, stages

    fresh = spark.createDataFrame([("s", n, k, "t") for n, k in (("a/1.png", 5), ("a/2.jpg", 0), ("a/3.jpg", 9), ("a/4.dat", 1))], "source string, rel_path string, size_bytes long, modified string")
    contents = spark.createDataFrame([("s", "a/1.png", "x", True, None), ("s", "a/2.jpg", "y", False, None), ("s", "a/3.jpg", "z", True, "no_video")], "source string, rel_path string, sha256 string, decoded boolean, video_flag string")
    created = {"File:MIMEType": SCANNED_TYPES[0], "XMP:CreateDate": "2011:02:03 04:05:06"}
    own = {"File:MIMEType": "image/jpeg", "EXIF:DateTimeOriginal": "2001:02:03 04:05:06", "EXIF:CreateDate": "2011:02:03 04:05:06"}
    dumps = spark.createDataFrame([("s", "a/1.png", json.dumps(created)), ("s", "a/3.jpg", json.dumps(own))], "source string, rel_path string, dump string")
    found = ingest.described(fresh, contents, dumps)
    rows = {r.rel_path: r for r in found.collect()}
    assert rows["a/2.jpg"].flags == ["mime_from_extension", "unreadable_metadata", "zero_byte", "corrupt"] and rows["a/2.jpg"].kind == "image"
    assert rows["a/3.jpg"].flags == ["no_video"] and rows["a/3.jpg"].dated == "2001-02-03T04:05:06" and not rows["a/3.jpg"].from_create_date
    assert rows["a/1.png"].exif_dto is None and rows["a/1.png"].dated == "2011-02-03T04:05:06" and rows["a/1.png"].from_create_date
    dated = {r.rel_path: r for r in stages.date_candidates(found.withColumn("trust", F.lit("curated"))).collect()}
    assert dated["a/1.png"].exif_flags == ["scanner_createdate"] and dated["a/1.png"].exif_dto == "2011-02-03T04:05:06" and dated["a/3.jpg"].exif_flags == []
