"""Normalisation as one step: what it stores, what a rerun writes, sources by themselves."""

import pytest
from pyspark.sql import functions as F

from dovetail.plans import normalise

FILES = "id long, source string, rel_path string, kind string, mime string, exif map<string,string>"


def _file(i, source, path):
    name = path.rsplit("/", 1)[-1]
    kind = "sidecar_json" if name.endswith(".json") else "image"
    return (i, source, path, kind, "image/jpeg" if kind == "image" else "application/json", {"EXIF:Software": "Google"} if i % 2 else {})


@pytest.fixture
def export(spark):
    rows = [_file(i, "TAKEOUT:a", p) for i, p in enumerate(["Trip/x.jpg", "Trip/x.jpg.json", "Trip/x-edited.jpg", "Trip/y.jpg", "Trip/metadata.json", "Photos from 2001/z.jpg", "Photos from 2001/z.jpg.json", "Photos from 2001/gone.jpg.json"])]
    rows += [_file(20 + i, "TAKEOUT:b", p) for i, p in enumerate(["q/r.jpg", "q/r.jpg.json"])]
    texts = [(1, '{"title": "x.jpg", "photoTakenTime": {"timestamp": "0"}, "geoData": {"latitude": 1.5, "longitude": 2}}'), (4, '{"title": "Our trip"}'), (6, "broken"), (21, '{"description": "d"}')]
    return spark.createDataFrame(rows, FILES), spark.createDataFrame(texts, "id long, text string")


def test_tables_and_reruns(spark, tmp_path, export):
    files, texts = export
    c = normalise.tables(spark, str(tmp_path / "n"))
    changed, found = normalise.normalise(c, files, texts, "one")
    assert changed and c.number() == 1
    sidecars = {r.id: r for r in c.read("sidecars").collect()}
    assert sidecars[1].media_id == 0 and sidecars[1].taken.startswith("1970-01-01T00:00:00") and sidecars[1].lat == 1.5
    assert sidecars[6].media_id == 5 and sidecars[6].reason == "parse_error" and sidecars[6].taken is None
    assert sidecars[7].media_id is None and sidecars[7].reason == "no_media_match" and sidecars[21].description == "d"
    assert {(r.media_id, r.album) for r in c.read("albums").collect()} == {(0, "Our trip"), (2, "Our trip"), (3, "Our trip"), (20, "q")}
    assert [(r.edited_id, r.original_id) for r in c.read("edits").collect()] == [(2, 0)]
    assert {r.id for r in c.read("recompressed").collect()} == {3, 5}
    rows = {r.source: r for r in found.collect()}
    assert rows["TAKEOUT:a"].media == 4 and rows["TAKEOUT:a"].unmatched_media == 1 and rows["TAKEOUT:a"].below and not rows["TAKEOUT:b"].below
    made = normalise.normalised(files, texts)
    assert {(r.rel_path, r.reason) for r in normalise.unmatched(files, made).collect()} == {("Trip/y.jpg", "no_sidecar"), ("Photos from 2001/z.jpg.json", "parse_error"), ("Photos from 2001/gone.jpg.json", "no_media_match")}
    decisions = c.read("decisions").count()
    assert normalise.normalise(c, files, texts, "two")[0] is False and c.number() == 1
    # one source anew: the other's rows stay, decisions are added
    less = files.where("rel_path <> 'q/r.jpg.json'")
    assert normalise.normalise(c, less, texts, "three", sources=["TAKEOUT:b"])[0] and c.number() == 2
    assert {r.id for r in c.read("sidecars").collect()} == {1, 6, 7} and c.read("decisions").count() == decisions


def test_all_or_nothing(spark, tmp_path, export):
    files, texts = export
    c = normalise.tables(spark, str(tmp_path / "n"))
    bad = files.unionByName(spark.createDataFrame([(None, "TAKEOUT:b", "q/s.jpg", "image", "image/jpeg", {"EXIF:Software": "google"})], FILES))
    with pytest.raises(ValueError):
        normalise.normalise(c, bad, texts, "one")
    assert c.number() == 0 and c.read("sidecars") is None
    with pytest.raises(ValueError):
        normalise.normalise(c, files, texts, "one", sources=["TAKEOUT:none"])


def test_sidecars_that_stand_in_one_file_are_dealt(spark, export, monkeypatch):
    files, texts = export
    kept, stash = {}, normalise.shared.stash
    monkeypatch.setattr(normalise.shared, "stash", lambda df, name: kept.setdefault(name, stash(df, name)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        normalise.normalised(files.coalesce(1), texts)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert kept["placed"].where("kind = 'sidecar_json'").select(F.input_file_name()).distinct().count() > 1
