"""Merged facts of clusters in what is written into files."""

from dovetail.plans import archive

MEDIA = "id long, source string, rel_path string, gps_lat double, gps_lon double, side_lat double, side_lon double, description string, resolved_date string, resolved_precision string, resolved_source string"


def test_winners_take_their_clusters_facts(spark):
    rows = [
        (1, "s", "Caves/a.jpg", None, None, None, None, "own", None, None, None),
        (2, "s", "x/b.jpg", None, None, 5.0, 6.0, "", "2001-01-01", "day", "filename"),
        (3, "s", "Caves/c-edited.jpg", 1.0, 2.0, 9.0, 9.0, None, None, None, None),
        (4, "s", "Caves/c.jpg", 1.0, None, None, None, "alone", None, None, None),
    ]
    media = spark.createDataFrame(rows, MEDIA)
    people = spark.createDataFrame([(1, 1, "winner"), (1, 2, "loser")], "cluster_id long, id long, role string")
    clusters = spark.createDataFrame(
        [(1, 1, 7.0, 8.0, "takeout", ["d1", "d2"], ["Caves", "Album", "drop"], ["s:Caves/a.jpg", "s:x/b.jpg"], "2002-02-02", "day", "exif")],
        "cluster_id long, winner_id long, lat double, lon double, gps_source string, descriptions array<string>, keywords array<string>, merged_from array<string>, date string, precision string, source string",
    )
    keyword_map = spark.createDataFrame([("Caves", "caving"), ("drop", None)], "keyword string, mapped string")
    albums = spark.createDataFrame([(1, "Album"), (4, "Trip")], "id long, album string")
    got = {r.id: r for r in archive.facts(media, people, clusters, albums=albums, keyword_map=keyword_map).collect()}
    assert (got[1].gps_lat, got[1].gps_lon, got[1].gps_flagged) == (7.0, 8.0, True) and got[1].description == "d1; d2"
    assert got[1].keywords == ["Album", "caving"] and got[1].merged_from == ["s:Caves/a.jpg", "s:x/b.jpg"] and got[1].rating is None
    assert (got[2].gps_lat, got[2].gps_flagged, got[2].description, got[2].merged_from) == (5.0, True, None, [])
    assert (got[3].gps_lat, got[3].gps_flagged, got[3].rating) == (1.0, False, 4) and got[3].keywords == ["caving", "edited-preferred"]
    assert got[4].gps_lat is None and got[4].keywords == ["Trip", "caving", "has-edit"] and got[4].description == "alone"
    args = {r.id: r.args for r in archive.assignments(media, people, clusters, albums=albums, keyword_map=keyword_map).collect()}
    assert set(args) == {1, 3, 4} and "-DateTimeOriginal=2002:02:02 00:00:00" in args[1] and "-XMP-dc:Subject+=caving" in args[1]
    assert "-XMP:Rating=4" in args[3] and "-XMP-pipeline:MergedFrom+=s:x/b.jpg" in args[1]
