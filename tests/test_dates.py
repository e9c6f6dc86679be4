import pytest
from pyspark.sql import functions as F

from dovetail.functions import dates


def _one(spark, value, column):
    row = spark.createDataFrame([(value,)], "p string").select(column(F.col("p")).alias("r")).first().r
    return tuple(row) if row is not None and not isinstance(row, str) else row


FOLDERS = {
    "1998/beach.jpg": ("1998-01-01", "year"),
    "2003-07/park.jpg": ("2003-07-01", "month"),
    "2010-06-15_wedding/w.jpg": ("2010-06-15", "day"),
    "2010_wedding/w.jpg": ("2010-01-01", "year"),
    "20100615_wedding/w.jpg": ("2010-06-15", "day"),
    "Photos from 2015/a.jpg": ("2015-01-01", "year"),
    "1998/1998-07/a.jpg": ("1998-07-01", "month"),
    "2010/event_20100715/a.jpg": ("2010-07-15", "day"),
    "Europe_2010/a.jpg": ("2010-01-01", "year"),
    "2005?/a.jpg": ("2005-01-01", "year"),
    "200804_SanFrancisco/a.jpg": ("2008-04-01", "month"),
    "card-telling_20060624/v.mp4": ("2006-06-24", "day"),
    "2010-02-31/a.jpg": None,
    "2004-2009/a.jpg": None,
    "scans/1998.jpg": None,
    "id_20069999/a.jpg": None,
    "batch_00012345/a.jpg": None,
}
NAMES = {
    "IMG_20150418_093000.jpg": ("2015-04-18T09:30:00", "second"),
    "PXL_20220101_120000123.jpg": ("2022-01-01T12:00:00", "second"),
    "IMG-20150418-WA0001.jpg": ("2015-04-18", "day"),
    "IMG00063-20101121-1633.jpg": ("2010-11-21", "day"),
    "2016-08-16 22.20.21.jpg": ("2016-08-16T22:20:21", "second"),
    "2016-08-16T09-05-00_edit.jpg": ("2016-08-16T09:05:00", "second"),
    "2016-08-16_note.jpg": ("2016-08-16", "day"),
    "2001-09_Palisades-NJ_b.JPG": ("2001-09-01", "month"),
    "200804_SanFrancisco_DSCN0200.JPG": ("2008-04-01", "month"),
    "family_trip_200704_event_20070408_PD(10).JPG": ("2007-04-08", "day"),
    "20040904_tokyo.jpg": ("2004-09-04", "day"),
    "scan001.jpg": None,
    "IMG_20151340_000000.jpg": None,
    "20991340.jpg": None,
    "serial_120070408.jpg": None,
    "12345678.jpg": None,
    "2016-13-01.jpg": None,
    "209913_x.jpg": None,
    "20040904_to_20090926_01003.jpg": None,
    "2004_to_2009_batch.jpg": None,
}


@pytest.mark.parametrize("path", FOLDERS)
def test_folder(spark, path):
    assert _one(spark, path, dates.folder_candidate) == FOLDERS[path]


@pytest.mark.parametrize("name", NAMES)
def test_filename(spark, name):
    assert _one(spark, f"x/{name}", dates.filename_candidate) == NAMES[name]


@pytest.mark.parametrize(
    "text, iso",
    [("1998:07:12 14:33:05", "1998-07-12T14:33:05"), ("2015:04:18 09:30:00+02:00", "2015-04-18T09:30:00+02:00"), ("2015:04:18 09:30:00.25Z", "2015-04-18T09:30:00.25+00:00"), ("0000:00:00 00:00:00", None), ("soon", None), (None, None)],
)
def test_exif(spark, text, iso):
    assert _one(spark, text, dates.exif_to_iso) == iso


CASES = [  # exif, trusted, folder, precision, curated, takeout, artifact, filename, filename precision -> date, precision, source, rule
    (("1998-07-12T14:33:05", True, "1998-01-01", "year", True, None, False, None, None), ("1998-07-12T14:33:05", "second", "exif", "R1")),
    (("2005-07-12T14:33:05", True, "1998-01-01", "year", True, None, False, None, None), (None, None, None, "R6")),
    (("2005-07-12T14:33:05", True, "1998-01-01", "year", False, None, False, None, None), ("2005-07-12T14:33:05", "second", "exif", "R2")),
    (("2000-01-01T00:00:00", False, "2003-07-01", "month", True, None, False, None, None), ("2003-07-01", "month", "folder", "R3")),
    ((None, True, "2003-01-01", "year", True, None, False, "2003-09-16", "day"), ("2003-09-16", "day", "filename", "R3f")),
    ((None, True, "2003-01-01", "year", True, None, False, "2004-09-16", "day"), (None, None, None, "R3c")),
    ((None, True, "2015-01-01", "year", False, "2015-04-18T12:00:00", False, None, None), ("2015-04-18T12:00:00", "second", "takeout_json", "R4")),
    ((None, True, "2015-01-01", "year", False, "2015-04-18T12:00:00", True, None, None), ("2015-01-01", "year", "folder", "R4b")),
    ((None, True, "2015-01-01", "year", False, None, None, "2004-09-16", "day"), ("2004-09-16", "day", "filename", "R4bf")),
    ((None, True, None, None, False, None, None, "2004-09-16", "day"), ("2004-09-16", "day", "filename", "R5")),
    ((None, True, None, None, False, None, None, None, None), (None, None, None, "R7")),
]


@pytest.mark.parametrize("given, wanted", CASES)
def test_rules(spark, given, wanted):
    row = spark.createDataFrame([given], "e string, t boolean, f string, fp string, c boolean, k string, a boolean, n string, np string")
    got = row.select(dates.resolve(*(F.col(c) for c in ("e", "t", "f", "fp", "c", "k", "a", "n", "np"))).alias("r")).first().r
    assert (got.date, got.precision, got.source, got.rule) == wanted
    assert got.status == ("conflict" if wanted[3] in ("R6", "R3c", "R7") else "auto")


@pytest.mark.parametrize("text, wanted", [("2000", ("2000-01-01", "year")), ("2000-12", ("2000-12-01", "month")), (" 2000-12-24 ", ("2000-12-24", "day")), ("2000-12-24T21:34:13", ("2000-12-24T21:34:13", "second")), ("2001-02-30", None), ("x", None)])
def test_manual(spark, text, wanted):
    assert _one(spark, text, dates.manual_date) == wanted


@pytest.mark.parametrize("text, wanted", [("pre-2000", "pre-2000"), ("2004-2009", "2004-2009"), ("2009-2004", None), ("2004", None)])
def test_bucket(spark, text, wanted):
    assert _one(spark, text, dates.coarse_bucket) == wanted


def test_running_numbers_are_no_dates(spark):
    from pyspark.sql import functions as F

    from dovetail import queries
    from dovetail.functions import dates

    names = ["d/scan_x199001.jpg", "d/DSC_x20080415.DNG", "d/a_200804_b_x199001.jpg", "d/2001-02-03 pic_x200001.jpg"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    got = [r.d for r in df.select(dates.filename_candidate(F.col("p"), serial=queries._SERIAL)["date"].alias("d")).collect()]
    assert got == [None, None, "2008-04-01", "2001-02-03"]
    # without a pattern of running numbers, digits count as before
    assert df.limit(1).select(dates.filename_candidate(F.col("p"))["date"].alias("d")).first().d == "1990-01-01"


def test_raws_of_the_query_have_one_picture_of_their_name(spark):
    from dovetail import queries
    from dovetail.functions import paths
    from pyspark.sql import functions as F

    base = spark.range(0, 8000).select("id", F.lit("image").alias("kind"), F.lit("").alias("rel_path"), F.lit("").alias("exif_dto"))
    saved, queries.instances = queries.instances, lambda s, d: base
    try:
        rows = queries._raws(spark, "")
        assert rows.groupBy("rel_path").count().where("count > 1").isEmpty()
    finally:
        queries.instances = saved
