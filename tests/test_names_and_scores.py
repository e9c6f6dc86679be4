import pytest
from pyspark.sql import functions as F

from dovetail.functions import names, paths, scoring
from dovetail.operators import linkage, reconcile


def _call(spark, f, *values):
    kinds = {str: "string", int: "int", float: "double", bool: "boolean", type(None): "string"}
    schema = ", ".join(f"c{i} {kinds[type(v)]}" for i, v in enumerate(values))
    return spark.createDataFrame([values], schema).select(f(*(F.col(f"c{i}") for i in range(len(values)))).alias("r")).first().r


@pytest.mark.parametrize("a, b, d", [("00", "03", 2), ("ff", "ff", 0), ("ffffffffffffffff", "0000000000000000", 64), ("00", None, None), ("", "", None), ("0", "00", None)])
def test_hamming(spark, a, b, d):
    assert _call(spark, scoring.hamming, a, b) == d


@pytest.mark.parametrize("shape, close", [((1920, 1080, 1280, 720), True), ((1920, 1080, 1080, 1080), False), ((0, 1080, 1, 1), False), ((4000, 3000, 4000, 3010), True)])
def test_aspect(spark, shape, close):
    assert _call(spark, scoring.aspect_close, *shape) is close


def test_pinned_score(spark):
    df = spark.createDataFrame([("a.jpg", 4000, 3000, 5_000_000, 60)], "p string, w int, h int, s int, t int")
    parts = scoring.score_parts(F.col("p"), F.col("w"), F.col("h"), F.col("s"), F.col("t"), F.lit(True), F.lit(True), F.lit(False))
    row = df.select(*(F.round(c, 4).alias(k) for k, c in parts.items())).first()
    assert row.asDict() == {"resolution": 10.7549, "format": 1.5, "richness": 1.0, "trusted_date": 1.0, "source_trust": 0.75, "size": 3.3495, "recompression": 0.0}


@pytest.mark.parametrize("a, b, same", [("10s:1920x1080:00:00:00", "10s:1280x720:00:00:00", True), ("10s:1920x1080:00:00:00", "12s:1280x720:00:00:00", False), ("10s:1920x1080:00:?:00", "11s:1920x1080:00:00:ff", False), ("x", "10s:1920x1080:00:00:00", False)])
def test_videos(spark, a, b, same):
    assert _call(spark, lambda x, y: scoring.videos_similar(scoring.video_signature(x), scoring.video_signature(y)), a, b) is same


@pytest.mark.parametrize("name, wanted", [("IMG_1234.JPG.json", ("IMG_1234.JPG", None)), ("IMG_1234.JPG.supplemental-metadata.json", ("IMG_1234.JPG", None)), ("IMG_1234.JPG.supp.json", ("IMG_1234.JPG", None)), ("IMG_1234.JPG(1).json", ("IMG_1234.JPG", 1)), ("metadata.json", None), ("metadata(2).json", None), ("a.jpg", None)])
def test_sidecar_name(spark, name, wanted):
    got = _call(spark, names.sidecar_name, name)
    assert (got and tuple(got)) == wanted


@pytest.mark.parametrize("name, wanted", [("IMG_1234-edited.JPG", "IMG_1234.JPG"), ("IMG_1234.JPG", None), ("-edited.jpg", None)])
def test_edited(spark, name, wanted):
    assert _call(spark, names.edited_original, name) == wanted


@pytest.mark.parametrize("path, wanted", [("a/b.JPG", ("b", ".JPG")), ("a/.hidden", (".hidden", "")), ("a/b.tar.gz", ("b.tar", ".gz")), ("noext", ("noext", "")), ("a.b/c", ("c", ""))])
def test_stem_and_ext(spark, path, wanted):
    assert (_call(spark, paths.stem, path), _call(spark, paths.ext, path)) == wanted


MATCHES = [
    (["a.jpg.json"], ["a.jpg"], {"a.jpg.json": ("a.jpg", "exact", None)}),
    (["a.jpg.suppl.json"], ["a.jpg"], {"a.jpg.suppl.json": ("a.jpg", "exact", None)}),
    (["long_na.json"], ["long_name.jpg"], {"long_na.json": ("long_name.jpg", "truncation", None)}),
    (["long.json"], ["long1.jpg", "long2.jpg"], {"long.json": (None, "unmatched", "ambiguous_truncation")}),
    (["a.jpg(1).json"], ["a.jpg", "a(1).jpg"], {"a.jpg(1).json": ("a(1).jpg", "numbered", None)}),
    (["a.jpg(1).json"], ["a.jpg"], {"a.jpg(1).json": (None, "unmatched", "no_media_match")}),
    (["b.jpg.json", "metadata.json"], ["a.jpg"], {"b.jpg.json": (None, "unmatched", "no_media_match")}),
]


@pytest.mark.parametrize("sidecars, media, wanted", MATCHES)
def test_match(spark, sidecars, media, wanted):
    s = spark.createDataFrame([("d", j) for j in sidecars], "dir string, json_name string")
    m = spark.createDataFrame([("d", x) for x in media] + [("other", "b.jpg")], "dir string, media_name string")
    assert {r.json_name: (r.media_name, r.method, r.reason) for r in linkage.match_sidecars(s, m).collect()} == wanted


@pytest.mark.parametrize(
    "path, wanted",
    [("2005/2005-01/x.jpg", ("2005-01-01", "month", None, [])), ("caves/2006/x.jpg", ("2006-01-01", "year", None, ["caves"])), ("2004-2006/x.jpg", (None, None, "2004-2006", [])), ("undated/x.jpg", (None, None, "undated", [])), ("x.jpg", (None, None, None, []))],
)
def test_intent(spark, path, wanted):
    assert tuple(_call(spark, reconcile.intent, path)) == wanted
