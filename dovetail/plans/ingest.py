"""The first stage: a scan of a source, compared with what is known of it, becomes rows of the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dovetail.functions import metadata, names
from dovetail.sources import files, store

KEYS = ["source", "rel_path"]


def described(fresh: DataFrame, contents: DataFrame, dumps: DataFrame) -> DataFrame:
    """``fresh`` (source, rel_path, size_bytes, modified) with content hash, kind, typed metadata, flags, and ``dated``: the camera's date or else
    the first creation date that can be read (``from_create_date``).

    ``contents`` (source, rel_path, sha256, and where pictures and clips were decoded: decoded, video_flag), ``dumps`` (source, rel_path, dump). Files
    without either stay, with nulls.
    """
    for name, default in (("decoded", F.lit(True)), ("video_flag", F.lit(None).cast("string"))):
        contents = contents if name in contents.columns else contents.withColumn(name, default)
    read = fresh.join(contents.select(*KEYS, "sha256", "decoded", "video_flag"), KEYS, "left").join(dumps.select(*KEYS, "dump"), KEYS, "left")
    f = metadata.fields(F.col("dump"))
    rows = read.withColumns({k: f[k] for k in ("mime", "exif_dto", "gps_lat", "gps_lon", "camera_make", "camera_model", "tags", "width", "height", "error")})
    dated = metadata.exif_candidate(F.col("exif_dto"), F.col("dump"))
    rows = rows.withColumns({"kind": names.kind(F.col("mime"), F.col("rel_path")), "dated": dated["date"], "from_create_date": dated["from_create_date"]})
    error = F.coalesce("error", F.when(F.col("dump").isNull(), "no dump"))
    flags = names.file_flags(F.col("mime"), F.col("kind"), F.col("size_bytes"), error, F.coalesce("decoded", F.lit(True)), F.col("video_flag"))
    return rows.withColumn("flags", flags).drop("dump", "error", "decoded", "video_flag")


def ingested(known: DataFrame, scan: DataFrame, contents: DataFrame, dumps: DataFrame) -> DataFrame:
    """The inventory after a scan: only what is new or changed is described, what is known and unchanged, or gone from the source, stays."""
    return store.upsert(known, described(files.changed(scan, known), contents, dumps), KEYS)


def summary(known: DataFrame, scan: DataFrame) -> DataFrame:
    """source, discovered, processed, unchanged, missing of every source that was scanned."""
    seen = scan.select(*KEYS, F.lit(True).alias("there"))
    fresh = files.changed(scan, known).select(*KEYS, F.lit(True).alias("fresh"))
    old = known.select(*KEYS, F.lit(True).alias("was")).join(scan.select("source").distinct(), "source", "left_semi")
    joined = seen.join(fresh, KEYS, "left").join(old, KEYS, "full")
    return joined.groupBy("source").agg(
        F.count("there").alias("discovered"),
        F.count("fresh").alias("processed"),
        (F.count("there") - F.count("fresh")).alias("unchanged"),
        F.count_if(F.col("there").isNull()).alias("missing"),
    )
