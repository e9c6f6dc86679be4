"""Hand edits read back: files that moved, went, came back or are new, and what a new folder says about a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dovetail.functions import dates, names, paths

#: Folders without a date of their own.
BUCKETS = ["undated", "pre-2000"]
YEAR_RANGE = r"^(19|20)\d{2}\s*-\s*(19|20)\d{2}$"


def moves(placed: DataFrame, disk: DataFrame) -> DataFrame:
    """id, old_rel, new_rel: recorded files that are missing, and the first unrecorded file of the same name."""
    missing = placed.select("id", F.col("rel").alias("old_rel"), paths.basename(F.col("rel")).alias("name")).join(disk.select(F.col("rel").alias("old_rel")), "old_rel", "left_anti")
    fresh = disk.select("rel").join(placed.select("rel"), "rel", "left_anti").groupBy(paths.basename(F.col("rel")).alias("name")).agg(F.min("rel").alias("new_rel"))
    return missing.join(fresh, "name").select("id", "old_rel", "new_rel")


def losses(placed: DataFrame, disk: DataFrame, moved: DataFrame, trash: DataFrame, elsewhere: DataFrame) -> DataFrame:
    """id, rel, state of recorded files that are neither there nor moved: removed (in the trash), exported (elsewhere), unaccounted."""
    gone = placed.select("id", "rel").join(disk.select("rel"), "rel", "left_anti").join(moved.select("id"), "id", "left_anti")
    in_trash = trash.select(F.col("original_rel").alias("rel"), F.lit(True).alias("trashed")).distinct()
    found = elsewhere.groupBy(paths.basename(F.col("rel")).alias("name")).agg(F.min("rel").alias("found"))
    joined = gone.join(in_trash, "rel", "left").withColumn("name", paths.basename(F.col("rel"))).join(found, "name", "left")
    return joined.select("id", "rel", F.when(F.col("trashed"), "removed").when(F.col("found").isNotNull(), "exported").otherwise("unaccounted").alias("state"))


def restorations(ledger: DataFrame, disk: DataFrame) -> DataFrame:
    """Files recorded as gone that are back in their place."""
    return ledger.where("disposition in ('removed', 'exported')").select("id", F.col("dest_rel_path").alias("rel")).join(disk.select("rel"), "rel", "left_semi").select("id", "rel")


def unknown(placed: DataFrame, disk: DataFrame, moved: DataFrame) -> DataFrame:
    """rel, kind (sidecar or media) of files on disk that nothing accounts for."""
    known = placed.select(F.explode(F.array("rel", F.concat("rel", F.lit(".xmp")))).alias("rel")).union(moved.select("new_rel"))
    return disk.select("rel").join(known, "rel", "left_anti").select("rel", F.when(F.endswith("rel", F.lit(".xmp")), "sidecar").otherwise("media").alias("kind"))


def intent(path: Column, patterns: tuple[str, ...] = dates.FOLDER_PATTERNS, buckets: list[str] = BUCKETS) -> Column:
    """struct(date, precision, bucket, keywords): what the folders of a path say."""
    parts = paths.components(path)
    coarse = lambda c: c.isin(buckets) | c.rlike(YEAR_RANGE)
    kept = F.filter(parts, lambda c: ~coarse(c) & (c != ""))
    rest = F.when(F.size(kept) > 0, F.concat(F.array_join(kept, "/"), F.lit("/"), paths.basename(path)))
    found = dates.folder_candidate(rest, patterns)
    said = F.coalesce(names.keywords(rest, patterns), F.array().cast("array<string>"))
    return F.struct(found["date"].alias("date"), found["precision"].alias("precision"), F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(parts, coarse)), -1).alias("bucket"), said.alias("keywords"))


def date_action(date: Column, precision: Column, bucket: Column, old: Column) -> Column:
    """keep, correct or demote: what a file's new place means for its date."""
    return (
        F.when(date.isNull(), F.when(bucket.isNotNull() & old.isNotNull(), "demote").otherwise("keep"))
        .when(old.isNull(), "correct")
        .when(dates.contains(date, precision, old), "keep")
        .otherwise("correct")
    )
