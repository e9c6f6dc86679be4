"""Where every file goes: dispositions, destinations, keywords, and the assignments written beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dovetail.functions import dates, names, paths


def archive_path(date: Column, precision: Column, undated: str, path: Column, sha256: Column, bucket: Column) -> Column:
    """``year/year-month/stem__sha8.ext``; year precision goes to the year, and no date to the bucket or ``undated``."""
    name = F.concat(paths.stem(path), F.lit("__"), F.substring(sha256, 1, 8), F.lower(paths.ext(path)))
    year = F.substring(date, 1, 4)
    return F.when(date.isNull(), F.concat_ws("/", F.coalesce(bucket, F.lit(undated)), name)).when(precision == "year", F.concat_ws("/", year, name)).otherwise(F.concat_ws("/", year, F.substring(date, 1, 7), name))


def quarantine_path(sha256: Column, path: Column) -> Column:
    return F.concat(F.substring(sha256, 1, 2), F.lit("/"), sha256, F.lit("__"), paths.basename(path))


def plan(media: DataFrame, undated: str = "undated", quarantine_edits: bool = False) -> DataFrame:
    """``media`` with disposition, reason, dest_rel_path, use_sidecar and winner_dest, by the first rule that applies.

    ``media``: id, kind, flags, rel_path, sha256, mime, role, cluster_id, edited (itself or its cluster), resolved_date,
    resolved_precision, bucket. ``edited`` is read only where edits go to quarantine.
    """
    broken = F.arrays_overlap("flags", F.array(F.lit("corrupt"), F.lit("zero_byte")))
    edit = F.col("edited") if quarantine_edits else F.lit(False)
    reason = (
        F.when(F.col("kind") == "sidecar_json", "takeout_sidecar")
        .when(F.col("kind") == "other", "non_media")
        .when(F.col("kind") == "sidecar_xmp", "prior_xmp_sidecar")
        .when(broken, "corrupt")
        .when(F.col("role") == "loser", "cluster_loser")
        .when(edit, "edited_version")
        .otherwise(F.coalesce("role", F.lit("singleton")))
    )
    disposition = F.when(F.col("reason").isin("takeout_sidecar", "non_media"), "excluded").when(F.col("reason").isin("prior_xmp_sidecar", "corrupt", "cluster_loser", "edited_version"), "quarantine").otherwise("archive")
    dest = F.when(F.col("disposition") == "archive", archive_path(F.col("resolved_date"), F.col("resolved_precision"), undated, F.col("rel_path"), F.col("sha256"), F.col("bucket"))).when(F.col("disposition") == "quarantine", quarantine_path(F.col("sha256"), F.col("rel_path")))
    placed = media.withColumn("reason", reason).withColumn("disposition", disposition).withColumn("dest_rel_path", dest)
    placed = placed.withColumn("use_sidecar", (F.col("disposition") == "archive") & ~F.coalesce(F.col("mime").isin(names.SAFE_WRITE_TYPES), F.lit(False)))
    winners = placed.where((F.col("disposition") == "archive") & (F.col("role") == "winner")).select("cluster_id", F.col("dest_rel_path").alias("winner_dest"))
    in_cluster = F.col("reason").isin("cluster_loser", "edited_version")
    return placed.join(winners, "cluster_id", "left").withColumn("winner_dest", F.when(in_cluster, F.col("winner_dest")))


def quarantine_index(placed: DataFrame) -> DataFrame:
    """A row for each quarantined content: its path, sources in order, and the reason and winner of the first."""
    first = F.struct("source", "rel_path", "id")
    rows = placed.where("disposition = 'quarantine'")
    return rows.groupBy("sha256").agg(
        F.min_by("dest_rel_path", first).alias("dest_rel_path"),
        F.array_sort(F.collect_list(F.concat_ws(":", "source", "rel_path"))).alias("sources"),
        F.min_by("reason", first).alias("reason"),
        F.min_by("winner_dest", first).alias("winner_dest"),
    )


def map_keywords(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """``rows`` (id, keywords) with each keyword replaced by its map's; unmapped ones stay, those mapped to null go."""
    said = mapping.select(F.col("folder_name").alias("raw"), F.col("keyword"), F.lit(True).alias("mapped"))
    each = rows.select("id", F.explode("keywords").alias("raw")).join(said, "raw", "left")
    kept = each.select("id", F.when(F.col("mapped"), F.col("keyword")).otherwise(F.col("raw")).alias("keyword")).where("keyword is not null")
    sets = kept.groupBy("id").agg(F.array_sort(F.collect_set("keyword")).alias("keywords"))
    return rows.select("id").join(sets, "id", "left").select("id", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))


def _assign(tag: str, value: Column) -> Column:
    return F.concat(F.lit(f"-{tag}="), value)


def metadata_assignments(rows: DataFrame, namespace: str = "XMP-pipeline") -> DataFrame:
    """id, args: the assignments of one archived file (resolved_*, gps_*, description, keywords, rating, merged_from, source, rel_path)."""
    stamp = dates.padded_exif(F.col("resolved_date"))
    place = F.col("gps_lat").isNotNull() & F.col("gps_lon").isNotNull()
    single = [
        *(_assign(t, stamp) for t in ("DateTimeOriginal", "CreateDate", "ModifyDate")),
        F.when(place, _assign("GPSLatitude", F.abs("gps_lat").cast("string"))),
        F.when(place, _assign("GPSLatitudeRef", F.when(F.col("gps_lat") >= 0, "N").otherwise("S"))),
        F.when(place, _assign("GPSLongitude", F.abs("gps_lon").cast("string"))),
        F.when(place, _assign("GPSLongitudeRef", F.when(F.col("gps_lon") >= 0, "E").otherwise("W"))),
        _assign("XMP-dc:Description", F.nullif(F.col("description"), F.lit(""))),
    ]
    later = [_assign("XMP:Rating", F.col("rating").cast("string")), _assign(f"{namespace}:DateSource", F.col("resolved_source")), _assign(f"{namespace}:DatePrecision", F.col("resolved_precision"))]
    args = F.concat(
        F.array_compact(F.array(*single)),
        F.transform("keywords", lambda k: F.concat(F.lit("-XMP-dc:Subject+="), k)),
        F.array_compact(F.array(*later)),
        F.transform("merged_from", lambda m: F.concat(F.lit(f"-{namespace}:MergedFrom+="), m)),
        F.array(_assign(f"{namespace}:SourcePath", F.concat_ws(":", "source", "rel_path"))),
    )
    return rows.select("id", args.alias("args"))


def sidecar_assignments(rows: DataFrame, namespace: str = "XMP-pipeline") -> DataFrame:
    """id, args: what a curated file's sidecar gets (date, precision, bucket, keywords, original_date). Keywords go before they are added."""
    stamp = dates.padded_exif(F.col("date"))
    dated = F.array_compact(F.array(*(_assign(t, stamp) for t in ("DateTimeOriginal", "CreateDate", "ModifyDate")), _assign(f"{namespace}:DatePrecision", F.col("precision"))))
    coarse = F.array_compact(F.array(_assign(f"{namespace}:DatePrecision", F.concat(F.lit("bucket:"), F.col("bucket")))))
    subjects = F.when(F.col("bucket").isNotNull() & ~F.array_contains("keywords", F.col("bucket")), F.array_append("keywords", F.col("bucket"))).otherwise(F.col("keywords"))
    each = F.flatten(F.transform(subjects, lambda k: F.array(F.concat(F.lit("-XMP-dc:Subject-="), k), F.concat(F.lit("-XMP-dc:Subject+="), k))))
    args = F.concat(F.when(F.col("date").isNotNull(), dated).otherwise(coarse), F.array_compact(F.array(_assign(f"{namespace}:OriginalDate", F.col("original_date")))), each, F.array(F.lit(f"-{namespace}:DateSource=folder_move")))
    return rows.select("id", args.alias("args"))


def space_needed(placed: DataFrame, margin_percent: float = 15.0) -> DataFrame:
    """Bytes to copy: of what is archived, and of one file of each quarantined content; and with the margin."""
    quarantined = placed.where("disposition = 'quarantine'").groupBy("sha256").agg(F.min_by("size_bytes", F.struct("source", "rel_path", "id")).alias("size_bytes"))
    each = placed.where("disposition = 'archive'").select("size_bytes", F.lit(True).alias("archive")).unionByName(quarantined.select("size_bytes", F.lit(False).alias("archive")))
    of = lambda archive: F.coalesce(F.sum(F.when(F.col("archive") == archive, F.col("size_bytes"))), F.lit(0))
    sums = each.agg(of(True).alias("archive_bytes"), of(False).alias("quarantine_bytes"))
    need = (F.col("archive_bytes") + F.col("quarantine_bytes")) * (1 + margin_percent / 100)
    return sums.select("archive_bytes", "quarantine_bytes", need.cast("bigint").alias("required_bytes"))


def purge_plan(ledger: DataFrame, report: DataFrame) -> DataFrame:
    """id, dest_rel_path, size_bytes of what is in quarantine, once the last report (passed) is one that passed; raises otherwise."""
    passed = [r.passed for r in report.select("passed").limit(2).collect()]
    if passed != [True]:
        raise ValueError("quarantine is purged only after a verification that passed")
    return ledger.where("disposition = 'quarantine' and dest_rel_path is not null").select("id", "dest_rel_path", "size_bytes")
