"""Review: queues of what is undecided, and bulk decisions as updates of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dovetail.functions import dates


def date_queue(inventory: DataFrame, resolutions: DataFrame, members: DataFrame, merged: DataFrame, skipped: bool = False) -> DataFrame:
    """Conflicts that a duplicate cluster has not settled: neither a loser, nor a winner with a merged date.

    ``resolutions`` (id, status, skipped), ``members`` (id, cluster_id, role), ``merged`` (cluster_id, merged_json).
    """
    wanted = resolutions.where((F.col("status") == "conflict") & (F.coalesce("skipped", F.lit(False)) == skipped))
    queue = inventory.join(wanted.select("id"), "id", "left_semi")
    if skipped:
        return queue
    dated = F.get_json_object("merged_json", "$.date.date").isNotNull()
    settled = members.join(merged, "cluster_id", "left").where((F.col("role") == "loser") | ((F.col("role") == "winner") & dated))
    return queue.join(settled, "id", "left_anti")


def camera_window(inventory: DataFrame, seconds: int = 3600, most: int = 10) -> DataFrame:
    """id, other_id, gap: up to ``most`` files of the same camera within the window, nearest first, ties to the smaller id.

    Files of one camera and second go together. Of each second only the first ``most`` + 1 by id can be among anyone's nearest, and of
    the seconds only the ``most`` next on each side, so nothing is paired with all there is; a task holds at most the distinct seconds
    of three windows of a camera.
    """
    at = F.unix_timestamp(F.try_to_timestamp(F.substring("exif_dto", 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    rows = inventory.select("id", "camera_model", at.alias("at")).where("at is not null and camera_model is not null")
    by_id = Window.partitionBy("camera_model", "at").orderBy("id")
    few = rows.withColumn("rn", F.row_number().over(by_id)).where(F.col("rn") <= most + 1)
    times = few.groupBy("camera_model", "at").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    step = F.floor(F.col("at") / seconds)
    spread = times.withColumn("shift", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("bucket", step + F.col("shift"))
    around = Window.partitionBy("camera_model", "bucket").orderBy("at").rowsBetween(-most, most)
    seen = spread.withColumn("near", F.collect_list(F.struct("at", "ids")).over(around)).where("shift = 0")
    others = F.flatten(F.transform("near", lambda t: F.transform(t["ids"], lambda i: F.struct(F.abs(t["at"] - F.col("at")).alias("gap"), i.alias("other_id")))))
    nearest = F.slice(F.array_sort(F.filter(others, lambda o: o["gap"] <= seconds)), 1, most + 1)
    of_time = seen.select("camera_model", "at", nearest.alias("nearest"))
    mine = F.slice(F.filter("nearest", lambda o: o["other_id"] != F.col("id")), 1, most)
    return rows.join(of_time, ["camera_model", "at"]).select("id", F.explode(mine).alias("o")).select("id", "o.other_id", "o.gap")


def set_dates(resolutions: DataFrame, chosen: DataFrame) -> DataFrame:
    """``resolutions`` with typed dates (id, entered) in place; what is no date leaves its row as it was."""
    parsed = chosen.select("id", dates.manual_date(F.col("entered")).alias("m")).where(F.col("m").isNotNull())
    joined = resolutions.join(parsed, "id", "left")
    hit = F.col("m").isNotNull()
    new = {"resolved_date": F.when(hit, F.col("m.date")).otherwise(F.col("resolved_date")), "resolved_precision": F.when(hit, F.col("m.precision")).otherwise(F.col("resolved_precision")), "resolved_source": F.when(hit, "review").otherwise(F.col("resolved_source")), "status": F.when(hit, "reviewed").otherwise(F.col("status"))}
    return joined.withColumns(new).select(*resolutions.columns)


def accept_candidate(resolutions: DataFrame, chosen: DataFrame) -> DataFrame:
    """``resolutions`` (with cand_exif, cand_folder, cand_takeout, cand_filename, folder_precision) with the candidate named in ``chosen`` (id, which)."""
    joined = resolutions.join(chosen.select("id", "which"), "id", "left")
    which = F.col("which")
    date = F.when(which == "exif", F.col("cand_exif")).when(which == "folder", F.col("cand_folder")).when(which == "takeout_json", F.col("cand_takeout")).when(which == "filename", F.col("cand_filename"))
    precision = F.when(which == "folder", F.col("folder_precision")).when((which == "filename") & ~F.contains("cand_filename", F.lit("T")), "day").otherwise("second")
    hit = date.isNotNull()
    new = {"resolved_date": F.when(hit, date).otherwise(F.col("resolved_date")), "resolved_precision": F.when(hit, precision).otherwise(F.col("resolved_precision")), "resolved_source": F.when(hit, which).otherwise(F.col("resolved_source")), "status": F.when(hit, "reviewed").otherwise(F.col("status"))}
    return joined.withColumns(new).select(*resolutions.columns)


#: Candidates that a whole folder can be given.
BATCH_CANDIDATES = {"folder": ("cand_folder", "folder"), "exif": ("cand_exif", "exif"), "filename": ("cand_filename", "filename")}


def batch_accept(resolutions: DataFrame, folder: DataFrame, which: str) -> DataFrame:
    """``resolutions`` where every conflict among the rows of ``folder`` (id) that has the candidate ``which`` takes it; others stay.

    What a folder says keeps its precision, a day where it has none; other dates are to the second where they have a time.
    """
    if which not in BATCH_CANDIDATES:
        raise ValueError(f"unknown batch action: {which}")
    column, source = BATCH_CANDIDATES[which]
    date = F.nullif(F.col(column), F.lit(""))
    precision = F.coalesce("folder_precision", F.lit("day")) if which == "folder" else F.when(F.contains(date, F.lit("T")), "second").otherwise("day")
    joined = resolutions.join(folder.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    hit = F.coalesce("_hit", F.lit(False)) & (F.col("status") == "conflict") & date.isNotNull()
    new = {"resolved_date": date, "resolved_precision": precision, "resolved_source": F.lit(source), "status": F.lit("reviewed")}
    return joined.select(*(F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in resolutions.columns))


def set_column(rows: DataFrame, chosen: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``column`` as in ``chosen`` (id, value) where it has the id: skips, buckets, sequence hints."""
    return rows.join(chosen.select("id", F.col("value").alias("_value"), F.lit(True).alias("_hit")), "id", "left").withColumn(column, F.when(F.col("_hit"), F.col("_value")).otherwise(F.col(column))).select(*rows.columns)


def accept_clusters(clusters: DataFrame, include_video: bool = False) -> DataFrame:
    """Pending clusters become reviewed; those of clips only where asked for."""
    hit = (F.col("status") == "pending") & (F.lit(include_video) | (F.col("kind") != "near_video"))
    return clusters.withColumn("status", F.when(hit, "reviewed").otherwise(F.col("status")))


def prefer_curated(clusters: DataFrame, members: DataFrame, inventory: DataFrame) -> DataFrame:
    """cluster_id, old_winner, new_winner of pending clusters where an export wins over a curated file of its size: the smallest such id."""
    rows = clusters.where("status = 'pending'").select("cluster_id", "winner_id").join(members.select("cluster_id", "id"), "cluster_id").join(inventory.select("id", "trust", "width", "height"), "id")
    win = rows.where("id = winner_id and trust <> 'curated'").select("cluster_id", F.col("width").alias("w"), F.col("height").alias("h"))
    other = rows.where("trust = 'curated'").join(win, "cluster_id").where(F.col("width").eqNullSafe(F.col("w")) & F.col("height").eqNullSafe(F.col("h")))
    return other.groupBy("cluster_id").agg(F.first("winner_id").alias("old_winner"), F.min("id").alias("new_winner"))


def swap_winners(members: DataFrame, swaps: DataFrame) -> DataFrame:
    """``members`` (cluster_id, id, role) with the winners of ``swaps`` (cluster_id, new_winner); those before become losers."""
    joined = members.join(swaps.select("cluster_id", "new_winner"), "cluster_id", "left")
    role = F.when(F.col("new_winner") == F.col("id"), "winner").when(F.col("new_winner").isNotNull() & (F.col("role") == "winner"), "loser").otherwise(F.col("role"))
    return joined.withColumn("role", role).select(*members.columns)


def split_member(members: DataFrame, gone: DataFrame) -> DataFrame:
    """``members`` where those of ``gone`` (cluster_id, id) are no duplicates any more; clusters of one that remain dissolve."""
    marked = members.join(gone.select("cluster_id", "id", F.lit(True).alias("out")), ["cluster_id", "id"], "left").withColumn("role", F.when(F.col("out"), "not_duplicate").otherwise(F.col("role")))
    rest = F.count_if(F.col("role") != "not_duplicate").over(Window.partitionBy("cluster_id"))
    touched = F.max(F.coalesce("out", F.lit(False))).over(Window.partitionBy("cluster_id"))
    return marked.withColumn("role", F.when(touched & (rest < 2), "not_duplicate").otherwise(F.col("role"))).select(*members.columns)
