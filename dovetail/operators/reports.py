"""Reports and views for review, as tables: what is listed, joined, counted and ordered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dovetail.functions import paths


def direct_children(rows: DataFrame, source: str, folder: str) -> DataFrame:
    """``rows`` (source, rel_path) that lie in ``folder`` itself."""
    return rows.where((F.col("source") == source) & (paths.dirname(F.col("rel_path")) == folder))


def pending_clusters(clusters: DataFrame, members: DataFrame, media: DataFrame) -> DataFrame:
    """cluster_id, cluster_kind, winner_id, winner_path, members of every pending cluster; a winner that is gone gives a null path."""
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("members"))
    winner = media.select(F.col("id").alias("winner_id"), F.col("rel_path").alias("winner_path"))
    pending = clusters.where("status = 'pending'").select("cluster_id", "cluster_kind", "winner_id")
    joined = pending.join(winner, "winner_id", "left").join(sizes, "cluster_id", "left")
    return joined.select("cluster_id", "cluster_kind", "winner_id", "winner_path", F.coalesce("members", F.lit(0)).alias("members"))


def cluster_members(members: DataFrame, media: DataFrame) -> DataFrame:
    """Each cluster's members with their facts and their place by score, the best first and those without a score last."""
    facts = media.select("id", "source", "rel_path", "width", "height", "size_bytes")
    order = Window.partitionBy("cluster_id").orderBy(F.desc_nulls_last("score"), "id")
    return members.join(facts, "id").withColumn("place", F.row_number().over(order))


def pending_sidecars(tasks: DataFrame, ledger: DataFrame, resolutions: DataFrame, keywords: DataFrame) -> DataFrame:
    """What has still to be written beside archived files: tasks (id, reason, written_at) with path, date and sorted keywords."""
    open_ = tasks.where("written_at is null").select("id", "reason")
    there = ledger.where("disposition = 'archive' and dest_rel_path is not null").select("id", F.col("dest_rel_path").alias("rel"))
    dated = resolutions.select("id", F.col("resolved_date").alias("date"), F.col("resolved_precision").alias("precision"), "bucket")
    words = keywords.groupBy("id").agg(F.array_sort(F.collect_set("keyword")).alias("keywords"))
    joined = open_.join(there, "id").join(dated, "id", "left").join(words, "id", "left")
    return joined.withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))


def applied(tasks: DataFrame, written: DataFrame, at: str) -> DataFrame:
    """``tasks`` with ``at`` as the time of those in ``written`` (id)."""
    hit = tasks.join(written.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    return hit.withColumn("written_at", F.when(F.col("_hit"), F.lit(at)).otherwise(F.col("written_at"))).select(*tasks.columns)


def manifest(placed: DataFrame, kind: str) -> DataFrame:
    """The rows of one disposition as flat text: source, rel_path, dest_rel_path, reason and keywords joined by semicolons."""
    words = F.array_join("keywords", ";") if "keywords" in placed.columns else F.lit("")
    return placed.where(F.col("disposition") == kind).select("source", "rel_path", "dest_rel_path", "reason", words.alias("keywords"))


def write_csv(report: DataFrame, path: str) -> None:
    """A report with a header, as CSV files below ``path``; quotes within quotes are doubled, as CSV readers expect."""
    report.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def as_json(passed: bool, counts: DataFrame, faults: DataFrame) -> DataFrame:
    """One row of JSON: passed, counts (disposition, n, bytes) and, ordered, what is wrong (kind, subject). Faults are few in a run that passes."""
    of = counts.agg(F.array_sort(F.collect_list(F.struct("disposition", "n", "bytes"))).alias("counts"))
    wrong = faults.agg(F.array_sort(F.collect_list(F.struct("kind", "subject"))).alias("discrepancies"))
    both = of.withColumn("k", F.lit(0)).join(wrong.withColumn("k", F.lit(0)), "k")
    return both.select(F.to_json(F.struct(F.lit(passed).alias("passed"), "counts", "discrepancies")).alias("report"))


def unknown_sources(wanted: list[str], known: DataFrame) -> list[str]:
    """The names in ``wanted`` that no row of ``known`` (source) has, in order. The sources of an inventory are few."""
    have = {r.source for r in known.where(F.col("source").isin(wanted)).select("source").distinct().collect()}
    return sorted(set(wanted) - have)
