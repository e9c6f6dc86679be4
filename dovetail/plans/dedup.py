"""The duplicate stage: pairs of companions first, then their copies, then exact and near clusters over the rest.

A file is in one cluster at most. Clusters that a person has reviewed stay as they are and their files take no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dovetail.functions import names
from dovetail.operators import duplicates, linkage
from dovetail.plans.stages import Settings, near_clusters
from dovetail.sources import shared


def companions(media: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """cluster_kind, winner_id, companion_id, place of RAW and JPEG pairs, then of stills with clips among the rest.

    ``place`` orders the pairs: by kind, then source and path of the winner.
    """
    raw = duplicates.pair_raw_jpeg(media)
    raw = shared.stash(raw, "raw-pairs")
    winner, companion = ("raw_id", "jpeg_id") if settings.prefer_raw else ("jpeg_id", "raw_id")
    used = raw.select(F.explode(F.array("raw_id", "jpeg_id")).alias("id"))
    live = duplicates.pair_live(media.join(used, "id", "left_anti"))
    pairs = raw.select(F.lit("pair_raw_jpeg").alias("cluster_kind"), F.col(winner).alias("winner_id"), F.col(companion).alias("companion_id"))
    pairs = pairs.unionByName(live.select(F.lit("pair_live").alias("cluster_kind"), F.col("image_id").alias("winner_id"), F.col("video_id").alias("companion_id")))
    of = media.select(F.col("id").alias("winner_id"), "source", "rel_path")
    place = F.struct((F.col("cluster_kind") != "pair_raw_jpeg").alias("later"), "source", "rel_path", "winner_id").alias("place")
    return shared.stash(pairs.join(of, "winner_id").select("cluster_kind", "winner_id", "companion_id", place), "companions")


def members(media: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """cluster_id (smallest id), cluster_kind, weak, id, and fixed_role (of pairs; else null)."""
    pairs = companions(media, settings)
    halves = pairs.select("cluster_kind", "winner_id", "place", F.explode(F.array(F.struct(F.col("winner_id").alias("id"), F.lit("winner").alias("fixed_role")), F.struct(F.col("companion_id").alias("id"), F.lit("companion").alias("fixed_role")))).alias("half"))
    halves = halves.select("cluster_kind", "winner_id", "place", "half.id", "half.fixed_role")
    # a copy of either half goes to the first pair that has its content
    content = halves.join(media.select("id", "sha256"), "id").groupBy("sha256").agg(F.min_by(F.struct("winner_id", "cluster_kind"), "place").alias("pair"))
    free = media.select("id", "sha256").join(halves.select("id"), "id", "left_anti")
    absorbed = free.join(content, "sha256").select("pair.cluster_kind", "pair.winner_id", "id", F.lit("loser").alias("fixed_role"))
    paired = shared.stash(halves.drop("place").unionByName(absorbed), "paired")
    ids = paired.groupBy("winner_id").agg(F.min("id").alias("cluster_id"))
    paired = paired.join(ids, "winner_id").select("cluster_id", "cluster_kind", F.lit(False).alias("weak"), "id", "fixed_role")
    rest = near_clusters(media.join(paired.select("id"), "id", "left_anti"), settings)
    return paired.unionByName(rest.select("cluster_id", "cluster_kind", "weak", "id", F.lit(None).cast("string").alias("fixed_role")))


#: What guardrails and dates read of a cluster's members, and what merged facts read besides.
_RANKED = ("cluster_id", "cluster_kind", "weak", "fixed_role", "id", "source", "rel_path", "kind", "trust", "width", "height", "score", "rank", "gap", "resolved_date", "resolved_precision", "resolved_source")
_MERGED = ("gps_lat", "gps_lon", "side_lat", "side_lon", "description", "title")


def plan(media: DataFrame, settings: Settings = Settings(), albums: DataFrame | None = None, reviewed: DataFrame | None = None, merged: bool = True, judged: bool = True) -> tuple[DataFrame, DataFrame]:
    """Members (cluster_id, id, role, score, rank, gap) and clusters (cluster_id, cluster_kind, winner_id, status, guardrails, merged facts, merge_flags).

    ``merged``: false where the clusters' merged facts (places, texts, keywords, merge_flags) are not asked for. ``judged``: false where
    what is found against them (guardrails, status) is not.
    ``media``: resolved and stored, as it is read several times, with side_lat, side_lon, description and title of its sidecar where there are any. ``albums`` (id, album).
    ``reviewed`` (id): files of clusters that a person has settled.
    """
    trusted = F.col("exif_dto").isNotNull() & (F.size("exif_flags") == 0)
    pool = media.where("kind in ('image', 'video')")
    if reviewed is not None:
        pool = shared.stash(pool.join(reviewed.select("id"), "id", "left_anti"), "pool")
    for name, kind in (("side_lat", "double"), ("side_lon", "double"), ("description", "string"), ("title", "string")):
        if name not in pool.columns:
            pool = pool.withColumn(name, F.lit(None).cast(kind))
    of = shared.stash(members(pool, settings), "members")
    ranked = duplicates.ranked(duplicates.scored(pool, trusted).join(of, "id"))
    ranked = shared.stash(ranked.select(*_RANKED, *(_MERGED if merged else ())), "ranked")
    role = F.coalesce("fixed_role", F.when(F.col("rank") == 1, "winner").otherwise("loser"))
    people = ranked.select("cluster_id", "id", role.alias("role"), "score", "rank", "gap")
    kinds = of.groupBy("cluster_id").agg(F.first("cluster_kind").alias("cluster_kind"), F.bool_or("weak").alias("weak"))
    dates = duplicates.merged_dates(ranked)
    winners = people.where("role = 'winner'").select("cluster_id", F.col("id").alias("winner_id"))
    none = F.array().cast("array<string>")
    pair = F.startswith("cluster_kind", F.lit("pair_"))
    found = kinds.join(winners, "cluster_id").join(dates, "cluster_id")
    if judged:
        rails = duplicates.guardrails(ranked.drop("cluster_kind", "weak"), kinds, settings.score_margin)
        found = found.join(rails, "cluster_id").withColumn("guardrails", F.when(pair, none).otherwise(F.col("guardrails")))
    if merged:
        topics = ranked.select("cluster_id", F.explode(names.keywords(F.col("rel_path"), settings.folder_patterns)).alias("keyword"))
        if albums is not None:
            topics = topics.unionByName(ranked.select("cluster_id", "id").join(albums, "id").select("cluster_id", F.col("album").alias("keyword")))
        topics = topics.groupBy("cluster_id").agg(F.array_sort(F.collect_set("keyword")).alias("keywords"))
        found = found.join(duplicates.merged_facts(ranked), "cluster_id").join(topics, "cluster_id", "left").withColumn("keywords", F.coalesce("keywords", none))
        found = found.withColumn("merge_flags", F.concat("flags", F.when(F.col("gps_source") == "takeout", F.array(F.lit("gps_from_takeout"))).otherwise(none)))
    if not judged:
        return people, found
    status = F.when((F.size("guardrails") == 0) & ~F.col("disagrees"), "auto").otherwise("pending")
    return people, found.withColumn("status", status)


def locked(people: DataFrame, clusters: DataFrame) -> DataFrame:
    """id of every file in a cluster that a person has reviewed."""
    return people.join(clusters.where("status = 'reviewed'").select("cluster_id"), "cluster_id").select("id").distinct()


def with_archived(media: DataFrame, ledger: DataFrame) -> DataFrame:
    """``media`` with archived: in the archive by ``ledger`` (id, disposition, verified_ok) and verified there; false without a row."""
    there = (F.col("disposition") == "archive") & F.col("verified_ok")
    held = ledger.groupBy("id").agg(F.bool_or(there).alias("archived"))
    return media.drop("archived").join(held, "id", "left").withColumn("archived", F.coalesce("archived", F.lit(False)))


def replaced(old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Members and clusters with those of ``old`` that are not reviewed replaced by ``new``."""
    members_, clusters = old
    kept = clusters.where("status = 'reviewed'")
    stays = members_.join(kept.select("cluster_id"), "cluster_id", "left_semi")
    return stays.unionByName(new[0], allowMissingColumns=True), kept.unionByName(new[1], allowMissingColumns=True)


def audit(people: DataFrame, clusters: DataFrame, media: DataFrame, most: int = 200) -> DataFrame:
    """The first ``most`` clusters to look at: those pending first, by kind and the winner's path. A report, so it has a limit."""
    paths = media.select("id", "rel_path")
    listed = people.join(paths, "id").groupBy("cluster_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "rel_path"))), lambda x: x["rel_path"]), ";").alias("members"),
        F.max(F.when(F.col("rank") == 1, F.round("gap", 3))).alias("score_gap"),
    )
    winner = clusters.join(paths.select(F.col("id").alias("winner_id"), F.col("rel_path").alias("winner")), "winner_id")
    rows = winner.join(listed, "cluster_id").select("cluster_id", "cluster_kind", "status", F.array_join("guardrails", ";").alias("guardrails"), "winner", "members", "score_gap")
    return rows.orderBy(F.when(F.col("status") == "pending", 0).otherwise(1), "cluster_kind", "winner", "cluster_id").limit(most)


def placed(media: DataFrame, people: DataFrame, clusters: DataFrame, edits: bool = True) -> DataFrame:
    """``media`` (all files) with role, cluster_id, edited (if ``edits`` are asked for), and the merged date of its cluster for winners."""
    joined = media.join(people.select("id", "cluster_id", "role"), "id", "left")
    if edits:
        is_edit = linkage.edited_pairs(media.where("kind in ('image', 'video')")).select(F.col("edited_id").alias("id")).distinct().withColumn("is_edit", F.lit(True))
        touched = people.join(is_edit, "id").select("cluster_id", F.lit(True).alias("has_edit")).distinct()
        joined = joined.join(is_edit, "id", "left").join(touched, "cluster_id", "left").withColumn("edited", F.coalesce("is_edit", "has_edit", F.lit(False))).drop("is_edit", "has_edit")
    merged = clusters.where("date is not null").select(F.col("winner_id").alias("id"), F.struct("date", "precision", "source").alias("merged"))
    joined = joined.join(merged, "id", "left")
    has = F.col("merged").isNotNull()
    for name, of in (("resolved_date", "date"), ("resolved_precision", "precision"), ("resolved_source", "source")):
        joined = joined.withColumn(name, F.when(has, F.col(f"merged.{of}")).otherwise(F.col(name)))
    return joined.drop("merged")
