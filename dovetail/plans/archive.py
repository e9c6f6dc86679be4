"""What is written into each archived file: its own facts, or the merged ones of the cluster that it wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dovetail.functions import names
from dovetail.operators import linkage, placement
from dovetail.plans.stages import Settings

#: The keywords and the rating that tell an edit and its original.
EDIT_KEYWORD, ORIGINAL_KEYWORD, EDIT_RATING = "edited-preferred", "has-edit", 4


def facts(media: DataFrame, people: DataFrame, clusters: DataFrame, settings: Settings = Settings(), albums: DataFrame | None = None, keyword_map: DataFrame | None = None) -> DataFrame:
    """``media`` with gps_lat, gps_lon, gps_flagged (a sidecar's place), description, keywords, rating and merged_from as they are to be written.

    ``media`` has side_lat, side_lon and description of each file's own sidecar; ``people`` and ``clusters`` are of ``dedup.plan``. ``albums`` (id, album);
    ``keyword_map`` (keyword, mapped): what a keyword is written as, nothing where that is null or empty. The winner of a cluster takes the
    cluster's facts, all others their own.
    """
    merged = clusters.select(F.col("winner_id").alias("id"), F.struct("lat", "lon", "gps_source", "descriptions", "keywords", "merged_from").alias("m"))
    edits = linkage.edited_pairs(media)
    ends = edits.select(F.col("edited_id").alias("id"), F.lit(True).alias("edit")).unionByName(edits.select(F.col("original_id").alias("id"), F.lit(False).alias("edit"))).distinct()
    of = people.select("id", "cluster_id")
    in_cluster = ends.join(of, "id").groupBy("cluster_id").agg(F.bool_or("edit").alias("cluster_edit"), F.bool_or(~F.col("edit")).alias("cluster_original"))
    own = ends.groupBy("id").agg(F.bool_or("edit").alias("own_edit"), F.bool_or(~F.col("edit")).alias("own_original"))
    rows = media.join(merged, "id", "left").join(of, "id", "left").join(in_cluster, "cluster_id", "left").join(own, "id", "left")
    wins = F.col("m").isNotNull()
    place = lambda lat, lon, flagged: F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon"), flagged.alias("flagged")))
    gps = F.coalesce(
        place(F.col("m.lat"), F.col("m.lon"), F.col("m.gps_source") == "takeout"),
        place(F.col("gps_lat"), F.col("gps_lon"), F.lit(False)),
        place(F.col("side_lat"), F.col("side_lon"), F.lit(True)),
    )
    description = F.nullif(F.when(wins, F.array_join("m.descriptions", "; ")).otherwise(F.col("description")), F.lit(""))
    either = lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))
    edit, original = either(F.col("own_edit"), F.col("cluster_edit")), either(F.col("own_original"), F.col("cluster_original"))
    none = F.array().cast("array<string>")
    raw = rows.select("id", F.explode(F.when(wins, F.col("m.keywords")).otherwise(names.keywords(F.col("rel_path"), settings.folder_patterns))).alias("keyword"))
    if albums is not None:  # those of a cluster are among its keywords
        raw = raw.unionByName(albums.join(merged.select("id"), "id", "left_anti").select("id", F.col("album").alias("keyword")))
    if keyword_map is not None:
        known = keyword_map.select("keyword", F.struct("mapped").alias("to"))
        raw = raw.join(known, "keyword", "left").select("id", F.when(F.col("to").isNull(), F.col("keyword")).otherwise(F.col("to.mapped")).alias("keyword"))
    words = raw.where("coalesce(keyword, '') <> ''").groupBy("id").agg(F.collect_set("keyword").alias("words"))
    told = F.when(edit, F.array(F.lit(EDIT_KEYWORD))).when(original, F.array(F.lit(ORIGINAL_KEYWORD))).otherwise(none)
    out = rows.join(words, "id", "left").withColumns(
        {
            "gps": gps,
            "new_description": description,
            "new_keywords": F.array_sort(F.array_union(F.coalesce("words", none), told)),
            "rating": F.when(edit, EDIT_RATING),
            "merged_from": F.coalesce("m.merged_from", none),
        }
    )
    kept = [c for c in media.columns if c not in ("gps_lat", "gps_lon", "description", "keywords", "rating", "merged_from", "gps_flagged")]
    flagged = F.coalesce("gps.flagged", F.lit(False)).alias("gps_flagged")
    return out.select(*kept, F.col("gps.lat").alias("gps_lat"), F.col("gps.lon").alias("gps_lon"), flagged, F.col("new_description").alias("description"), F.col("new_keywords").alias("keywords"), "rating", "merged_from")


def assignments(media: DataFrame, people: DataFrame, clusters: DataFrame, settings: Settings = Settings(), albums: DataFrame | None = None, keyword_map: DataFrame | None = None) -> DataFrame:
    """id, args: the assignments of every file that is no copy, with the facts above and, for winners, the date of their cluster."""
    rows = facts(media, people, clusters, settings, albums, keyword_map)
    losers = people.where("role = 'loser'").select("id")
    dated = clusters.where("date is not null").select(F.col("winner_id").alias("id"), F.struct("date", "precision", "source").alias("d"))
    rows = rows.join(losers, "id", "left_anti").join(dated, "id", "left")
    pick = lambda new, old: F.when(F.col("d").isNotNull(), F.col(f"d.{new}")).otherwise(F.col(old))
    rows = rows.withColumns({"resolved_date": pick("date", "resolved_date"), "resolved_precision": pick("precision", "resolved_precision"), "resolved_source": pick("source", "resolved_source")})
    return placement.metadata_assignments(rows.drop("d"))
