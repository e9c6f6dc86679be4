"""Duplicate clusters: exact by content, near by banded bit vectors, pairs of companions; winners, guardrails and merged facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dovetail.functions import dates, names, paths, scoring
from dovetail.operators import pairing, tiles
from dovetail.sources import shared


def exact_clusters(media: DataFrame) -> DataFrame:
    """id, cluster_id (smallest id of its content) of files whose content another file has."""
    groups = media.groupBy("sha256").agg(F.min("id").alias("cluster_id"), F.count("*").alias("n")).where("n > 1").select("sha256", "cluster_id")
    return media.join(groups, "sha256").select("id", "cluster_id")


def representatives(media: DataFrame) -> DataFrame:
    """The first file of each content, by source and path."""
    first = Window.partitionBy("sha256").orderBy("source", "rel_path", "id")
    return media.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")


def bands(images: DataFrame) -> DataFrame:
    """id, phash, dhash, width, height of images with a hash, once for each 16-bit band: its place ``i`` and value ``v``."""
    columns = ["id", "phash", "dhash", "width", "height"]
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), scoring.band(F.col("phash"), i).alias("v")) for i in range(4)))).alias("band")
    return images.where("length(phash) = 16").select(*columns, each).select(*columns, "band.i", "band.v")


def band_links(images: DataFrame, phash_most: int = 6, band_width: int = 4, dhash_most: int = 8) -> DataFrame:
    """id, class_id, n_links, n_weak of every image: the smallest id of its hashes and shape, the images it shares a 16-bit band with and is near in both
    hashes and in shape, and those of them beyond ``phash_most``. Pairs are counted, not made."""
    signs = ["phash", "dhash", "width", "height"]
    found = tiles.link_counts(bands(images), phash_most, band_width, dhash_most)
    rows = images.select("id", F.min("id").over(Window.partitionBy(*signs)).alias("class_id"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.join(found, "id", "left").select("id", "class_id", none("n_links"), none("n_weak"))


def image_ties(each: DataFrame, edits: DataFrame, phash_most: int = 6, band_width: int = 4, dhash_most: int = 8) -> DataFrame:
    """a, b, weak with the components of the links among images of ``bands``, less those of an edited file and its original."""
    made_from = edits.select(F.col("edited_id").alias("id"), F.col("original_id").alias("orig"))
    return tiles.ties(each.join(made_from, "id", "left"), phash_most, band_width, dhash_most)


def clip_places(videos: DataFrame) -> DataFrame:
    """id, sig, second and shape of clips with a signature: shapes that agree within one in a hundred are in the same step of a twentieth of
    their logarithm, or in the next."""
    parsed = videos.select("id", scoring.video_signature(F.col("video_sig")).alias("sig")).where(F.col("sig").isNotNull())
    return parsed.select("id", "sig", F.floor("sig.seconds").alias("second"), F.floor(20 * F.ln(F.try_divide(F.col("sig.width"), F.col("sig.height")))).alias("shape"))


def around(places: DataFrame) -> DataFrame:
    """``clip_places`` with the seconds and shapes next to them."""
    near = lambda c: F.array(c - 1, c, c + 1)
    return places.withColumn("second", F.explode(near(F.col("second")))).withColumn("shape", F.explode(near(F.col("shape"))))


def clip_matches(left: DataFrame, right: DataFrame, most: int = 6) -> DataFrame:
    """a, b (smaller id first) of clips of ``around`` and of ``clip_places`` that are similar."""
    a, b = left.alias("a"), right.alias("b")
    in_order = F.col("a.id") < F.col("b.id")
    first, second = F.when(in_order, F.col("a.sig")).otherwise(F.col("b.sig")), F.when(in_order, F.col("b.sig")).otherwise(F.col("a.sig"))
    met = a.join(b, (F.col("a.second") == F.col("b.second")) & (F.col("a.shape") == F.col("b.shape")) & (F.col("a.id") != F.col("b.id")) & scoring.videos_similar(first, second, most))
    return met.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()


def clip_points(places: DataFrame, *apart: str) -> DataFrame:
    """Of clips that are told by ``clip_places`` and the columns ``apart`` the smallest id, and how many there are: copies of a signature meet
    others once. Clips that are not even similar to themselves are similar to none."""
    alike = places.where(scoring.videos_similar(F.col("sig"), F.col("sig")))
    return alike.withColumn("id_", F.col("id")).groupBy("sig", "second", "shape", *apart).agg(F.min("id_").alias("id"), F.count("*").alias("n"))


def clip_ties(places: DataFrame, edits: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """a, b with the components of the links among clips of ``clip_places``, less those of an edited file and its original, and between them and ``old``
    ones (with label), whose links among themselves are known."""
    own = edits.select(F.explode(F.array("edited_id", "original_id")).alias("id")).distinct().withColumn("own", F.col("id"))
    new = shared.stash(places.select("id", "sig", "second", "shape").join(own, "id", "left"), "clips")
    points = shared.stash(clip_points(new, "own").drop("n"), "clip-points")
    copies = new.join(points.withColumnRenamed("id", "a"), (new["sig"] == points["sig"]) & new["own"].eqNullSafe(points["own"])).select("a", F.col("id").alias("b")).where("a <> b")
    place = ["id", "sig", "second", "shape"]
    pairs = clip_matches(around(points.select(place)), points.select(place))
    if old is not None:
        there = clip_points(old.select("id", "sig", "second", "shape", "label").join(own, "id", "left"), "label", "own")
        pairs = pairs.unionByName(clip_matches(around(points.select(place)), there.select(place)))
    return without_edits(pairs, edits).unionByName(copies)


def video_links(videos: DataFrame, most: int = 6) -> DataFrame:
    """id, class_id, n_links of every clip: the smallest id of its signature, and how many clips have a similar one. Signatures are met by whole
    seconds of length and by shape, each once, whatever number of clips has it."""
    points = shared.stash(clip_points(clip_places(videos)), "clip-points")
    place = ["id", "sig", "second", "shape"]
    met = clip_matches(around(points.select(place)), points.select(place), most)
    both = met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(points.select(F.col("id").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("others"))
    counts = points.join(others, points["id"] == others["a"], "left").select("sig", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    rows = videos.select("id", F.min("id").over(Window.partitionBy("video_sig")).alias("class_id"), scoring.video_signature(F.col("video_sig")).alias("sig"))
    return rows.join(counts, "sig", "left").select("id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def without_edits(pairs: DataFrame, edits: DataFrame) -> DataFrame:
    """``pairs`` (a, b) without those of an edited file and its original."""
    linked = edits.select(F.least("edited_id", "original_id").alias("a"), F.greatest("edited_id", "original_id").alias("b"))
    return pairs.join(linked, ["a", "b"], "left_anti")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) for the nodes of ``edges`` (a, b): large-star and small-star steps, each stored, until only stars are left."""
    pairs = shared.stash(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # of stars around their smallest nodes, each node has either one neighbour, or larger ones only
        if both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).where("m < u and n > 1").isEmpty():
            roots = pairs.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        pairs = shared.stash(small, "edges")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def pair_raw_jpeg(images: DataFrame, within_seconds: int = 1) -> DataFrame:
    """raw_id, jpeg_id: each raw file with the first free picture of its directory of the same name, else of its camera and second.

    Raw files choose by source and path. A name or a camera's second in a directory is one list (see ``pairing``), not a directory.
    """
    second = F.unix_timestamp(F.try_to_timestamp(F.substring("exif_dto", 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    rows = images.where("kind = 'image'").select("id", "source", "rel_path", paths.dirname(F.col("rel_path")).alias("dir"), paths.stem(F.col("rel_path")).alias("stem"), F.lower(paths.ext(F.col("rel_path"))).isin(names.RAW_EXTENSIONS).alias("raw"), F.nullif("camera_model", F.lit("")).alias("camera"), second.alias("second"))
    both = rows.groupBy("dir").agg(F.bool_or("raw").alias("has_raw"), F.bool_or(~F.col("raw")).alias("has_other")).where("has_raw and has_other").select("dir")
    order = ["dir", "source", "rel_path", "id"]
    queue = rows.join(both, "dir", "left_semi").repartitionByRange(*order).sortWithinPartitions(*order)
    queue = shared.stash(queue.withColumn("place", F.monotonically_increasing_id()), "queue")
    named = F.struct(F.lit(0).alias("level"), F.to_json(F.struct("dir", "stem")).alias("list"))
    timed = lambda s: F.when(F.col("camera").isNotNull() & F.col("second").isNotNull(), F.struct(F.lit(1).alias("level"), F.to_json(F.struct("dir", "camera", s.alias("second"))).alias("list")))
    span = range(-int(within_seconds), int(within_seconds) + 1)
    lists = lambda *x: F.explode(F.array_compact(F.array(named, *x))).alias("l")
    asks = queue.where("raw").select(F.col("place").alias("ask"), lists(*(timed(F.col("second") + k) for k in span))).select("ask", "l.level", "l.list")
    offers = queue.where("not raw").select(F.col("place").alias("offer"), lists(timed(F.col("second")))).select("offer", "l.list")
    found = pairing.in_turn(asks, offers)
    of = queue.select("id", "place")
    return found.join(of.select(F.col("id").alias("raw_id"), F.col("place").alias("ask")), "ask").join(of.select(F.col("id").alias("jpeg_id"), F.col("place").alias("offer")), "offer").select("raw_id", "jpeg_id")


def pair_live(media: DataFrame) -> DataFrame:
    """image_id, video_id: the first picture and the first clip, by source and path, that share a content identifier."""
    order = F.struct("source", "rel_path", "id")
    first = lambda k: F.min_by("id", F.when(F.col("kind") == k, order))
    return media.where("content_id is not null").groupBy("content_id").agg(first("image").alias("image_id"), first("video").alias("video_id")).where("image_id is not null and video_id is not null").select("image_id", "video_id")


def absorb(pairs: DataFrame, media: DataFrame) -> DataFrame:
    """winner_id, id: files with the content of either half of a pair (winner_id, companion_id), for the first such pair; not the halves."""
    halves = pairs.select("winner_id", F.explode(F.array("winner_id", "companion_id")).alias("id"))
    content = halves.join(media.select("id", "sha256"), "id").groupBy("sha256").agg(F.min("winner_id").alias("winner_id"))
    return media.select("id", "sha256").join(halves.select("id"), "id", "left_anti").join(content, "sha256").select("winner_id", "id")


def scored(media: DataFrame, trusted_date: Column) -> DataFrame:
    """``media`` with the parts of its score, unrounded, and the score."""
    parts = scoring.score_parts(F.col("rel_path"), F.col("width"), F.col("height"), F.col("size_bytes"), F.col("tags"), trusted_date, F.col("trust") == "curated", F.col("recompressed"))
    return media.select("*", *(c.alias(f"s_{k}") for k, c in parts.items()), scoring.total(parts).alias("score"))


def ranked(members: DataFrame) -> DataFrame:
    """``members`` (cluster_id, score, ...) with rank and gap to the next: by score, what is archived and curated first, source, path."""
    order = Window.partitionBy("cluster_id").orderBy(F.desc("score"), F.when(F.col("archived"), 0).otherwise(1), F.when(F.col("trust") == "curated", 0).otherwise(1), "source", "rel_path", "id")
    return members.withColumns({"rank": F.row_number().over(order), "gap": F.col("score") - F.lead("score").over(order)})


def merged_dates(members: DataFrame) -> DataFrame:
    """cluster_id, date, precision, source, flags, disagrees: the date that a cluster's members agree on or the best of them.

    ``members`` (cluster_id, kind, trust, rel_path, resolved_date, resolved_precision, resolved_source). Clips and folders of an
    export neither win nor contest unless nothing else is dated.
    """
    dated = F.col("resolved_date").isNotNull() & F.col("resolved_source").isNotNull()
    reliable = dated & (F.col("kind") != "video") & ~((F.col("resolved_source") == "folder") & (F.col("trust") != "curated"))
    of = Window.partitionBy("cluster_id")
    pool = members.withColumn("dated", dated).withColumn("in_pool", F.when(F.max(reliable).over(of), reliable).otherwise(dated))
    order = F.struct(dates.source_rank(F.col("resolved_source"), F.col("trust")), dates.precision_chars(F.col("resolved_precision"), 4), F.col("rel_path"))
    chosen = F.max_by(F.struct(F.col("resolved_date").alias("date"), F.col("resolved_precision").alias("precision"), F.col("resolved_source").alias("source")), F.when(F.col("in_pool"), order))
    # over the members as they are dealt, not as a table of clusters that all members meet again
    joined = pool.withColumn("best", chosen.over(of))
    chars = F.least(F.lit(10), dates.precision_chars(F.col("resolved_precision"), 10), dates.precision_chars(F.col("best.precision"), 10))
    differs = F.col("in_pool") & (F.substring("resolved_date", F.lit(1), chars) != F.substring("best.date", F.lit(1), chars))
    grouped = joined.groupBy("cluster_id").agg(F.first("best").alias("best"), F.bool_or("dated").alias("any_dated"), F.bool_and("dated").alias("all_dated"), F.max(F.coalesce(differs, F.lit(False))).alias("differs"))
    flags = F.when(~F.col("any_dated"), F.array(F.lit("date_unresolved"))).otherwise(F.array_compact(F.array(F.when(F.col("differs"), F.lit("date_disagreement")), F.when(~F.col("all_dated"), F.lit("date_unresolved_members")))))
    return grouped.select("cluster_id", "best.date", "best.precision", "best.source", flags.alias("flags"), (~F.col("any_dated") | F.col("differs")).alias("disagrees"))


def guardrails(members: DataFrame, kinds: DataFrame, margin: float = 0.5) -> DataFrame:
    """cluster_id, guardrails of each cluster, in their fixed order. ``members``: ranked; ``kinds`` (cluster_id, cluster_kind, weak)."""
    win = members.where("rank = 1").select("cluster_id", F.struct("id", "kind", "trust", "width", "height", "gap").alias("w"))
    joined = members.join(win, "cluster_id").join(kinds, "cluster_id")
    other = F.col("id") != F.col("w.id")
    shape = scoring.aspect_close(F.col("w.width"), F.col("w.height"), F.col("width"), F.col("height"))
    same_size = F.col("width").eqNullSafe(F.col("w.width")) & F.col("height").eqNullSafe(F.col("w.height"))
    grouped = joined.groupBy("cluster_id").agg(
        F.first("cluster_kind").alias("kind"),
        F.first("weak").alias("weak"),
        F.first("w").alias("w"),
        F.max(other & (F.col("kind") == F.col("w.kind")) & ~shape).alias("odd_shape"),
        F.max(other & (F.col("trust") == "curated") & same_size).alias("curated_equal"),
    )
    near = F.col("kind") != "exact"
    found = F.array(
        F.when(near & (F.col("kind") != "near_image") & (F.col("w.gap") < margin), F.lit("score_margin")),
        F.when(near & F.col("odd_shape"), F.lit("aspect_mismatch")),
        F.when((F.col("w.trust") == "takeout") & F.col("curated_equal"), F.lit("takeout_winner_over_curated")),
        F.when(F.col("weak"), F.lit("possible_duplicate_band")),
        F.when(F.col("kind") == "near_video", F.lit("video_never_auto")),
    )
    return grouped.select("cluster_id", F.array_compact(found).alias("guardrails"))


def merged_facts(members: DataFrame) -> DataFrame:
    """cluster_id, lat, lon, gps_source, descriptions, titles, merged_from. ``members``: ranked, with gps_*, side_lat, side_lon, description, title.

    The winner's own place first, then any camera's, then any sidecar's; members of a pair (``fixed_role``) in the order of winner, companion, copies.
    """
    has, side = F.col("gps_lat").isNotNull(), F.col("side_lat").isNotNull()
    place = F.when(has, F.struct(F.col("gps_lat").alias("lat"), F.col("gps_lon").alias("lon"), F.lit("exif").alias("source"))).when(side, F.struct(F.col("side_lat").alias("lat"), F.col("side_lon").alias("lon"), F.lit("takeout").alias("source")))
    turn = F.when(F.col("rank") == 1, 0).otherwise(1)
    if "fixed_role" in members.columns:
        role = F.col("fixed_role")
        turn = F.when(role == "winner", 0).when(role == "companion", 1).when(role == "loser", 2).otherwise(turn)
    order = F.when(has | side, F.struct(F.when(has, 0).otherwise(1), turn, F.col("id")))
    spoken = lambda c: F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit(""))))
    grouped = members.groupBy("cluster_id").agg(F.min_by(place, order).alias("gps"), spoken("description").alias("descriptions"), spoken("title").alias("titles"), F.array_sort(F.collect_list(F.concat_ws(":", "source", "rel_path"))).alias("merged_from"))
    return grouped.select("cluster_id", "gps.lat", "gps.lon", F.col("gps.source").alias("gps_source"), "descriptions", "titles", "merged_from")
