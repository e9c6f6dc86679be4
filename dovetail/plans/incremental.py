"""Import of a few files into a large archive: near and exact clusters from stored indexes, without scanning what is there.

Stored tables (see ``sources.catalog``), each looked up by what new files have:

* ``contents`` by content hash: its first file, and the cluster label it had when it was stored;
* ``bands`` by band and value of image hashes, ``clips`` by second and shape of clips: first files only, with their labels;
* ``members`` by label: every file, with its content;
* ``links``: labels that have been merged since, and into which; small, and read whole.

New contents are banded and matched against each other and against the bands they share; the pairs found tie labels, not files, so
components are found over the labels that new files touch. A label is the smallest id of its cluster. The result equals a run over
all files; where it could not (a new file comes before the first file of its content and differs from it in kind or hashes, or one of
them is in an edit; or an edit joins two files that are there), ``import_files`` says so and ``build`` runs over everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dovetail.operators import duplicates, linkage
from dovetail.plans.stages import Settings
from dovetail.sources import shared
from dovetail.sources.catalog import Catalog

KEYS = {"contents": ["sha256"], "bands": ["i", "v", "id"], "clips": ["second", "shape", "id"], "members": ["label", "id"], "links": ["label"], "weak": ["label", "id"]}
BY = {"bands": ["i", "v"], "clips": ["second", "shape"], "members": ["label"], "weak": ["label"]}
#: What a file is told by; a catalog of files has at least these columns.
MEDIA = ["id", "source", "rel_path", "kind", "sha256", "phash", "dhash", "width", "height", "video_sig"]


#: What pairs are told by; equal for equal contents, unless a file could not be read.
SIGNS = ["kind", "phash", "dhash", "width", "height", "video_sig"]


class NeedsAll(ValueError):
    """An import that cannot be told from the stored indexes."""


def indexes(spark: SparkSession, path: str, rows_per_file: int = 1_000_000) -> Catalog:
    return Catalog(spark, path, KEYS, rows_per_file=rows_per_file, by=BY)


def _first_files(media: DataFrame) -> DataFrame:
    return duplicates.representatives(media.select(*MEDIA))


def _ties(edits: DataFrame, settings: Settings, bands: DataFrame, clips: DataFrame, old_bands: DataFrame | None = None, old_clips: DataFrame | None = None) -> DataFrame:
    """a, b, weak with the components of the links among new first files, and between them and old ones."""
    columns = ["id", "phash", "dhash", "width", "height", "i", "v"]
    every = bands.select(*columns, F.lit(False).alias("old"))
    if old_bands is not None:
        every = every.unionByName(old_bands.select(*columns, F.lit(True).alias("old")))
    near = duplicates.image_ties(every, edits, settings.phash_most, settings.band_width, settings.dhash_most)
    return near.unionByName(duplicates.clip_ties(clips, edits, old_clips).withColumn("weak", F.lit(True)))


def build(catalog: Catalog, media: DataFrame, settings: Settings = Settings()) -> None:
    """The indexes of all files of ``media``."""
    media = shared.stash(media.where("kind in ('image', 'video')").select(*MEDIA), "media")
    first = shared.stash(_first_files(media), "first")
    bands, clips = duplicates.bands(first.where("kind = 'image'")), duplicates.clip_places(first.where("kind = 'video'"))
    pairs = shared.stash(_ties(linkage.edited_pairs(media), settings, bands, clips), "pairs")
    least = media.groupBy("sha256").agg(F.min("id").alias("least"))
    named = shared.stash(first.join(least, "sha256"), "named")
    label = named.select(F.col("id").alias("node"), "least")
    edges = pairs.join(label.select(F.col("node").alias("a"), F.col("least").alias("u")), "a").join(label.select(F.col("node").alias("b"), F.col("least").alias("v")), "b")
    found = duplicates.components(edges.select(F.col("u").alias("a"), F.col("v").alias("b")))
    labels = named.join(found.select(F.col("node").alias("least"), "component"), "least", "left").withColumn("label", F.coalesce("component", "least"))
    labels = shared.stash(labels.select(*MEDIA, "label"), "labels")
    of = labels.select("id", "label")
    weak = pairs.where("weak").select(F.explode(F.array("a", "b")).alias("id")).distinct().join(of, "id")
    catalog.publish(
        {
            "contents": labels,
            "bands": bands.join(of, "id"),
            "clips": clips.join(of, "id"),
            "members": media.select("id", "sha256", "kind").join(labels.select("sha256", "label"), "sha256"),
            "weak": weak.select("label", "id"),
            "links": labels.select("label", F.col("label").alias("into")).limit(0),
        }
    )


def _current(rows: DataFrame, links: DataFrame | None) -> DataFrame:
    """``rows`` with ``now``, the label that theirs has been merged into."""
    return rows.withColumn("now", F.col("label")) if links is None else rows.join(links, "label", "left").withColumn("now", F.coalesce("into", "label")).drop("into")


def import_files(catalog: Catalog, new: DataFrame, edits: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Add the files of ``new`` (ids not in the catalog) to the indexes; the clusters they touch, as of ``clusters``. ``edits``: edited_id, original_id of
    every edited file or original among them."""
    new = shared.stash(new.where("kind in ('image', 'video')").select(*MEDIA), "import")
    links = catalog.read("links")
    known = catalog.lookup("contents", new.select("sha256"))
    held = None if known is None else shared.stash(known, "known")
    first = _first_files(new)
    if held is not None:
        was = held.select("sha256", F.struct("source", "rel_path", F.col("id").alias("of")).alias("was"), F.struct(*SIGNS).alias("signs"))
        earlier = first.join(was, "sha256").where(F.struct("source", "rel_path", F.col("id").alias("of")) < F.col("was"))
        if not earlier.where(~F.struct(*SIGNS).eqNullSafe(F.col("signs"))).isEmpty():
            raise NeedsAll("a new file comes before the first file of its content and differs from it")
        if not earlier.join(edits.select(F.explode(F.array("edited_id", "original_id")).alias("of")), F.col("of").isin(F.col("id"), F.col("was.of")), "left_semi").isEmpty():
            raise NeedsAll("a new file comes before the first file of its content, and one of them is in an edit")
        first = first.join(held.select("sha256"), "sha256", "left_anti")
    ids = new.select("id")
    old_ends = edits.join(ids.withColumnRenamed("id", "edited_id"), "edited_id", "left_anti").join(ids.withColumnRenamed("id", "original_id"), "original_id", "left_anti")
    if not old_ends.isEmpty():
        raise NeedsAll("an edit joins two files that are there already")
    first = shared.stash(first, "new-first")
    bands = shared.stash(duplicates.bands(first.where("kind = 'image'")), "new-bands")
    clips = shared.stash(duplicates.clip_places(first.where("kind = 'video'")), "new-clips")
    old_bands = catalog.lookup("bands", bands)
    old_clips = catalog.lookup("clips", duplicates.around(clips))
    pairs = shared.stash(_ties(edits, settings, bands, clips, old_bands, old_clips), "new-pairs")
    # labels of all first files that the pairs name: of new contents their smallest id, of old ones what they are merged into by now
    least = new.groupBy("sha256").agg(F.min("id").alias("least"))
    fresh = first.select("id", "sha256").join(least, "sha256").select("id", F.col("least").alias("now"))
    label = fresh
    for old in (old_bands, old_clips):
        if old is not None:
            label = label.unionByName(_current(old.select("id", "label").distinct(), links).select("id", "now"))
    label = shared.stash(label.distinct(), "pair-labels")
    edges = pairs.join(label.select(F.col("id").alias("a"), F.col("now").alias("u")), "a").join(label.select(F.col("id").alias("b"), F.col("now").alias("v")), "b").select(F.col("u").alias("a"), F.col("v").alias("b"))
    # a new copy with a smaller id than its cluster's label gives the cluster its label
    if held is not None:
        copies = _current(held.select("sha256", "label"), links).join(least, "sha256").select(F.col("now").alias("a"), F.col("least").alias("b"))
        edges = edges.unionByName(copies.where("b < a"))
    merged = shared.stash(duplicates.components(edges).where("node <> component"), "merged-labels")
    into = merged.select(F.col("node").alias("label"), F.col("component").alias("into"))
    labelled = shared.stash(first.join(least, "sha256").join(into.withColumnRenamed("label", "least"), "least", "left").select(*MEDIA, F.coalesce("into", "least").alias("label")), "new-labels")
    of = labelled.select("id", "label")
    contents = labelled.select("sha256", "label")
    if held is not None:
        contents = contents.unionByName(held.select("sha256", "label"))
    members = new.select("id", "sha256", "kind").join(contents, "sha256")
    changes = {}
    if held is not None:
        changes["contents"] = earlier.select(*MEDIA).join(held.select("sha256", "label"), "sha256")
    moved = into if links is None else into.unionByName(links.join(into.select(F.col("label").alias("into"), F.col("into").alias("further")), "into").select("label", F.col("further").alias("into")))
    changes["links"] = moved
    weak = pairs.where("weak").select(F.explode(F.array("a", "b")).alias("id")).distinct()
    marks = weak.join(label, "id").select(F.col("now").alias("label"), "id")
    catalog.change(changes, {"contents": labelled, "bands": bands.join(of, "id"), "clips": clips.join(of, "id"), "members": members, "weak": marks.join(_known(catalog, "weak", marks), ["label", "id"], "left_anti")})
    touched = _current(shared.stash(members.select("label").distinct(), "touched"), catalog.read("links")).select(F.col("now").alias("cluster_id")).distinct()
    return clusters(catalog, touched)


def _known(catalog: Catalog, name: str, asked: DataFrame) -> DataFrame:
    found = catalog.lookup(name, asked)
    return asked.limit(0) if found is None else found


def clusters(catalog: Catalog, only: DataFrame | None = None) -> DataFrame:
    """id, cluster_id, cluster_kind, weak of all clusters, or of those in ``only`` (cluster_id), reading only the files with their members."""
    links = catalog.read("links")
    if only is None:
        rows, weak = catalog.read("members"), catalog.read("weak")
    else:
        labels = only.select(F.col("cluster_id").alias("label"))
        if links is not None:
            labels = labels.unionByName(links.join(only.select(F.col("cluster_id").alias("into")), "into").select("label"))
        labels = shared.stash(labels.distinct(), "labels")
        rows, weak = catalog.lookup("members", labels), catalog.lookup("weak", labels)
    members = shared.stash(_current(rows, links).select("id", "sha256", "kind", F.col("now").alias("cluster_id")), "cluster-members")
    kinds = members.groupBy("cluster_id").agg(F.count("*").alias("k"), F.count_distinct("sha256").alias("contents"), F.bool_or(F.col("kind") == "video").alias("clip")).where("k > 1")
    if weak is None:
        kinds = kinds.withColumn("weak", F.lit(False))
    else:
        marked = _current(weak, links).select(F.col("now").alias("cluster_id")).distinct().withColumn("weak", F.lit(True))
        kinds = kinds.join(marked, "cluster_id", "left").withColumn("weak", F.coalesce("weak", F.lit(False)))
    kind = F.when(F.col("contents") == 1, "exact").when(F.col("clip"), "near_video").otherwise("near_image")
    return members.select("id", "cluster_id").join(kinds.select("cluster_id", kind.alias("cluster_kind"), "weak"), "cluster_id").select("id", "cluster_id", "cluster_kind", "weak")
