"""The stages: dates, duplicates, placement, and the ledger that verification reads, each one plan over the inventory."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dovetail.functions import dates, paths
from dovetail.operators import duplicates, linkage, placement
from dovetail.sources import shared


@dataclass(frozen=True)
class Settings:
    """Thresholds and policies, with their defaults. Unknown names and overrides that contradict each other are errors."""

    phash_most: int = 6
    band_width: int = 4
    dhash_most: int = 8
    score_margin: float = 0.5
    mass_identical: int = 25
    undated: str = "undated"
    quarantine_edits: bool = False
    folder_patterns: tuple[str, ...] = dates.FOLDER_PATTERNS
    filename_patterns: tuple[str, ...] = dates.FILENAME_PATTERNS
    serial: str = ""
    camera_years: tuple[tuple[str, int], ...] = ()
    prefer_raw: bool = False
    curated: tuple[str, ...] = ()
    derived: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        both = sorted(set(self.curated) & set(self.derived))
        if both:
            raise ValueError(f"prefixes in both lists of overrides: {', '.join(both)}")

    @classmethod
    def of(cls, values: dict) -> Settings:
        """From plain values, such as those of a settings file."""
        unknown = sorted(set(values) - {f.name for f in fields(cls)})
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})

    @classmethod
    def load(cls, path: str, sections: tuple[str, ...] = ("dates", "duplicates", "placement", "provenance")) -> Settings:
        """From a TOML file whose ``sections`` group the settings; other sections are errors."""
        with open(path, "rb") as f:
            data = tomllib.load(f)
        unknown = sorted(set(data) - set(sections))
        if unknown:
            raise ValueError(f"unknown sections: {', '.join(unknown)}")
        merged = {}
        for name in sections:
            twice = sorted(set(merged) & set(data.get(name, {})))
            if twice:
                raise ValueError(f"set in two sections: {', '.join(twice)}")
            merged.update(data.get(name, {}))
        pairs = merged.get("camera_years")
        return cls.of({**merged, "camera_years": [tuple(p) for p in pairs.items()]} if isinstance(pairs, dict) else merged)


def date_candidates(media: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``media`` with folder and filename candidates, flags of its camera date, and whether its folder is curated.

    Where ingest has told the date to go by (``dated``), that is its camera date from here on.
    """
    if "dated" in media.columns:
        media = media.withColumn("exif_dto", F.col("dated"))
    marked = linkage.mass_identical(media, settings.mass_identical)
    year = F.lit(None).cast("int")
    for model, first in settings.camera_years:
        year = F.when(F.col("camera_model") == model, first).otherwise(year)
    folder = dates.folder_candidate(F.col("rel_path"), settings.folder_patterns)
    name = dates.filename_candidate(F.col("rel_path"), settings.filename_patterns, settings.serial)
    found = marked.withColumns({"folder": folder, "filename": name})
    created = F.col("from_create_date") if "from_create_date" in media.columns else F.lit(False)
    flags = dates.exif_flags(F.col("exif_dto"), created, F.col("mime"), year, F.col("folder.date"), F.col("folder.precision"), F.col("mass_identical"))
    return found.withColumns({"exif_flags": flags, "curated": F.col("trust") == "curated"})


def resolved(media: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``media`` with resolved_date, resolved_precision, resolved_source, status, confidence and rule."""
    found = date_candidates(media, settings)
    choice = dates.resolve(F.col("exif_dto"), F.size("exif_flags") == 0, F.col("folder.date"), F.col("folder.precision"), F.col("curated"), F.col("taken"), F.col("artifact"), F.col("filename.date"), F.col("filename.precision"))
    r = found.withColumn("r", choice)
    return r.select("*", F.col("r.date").alias("resolved_date"), F.col("r.precision").alias("resolved_precision"), F.col("r.source").alias("resolved_source"), "r.status", "r.confidence", "r.rule").drop("r")


def resolved_again(media: DataFrame, edits: DataFrame, sidecars: DataFrame, before: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """As ``resolved``, with an edited file's date from its original's sidecar where it has none, and rows of ``before`` that a person has reviewed kept.

    ``sidecars`` (media_id, taken, artifact); ``before`` (id, resolved_date, resolved_precision, resolved_source, status, confidence, rule).
    """
    found = resolved(linkage.through_edits(media.drop("taken", "artifact"), sidecars, edits), settings)
    if before is None:
        return found
    columns = ["resolved_date", "resolved_precision", "resolved_source", "status", "confidence", "rule"]
    kept = before.where("status = 'reviewed'").select("id", F.struct(*columns).alias("kept"))
    joined = found.join(kept, "id", "left")
    return joined.withColumns({c: F.when(F.col("kept").isNotNull(), F.col(f"kept.{c}")).otherwise(F.col(c)) for c in columns}).drop("kept")


def near_clusters(media: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """id, cluster_id, cluster_kind, weak: exact copies, near images and near clips as components of their links."""
    media = shared.stash(media.select("id", "source", "rel_path", "kind", "sha256", "phash", "dhash", "width", "height", "video_sig"), "media")
    first = shared.stash(duplicates.representatives(media), "first")
    edits = shared.stash(linkage.edited_pairs(media), "edits")
    images = duplicates.image_ties(duplicates.bands(first.where("kind = 'image'")), edits, settings.phash_most, settings.band_width, settings.dhash_most)
    clips = duplicates.clip_ties(duplicates.clip_places(first.where("kind = 'video'")), edits).withColumn("weak", F.lit(True))
    near = shared.stash(images.unionByName(clips), "near-pairs")
    of_content = first.select("sha256", F.col("id").alias("first_id"))
    copies = media.select("id", "sha256").join(of_content, "sha256").select(F.col("first_id").alias("a"), F.col("id").alias("b"))
    members = duplicates.components(near.select("a", "b").unionByName(copies.where("a <> b")))
    weak = near.where("weak").select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("weak", F.lit(True))
    facts = members.join(media.select(F.col("id").alias("node"), "sha256", "kind"), "node").join(weak, "node", "left")
    kinds = facts.groupBy("component").agg(F.count_distinct("sha256").alias("contents"), F.bool_or(F.col("kind") == "video").alias("clip"), F.bool_or(F.coalesce("weak", F.lit(False))).alias("weak"))
    kind = F.when(F.col("contents") == 1, "exact").when(F.col("clip"), "near_video").otherwise("near_image")
    return members.join(kinds.select("component", kind.alias("cluster_kind"), "weak"), "component").select(F.col("node").alias("id"), F.col("component").alias("cluster_id"), "cluster_kind", "weak")


def exact_roles(media: DataFrame) -> DataFrame:
    """``media`` (resolved) with cluster_id, score, rank, gap and role in the clusters of equal content; nulls outside them."""
    pictures = media.where("kind in ('image', 'video')")
    trusted = F.col("exif_dto").isNotNull() & (F.size("exif_flags") == 0)
    members = duplicates.scored(pictures, trusted).join(duplicates.exact_clusters(pictures), "id")
    ranked = duplicates.ranked(members).select("id", "cluster_id", "score", "rank", "gap", F.when(F.col("rank") == 1, "winner").otherwise("loser").alias("role"))
    return media.join(ranked, "id", "left")


def placements(media: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The plan of every file of the inventory, over the clusters of the duplicate stage."""
    from dovetail.plans import dedup

    found = shared.stash(resolved(media, settings), "resolved")
    people, clusters = dedup.plan(found, settings, merged=False, judged=False)
    rows = dedup.placed(found, people, clusters, edits=settings.quarantine_edits)
    empty = F.when(F.col("size_bytes") == 0, F.array(F.lit("zero_byte"))).otherwise(F.array().cast("array<string>"))
    flagged = rows.withColumns({"flags": empty, "bucket": F.lit(None).cast("string")})
    return placement.plan(flagged, settings.undated, settings.quarantine_edits)


def topical(media: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """id, dir, keywords of every file."""
    from dovetail.functions import names

    return media.select("id", paths.dirname(F.col("rel_path")).alias("dir"), names.keywords(F.col("rel_path"), settings.folder_patterns).alias("keywords"))
