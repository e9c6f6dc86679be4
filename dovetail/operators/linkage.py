"""Sidecars to media, edits to originals, and directories to their provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dovetail.functions import names, paths, scoring
from dovetail.sources import shared


def match_sidecars(sidecars: DataFrame, media: DataFrame) -> DataFrame:
    """dir, json_name, media_name, method, reason for each sidecar (dir, json_name) among the media (dir, media_name) of its directory.

    A numbered sidecar only ever names the numbered file. Others name the file itself, or else the only file that begins
    with what is left of a name that was cut short: its first letters, as many as some name of its directory has left.
    All joins are on the directory and a name or its first letters.
    """
    parsed = sidecars.select("dir", "json_name", names.sidecar_name(F.col("json_name")).alias("p")).where(F.col("p").isNotNull())
    wanted = F.when(F.col("p.number").isNull(), F.col("p.base")).otherwise(names.numbered(F.col("p.base"), F.col("p.number")))
    # stored, as the name's expressions are long and each join would take them up again
    parsed = shared.stash(parsed.select("dir", "json_name", F.col("p.number").alias("number"), wanted.alias("wanted")), "sidecar-names")
    files = media.select("dir", "media_name").distinct()
    direct = parsed.join(files.withColumnRenamed("media_name", "wanted").withColumn("found", F.lit(True)), ["dir", "wanted"], "left")
    cut = direct.where(F.col("found").isNull() & F.col("number").isNull())
    lengths = cut.select("dir", F.char_length("wanted").alias("size")).distinct()
    begins = files.join(lengths, "dir").select("dir", "media_name", F.substring("media_name", F.lit(1), F.col("size")).alias("wanted"))
    prefix = cut.select("dir", "json_name", "wanted").join(begins, ["dir", "wanted"])
    longer = prefix.groupBy("dir", "json_name").agg(F.count("*").alias("n"), F.min("media_name").alias("only"))
    joined = direct.join(longer, ["dir", "json_name"], "left")
    method = F.when(F.col("found"), F.when(F.col("number").isNull(), "exact").otherwise("numbered")).when(F.col("n") == 1, "truncation").otherwise("unmatched")
    name = F.when(F.col("found"), F.col("wanted")).when(F.col("n") == 1, F.col("only"))
    reason = F.when(F.col("found") | (F.col("n") == 1), F.lit(None)).when(F.col("n") > 1, "ambiguous_truncation").otherwise("no_media_match")
    return joined.select("dir", "json_name", name.alias("media_name"), method.alias("method"), reason.alias("reason"))


def edited_pairs(media: DataFrame) -> DataFrame:
    """edited_id, original_id: an edited file and the file of its directory and source that it was made from."""
    named = media.select("id", "source", paths.dirname(F.col("rel_path")).alias("dir"), paths.basename(F.col("rel_path")).alias("name"))
    edited = named.withColumn("name", names.edited_original(F.col("name"))).where(F.col("name").isNotNull())
    return edited.alias("e").join(named.alias("o"), ["source", "dir", "name"]).groupBy(F.col("e.id").alias("edited_id")).agg(F.min("o.id").alias("original_id"))


def through_edits(media: DataFrame, sidecars: DataFrame, edits: DataFrame) -> DataFrame:
    """``media`` with its own sidecar's columns or, where it has none, the whole row of its original's sidecar."""
    columns = [c for c in sidecars.columns if c != "media_id"]
    held = sidecars.select("media_id", F.struct(*columns).alias("s"))
    own = media.join(held.select(F.col("media_id").alias("id"), F.col("s").alias("own")), "id", "left")
    other = own.join(edits.select(F.col("edited_id").alias("id"), "original_id"), "id", "left").join(held.select(F.col("media_id").alias("original_id"), F.col("s").alias("other")), "original_id", "left")
    chosen = F.coalesce("own", "other")
    return other.select(*media.columns, *(chosen[c].alias(c) for c in columns))


def prefix_overrides(dirs: DataFrame, overrides: DataFrame) -> DataFrame:
    """source, dir, override of the directories in ``dirs`` that are, or lie below, a prefix of ``overrides`` (prefix, classification). Curated
    prefixes come first. A directory meets prefixes by itself and those above it, so thousands of prefixes are one join."""
    above = dirs.select("source", "dir", F.explode(paths.ancestors(F.col("dir"))).alias("prefix"))
    met = above.join(overrides.select(F.rtrim("prefix", F.lit("/")).alias("prefix"), "classification").distinct(), "prefix")
    any_curated = F.bool_or(F.col("classification") == "curated")
    return met.groupBy("source", "dir").agg(F.when(any_curated, "curated").otherwise(F.min("classification")).alias("override"))


def trusted(media: DataFrame, provenance: DataFrame) -> DataFrame:
    """``media`` with the trust that the classification of its directory gives it; files of unknown directories keep theirs."""
    of = provenance.select(F.col("source"), F.col("dir").alias("of_dir"), F.when(F.col("classification") == "curated", "curated").otherwise("takeout").alias("given"))
    joined = media.withColumn("of_dir", paths.dirname(F.col("rel_path"))).join(of, ["source", "of_dir"], "left")
    return joined.withColumn("trust", F.coalesce("given", "trust")).select(*media.columns)


def directory_provenance(media: DataFrame, sidecars: DataFrame, matched: DataFrame, threshold: float = 0.5, curated: list[str] = (), derived: list[str] = (), overrides: DataFrame | None = None) -> DataFrame:
    """source, dir, counts, ratios, signal, classification, override of each directory.

    ``media`` (source, dir, media_name, recompressed), ``sidecars`` (source, dir, json_name), ``matched`` (source, dir, json_name,
    media_name). Prefixes in ``curated`` and ``derived``, or in a table ``overrides`` (prefix, classification), override the signal.
    """
    files = media.groupBy("source", "dir").agg(F.count("*").alias("media_count"), F.count_if("recompressed").alias("recompressed_count"))
    speaks = names.sidecar_name(F.col("json_name")).isNotNull()
    jsons = sidecars.groupBy("source", "dir").agg(F.count_if(speaks).alias("sidecar_count"), F.max(F.col("json_name").rlike(names.ALBUM_DESCRIPTOR)).alias("descriptor"))
    found = matched.where("media_name is not null").groupBy("source", "dir").agg(F.count("*").alias("matched_count"))
    joined = files.join(jsons, ["source", "dir"], "full").join(found, ["source", "dir"], "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    matched_ratio = F.when(n("media_count") > 0, n("matched_count") / n("media_count")).when(n("sidecar_count") > 0, 1.0).otherwise(0.0)
    recompressed_ratio = F.coalesce(F.try_divide(n("recompressed_count"), n("media_count")), F.lit(0.0))
    named = F.exists(F.split("dir", "/"), lambda c: c.rlike(names.EXPORT_DIR))
    descriptor = F.coalesce("descriptor", F.lit(False))
    signal = scoring.trust_signal(matched_ratio, named, descriptor, recompressed_ratio)
    named_ = [(p, "curated") for p in curated] + [(p, "takeout_derived") for p in derived]
    listed = media.sparkSession.createDataFrame(named_, "prefix string, classification string")
    listed = listed if overrides is None else listed.unionByName(overrides.select("prefix", "classification"))
    joined = joined.join(prefix_overrides(joined.select("source", "dir"), listed), ["source", "dir"], "left")
    return joined.select(
        "source",
        "dir",
        n("media_count").alias("media_count"),
        n("sidecar_count").alias("sidecar_count"),
        F.round(matched_ratio, 4).alias("matched_ratio"),
        named.alias("name_signature"),
        descriptor.alias("descriptor"),
        F.round(recompressed_ratio, 4).alias("recompressed_ratio"),
        signal.alias("signal"),
        F.coalesce("override", F.when(signal >= threshold, "takeout_derived").otherwise("curated")).alias("classification"),
        F.concat(F.lit("config:"), "override").alias("override"),
    )


def mass_identical(media: DataFrame, more_than: int = 25) -> DataFrame:
    """``media`` with mass_identical: more than so many files of its directory share its camera date."""
    where = Window.partitionBy("source", paths.dirname(F.col("rel_path")), "exif_dto")
    return media.withColumn("mass_identical", F.col("exif_dto").isNotNull() & (F.count("exif_dto").over(where) > more_than))
