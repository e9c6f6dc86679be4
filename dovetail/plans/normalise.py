"""Normalisation of exports: sidecars to media, edits to originals, albums and recompressed files, published together for the sources at hand.

Sidecars are matched within a directory of a source. The four tables of a run and its decisions become visible by one pointer, or not at
all; what is there of other sources stays, and a run that finds what is there writes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dovetail.functions import names, paths
from dovetail.operators import linkage, stats
from dovetail.sources import shared
from dovetail.sources.catalog import Catalog

KEYS = {"sidecars": ["id"], "albums": ["media_id", "album"], "edits": ["edited_id"], "recompressed": ["id"], "decisions": ["subject", "rule", "run"]}
LEAST_RATE = 0.99


def tables(spark: SparkSession, path: str, rows_per_file: int = 1_000_000) -> Catalog:
    return Catalog(spark, path, KEYS, rows_per_file=rows_per_file)


def normalised(files: DataFrame, texts: DataFrame) -> dict[str, DataFrame]:
    """The tables of ``KEYS`` but decisions, each with its source. ``files`` (id, source, rel_path, kind, mime, exif: map of tags), ``texts`` (id, text) of
    sidecar files; a file without a text has no facts."""
    p = F.col("rel_path")
    placed = files.select("id", "source", "kind", "mime", "exif", "rel_path", paths.dirname(p).alias("in_dir"), paths.basename(p).alias("name"))
    # dealt by id: the names of sidecars are long to read, and all sidecars of an export may stand in one file
    placed = shared.stash(placed.withColumn("dir", F.to_json(F.struct("source", "in_dir"))).repartition("id"), "placed")
    media = placed.where("kind in ('image', 'video')")
    jsons = placed.where("kind = 'sidecar_json'").join(texts.select("id", "text"), "id", "left")
    found = linkage.match_sidecars(jsons.select("dir", F.col("name").alias("json_name")), media.select("dir", F.col("name").alias("media_name")))
    of = media.select("dir", F.col("name").alias("media_name"), F.col("id").alias("media_id"))
    body = names.sidecar_body(F.col("text"))
    read = jsons.select("id", "source", "dir", F.col("name").alias("json_name"), "rel_path", body.alias("b"))
    sidecars = read.join(found, ["dir", "json_name"]).join(of, ["dir", "media_name"], "left")
    sidecars = sidecars.select("id", "source", "rel_path", "media_id", "method", F.when(F.col("media_id").isNotNull() & F.col("b").isNull(), "parse_error").otherwise(F.col("reason")).alias("reason"), "b.taken", "b.created", "b.lat", "b.lon", "b.description", "b.title")
    descriptors = jsons.where(F.col("name").rlike(names.ALBUM_DESCRIPTOR)).groupBy("dir").agg(F.min_by(F.struct(body["title"].alias("title")), "name").alias("d"))
    named = media.join(descriptors, "dir", "left").withColumn("album", names.album_name(F.col("in_dir"), F.col("d").isNotNull(), F.col("d.title")))
    albums = named.where("album is not null").select(F.col("id").alias("media_id"), "album", F.col("in_dir").alias("album_dir"), "source")
    edits = linkage.edited_pairs(media).join(media.select(F.col("id").alias("edited_id"), "source"), "edited_id")
    again = media.where(names.recompressed(F.col("exif"), F.col("mime"))).select("id", "source")
    return {name: shared.stash(df, name) for name, df in (("sidecars", sidecars), ("albums", albums), ("edits", edits), ("recompressed", again))}


def unmatched(files: DataFrame, made: dict[str, DataFrame]) -> DataFrame:
    """source, rel_path, kind, reason: sidecars without media or facts, and media without a sidecar, their own or their original's."""
    lost = made["sidecars"].where("reason is not null").select("source", "rel_path", F.lit("sidecar").alias("kind"), "reason")
    has = made["sidecars"].where("media_id is not null").select(F.col("media_id").alias("id"))
    through = made["edits"].join(has.withColumnRenamed("id", "original_id"), "original_id", "left_semi").select(F.col("edited_id").alias("id"))
    alone = files.where("kind in ('image', 'video')").join(has.unionByName(through), "id", "left_anti")
    return lost.unionByName(alone.select("source", "rel_path", F.lit("media").alias("kind"), F.lit("no_sidecar").alias("reason")))


def summary(files: DataFrame, made: dict[str, DataFrame], least_rate: float = LEAST_RATE) -> DataFrame:
    """A row for each source: media, sidecars, how they were matched, media without one, match_rate, and whether that is below ``least_rate``."""
    media = files.where("kind in ('image', 'video')").groupBy("source").agg(F.count("*").alias("media"))
    how = [F.count_if(F.col("method") == m).alias(m) for m in ("exact", "numbered", "truncation")]
    by_source = made["sidecars"].groupBy("source").agg(F.count("*").alias("sidecars"), *how, F.count_if(F.col("media_id").isNull()).alias("unmatched_sidecars"))
    alone = unmatched(files, made).where("kind = 'media'").groupBy("source").agg(F.count("*").alias("unmatched_media"))
    counts = {name: made[name].groupBy("source").agg(F.count("*").alias(name)) for name in ("albums", "edits", "recompressed")}
    joined = media
    for df in (by_source, alone, *counts.values()):
        joined = joined.join(df, "source", "left")
    joined = joined.fillna(0)
    rate = stats.ratio(F.col("media") - F.col("unmatched_media"), F.col("media"), 1.0)
    return joined.withColumns({"match_rate": rate, "below": rate < least_rate})


def normalise(catalog: Catalog, files: DataFrame, texts: DataFrame, run: str, sources: list[str] | None = None) -> tuple[bool, DataFrame]:
    """Replace what the tables hold of ``sources`` (all of ``files`` unless given) by what is found now; whether anything changed, and the summary."""
    there = [r[0] for r in files.select("source").distinct().collect()] if sources is None else list(sources)
    have = {r[0] for r in files.where(F.col("source").isin(there)).select("source").distinct().collect()}
    if set(there) - have or not there:
        raise ValueError(f"sources without files: {', '.join(sorted(set(there) - have)) or 'all'}")
    mine = files.where(F.col("source").isin(there))
    made = normalised(mine, texts)
    whole = {}
    for name, df in made.items():
        old = catalog.read(name)
        whole[name] = df if old is None else df.unionByName(old.where(~F.col("source").isin(there)).select(*df.columns))
    detail = lambda *c: F.to_json(F.struct(*c)).alias("detail")
    linked = made["edits"].select(F.concat(F.lit("instance:"), F.col("edited_id")).alias("subject"), F.lit("edited.link").alias("rule"), detail("edited_id", "original_id"))
    decided = made["sidecars"].select(F.concat(F.lit("instance:"), F.col("id")).alias("subject"), F.concat(F.lit("sidecar."), F.col("method")).alias("rule"), detail("rel_path", "media_id", "reason")).unionByName(linked)
    changed = catalog.publish(whole, then_append={"decisions": decided.withColumn("run", F.lit(run))})
    return changed, summary(mine, made)
