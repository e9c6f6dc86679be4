"""Proof that nothing was lost: the ledger against the inventory and against what is on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILELESS = ["excluded", "removed", "exported"]
VALID = ["archive", "quarantine", *FILELESS]


def discrepancies(inventory: DataFrame, ledger: DataFrame, disk: DataFrame, checksums_only: bool = False, purged: bool = False, ignored_names: list[str] = (), ignored_dirs: list[str] = ()) -> DataFrame:
    """kind, subject of every difference.

    ``inventory`` (id, source, rel_path, sha256), ``ledger`` (id, disposition, dest_rel_path, dest_sha256), ``disk`` (base, rel, sha256).
    """
    subject = F.concat_ws(":", "source", "rel_path")
    placed = inventory.join(ledger, "id").withColumn("subject", subject)
    kept = placed.where(F.col("disposition").isin("archive", "quarantine"))
    recorded = kept.where("coalesce(dest_rel_path, '') <> '' and coalesce(dest_sha256, '') <> ''")
    checked = recorded.where(~(F.col("disposition") == "quarantine") | F.lit(not purged))
    actual = disk.select(F.col("base").alias("disposition"), F.col("rel").alias("dest_rel_path"), F.col("sha256").alias("actual"), F.lit(True).alias("there"))
    on_disk = checked.join(actual, ["disposition", "dest_rel_path"], "left").withColumn("place", F.concat_ws("/", "disposition", "dest_rel_path"))
    known = recorded_paths(ledger)
    stray = disk.where(~F.substring_index("rel", "/", -1).isin(list(ignored_names)) & ~F.substring_index("rel", "/", 1).isin(list(ignored_dirs))).join(known, ["base", "rel"], "left_anti")
    parts = [
        placed.where(~F.col("disposition").isin(VALID)).select(F.lit("invalid_disposition").alias("kind"), "subject"),
        kept.where("coalesce(dest_rel_path, '') = '' or coalesce(dest_sha256, '') = ''").select(F.lit("missing_dest_record"), "subject"),
        recorded.where("disposition = 'quarantine' and dest_sha256 <> sha256").select(F.lit("quarantine_not_byte_identical"), "subject"),
        on_disk.where("there is null").select(F.lit("missing_dest_file"), "subject"),
        on_disk.where("there and actual <> dest_sha256").select(F.lit("hash_mismatch"), "place"),
        stray.select(F.concat(F.lit("orphan_in_"), F.col("base")), "rel"),
    ]
    if not checksums_only:
        parts.append(missing_placement(inventory, ledger).select(F.lit("missing_placement"), subject))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def missing_placement(inventory: DataFrame, ledger: DataFrame) -> DataFrame:
    return inventory.join(ledger, "id", "left_anti")


def recorded_paths(ledger: DataFrame) -> DataFrame:
    """base, rel of all that may stand on disk: recorded paths and, in the archive, their sidecars."""
    named = ledger.where("coalesce(dest_rel_path, '') <> ''")
    archive = named.where("disposition = 'archive'").select(F.lit("archive").alias("base"), F.explode(F.array("dest_rel_path", F.concat("dest_rel_path", F.lit(".xmp")))).alias("rel"))
    return archive.union(named.where("disposition = 'quarantine'").select(F.lit("quarantine"), "dest_rel_path")).distinct()


def counters(inventory: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows and bytes of each disposition; rows without one are left out."""
    return ledger.where("disposition is not null").join(inventory.select("id", "size_bytes"), "id").groupBy("disposition").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))
