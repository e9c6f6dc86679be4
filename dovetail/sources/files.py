"""Scans of folders and small files, as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Composed form; Spark has no such function."""
    import unicodedata

    return text.map(lambda t: unicodedata.normalize("NFC", t) if t is not None else None)


def below(path: Column, root: str) -> Column:
    """What follows ``root`` in ``path``, whatever scheme stands before it."""
    base = root.rstrip("/") + "/"
    return F.substring(path, F.instr(path, F.lit(base)) + len(base), F.char_length(path))


def walk(spark: SparkSession, root: str) -> DataFrame:
    """rel_path (composed), size_bytes, modified of every file below ``root``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    return files.select(nfc(below(F.col("path"), root)).alias("rel_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def digests(spark: SparkSession, root: str) -> DataFrame:
    """rel_path, size_bytes, sha256 of every file below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(nfc(below(F.col("path"), root)).alias("rel_path"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def changed(scan: DataFrame, known: DataFrame) -> DataFrame:
    """Scanned files that are new, or whose size or time differs from what is known by (source, rel_path)."""
    old = known.select("source", "rel_path", F.col("size_bytes").alias("old_size"), F.col("modified").alias("old_modified"), F.lit(True).alias("is_known"))
    joined = scan.join(old, ["source", "rel_path"], "left")
    same = F.col("is_known") & F.col("old_size").eqNullSafe(F.col("size_bytes")) & F.col("old_modified").eqNullSafe(F.col("modified"))
    return joined.where(~F.coalesce(same, F.lit(False))).select(*scan.columns)


def tree(listing: DataFrame, ignored_names: list[str], ignored_dirs: list[str]) -> DataFrame:
    """``listing`` (rel_path) without ignored names and top directories."""
    return listing.where(~F.substring_index("rel_path", "/", -1).isin(ignored_names) & ~F.substring_index("rel_path", "/", 1).isin(ignored_dirs))


def json_bodies(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """rel_path and text of every matching file."""
    read = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root)
    # the path comes with escapes; a plus sign in it is one
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return read.select(below(path, root).alias("rel_path"), F.col("value").alias("text"))


def archive_members(spark: SparkSession, root: str) -> DataFrame:
    """rel_path, member, size_bytes, sha256 of every file in the zip archives below ``root``, read in pieces; nothing is unpacked.

    An archive is held whole (2 GB at most), a member never. One that cannot be read gives a row with a null member.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        import io
        import zipfile
        import zlib

        for batch in batches:
            for path, content in zip(batch["rel_path"], batch["content"]):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for info in z.infolist():
                            if not info.is_dir():
                                digest = hashlib.sha256()
                                with z.open(info) as f:
                                    while piece := f.read(1 << 20):
                                        digest.update(piece)
                                rows.append((path, info.filename, info.file_size, digest.hexdigest()))
                except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, OSError):
                    rows = [(path, None, None, None)]
                if rows:
                    yield pd.DataFrame(rows, columns=["rel_path", "member", "size_bytes", "sha256"]).astype({"size_bytes": "Int64"})

    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(root)
    return found.select(below(F.col("path"), root).alias("rel_path"), "content").mapInPandas(run, "rel_path string, member string, size_bytes long, sha256 string")


def verify_report(spark: SparkSession, path: str) -> DataFrame:
    """passed, counts, discrepancies of the JSON report that a verification left."""
    schema = "passed boolean, counts array<struct<disposition: string, n: long, bytes: long>>, discrepancies array<struct<kind: string, subject: string>>"
    return spark.read.schema(schema).json(path, multiLine=True)


def trash_records(texts: DataFrame, root: str) -> DataFrame:
    """original_rel, below ``root``, and entry (name without ending) of each readable trash record (rel_path, text).

    Records of paths elsewhere confirm nothing and are left out. Of several for a path the last by name counts, so that no removal
    meets two.
    """
    path = F.get_json_object("text", "$.path")
    prefix = root.rstrip("/") + "/"
    entry = F.regexp_replace(F.substring_index("rel_path", "/", -1), r"(?s)(?<=.)\.[^.]*$", "")
    inside = texts.where(F.startswith(path, F.lit(prefix))).select(F.substring(path, F.lit(len(prefix) + 1), F.char_length(path)).alias("original_rel"), entry.alias("entry"))
    return inside.groupBy("original_rel").agg(F.max("entry").alias("entry"))


def keyword_map(spark: SparkSession, path: str) -> DataFrame:
    """folder_name, keyword (null: dropped) of a CSV with folder_name, proposed_keyword, action, in any order of columns.

    Keep and rename take what is proposed, or the folder's name where nothing is; no action is keep, any other raises. Rows without a
    name are left out, and of several rows of a name the last counts. The file is edited by hand, so it is small.
    """
    rows = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path)
    # of names that have nothing but spaces, nothing is left
    said = {c: F.nullif(F.trim(c), F.lit("")) if c in rows.columns else F.lit(None).cast("string") for c in ("folder_name", "proposed_keyword", "action")}
    rows = rows.select(F.monotonically_increasing_id().alias("at"), *(said[c].alias(c) for c in said)).where("folder_name is not null")
    action = F.lower(F.coalesce("action", F.lit("keep")))
    wrong = F.raise_error(F.concat(F.lit("unknown action "), action, F.lit(" for "), F.col("folder_name"))).cast("string")
    keyword = F.when(action.isin("keep", "rename"), F.coalesce("proposed_keyword", "folder_name")).when(action != "drop", wrong)
    return rows.select("folder_name", "at", keyword.alias("keyword")).groupBy("folder_name").agg(F.max(F.struct("at", "keyword")).alias("row")).select("folder_name", "row.keyword")


def perceptual_hashes(files: DataFrame) -> DataFrame:
    """rel_path, phash, dhash, width, height of images (rel_path, content); nulls for what cannot be read. Needs Pillow and imagehash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import imagehash
        from PIL import Image, ImageOps

        for batch in batches:
            rows = []
            for path, content in zip(batch["rel_path"], batch["content"]):
                try:
                    image = ImageOps.exif_transpose(Image.open(io.BytesIO(content))).convert("RGB")
                    size = image.size
                    image.thumbnail((512, 512))
                    rows.append((path, str(imagehash.phash(image)), str(imagehash.dhash(image)), *size))
                except (OSError, ValueError):
                    rows.append((path, None, None, None, None))
            yield pd.DataFrame(rows, columns=["rel_path", "phash", "dhash", "width", "height"])

    return files.select("rel_path", "content").mapInPandas(run, "rel_path string, phash string, dhash string, width int, height int")
