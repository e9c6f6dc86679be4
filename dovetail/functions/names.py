"""What file names and metadata say: kinds, sidecars, edits, albums, recompression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dovetail.functions import paths

#: Extensions by kind, the formats that are edited in place, and the directories that say nothing.
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".tif", ".tiff", ".heic", ".heif", ".webp", ".bmp", ".dng", ".cr2", ".cr3", ".nef", ".arw", ".orf", ".raf", ".rw2"]
VIDEO_EXTENSIONS = [".mp4", ".mov", ".m4v", ".avi", ".mts", ".m2ts", ".3gp", ".mpg", ".mpeg", ".wmv", ".webm", ".mkv"]
RAW_EXTENSIONS = [".dng", ".cr2", ".cr3", ".nef", ".arw", ".orf", ".raf", ".rw2"]
SAFE_WRITE_TYPES = ["image/jpeg", "image/png", "image/tiff", "image/heic", "image/heif"]
SCAFFOLD_DIRS = ["Takeout", "Google Photos"]
#: Name shapes.
ALBUM_DESCRIPTOR = r"^metadata(\(\d+\))?\.json$"
DATED_ALBUM = r"^Photos from \d{4}$"
EXPORT_DIR = r"^(Photos from \d{4}|Google Photos|Takeout)$"
SUPPLEMENT = ".supplemental-metadata"
EDITED = "-edited"


def kind(mime: Column, path: Column) -> Column:
    """image, video, sidecar_json, sidecar_xmp or other; the extension decides only where there is no type."""
    ext = F.lower(paths.ext(path))
    by_ext = F.when(ext == ".json", "sidecar_json").when(ext == ".xmp", "sidecar_xmp").when(ext.isin(IMAGE_EXTENSIONS), "image").when(ext.isin(VIDEO_EXTENSIONS), "video").otherwise("other")
    by_type = (
        F.when(mime == "application/json", "sidecar_json")
        .when((ext == ".xmp") | (mime == "application/rdf+xml"), "sidecar_xmp")
        .when(F.startswith(mime, F.lit("image/")), "image")
        .when(F.startswith(mime, F.lit("video/")), "video")
        .otherwise("other")
    )
    return F.when(mime.isNull(), by_ext).otherwise(by_type)


def file_flags(mime: Column, kind_: Column, size: Column, error: Column, decoded: Column, video_flag: Column) -> Column:
    """Flags of a scanned file, in their fixed order."""
    found = F.array(
        F.when(mime.isNull() & (kind_ != "other"), F.lit("mime_from_extension")),
        F.when(error.isNotNull(), F.lit("unreadable_metadata")),
        F.when(size == 0, F.lit("zero_byte")),
        F.when((kind_ == "image") & ~decoded, F.lit("corrupt")),
        video_flag,
    )
    return F.array_compact(found)


def sidecar_name(name: Column) -> Column:
    """struct(base, number) of a sidecar's name: the media name it speaks of; null for album descriptors and other names."""
    core = F.regexp_replace(name, r"(?s)\.json$", "")
    number = F.regexp_extract(core, r"(?s)^.+\((\d+)\)$", 1)
    bare = F.when(number != "", F.regexp_extract(core, r"(?s)^(.+)\(\d+\)$", 1)).otherwise(core)
    cuts = "|".join(SUPPLEMENT[:n].replace(".", r"\.") for n in range(len(SUPPLEMENT), 3, -1))
    base = F.regexp_replace(bare, f"(?:{cuts})$", "")
    fits = F.endswith(name, F.lit(".json")) & ~name.rlike(ALBUM_DESCRIPTOR)
    return F.when(fits, F.struct(base.alias("base"), F.nullif(number, F.lit("")).try_cast("int").alias("number")))


def numbered(base: Column, number: Column) -> Column:
    return F.concat(paths.stem(base), F.lit("("), number.cast("string"), F.lit(")"), paths.ext(base))


def edited_original(name: Column) -> Column:
    """The name of the file that an edited one was made from; null for others."""
    stem = paths.stem(name)
    cut = F.char_length(stem) - len(EDITED)
    return F.when(F.endswith(stem, F.lit(EDITED)) & (cut > 0), F.concat(F.substring(stem, F.lit(1), cut), paths.ext(name)))


def recompressed(exif: Column, mime: Column) -> Column:
    """Whether a JPEG was encoded anew by the export: no maker notes, and its software says so. ``exif``: map of tags."""
    notes = F.exists(F.map_keys(exif), lambda k: F.startswith(k, F.lit("MakerNotes")))
    software = F.lower(F.coalesce(F.element_at(exif, F.lit("EXIF:Software")), F.lit("")))
    return F.coalesce((mime == "image/jpeg") & ~notes & F.contains(software, F.lit("google")), F.lit(False))


def album_name(dir_path: Column, has_descriptor: Column, title: Column) -> Column:
    """The album that a directory is: the descriptor's title or the directory's name; null for dated and root directories."""
    name = F.nullif(paths.basename(dir_path), F.lit(""))
    plain = ~name.rlike(DATED_ALBUM) & (name != "Google Photos")
    return F.when(has_descriptor, F.coalesce(F.nullif(title, F.lit("")), name)).when(plain, name)


def epoch_iso(seconds: Column) -> Column:
    """Seconds since 1970, as text, as an ISO time in UTC."""
    return F.concat(F.date_format(F.timestamp_seconds(seconds.try_cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def sidecar_body(text: Column) -> Column:
    """struct(title, description, taken, created, lat, lon) of a sidecar's JSON; null if it is no JSON object. (0, 0) is no place."""
    get = lambda path: F.get_json_object(text, path)
    lat, lon = (get(f"$.geoData.{k}").try_cast("double") for k in ("latitude", "longitude"))
    place = lat.isNotNull() & lon.isNotNull() & ~((lat == 0) & (lon == 0))
    body = F.struct(
        F.nullif(get("$.title"), F.lit("")).alias("title"),
        F.nullif(get("$.description"), F.lit("")).alias("description"),
        epoch_iso(get("$.photoTakenTime.timestamp")).alias("taken"),
        epoch_iso(get("$.creationTime.timestamp")).alias("created"),
        F.when(place, lat).alias("lat"),
        F.when(place, lon).alias("lon"),
    )
    return F.when(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), body)


def content_identifier(exif: Column) -> Column:
    """The value of the tag that ends in ContentIdentifier, which pairs a still with its clip."""
    found = F.filter(F.map_entries(exif), lambda e: F.substring_index(e["key"], ":", -1) == "ContentIdentifier")
    return F.get(F.transform(found, lambda e: e["value"]), F.lit(0))


def tag_richness(exif: Column) -> Column:
    """How many tags say something about the picture."""
    counts = lambda k: (k != "SourceFile") & ~k.rlike(r"^(?:File:|ExifTool:|Composite:)")
    return F.size(F.filter(F.map_keys(exif), counts)).cast("bigint")


def keywords(path: Column, folder_patterns: tuple[str, ...]) -> Column:
    """The directories that are topics: neither scaffold nor dated from their start."""
    from dovetail.functions.dates import java

    def topic(c: Column) -> Column:
        out = (c != "") & ~c.isin(SCAFFOLD_DIRS) & ~c.rlike(DATED_ALBUM)
        for p in folder_patterns:
            out = out & ~c.rlike("^(?:" + java(p) + ")")
        return out

    return F.filter(paths.components(path), topic)
