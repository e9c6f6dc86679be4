"""Typed columns from the raw tag dump of a file, a JSON object of tags by group and name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dovetail.functions import dates

#: The tags that hold a size or a date, in the order in which they are asked; groups that say nothing of the picture.
WIDTH_TAGS = ["File:ImageWidth", "EXIF:ExifImageWidth", "PNG:ImageWidth"]
HEIGHT_TAGS = ["File:ImageHeight", "EXIF:ExifImageHeight", "PNG:ImageHeight"]
CREATE_DATE_TAGS = ["EXIF:CreateDate", "QuickTime:CreateDate", "XMP:CreateDate"]
PLAIN_GROUPS = r"^(?:File:|ExifTool:|Composite:)"


def _variant(raw: Column, tag: str, kind: str) -> Column:
    """The tag's value if it is of the kind that is asked for."""
    path = f"$['{tag}']"
    found = F.schema_of_variant(F.try_variant_get(raw, path, "variant"))
    fits = {"string": found == "STRING", "bigint": found == "BIGINT", "double": (found == "BIGINT") | (found == "DOUBLE") | found.startswith("DECIMAL")}[kind]
    return F.when(fits, F.try_variant_get(raw, path, kind))


def text_tag(raw: Column, *tags: str) -> Column:
    """The first of ``tags`` that is a text with something in it, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(_variant(raw, t, "string")), F.lit("")) for t in tags))


def whole_tag(raw: Column, *tags: str) -> Column:
    """The first of ``tags`` that is a whole number."""
    return F.coalesce(*(_variant(raw, t, "bigint") for t in tags))


def fields(text: Column) -> dict[str, Column]:
    """mime, exif_dto, place, camera, tags (how many say something of the picture), width, height, error of a dump; nulls for no JSON."""
    raw = F.try_parse_json(text)
    names = F.json_object_keys(text)
    counted = F.filter(names, lambda k: (k != "SourceFile") & ~k.rlike(PLAIN_GROUPS))
    return {
        "mime": text_tag(raw, "File:MIMEType"),
        "exif_dto": dates.exif_to_iso(text_tag(raw, "EXIF:DateTimeOriginal")),
        "gps_lat": _variant(raw, "Composite:GPSLatitude", "double"),
        "gps_lon": _variant(raw, "Composite:GPSLongitude", "double"),
        "camera_make": text_tag(raw, "EXIF:Make"),
        "camera_model": text_tag(raw, "EXIF:Model"),
        "tags": F.size(counted).cast("bigint"),
        "width": whole_tag(raw, *WIDTH_TAGS).cast("int"),
        "height": whole_tag(raw, *HEIGHT_TAGS).cast("int"),
        "error": text_tag(raw, "ExifTool:Error"),
    }


def exif_candidate(exif_dto: Column, text: Column) -> Column:
    """struct(date, from_create_date): the camera's date, or else the first creation date that can be read."""
    raw = F.try_parse_json(text)
    created = F.coalesce(*(dates.exif_to_iso(_variant(raw, t, "string")) for t in CREATE_DATE_TAGS))
    has = F.nullif(exif_dto, F.lit(""))
    return F.struct(F.coalesce(has, created).alias("date"), (has.isNull() & created.isNotNull()).alias("from_create_date"))
