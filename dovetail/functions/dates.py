"""Dates that names, folders and metadata carry, and the rules that choose among them. Dates are ISO text with a precision."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from dovetail.functions import paths

#: The patterns that date a folder, tried in this order on each component, the deepest first.
FOLDER_PATTERNS = (
    r"^(?P<year>(19|20)\d{2})$",
    r"^(?P<year>(19|20)\d{2})-(?P<month>0[1-9]|1[0-2])$",
    r"^(?P<year>(19|20)\d{2})-(?P<month>0[1-9]|1[0-2])-(?P<day>0[1-9]|[12]\d|3[01])$",
    r"^(?P<year>(19|20)\d{2})-(?P<month>0[1-9]|1[0-2])-(?P<day>0[1-9]|[12]\d|3[01])[_ -].*$",
    r"^(?P<year>(19|20)\d{2})[_ -](?P<event>\D.*)$",
    r"^(?P<year>(19|20)\d{2})(?P<month>0[1-9]|1[0-2])(?P<day>0[1-9]|[12]\d|3[01])[_ -].*$",
    r"^Photos from (?P<year>(19|20)\d{2})$",
    r"^(?P<event>.*[^\d_ -])[_ -](?P<year>(19|20)\d{2})$",
    r"^(?P<year>(19|20)\d{2})[?~]$",
    r"(?<![\d])(?P<year>(19|20)\d{2})(?P<month>0[1-9]|1[0-2])(?P<day>0[1-9]|[12]\d|3[01])(?![\d])",
    r"(?<![\d])(?P<year>(19|20)\d{2})(?P<month>0[1-9]|1[0-2])(?![\d])",
)
#: The patterns that date a file name, in this order.
FILENAME_PATTERNS = (
    r"^(?:IMG|VID|PXL|MVIMG)[-_](?P<year>(19|20)\d{2})(?P<month>\d{2})(?P<day>\d{2})[-_](?P<hour>\d{2})(?P<minute>\d{2})(?P<second>\d{2})",
    r"^(?P<year>(19|20)\d{2})(?P<month>\d{2})(?P<day>\d{2})[-_ ](?P<hour>\d{2})(?P<minute>\d{2})(?P<second>\d{2})",
    r"^IMG-(?P<year>(19|20)\d{2})(?P<month>\d{2})(?P<day>\d{2})-WA",
    r"(?<![\d])(?P<year>(19|20)\d{2})-(?P<month>0[1-9]|1[0-2])(?:-(?P<day>0[1-9]|[12]\d|3[01])(?:[ _T](?P<hour>[01]\d|2[0-3])[.:_-](?P<minute>[0-5]\d)[.:_-](?P<second>[0-5]\d))?)?(?![\d])",
    r"(?<![\d])(?P<year>(19|20)\d{2})(?P<month>0[1-9]|1[0-2])(?P<day>0[1-9]|[12]\d|3[01])(?![\d])",
    r"(?<![\d])(?P<year>(19|20)\d{2})(?P<month>0[1-9]|1[0-2])(?![\d])",
)
#: Names of ranges carry no date; dates that clocks start from; years after a dated folder that mean a scan; confidences.
RANGE_NAME = r"(?i)(?<!\d)(?:19|20)\d{2}(?:[-.]?\d{2}[-.]?\d{2})?[-_ ]+to[-_ ]+(?:19|20)\d{2}"
EPOCH_DATES = ["1970-01-01", "1980-01-01", "2000-01-01"]
SCAN_YEARS = 2
SCANNED_TYPES = ["image/png", "image/tiff"]
CONFIDENCE = {"R1": 0.95, "R2": 0.85, "R3": 0.8, "R3f": 0.82, "R4": 0.7, "R4b": 0.6, "R4bf": 0.68, "R5": 0.5}
#: Characters of an ISO date that each precision covers, and the rank of each source when dates are merged.
PRECISION_CHARS = {"second": 19, "day": 10, "month": 7, "year": 4}
SOURCE_RANK = {"review": 5.0, "folder": 4.0, "exif": 3.0, "takeout_json": 2.0, "filename": 1.0}

_FOUND = "struct<date:string,precision:string>"
_PARTS = ("year", "month", "day", "hour", "minute", "second")


def java(pattern: str) -> str:
    return pattern.replace("(?P<", "(?<")


def _of_match(text: Column, pattern: str, make: Callable[..., Column]) -> Column:
    """What ``make`` gives for the named groups of the pattern's first match (null where one took no part); null without a match. Texts that do not match
    cost one look, and each group is taken once, however often ``make`` names it."""
    places = re.compile(pattern).groupindex
    groups = [F.regexp_extract(text, java(pattern), k).alias(name) for name, k in places.items() if name in _PARTS]
    none = F.lit(None).cast("string")
    if not groups:
        return F.lit(None).cast(_FOUND)
    made = F.transform(F.array(F.struct(*groups)), lambda g: make(*(F.nullif(g[name], F.lit("")) if name in places else none for name in _PARTS)))
    return F.when(text.rlike(java(pattern)), F.get(made, F.lit(0)))


def is_date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd").isNotNull()


def _as_found(date: Column, precision: str) -> Column:
    return F.struct(date.alias("date"), F.lit(precision).alias("precision"))


def _folder_date(year: Column, month: Column, day: Column, *_: Column) -> Column:
    return (
        F.when(year.isNull(), F.lit(None).cast(_FOUND))
        .when(day.isNotNull(), F.when(is_date(year, month, day), _as_found(F.concat_ws("-", year, month, day), "day")))
        .when(month.isNotNull(), F.when(month.between("01", "12"), _as_found(F.concat(year, F.lit("-"), month, F.lit("-01")), "month")))
        .otherwise(_as_found(F.concat(year, F.lit("-01-01")), "year"))
    )


def folder_candidate(path: Column, patterns: tuple[str, ...] = FOLDER_PATTERNS) -> Column:
    """struct(date, precision) of the deepest directory that a pattern dates, else null."""
    found = F.transform(F.reverse(paths.components(path)), lambda c: F.coalesce(*(_of_match(c, p, _folder_date) for p in patterns)))
    return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))


def _filename_date(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    date = F.concat_ws("-", year, month, day)
    clock = (F.try_to_number(hour, F.lit("99")) < 24) & (F.try_to_number(minute, F.lit("99")) < 60) & (F.try_to_number(second, F.lit("99")) < 60)
    return (
        F.when(year.isNull() | month.isNull(), F.lit(None).cast(_FOUND))
        .when(day.isNull(), F.when(month.between("01", "12"), _as_found(F.concat(year, F.lit("-"), month, F.lit("-01")), "month")))
        .when(~is_date(year, month, day), F.lit(None).cast(_FOUND))
        .when(F.coalesce(clock, F.lit(False)), _as_found(F.concat(date, F.lit("T"), F.concat_ws(":", hour, minute, second)), "second"))
        .otherwise(_as_found(date, "day"))
    )


def filename_candidate(path: Column, patterns: tuple[str, ...] = FILENAME_PATTERNS, serial: str = "") -> Column:
    """struct(date, precision) of the first pattern that dates the file's name, else null. ``serial``: a pattern of running numbers in names, which
    may look like dates and are none. The patterns read a lambda's variable, as compiled code of all of them is over the JVM's 64 KB a method."""
    name = paths.basename(path)
    if serial:
        name = F.regexp_replace(name, java(serial), "")
    return F.get(F.transform(F.array(name), lambda n: F.when(~n.rlike(RANGE_NAME), F.coalesce(*(_of_match(n, p, _filename_date) for p in patterns)))), F.lit(0))


#: Fixed value: the shape of a camera's date text.
EXIF_DATE = r"^(\d{4}):(\d{2}):(\d{2})[ T](\d{2}):(\d{2}):(\d{2})(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$"


def exif_to_iso(value: Column) -> Column:
    """A camera's date text as ISO; null if it is none, or zero."""
    text = F.trim(value)
    g = [F.regexp_extract(text, EXIF_DATE, k) for k in range(9)]
    zone = F.when(g[8] == "Z", "+00:00").otherwise(g[8])
    iso = F.concat(g[1], F.lit("-"), g[2], F.lit("-"), g[3], F.lit("T"), g[4], F.lit(":"), g[5], F.lit(":"), g[6], g[7], zone)
    return F.when((g[0] != "") & (g[1] != "0000") & (g[2] != "00") & (g[3] != "00"), iso)


def year_of(iso: Column) -> Column:
    return F.substring(iso, 1, 4).try_cast("int")


def exif_flags(exif: Column, from_create_date: Column, mime: Column, camera_year: Column, folder: Column, precision: Column, mass: Column) -> Column:
    """Reasons to distrust a camera date, in their fixed order; none without a camera date."""
    found = F.array(
        F.when(F.substring(exif, 1, 10).isin(EPOCH_DATES), F.lit("epoch_default")),
        F.when(mass, F.lit("mass_identical")),
        F.when(year_of(exif) < camera_year, F.lit("predates_camera")),
        F.when(precision.isin("day", "month") & (year_of(exif) - year_of(folder) >= SCAN_YEARS), F.lit("scanner_date")),
        F.when(from_create_date & mime.isin(SCANNED_TYPES), F.lit("scanner_createdate")),
    )
    return F.when(exif.isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(found))


def within(date: Column, folder: Column, precision: Column) -> Column:
    """Whether a date is close enough to a folder's: the same month for day and month folders, else the same year."""
    return F.when(precision.isin("day", "month"), F.substring(date, 1, 7) == F.substring(folder, 1, 7)).otherwise(F.substring(date, 1, 4) == F.substring(folder, 1, 4))


def resolve(exif: Column, trusted: Column, folder: Column, folder_precision: Column, curated: Column, takeout: Column, artifact: Column, filename: Column, filename_precision: Column) -> Column:
    """struct(date, precision, source, status, confidence, rule): the first rule that applies."""

    def chosen(rule: str, date: Column, precision: Column, source: str) -> Column:
        return F.struct(date.alias("date"), precision.alias("precision"), F.lit(source).alias("source"), F.lit("auto").alias("status"), F.lit(CONFIDENCE[rule]).alias("confidence"), F.lit(rule).alias("rule"))

    none = F.lit(None).cast("string")

    def conflict(rule: str) -> Column:
        return F.struct(none.alias("date"), none.alias("precision"), none.alias("source"), F.lit("conflict").alias("status"), F.lit(None).cast("double").alias("confidence"), F.lit(rule).alias("rule"))

    second = F.lit("second")
    has_exif = exif.isNotNull() & trusted
    in_curated = folder.isNotNull() & curated
    return (
        F.when(has_exif & in_curated & within(exif, folder, folder_precision), chosen("R1", exif, second, "exif"))
        .when(has_exif & in_curated, conflict("R6"))
        .when(has_exif, chosen("R2", exif, second, "exif"))
        .when(in_curated & filename.isNull(), chosen("R3", folder, folder_precision, "folder"))
        .when(in_curated & within(filename, folder, folder_precision), chosen("R3f", filename, filename_precision, "filename"))
        .when(in_curated, conflict("R3c"))
        .when(takeout.isNotNull() & ~F.coalesce(artifact, F.lit(False)), chosen("R4", takeout, second, "takeout_json"))
        .when(folder.isNotNull() & filename.isNull(), chosen("R4b", folder, folder_precision, "folder"))
        .when(folder.isNotNull(), chosen("R4bf", filename, filename_precision, "filename"))
        .when(filename.isNotNull(), chosen("R5", filename, filename_precision, "filename"))
        .otherwise(conflict("R7"))
    )


def precision_chars(precision: Column, default: int) -> Column:
    out = F.lit(default)
    for name, n in PRECISION_CHARS.items():
        out = F.when(precision == name, n).otherwise(out)
    return out


def source_rank(source: Column, trust: Column) -> Column:
    """How much a source counts in a merge; a folder of an export counts less than its sidecars."""
    out = F.lit(0.0)
    for name, rank in SOURCE_RANK.items():
        out = F.when(source == name, rank).otherwise(out)
    return F.when((source == "folder") & (trust != "curated"), 1.5).otherwise(out)


def contains(folder: Column, precision: Column, resolved: Column) -> Column:
    """Whether a folder's date brackets a resolved one."""
    same = lambda n: F.substring(resolved, 1, n) == F.substring(folder, 1, n)
    return F.when(precision == "year", same(4)).when(precision == "month", same(7)).otherwise(same(10))


def manual_date(text: Column) -> Column:
    """struct(date, precision) of a date typed as year, month, day or second; null if there is no such day."""
    t = F.trim(text)
    day = F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd").isNotNull()
    return (
        F.when(t.rlike(r"^\d{4}$"), _as_found(F.concat(t, F.lit("-01-01")), "year"))
        .when(t.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), _as_found(F.concat(t, F.lit("-01")), "month"))
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}$") & day, _as_found(t, "day"))
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d:[0-5]\d$") & day, _as_found(t, "second"))
        .otherwise(F.lit(None).cast(_FOUND))
    )


def coarse_bucket(text: Column) -> Column:
    """``pre-2000`` or a range of years in order; else null."""
    t = F.trim(text)
    first, last = F.substring(t, 1, 4), F.substring(t, 6, 4)
    return F.when((t == "pre-2000") | (t.rlike(r"^(19|20)\d{2}-(19|20)\d{2}$") & (first <= last)), t)


def padded_exif(iso: Column) -> Column:
    """An ISO date as a camera writes it, padded to the second, without its zone."""
    clock = F.when(F.char_length(iso) >= 19, F.substring(iso, 12, 8)).otherwise("00:00:00")
    return F.concat(F.translate(F.substring(iso, 1, 10), "-", ":"), F.lit(" "), clock)
