"""Bit-vector distance, shape, and the score that picks a winner among duplicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dovetail.functions import names, paths


def bits(text: Column) -> Column:
    """The bits of a hex text of up to 16 digits."""
    return F.conv(text, 16, -10).try_cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hex texts of equal length, up to 64 bits; null if one is missing or empty."""
    same = (F.char_length(a) == F.char_length(b)) & (a != "")
    return F.when(same, F.bit_count(bits(a).bitwiseXOR(bits(b))))


def band(phash: Column, i: int) -> Column:
    """The ``i``-th 16 bits from the low end of 64."""
    return F.substring(phash, 13 - 4 * i, 4)


def aspect_close(w1: Column, h1: Column, w2: Column, h2: Column, tolerance: float = 0.01) -> Column:
    """Whether two shapes are known and agree within one in a hundred."""
    a, b = F.try_divide(w1, h1), F.try_divide(w2, h2)
    near = F.try_divide(F.abs(a - b), F.greatest(a, b)) <= tolerance
    return F.coalesce(near & (a > 0) & (b > 0), F.lit(False))


def format_rank(path: Column, recompressed: Column) -> Column:
    raw = F.lower(paths.ext(path)).isin(names.RAW_EXTENSIONS)
    return F.when(raw, 2.0).when(recompressed, 0.0).otherwise(1.0)


def score_parts(path: Column, width: Column, height: Column, size: Column, tags: Column, trusted_date: Column, curated: Column, recompressed: Column) -> dict[str, Column]:
    """The parts of the score, unrounded."""
    megapixels = F.coalesce(width, F.lit(0)).cast("double") * F.coalesce(height, F.lit(0)) / 1e6
    return {
        "resolution": 3.0 * F.log2(F.greatest(megapixels, F.lit(0.01))),
        "format": 1.5 * format_rank(path, recompressed),
        "richness": F.least(F.coalesce(tags, F.lit(0)), F.lit(60)) / 60.0,
        "trusted_date": F.when(trusted_date, 1.0).otherwise(0.0),
        "source_trust": F.when(curated, 0.75).otherwise(0.0),
        "size": 0.5 * F.log10(F.greatest(size, F.lit(1)).cast("double")),
        "recompression": F.when(recompressed, -2.0).otherwise(0.0),
    }


def total(parts: dict[str, Column]) -> Column:
    out = F.lit(0.0)
    for part in parts.values():
        out = out + part
    return F.round(out, 4)


def video_signature(text: Column) -> Column:
    """struct(seconds, width, height, hashes) of ``<seconds>s:<width>x<height>:<hash>:...``; null for other texts."""
    shape = r"^(\d+)s:(\d+)x(\d+):(.+)$"
    g = lambda k: F.regexp_extract(text, shape, k)
    parsed = F.struct(g(1).try_cast("double").alias("seconds"), g(2).try_cast("int").alias("width"), g(3).try_cast("int").alias("height"), F.split(g(4), ":").alias("hashes"))
    return F.when(text.rlike(shape), parsed)


def videos_similar(a: Column, b: Column, most: int = 6) -> Column:
    """Whether two signatures are a second apart at most, of one shape, with two keyframes within ``most`` bits."""
    near = F.zip_with(a["hashes"], b["hashes"], lambda x, y: (x != "?") & (y != "?") & (hamming(x, y) <= most))
    close = F.size(F.filter(near, lambda x: F.coalesce(x, F.lit(False)))) >= 2
    return F.coalesce((F.abs(a["seconds"] - b["seconds"]) <= 1) & aspect_close(a["width"], a["height"], b["width"], b["height"]) & close, F.lit(False))


def trust_signal(matched: Column, named: Column, descriptor: Column, recompressed: Column) -> Column:
    """How far a directory looks like an export, from 0 to 1."""
    raw = 0.6 * matched + F.when(named, 0.5).otherwise(0.0) + F.when(descriptor, 0.3).otherwise(0.0) + 0.2 * recompressed
    return F.round(F.least(F.lit(1.0), raw), 4)
