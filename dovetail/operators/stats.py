"""Counts, histograms, ratios, samples and gates over the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dovetail.sources import shared


def counts(df: DataFrame, key: str) -> DataFrame:
    """Rows of each value of ``key``; rows without one are left out."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))


def size_histogram(df: DataFrame, key: str) -> DataFrame:
    """How many groups of ``key`` have how many rows."""
    return df.groupBy(key).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


def one_sided(df: DataFrame, key: str, side: Column) -> DataFrame:
    """Values of ``key`` all of whose rows are on ``side``."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.bool_and(side).alias("all_on_side")).where("all_on_side").drop("all_on_side")


def date_summary(df: DataFrame, key: str, date: str) -> DataFrame:
    """First day, last day and number of days of each ``key``, and the same as text."""
    day = F.substring(date, 1, 10)
    grouped = df.where(F.col(date).isNotNull()).groupBy(key).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count_distinct(day).alias("days"))
    text = F.when(F.col("days") == 1, F.col("first_day")).otherwise(F.concat(F.col("first_day"), F.lit(" ... "), F.col("last_day"), F.lit(" ("), F.col("days").cast("string"), F.lit(" distinct)")))
    return grouped.withColumn("summary", text)


def first_known(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The first value that is not null of each ``key``, in ``order``."""
    return df.groupBy(key).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias(value))


def histogram(df: DataFrame, words: str) -> DataFrame:
    """Rows for each element of the array ``words``, most first."""
    return df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word")


def ratio(part: Column, whole: Column, empty: float) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(empty))


def sample(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """``k`` rows, the same for the same seed: the smallest hashes of the key."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(k)


def stratified_sample(df: DataFrame, stratum: str, key: str, least: int = 5, share: float = 0.01, seed: int = 0) -> DataFrame:
    """``least`` rows of each stratum, or ``share`` of it where that is more: those of the smallest hashes of the key, so the same for the same seed.

    The hash that bounds a stratum is found by counts of its first digits, so nothing is sorted but the rows that share eight digits with it.
    """
    rows = df.withColumn("digest", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))
    bounds = df.groupBy(stratum).agg(F.greatest(F.lit(least), F.ceil(F.count("*") * F.lit(share))).alias("left")).withColumn("bound", F.lit(""))
    for width in (4, 8):
        at = F.substring("digest", 1, width).alias("head")
        inside = rows.join(bounds, stratum).where(F.startswith("digest", F.col("bound"))).groupBy(stratum, at).agg(F.count("*").alias("n"))
        upward = Window.partitionBy(stratum).orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
        met = inside.withColumn("below", F.coalesce(F.sum("n").over(upward), F.lit(0))).join(bounds.select(stratum, "left"), stratum)
        found = met.where("below < left").groupBy(stratum).agg(F.max_by(F.struct("head", (F.col("left") - F.col("below")).alias("left")), "head").alias("b"))
        bounds = shared.stash(found.select(stratum, F.col("b.left").alias("left"), F.col("b.head").alias("bound")), "bounds")
    joined = rows.join(bounds, stratum)
    sure = joined.where(F.substring("digest", 1, 8) < F.col("bound"))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy("digest", key))
    edge = joined.where(F.startswith("digest", F.col("bound"))).withColumn("place", place).where("place <= left").drop("place")
    return sure.unionByName(edge).select(*df.columns)


def capped(df: DataFrame, order: list[str], most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` rows for a report, and the exact count of all."""
    return df.orderBy(*order).limit(most), df.agg(F.count("*").alias("n"))


def gate(df: DataFrame, message: str) -> None:
    """Raise if there is a row."""
    if not df.isEmpty():
        raise ValueError(message)
