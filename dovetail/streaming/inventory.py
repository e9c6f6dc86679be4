"""Extras that the batch stages do not need: inventory batches as a stream, and windowed counts of an event log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dovetail.sources import store
from dovetail.sources.catalog import Catalog


def _one_of_each(batch: DataFrame, keys: list[str]) -> DataFrame:
    """Of several rows of a key, the last by its other columns as JSON: the same whenever the batch runs, whatever types they have."""
    others = [c for c in batch.columns if c not in keys]
    if not others:
        return batch.distinct()
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*others), F.to_json(F.struct(*others))).alias("row")).select(*keys, "row.*")


def ingest(spark: SparkSession, folder: str, schema: str, table: store.Table, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Merge every new Parquet file of ``folder`` into ``table`` by ``keys``; a batch that runs again changes nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        old, new = table.read(), _one_of_each(batch, keys)
        table.write(new if old is None else store.upsert(old, new, keys))

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_keyed(spark: SparkSession, folder: str, schema: str, catalog: Catalog, name: str, checkpoint: str) -> StreamingQuery:
    """As ``ingest``, into a keyed table: a batch reads and rewrites only the files that may hold its keys."""

    def merge(batch: DataFrame, _: int) -> None:
        catalog.merge(name, _one_of_each(batch, catalog.keys[name]))

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count("*").alias("n")).select("window.start", key, "n")


def append(log: DataFrame, path: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """Append a stream of decisions to a Parquet log, each once."""
    return change(log).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
