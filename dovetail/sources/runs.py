"""Bookkeeping of stage runs: a log of events in a stored table, and the state of each run read from it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dovetail.sources import store

EVENTS = "run_id string, stage string, event string, at timestamp, args string"


@contextmanager
def recorded(log: store.Table, stage: str, args: dict | None = None) -> Iterator[str]:
    """The id of a new run. Its start is logged at once, and its end as ok or, where an exception passes, as failed."""
    run_id = uuid.uuid4().hex
    said = json.dumps(args or {}, sort_keys=True)

    def add(event: str) -> None:
        rows = log.spark.createDataFrame([(run_id, stage, event, said)], "run_id string, stage string, event string, args string")
        log.append(rows.select("run_id", "stage", "event", F.current_timestamp().alias("at"), "args"))

    add("running")
    try:
        yield run_id
    except BaseException:
        add("failed")
        raise
    add("ok")


def states(log: DataFrame) -> DataFrame:
    """run_id, stage, started, finished (null while it runs), status, args of every run in ``log`` (EVENTS)."""
    start, end = F.col("event") == "running", F.col("event") != "running"
    return log.groupBy("run_id").agg(
        F.min("stage").alias("stage"),
        F.min(F.when(start, F.col("at"))).alias("started"),
        F.min(F.when(end, F.col("at"))).alias("finished"),
        F.coalesce(F.min_by("event", F.when(end, F.col("at"))), F.lit("running")).alias("status"),
        F.min("args").alias("args"),
    )


def latest(log: DataFrame) -> DataFrame:
    """The last run of each stage, by its start and then its id."""
    found = states(log)
    columns = [c for c in found.columns if c != "stage"]
    return found.groupBy("stage").agg(F.max_by(F.struct(*columns), F.struct("started", "run_id")).alias("row")).select("stage", "row.*")
