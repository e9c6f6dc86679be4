"""Helpers shared by the operators of this subpackage: table access, the shared folder, shipping code."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Spark contexts (by application id) that already have the package.
_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bounds of an Arrow batch while a table is written by ``stash``: whole texts are what a Python worker and its task hold besides
#: their own work.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of bounded rows and bytes inside; the session's own settings come back after."""
    before = {k: spark.conf.get(k, None) for k in BATCHES}
    for k, v in BATCHES.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def map_arrow(df: DataFrame, run: Callable[[Iterator], Iterator], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with this package at hand; the worker gives its free memory back when a task ends."""
    ship(df.sparkSession)

    def task(batches: Iterator) -> Iterator:
        from dovetail.llm import held

        try:
            yield from run(batches)
        finally:
            held.trim()

    return df.mapInArrow(task, schema)


def ship(spark: SparkSession) -> None:
    """Give every executor this subpackage, once a Spark context, so that Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("dovetail/__init__.py", "")
        for p in sorted(here.glob("*.py")):
            z.writestr(f"dovetail/llm/{p.name}", p.read_text())
    folder = tempfile.mkdtemp(prefix="dovetail-")  # of the driver, which serves the file to executors as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "dovetail_llm.zip")
    Path(path).write_bytes(buffer.getvalue())
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local master gets a temporary one where that is unset."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="dovetail-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stash(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it again. Survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_batches(spark):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Parts that the rows of a frequent key are dealt to.
SALTS = 64


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], how: str = "left", rows: str = "rows") -> DataFrame:
    """``left.join(right, keys, how)`` where no key holds a task up. ``right`` has a row for each key, and in ``rows`` how many of
    ``left`` have it. Keys with over a thousandth of all, so a thousand at most, are dealt to parts by ``by``; so are null keys."""
    total = right.agg(F.sum(rows)).first()[0] or 0
    first = keys[0]
    hot = [r[0] for r in right.where(F.col(rows) > total / 1000.0).select(first).distinct().collect()] if total else []
    is_hot = F.col(first).isin(hot) if hot else F.lit(False)
    deal = F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")
    salted = left.withColumn("salt", F.when(F.col(first).isNull() | is_hot, deal).otherwise(0))
    parts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(right.drop(rows).withColumn("salt", F.explode(parts)), [*keys, "salt"], how).drop("salt")


#: Rows of rejected documents that may be broadcast (16 bytes each).
MOST_REJECTED = 100_000


def quoted(column: str, of: str) -> str:
    """The name of a column of the frame called ``of``, whatever letters it has."""
    return f"{of}.`{column.replace('`', '``')}`"


def without(docs: DataFrame, rejected: DataFrame, how: str = "left_anti") -> DataFrame:
    """``docs`` less the rows with the doc_id and text hash (th) of ``rejected``, or only those (``left_semi``). Null ids are compared as equal;
    columns of ``docs`` may have any names and types."""
    keys = stash(rejected.select("doc_id", "th").distinct(), "rejected")
    if keys.limit(MOST_REJECTED + 1).count() <= MOST_REJECTED:
        keys = F.broadcast(keys)
    same = F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.xxhash64("d.text") == F.col("r.th"))
    return docs.alias("d").join(keys.alias("r"), same, how)
