"""Tables laid out for their joins: bucketed and sorted by the join's key, so that the join moves no rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from dovetail.sources import shared

BUCKETS = 64


def bucketed(df: DataFrame, keys: list[str], buckets: int = BUCKETS, name: str | None = None, path: str | None = None) -> DataFrame:
    """``df`` as a table in ``buckets`` by ``keys``, sorted by them within each. Joins and groupings by these keys of tables with as many buckets need
    no exchange, as long as the table is read whole or by its keys.

    Without ``name`` it is a table of this application in the shared folder. Rows of one key are one bucket, so a key that may be in a large part
    of all rows is not for this layout.
    """
    spark = df.sparkSession
    table = name or f"laid_out_{uuid.uuid4().hex}"
    where = path or f"{shared.shared_dir(spark)}/{table}"
    # each bucket is written by one task, as one file
    df.repartition(buckets, *keys).write.format("parquet").option("path", where).bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite").saveAsTable(table)
    if name is None:
        jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.table(table)


def exchanges(df: DataFrame) -> int:
    """How many times the plan of ``df`` moves rows between tasks, as planned before it runs."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
